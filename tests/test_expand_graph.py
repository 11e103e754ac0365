import datetime
import random

from kgjobs import queries


def nearest(seeds, edges, depth, most):
    """Breadth-first search from each seed, a level at a time, ids in order."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for q, start in seeds:
        level, seen = [start], {start}
        out.append((q, start, 0))
        found = []
        for d in range(1, depth + 1):
            level = sorted({n for x in level for n in near.get(x, ())} - seen)
            seen.update(level)
            found += [(q, n, d) for n in level]
        out += found[:most]
    return sorted(out)


def test_expand_graph_takes_every_source(spark, tmp_path):
    r = random.Random(2)
    day = datetime.date(2020, 1, 1)
    lines = [(r.randint(1, 90), r.choice([7, 900, *range(100, 130)]), day, r.choice("NNNR")) for _ in range(500)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_shipdate date, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    returned = {(a, b) for a, b, _, flag in lines if flag == "R"}
    opened = {(a, b) for a, b, _, _ in lines} - returned
    seeds = sorted({(a, a) for a, _, _, _ in lines})
    want = nearest(seeds, opened, 2, 30)
    got = sorted((x.query, x.id, x.depth) for x in queries.QUERIES["expand_graph"](spark, str(tmp_path)).collect())
    assert got == want and len(seeds) > 50 and max(sum(q == x[0] for x in want) for q, _ in seeds) == 31


def test_lists_are_looked_into_as_far_as_queries_need(spark):
    from pyspark.sql import functions as F

    from kgjobs.operators import retrieval

    from .test_growth import most_rows

    r = random.Random(4)
    # leaves of ten hubs of up to 300 leaves each: two steps away there are far more than any query takes
    edges = sorted({(1000 + leaf, r.choice(range(10))) for leaf in range(900) for _ in range(3)})
    edges += [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 6000)]
    df = spark.createDataFrame(edges, "src long, dst long").withColumn("valid_until", F.lit(None).cast("date"))
    seeds = df.select(F.col("src").alias("query"), F.col("src").alias("id")).distinct()
    got = retrieval.expand_graph(seeds, df, most=8)
    want = nearest(sorted({(a, a) for a, _ in edges}), edges, 2, 8)
    assert sorted((x.query, x.id, x.depth) for x in got.collect()) == want
    assert most_rows(got) < 10_000  # all that hubs lead to were 41,832 rows in one plan before; now lists are written and looked into
    two = spark.createDataFrame([("q", 1000), ("q", 1001), ("p", 5000)], "query string, id long")
    flat = {(x.query, x.id): x.depth for x in retrieval.expand_graph(two, df, depth=3, most=40).collect()}
    assert sum(q == "q" for q, _ in flat) == 42 and {k: v for k, v in flat.items() if k[0] == "p"} == {("p", 5000): 0, ("p", 5001): 1, ("p", 5002): 1}
