"""Work that must not grow with the square of a group: the most rows that a part of a plan makes, and whole results."""

from pyspark.sql import functions as F

from kgjobs.operators import context


def most_rows(df):
    """The most rows that one node of df's plan has made; df is run."""
    df.write.format("noop").mode("overwrite").save()
    got = df.select("*")
    got.collect()
    todo, most = [got._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            most = max(most, made.get().value())
    return most


def test_world_knowledge_joins_a_concepts_first_rows(spark):
    q = spark.range(300).select(F.col("id").alias("query"), F.array(F.concat(F.lit("SRC"), F.col("id") % 3), F.lit("none")).alias("concepts"))
    world = spark.range(2000).select(F.format_string("w%04d", "id").alias("id"), F.concat(F.lit("src"), F.col("id") % 30).alias("domain"), F.array(F.lit("x"), F.lit(None).cast("string")).alias("tags"))
    df = context.fetch_world_knowledge(q, world)
    want = {(k, f"w{i:04d}") for k in range(300) for i in [i for i in range(2000) if f"src{k % 3}" in f"src{i % 30}"][:10]}
    assert {(x.query, x.id) for x in df.collect()} == want
    assert most_rows(df) <= 20_000  # one join made 153,100 rows before
