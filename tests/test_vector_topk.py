import numpy as np

from kgjobs.operators import retrieval


def test_vector_topk_with_more_copies_than_k(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(3, 17))
    kinds = r.integers(0, 3, 1500)
    ids = r.permutation(5000)[:1500]
    rows = [(f"p{c % 400}", int(c), (base[n] * s).tolist()) for c, n, s in zip(ids, kinds, r.choice([1.0, 1.0, 2.0], 1500), strict=True)]
    rows += [("far", 6000, (-base[0]).tolist()), ("zero", 6001, [0.0] * 17), ("near", 6002, (base[0] + 0.01).tolist())]
    asked = [(k, v.tolist()) for k, v in enumerate(base)]
    want = set()
    for q, v in asked:
        unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
        scored = sorted((-round(float(unit(e) @ unit(v)), 9), c, p) for p, c, e in rows)
        want |= {(q, p) for s, c, p in scored[:20] if -s > 0.5}
    chunks = spark.createDataFrame(rows, "parent string, chunk long, embedding array<double>")
    queries_ = spark.createDataFrame(asked, "query long, embedding array<double>")
    for parts in (1, 3):
        got = {(x.query, x.parent) for x in retrieval.vector_topk(chunks.repartition(parts), queries_, k=20).collect()}
        assert got == want


def test_vector_fallback_scores_every_parent(spark):
    """Without a ranking no parent is left out, also beyond the 500 first of a ranking; odd vectors match nothing."""
    r = np.random.default_rng(5)
    rows = [(f"p{k % 700}", r.normal(size=6).tolist()) for k in range(1500)]
    odd = [("none", None), ("empty", []), ("short", [1.0, 2.0]), ("zero", [0.0] * 6)]
    asked = [(k, r.normal(size=6).tolist()) for k in range(40)] + [(40, [1.0, 2.0]), (41, None), (42, [0.0] * 6), (0, rows[0][1])]
    want = {}
    for q, v in asked:
        for p, e in rows + odd:
            if v and e and len(v) == len(e) and any(v) and any(e):
                score = float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e))
                if score > 0.4:
                    want[q, p] = max(score, want.get((q, p), 0))
    chunks = spark.createDataFrame(rows + odd, "parent string, embedding array<double>")
    got = retrieval.vector_fallback(None, chunks.repartition(3), spark.createDataFrame(asked, "query long, embedding array<double>"), above=0.4).collect()
    assert {(x.query, x.id): round(x.score, 9) for x in got} == {k: round(s, 9) for k, s in want.items()} and len(got) == len(want)
    assert len({x.id for x in got}) > 600 and (40, "short") in want


def test_vector_fallback_query_takes_all_parents(spark):
    """The registered query equals a direct search of all pairs on the driver's table."""
    from __spark_entry__ import queries

    d = "/root/testdata/sf0.001"
    e = [(x.vec_id, f"git:src{x.label}:{x.vec_id % 50}", np.array(x.embedding, float)) for x in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = {}
    for q, _, v in (x for x in e if x[0] % 20 == 0):
        for _, p, x in e:
            score = float(v @ x / np.linalg.norm(v) / np.linalg.norm(x))
            if score > 0.3:
                want[q, p] = max(score, want.get((q, p), 0))
    got = {(x.query, x.id): x.score for x in queries()["vector_fallback"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - s) < 1e-6 for k, s in want.items())
