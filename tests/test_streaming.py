"""Streams over several micro-batches give the rows of the batch jobs."""

import random

from pyspark.sql import functions as F

from kgjobs import streaming
from kgjobs.operators import feedback, retrieval


def files(spark, tmp_path, df, n):
    for k in range(n):
        df.where(F.pmod(F.hash("seq"), F.lit(n)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_sliding(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(6), n, r.random() < 0.6, r.choice(["a", "a", "a", "a", "b", None])) for n in range(400)]
    df = spark.createDataFrame(rows, "rule_id long, seq long, passed boolean, hash string")
    got = streaming.settle(streaming.sliding_confidence(files(spark, tmp_path, df, 3)), ["rule_id"])

    def brute(rule):
        known, run = None, []
        for _, _, ok, h in sorted((x for x in rows if x[0] == rule), key=lambda x: x[1]):
            if h is not None:
                run, known = ([] if known not in (None, h) else run), h
            run.append(ok)
        return 0.3 + 0.7 * sum(run[-20:]) / len(run[-20:])

    assert {x.rule_id: round(x.multiplier, 9) for x in got.collect()} == {k: round(brute(k), 9) for k in range(6)}


def test_counters_count_an_event_once(spark, tmp_path):
    rows = [(n % 50, n % 3, n, "user", n % 2 == 0, "2024-01-01 00:00:00") for n in range(50)] * 2
    df = spark.createDataFrame(rows, "event_id long, rule_id long, seq long, kind string, positive boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.settle(streaming.feedback_counters(files(spark, tmp_path, df, 2)), ["rule_id"])
    want = feedback.feedback_stats(df)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_mmr_fixture(spark):
    rows = [(1, 1, "r1", 1.0, [1.0, 0.0, 0.0]), (1, 2, "r2", 0.6, [1.0, 0.0, 0.0]), (1, 3, "r3", 0.55, [0.0, 1.0, 0.0]), (2, 1, "x", 1.0, None)]
    ranked = spark.createDataFrame(rows, "query long, rank int, id string, score double, embedding array<double>")
    got = sorted(map(tuple, retrieval.mmr_rerank(ranked).collect()))
    assert got == [(1, 1, "r1"), (1, 2, "r3"), (1, 3, "r2"), (2, 1, "x")]


def test_an_event_sixty_days_late_counts_once(spark, tmp_path):
    rows = [(n, n % 3, n, "user", True, "2024-04-01 00:00:00") for n in range(20)] + [(100, 1, 21, "user", True, "2024-02-01 00:00:00"), (5, 2, 22, "user", True, "2024-04-01 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, rule_id long, seq long, kind string, positive boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((df.where("seq < 20"), df.where("seq >= 20"), df.where("seq >= 20"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with streaming.keep_state_on_disk(spark):
        got = {r.rule_id: r.usage_count for r in streaming.settle(streaming.feedback_counters(read), ["rule_id"]).collect()}
    assert got == {0: 7, 1: 8, 2: 6}
