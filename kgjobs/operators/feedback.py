"""Feedback logs to confidence weights."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ["tdk_pass", "tdk_fail", "user_pos", "user_neg", "comp", "non_comp"]
#: Bounds of the additive confidence in tenths.
ADDITIVE = 1, 20


def feedback_stats(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Six counters, usage count and last event per rule (and user); an event id counts once."""
    by = by or ["rule_id"]
    return events.dropDuplicates(["event_id"]).groupBy(*by).agg(*counters())


def counters() -> list[Column]:
    of = lambda kind, ok: F.count_if((F.col("kind") == kind) & (F.col("positive") if ok else ~F.col("positive")))
    aggs = [of(k, ok).alias(c) for c, (k, ok) in zip(COUNTERS, [(k, ok) for k in ("tdk", "user", "compliance") for ok in (True, False)], strict=True)]
    return [*aggs, F.count("*").alias("usage_count"), F.max("ts").alias("last_feedback_at")]


def confidence_multiplier() -> Column:
    """1.0 under three samples, else weighted rates of the three sources in [0.3, 1.3]."""
    c = {x: F.col(x).cast("double") for x in COUNTERS}
    part = lambda ok, no: F.when(ok + no == 0, 1.0).otherwise(0.3 + ok / (ok + no))
    raw = 0.5 * part(c["tdk_pass"], c["tdk_fail"]) + 0.3 * part(c["user_pos"], c["user_neg"]) + 0.2 * part(c["comp"], c["non_comp"])
    total = sum((c[x] for x in COUNTERS[1:]), c[COUNTERS[0]])
    return F.when(total < 3, 1.0).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(1.3), raw)))


def decayed_multiplier(now: str, half_life_days: float = 90) -> Column:
    """1 + (raw - 1) 2 ** (-age / half life); raw without feedback or half-life."""
    raw = confidence_multiplier()
    if half_life_days <= 0:
        return raw
    age = F.greatest((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_feedback_at").cast("timestamp"))) / F.lit(86_400e6), F.lit(0.0))
    return F.coalesce(1 + (raw - 1) * F.pow(F.lit(2.0), -age / half_life_days), raw)


def recalculate_all(stats: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """New multipliers and whether they rose, fell or stayed (within 0.001) against previous(rule_id, multiplier)."""
    new = stats.select("rule_id", decayed_multiplier(now).alias("multiplier"))
    delta = F.col("multiplier") - F.coalesce("before", F.lit(1.0))
    return new.join(previous.withColumnRenamed("multiplier", "before"), "rule_id", "left").select("rule_id", "multiplier", F.when(F.abs(delta) < 0.001, "unchanged").when(delta > 0, "boosted").otherwise("degraded").alias("change"))


def user_multipliers(events: DataFrame, now: str) -> DataFrame:
    """Per (user, rule): 0.6 user + 0.4 global from three samples on, else global."""
    user = feedback_stats(events, ["user_id", "rule_id"]).select("user_id", "rule_id", confidence_multiplier().alias("own"), F.col("usage_count").alias("n"))
    world = feedback_stats(events).select("rule_id", decayed_multiplier(now).alias("world"))
    w = F.coalesce("world", F.lit(1.0))
    return user.join(world, "rule_id", "left").select("user_id", "rule_id", F.when(F.col("n") >= 3, 0.6 * F.col("own") + 0.4 * w).otherwise(w).alias("multiplier"))


def propagate_feedback(signals: DataFrame, seen: DataFrame) -> DataFrame:
    """One event per signal and rule ever seen in its conversation."""
    return signals.join(seen.select("conversation", "rule_id").distinct(), "conversation").select("conversation", "rule_id", (F.col("signal") == "Positive").alias("positive"))


def sliding_confidence(outcomes: DataFrame, keep: int = 20) -> DataFrame:
    """0.3 + 0.7 pass rate of the last outcomes since the validator hash last changed; outcomes(rule_id, seq, passed, hash)."""
    w = Window.partitionBy("rule_id").orderBy("seq")
    before = F.last("hash", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = outcomes.withColumn("reset", F.coalesce((F.col("hash") != before).cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("reset").over(w))
    last = Window.partitionBy("rule_id").orderBy(F.col("segment").desc(), F.col("seq").desc())
    rows = rows.withColumns({"n": F.row_number().over(last), "top": F.first("segment").over(last)})
    return rows.where((F.col("segment") == F.col("top")) & (F.col("n") <= keep)).groupBy("rule_id").agg((0.3 + 0.7 * F.avg(F.col("passed").cast("double"))).alias("multiplier"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rule_id, seq, passed) to one x -> min(high, max(low, x + move)) for each run of a rule, in tenths, with its first seq and passed."""
    names = ["rule_id", "seq", "passed", "low", "high", "move"]
    schema, last = None, None
    for b in batches:
        done = []
        for rule, seq, passed in zip(*(b.column(c).to_pylist() for c in names[:3]), strict=True):
            if last is None or last[0] != rule:
                done += [last] if last else []
                last = [rule, seq, passed, ADDITIVE[0], ADDITIVE[1], 0]
            d = 1 if passed else -2
            last[3:] = min(ADDITIVE[1], max(ADDITIVE[0], last[3] + d)), min(ADDITIVE[1], max(ADDITIVE[0], last[4] + d)), last[5] + d
        schema = pa.schema([*(b.schema.field(c) for c in names[:3]), *(pa.field(c, pa.int64()) for c in names[3:])])
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema=schema)
    if last:
        yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], schema=schema)


def additive_confidence(outcomes: DataFrame) -> DataFrame:
    """Fold of +0.1 (at most 2.0) and -0.2 (at least 0.1) from 1.0, in order of seq.

    Steps compose into one bounded move, so ranges of (rule, seq) are folded apart, a row at a time, and a rule's last
    fold is over one row for each range it lies in. Sums are of whole tenths.
    """
    kind = {f.name: f.dataType.simpleString() for f in outcomes.schema}
    order = ["rule_id", "seq", "passed"]
    ranges = outcomes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranges.mapInArrow(_steps, f"rule_id {kind['rule_id']}, seq {kind['seq']}, passed {kind['passed']}, low long, high long, move long")
    apply = lambda acc, x: F.least(x["high"], F.greatest(x["low"], acc + x["move"]))
    folded = F.aggregate(F.sort_array(F.collect_list(F.struct("seq", "passed", "low", "high", "move"))), F.lit(10).cast("long"), apply)
    return parts.groupBy("rule_id").agg((folded / F.lit(10.0)).alias("multiplier"))


def low_confidence(multipliers: DataFrame, below: float = 0.7) -> DataFrame:
    return multipliers.where(F.col("multiplier") < below).select("rule_id", F.round("multiplier", 2).alias("multiplier"))


def stale_rules(stats: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Rules whose last feedback is more than so many whole days old, with its age."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_feedback_at").cast("timestamp"))) / F.lit(86_400e6)).cast("long")
    return stats.select("rule_id", age.alias("age_days")).where(F.col("age_days") > days)


def rating_events(ratings: DataFrame) -> DataFrame:
    """ratings(rule_id, rating): helpful is positive, not_helpful and outdated are negative, others are left out as rejected."""
    return ratings.where("rating in ('helpful', 'not_helpful', 'outdated')").select("rule_id", F.lit("user").alias("kind"), (F.col("rating") == "helpful").alias("positive"))
