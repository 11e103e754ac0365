"""The append-only logs as streams. Each function takes a streaming DataFrame and starts or describes one query."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import counters
from ..operators.rules import incremental_status
from ..sources import scratch


#: Spark's setting and value for state on disk, with only changes written at a checkpoint.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keep_state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    name, value = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def feedback_counters(events: DataFrame, within: str | None = None) -> DataFrame:
    """Running counters per rule; an event id counts once, however late it comes or comes again.

    Each id's state is one key, spread by id; it belongs in the RocksDB store (``keep_state_on_disk``), where it takes disk
    and not memory. ``within`` bounds the state to ids of that time, and with it what counts: later rows are dropped.
    """
    once = events.dropDuplicates(["event_id"]) if within is None else events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("rule_id").agg(*counters())


def sliding_confidence(outcomes: DataFrame, keep: int = 20) -> DataFrame:
    """outcomes(rule_id, seq, passed, hash): 0.3 + 0.7 pass rate of the last outcomes since the hash last changed.

    The state of a rule is its newest ``keep`` rows and the last hash before them, so late rows find their place and
    frames of a hot rule are folded in one by one.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, older = json.loads(state.get[0]) if state.exists else ([], None)
        for f in frames:
            named = f[f["hash"].notna()]
            new = f.nlargest(keep, "seq")
            rest = named[~named["seq"].isin(new["seq"])].nlargest(1, "seq")
            fresh = [[int(s), bool(p), None if pd.isna(h) else h] for s, p, h in zip(new["seq"], new["passed"], new["hash"], strict=True)]
            rows = sorted(rows + fresh, key=lambda r: r[0])
            gone, rows = rows[:-keep], rows[-keep:]
            before = [[r[0], r[2]] for r in gone if r[2] is not None] + [[int(s), h] for s, h in zip(rest["seq"], rest["hash"], strict=True)] + ([older] if older else [])
            older = max(before, key=lambda r: r[0], default=None)
        state.update((json.dumps([rows, older]),))
        known, run = older[1] if older else None, []
        for _, passed, mark in rows:
            if mark is not None:
                run, known = ([] if known is not None and mark != known else run), mark
            run.append(passed)
        yield pd.DataFrame({"rule_id": [key[0]], "multiplier": [0.3 + 0.7 * sum(run) / len(run)]})

    kind = outcomes.schema["rule_id"].dataType.simpleString()
    return outcomes.groupBy("rule_id").applyInPandasWithState(fold, f"rule_id {kind}, multiplier double", "rows string", "update", GroupStateTimeout.NoTimeout)


def settle(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over all there is now and return the last row of each key.

    A batch is written under its number, so one that is run again replaces itself.
    """
    spark = updates.sparkSession
    base = scratch(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = updates.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rest = [c for c in updates.columns if c not in keys]
    rows = spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{base}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def incremental_ingest(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """items(id, hash) as a stream against a manifest(id, hash) that grows with it: (id, status) of every item seen.

    The manifest is a log: a batch appends only what is new or changed, under its number, and reads the batches before it.
    """
    spark = items.sparkSession
    base = scratch(spark, "ingest")
    manifest.select("id", "hash").write.parquet(f"{base}/log/batch=-1")
    kind = manifest.select("id", "hash").schema.add("batch", "long")

    def merge(batch: DataFrame, n: int) -> None:
        log = spark.read.schema(kind).parquet(f"{base}/log").where(F.col("batch") < n)
        known = log.join(batch.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max_by("hash", "batch").alias("hash"))
        incremental_status(batch, known).write.mode("overwrite").parquet(f"{base}/out/batch={n}")
        status = spark.read.parquet(f"{base}/out/batch={n}").where("status <> 'unchanged'")
        batch.join(status, "id", "left_semi").select("id", "hash").write.mode("overwrite").parquet(f"{base}/log/batch={n}")

    q = items.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "status")
