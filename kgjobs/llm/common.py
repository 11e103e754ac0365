"""Small things the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def lower_ascii_col(col: Column) -> Column:
    """Lower-case A-Z only, as a Spark expression."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session (tests) gets one of our own, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "kgjobs-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files as they end; the session's own setting comes back after them."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of the shared folder and read it back: lineage ends here, and lost executors cost nothing before it.

    Nothing reads the write's shuffle files after it, so Spark removes them as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that ``written`` gave as df. Call it only when all that is derived from it is written as well."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 300) -> None:
    """Bound what one Arrow batch holds, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 300, size: int = 8 << 20) -> Iterator[None]:
    """Bound what one Arrow batch holds for the jobs run inside; the session's own settings come back after them."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs(used..., _aside): all of a row goes into one struct, so that none of its names can clash with an operator's own."""
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_aside"))


def brought_back(df: DataFrame, docs: DataFrame, *outputs: str) -> DataFrame:
    """The columns of docs from _aside and the outputs; a column named like an output gives way to it."""
    return df.select(*[F.col("_aside").getField(c).alias(c) for c in docs.columns if c not in outputs], *outputs)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift), for arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def joined_by_share(rows: DataFrame, facts: DataFrame, key: str, hot: int, total: int | None = None) -> DataFrame:
    """rows joined to facts on key (not null): facts has a row for each key of rows, and in n_rows how many of them hold it.

    Keys with one ``hot``-th of all rows or more are ``hot`` at most, whatever the input's size: their facts are broadcast.
    So no key of what is shuffled to the other facts has more rows than that share. total: the number of rows, if known.
    """
    total = facts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"] if total is None else total
    facts = facts.withColumn("_hot", F.col("n_rows") * F.lit(hot) >= F.lit(total)).drop("n_rows")
    near, far = F.broadcast(facts.where("_hot").drop("_hot")), facts.where("not _hot").drop("_hot")
    return rows.join(near, key).unionByName(rows.join(near.select(key), key, "left_anti").join(far, key))


#: Nodes of many neighbours, and labels of many nodes, that a round of components broadcasts at most.
HOT_NODES = 10_000


def component_labels(edges: DataFrame, hot: int = HOT_NODES) -> DataFrame:
    """(id, label) for each end of edges(a, b): label is the smallest id that can be reached.

    Each round a node's label becomes the least of its own, its neighbours' and those that nodes of its own as label see
    (the smaller label is hooked to the larger one), then labels are followed one step (label of the label). So whole
    trees of labels merge, and rounds are about log n even where ids lie at random along a path. A label only falls, so
    rounds end by themselves, and where no node sees a smaller one all of a component have its smallest id. Every round
    is a few equi-joins that pre-aggregate; a node that a share of all edges leads to, and a label that a share of all
    nodes has, are broadcast (``joined_by_share``), so neither a star nor a component is one task's key. What a round
    reads twice is written to the shared folder. Null ends are dropped.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.count("*").alias("n_rows")), "cc-labels")
    degrees = labels.select(F.col("id").alias("b"), "n_rows")
    n_edges, n_nodes, labels = both.count(), labels.count(), labels.select("id", "label")
    while True:
        seen = labels.withColumnRenamed("id", "b").join(degrees, "b")
        near = joined_by_share(both, seen, "b", hot, n_edges).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low")), "cc-near")
        hook = step.where("low < label").groupBy(F.col("label").alias("id")).agg(F.min("low").alias("hook"))
        step = written(step.join(hook, "id", "left").select("id", "label", F.least("low", "hook").alias("low")), "cc-hooked")
        up = step.groupBy("low").agg(F.count("*").alias("n_rows")).join(labels.select(F.col("id").alias("low"), F.col("label").alias("jump")), "low")
        new = joined_by_share(step, up, "low", hot, n_nodes)
        new = written(new.select("id", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")), "cc-labels")
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels
