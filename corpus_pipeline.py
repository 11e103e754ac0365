"""A training corpus from raw documents: five stages, each a Spark job over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and other columns that docs has, whatever their names. A
null doc_id, null, empty or very long texts, repeated rows and empty tables are held as each stage's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgjobs.llm import leaks, neardup, pieces, quality, suffixes
from kgjobs.llm.common import shared_dir, table

#: Repeated passages of at least so many bytes are cut to their first copy; over 50 words of this corpus's shortest kind.
PASSAGE_BYTES = 200

#: SQL can express none of the first four stages' decisions as a whole; tests hold run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts and the one of toxicity doesn't reject; empty texts are scored like others."""
    labels = table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels)
    return quality.accepted(docs, model, quality.learn_toxic(docs, labels, model[0]))


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, aside): the row but for its text in one struct, so that no column's name can clash with an operator's.

    A row without an id gets one from its text, beyond those that tables number their rows with, so that its copies
    find each other and a copy with an id comes first.
    """
    own = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("aside"))


def _rows(named: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return named.select(*[F.col("text") if c == "text" else F.col("aside").getField(c).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, 0.8); of rows equal in both the first by its other columns stays."""
    named = _named(docs)
    kept = neardup.near_components(named.select("doc_id", "text"), 5, 80).where("kept").select("doc_id").distinct()
    first = F.min_by("aside", F.to_json("aside")).alias("aside")
    return _rows(named.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(first), docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated passages; documents that are such a copy as a whole go. A null text becomes empty."""
    cut = suffixes.cut_repeats(_named(docs), keep_first=True, least=PASSAGE_BYTES).where("n_removed = 0 or n_removed < n_bytes")
    text = F.when(F.col("n_removed") == 0, F.decode("kept", "UTF-8")).otherwise(_whole_characters(F.col("kept")))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*[new[c].alias(c) if c in new else F.col("aside").getField(c).alias(c) for c in docs.columns])


def _whole_characters(raw: Column) -> Column:
    """Bytes as text, less the broken characters that a cut may leave."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", "")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. A row is known by its id and text, so another row of the same id stays if it is clean."""
    named = _named(docs).withColumn("doc_id", F.xxhash64("doc_id", "text"))
    found = leaks.find_leaks(named, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _rows(named.join(found, "doc_id", "left_anti"), docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, checked by decoding them."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("suffix-array deduplication", suffix_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
