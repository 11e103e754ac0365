"""Quality rules with adaptive thresholds: cutoffs from mergeable quantile sketches per language and source.

``measured`` counts, in one Arrow pass over whole texts, what the rules need. Rules measure in whole numbers:

* ``word_length``: hundredths of a code point per word, ``symbols``: thousandths of the words' code points that are
  symbols, ``repeated_lines`` and ``repeated_words``: thousandths of the lines and of the words.

A sketch of a rule's values is its log-linear histogram: a value keeps its 7 leading binary digits (values below 128 are
exact, others too small by less than 1/64) and the counts of equal results are added up. So sketches merge by addition,
in any order and with the same result each time. Documents that pass the fixed rules are sketched by (language, source);
these sketches merge to those of languages and to one of all. A group of fewer than ``LEAST`` documents uses its
language's sketch, and where that has fewer as well, that of all.

A rule's cutoff lies 3 spreads beyond the upper quartile, for word lengths also below the lower one; the spread is that
of the quartiles, or the rule's least spread where they lie closer. Documents are joined to the cutoffs of their
(language, source), and one that goes beyond a cutoff isn't kept. The fixed rules: fewer than 50 words, or over half of
the words in three-word windows that occur twice.

Defined cases: null text is empty, has no words and fails the fixed rules; null languages and sources are groups of their
own; rows without an id, repeated rows and ties stay rows of their own; a missing lang or source column is null; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, arrow_batches, joined_by_share, written

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Documents that a sketch needs for cutoffs of its own.
LEAST = 100
#: Spreads beyond the quartiles.
FENCE = 3
#: Leading binary digits that a sketch keeps.
DIGITS = 7
#: Groups that are broadcast, at most.
HOT = 10_000
#: rule: (numerator, denominator, scale, least spread, whether small values fail too)
RULES = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbols": ("n_symbols", "word_chars", 1000, 10, False),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000, 150, False),
    "repeated_words": ("n_repeat_words", "n_words", 1000, 150, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[window] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), len(lines), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS..., base_failed), a written table."""
    held = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts_of(t or "") for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *map(pa.array, rows.T)], names=["doc_id", "lang", "source", *COUNTS])

    with arrow_batches(docs.sparkSession):
        read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.cast("string") for c in held])
        made = read.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        return written(made.withColumn("base_failed", failed), "measured")


def value(rule: str) -> Column:
    """A rule's whole number of a measured row; 0 where there is nothing to divide by."""
    a, b, scale, *_ = RULES[rule]
    return F.expr(f"{a} * {scale}L div greatest({b}, 1L)")


def sketched(v: Column) -> Column:
    """A value with its leading DIGITS binary digits only: the sketch's bucket."""
    return v - v % F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - DIGITS, F.lit(0))).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, level, rule, bucket, n): level 0 by language and source, 1 by language, 2 of all; partial counts meet in the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sketched(value(r)).alias("bucket")) for r in RULES]))
    own = rows.where("not base_failed").select("lang", "source", pairs.alias("x")).select("lang", "source", "x.rule", "x.bucket")
    own = written(own.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n")), "sketches")
    none = F.lit(None).cast("string").alias("source")
    languages = own.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    everything = own.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    level = lambda df, k: df.select("lang", "source", F.lit(k).alias("level"), "rule", "bucket", "n")
    return level(own, 0).unionByName(level(languages.withColumn("source", none), 1)).unionByName(level(everything.select(F.lit(None).cast("string").alias("lang"), none, "rule", "bucket", "n"), 2))


def quartiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, level, rule, docs, q1, q3): the least buckets with a quarter and three quarters of the counts at or below them.

    A sketch is bounded (64 buckets for each binary order of magnitude), so each is one sorted array in one row.
    """
    rows = sketch.groupBy("lang", "source", "level", "rule").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("held"))
    reach = lambda part: F.expr(f"aggregate(held, struct(0L as seen, cast(null as bigint) as at), (s, x) -> struct(s.seen + x.n as seen, if(s.at is null and 4 * (s.seen + x.n) >= {part} * docs, x.bucket, s.at) as at), s -> s.at)")
    return rows.select("lang", "source", "level", "rule", "docs", reach(1).alias("q1"), reach(3).alias("q3"))


def cutoffs(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(group, n_rows, level, docs, low_<rule>, high_<rule>...) for each (lang, source) of measured rows, a written table."""
    q = quartiles(sketches(rows))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(F.create_map(*[F.lit(x) for r, (*_, s, _) in RULES.items() for x in (r, s)]), F.col("rule")))
    q = q.groupBy("lang", "source", "level").pivot("rule", list(RULES)).agg(F.first("docs").alias("docs"), F.first(F.col("q1") - FENCE * spread).alias("low"), F.first(F.col("q3") + FENCE * spread).alias("high"))
    first = next(iter(RULES))
    made = F.struct("level", F.col(f"{first}_docs").alias("docs"), *[F.col(f"{r}_{end}").alias(f"{end}_{r}") for r in RULES for end in ("low", "high")])
    q = written(q.select("lang", "source", "level", made.alias("own")), "cutoffs")
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))
    at = lambda k, *keys: q.where(f"level = {k}").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("own").alias(f"at{k}"))
    same = lambda *keys: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    groups = groups.join(at(0, "lang", "source"), same("lang", "source"), "left").drop("_lang", "_source").join(at(1, "lang"), same("lang"), "left").drop("_lang")
    groups = groups.join(F.broadcast(at(2)), F.lit(True), "left")  # one row: the sketch of all
    enough = [F.when(F.col(f"at{k}.docs") >= least, F.col(f"at{k}")) for k in (0, 1)]
    return written(groups.select(group().alias("group"), "n_rows", F.coalesce(*enough, "at2").alias("own")).select("group", "n_rows", "own.*"), "cutoffs-of-groups")


def group() -> Column:
    """A key of (lang, source) that is never null."""
    return F.to_json(F.struct("lang", "source"))


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, failed, kept): failed names the rules whose cutoffs a document goes beyond."""
    rows = measured(docs)
    rows_by = joined_by_share(rows.withColumn("group", group()), cutoffs(rows, least), "group", HOT)
    beyond = [F.when((value(r) > F.col(f"high_{r}")) | ((value(r) < F.col(f"low_{r}")) if RULES[r][-1] else F.lit(False)), F.lit(r)) for r in RULES]
    out = rows_by.withColumn("failed", F.array_compact(F.array(*beyond)))
    return out.select("doc_id", *COUNTS, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
