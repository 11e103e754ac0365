"""Document fingerprints [native]: consistent weighted sampling with Spark expressions only.

A text is a weighted set: each distinct lower-cased word weighs the code points it covers (its count times its
length). For each of ``samples`` hash seeds and each word of weight S, gamma-distributed r, c and a uniform b are drawn
from the hash of (word, seed):

    t = floor(ln S / r + b),    ln a = ln c - r (t - b) - r

and the word of least a wins; (word, t) is the sample. Two texts agree in a sample with a probability equal to their
generalised Jaccard similarity, sum of min weights / sum of max weights. A fingerprint is the list of its samples, six
hex digits each; likeness is the share of places where two fingerprints agree.

Defined cases: null text is empty; a text without words has the empty fingerprint, which is like only another empty
one (1.0); equal texts have equal fingerprints; rows with the same doc_id stay apart (ordered by text); null doc_id
sorts as the lowest; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii_col, shuffles

SAMPLES = 32
#: Seeds that one generated row covers; SAMPLES is a multiple.
WIDTH = 4
#: Square roots in a logarithm: those of the JVM cost most of the run, roots next to nothing.
ROOTS = 4
#: Buckets of doc_id ranges; their bounds and heads are the only values that reach the driver.
MOST_BUCKETS = 1000


def _root(u: Column) -> Column:
    for _ in range(ROOTS):
        u = F.sqrt(u)
    return u


def _log_of_root(x: Column) -> Column:
    """ln u from x = u ** (1 / 2**ROOTS): sinh(ln x) is ln x but for a share of (ln x)**2 / 6."""
    return (x - F.lit(1.0) / x) * F.lit(2.0 ** (ROOTS - 1))


def _draw(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, group, m0..): per key and group of WIDTH seeds the winners' 24-bit marks.

    One hash gives b (16 bits), r and c (two 12-bit uniforms each: a gamma variable of shape 2 is -ln(u v)). Every step
    is a projection of its own, so that no draw is computed twice and generated methods stay small enough to compile.
    """
    js = range(WIDTH)
    u = lambda h, at: F.shiftright(h, at).bitwiseAND(F.lit(0xFFF)) * F.lit(2.0**-12) + F.lit(2.0**-13)
    keep = [*keys, "group", "wh", "ln_s"]
    h = terms.select(*keep, *[F.xxhash64("wh", "group", F.lit(j)).alias(f"h{j}") for j in js])
    x = h.select(*keep, *[_root(u(f"h{j}", 0) * u(f"h{j}", 12)).alias(f"x{j}") for j in js], *[_root(u(f"h{j}", 24) * u(f"h{j}", 36)).alias(f"y{j}") for j in js], *[(F.shiftrightunsigned(f"h{j}", 48) * F.lit(2.0**-16)).alias(f"b{j}") for j in js])
    r = x.select(*keep, *[(-_log_of_root(F.col(f"x{j}"))).alias(f"r{j}") for j in js], *[_root(-_log_of_root(F.col(f"y{j}"))).alias(f"z{j}") for j in js], *[f"b{j}" for j in js])
    t = r.select(*keep, *[F.floor(F.col("ln_s") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}") for j in js], *[x for j in js for x in (f"r{j}", f"z{j}", f"b{j}")])

    def packed(j: int) -> Column:
        r, t = F.col(f"r{j}"), F.col(f"t{j}")
        ln_a = _log_of_root(F.col(f"z{j}")) - r * (t - F.col(f"b{j}")) - r
        mark = F.col("wh").bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit(0xFFFFFF))
        return F.floor((ln_a + F.lit(1024.0)) * F.lit(2.0**28)) * F.lit(1 << 24) + mark

    least = t.groupBy(*keys, "group").agg(*[F.min(packed(j)).alias(f"s{j}") for j in js])
    return least.select(*keys, "group", *[F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFF)).alias(f"m{j}") for j in js])


def sign(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(*keys, fingerprint) for texts(*keys, text); keys name a row. Rows without words are left out.

    If texts is hash-partitioned by some of the keys, nothing is shuffled: words are counted and the samples' minima
    taken where the rows are.
    """
    words = texts.select(*keys, F.explode(F.split(lower_ascii_col("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    words = words.select(*keys, F.xxhash64("word").alias("wh"), F.length("word").alias("size"))
    terms = words.groupBy(*keys, "wh", "size").agg(F.count("*").alias("n"))
    groups = F.array(*[F.lit(g) for g in range(samples // WIDTH)])
    terms = terms.select(*keys, F.explode(groups).alias("group"), "wh", F.log(F.col("n") * F.col("size")).alias("ln_s"))
    marks = F.concat(*[F.lpad(F.lower(F.hex(f"m{j}")), 6, "0") for j in range(WIDTH)])
    parts = _draw(terms, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("group", marks.alias("marks")))).alias("parts"))
    return parts.select(*keys, F.array_join(F.col("parts.marks"), "").alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of agreeing samples of two fingerprints; two empty ones are alike, an empty and another are not."""
    same = [F.when(F.substring(a, 6 * j + 1, 6) == F.substring(b, 6 * j + 1, 6), 1).otherwise(0) for j in range(samples)]
    hits = same[0]
    for x in same[1:]:
        hits = hits + x
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(hits / F.lit(float(samples)))


def beside_next(documents: DataFrame) -> DataFrame:
    """Each document with its neighbour: (bucket, pos, doc_id, text, next_text, extra), in descending doc_id, the last beside the first.

    Documents are dealt to ranges of doc_id; only the ranges' bounds and first ids (MOST_BUCKETS at most) reach the
    driver. The first row of the range below is added to each range as an extra row, so that a window within the
    range finds every neighbour: one shuffle, no global order.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(MOST_BUCKETS, 64 * shuffles(spark))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("doc_id"))) if cuts else F.lit(0)
    # the lowest id is never beyond a cut, so rows without an id lie in its range, after it
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket))
    heads = sorted((r.bucket, r.top) for r in docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    heads = [(b, top) for b, top in heads if top is not None]
    if heads:
        heads_map = F.create_map(*[F.lit(v) for (_, top), (above, _) in zip(heads, [*heads[1:], heads[0]], strict=True) for v in (top, above)])
        extra = docs.where(F.col("doc_id").isin([top for _, top in heads])).withColumn("bucket", F.element_at(heads_map, F.col("doc_id")))
        rows = docs.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    else:
        rows = docs.withColumn("extra", F.lit(False))
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.repartition(4 * shuffles(spark), "bucket")
    return rows.select("bucket", F.row_number().over(order).alias("pos"), "doc_id", "text", F.coalesce(F.lead("text").over(order), F.first("text").over(order)).alias("next_text"), "extra")


def fingerprint_edits(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how near it is to that and to the next document.

    The edited text has the last third (floor) of the code points replaced by the first as many of the next document.
    """
    rows = beside_next(documents)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("bucket", "pos", "doc_id", "extra", "text", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    # a third kind of row carries what is not signed, so that no join has to bring it back
    meta = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("extra").cast("string"), n.cast("string"), F.sha2("edited", 256))
    row = lambda kind, text, meta: F.struct(F.lit(kind).alias("kind"), text.alias("text"), meta.cast("string").alias("meta"))
    kinds = F.array(row(0, F.col("text"), F.lit(None)), row(1, F.when(~F.col("extra"), F.col("edited")), F.lit(None)), row(2, F.lit("-"), meta))
    kinds = rows.select("bucket", "pos", F.explode(kinds).alias("x")).select("bucket", "pos", "x.kind", "x.text", "x.meta")
    signed = sign(kinds, ["bucket", "pos", "kind", "meta"], samples).groupBy("bucket", "pos").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.coalesce("meta", "fingerprint")))).alias("of"))
    of = lambda kind: F.coalesce(F.try_element_at("of", F.lit(kind)), F.lit(""))
    parts = F.split(of(2), r"\|")
    out = signed.select(
        "bucket", "pos", F.nullif(parts[0], F.lit("")).cast("long").alias("doc_id"), parts[1].cast("boolean").alias("extra"), parts[2].cast("long").alias("n_chars"), parts[3].alias("edited_sha256"), of(0).alias("fingerprint"), of(1).alias("edited_fingerprint")
    )
    order = Window.partitionBy("bucket").orderBy("pos")
    out = out.withColumn("next_fingerprint", F.coalesce(F.lead("fingerprint").over(order), F.first("fingerprint").over(order))).where(~F.col("extra"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
