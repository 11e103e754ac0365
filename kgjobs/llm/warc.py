"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record per page; equal payloads of at least ``least`` bytes are stored once (the smallest page_id's
record is the response, the others revisit it). The archives are plain ``text`` output whose line separator is the
blank line between records, so writing is distributed and committed as any Spark write.

Reading: archives are read by the text source with the record magic as line separator, so a large file is split among
tasks and no file is held whole. A magic may also stand inside a payload, hence every fragment is only a candidate:

1. tasks emit each candidate's offset and that of its successor (its own offset + header + Content-Length + 4);
2. pointer jumping from offset 0 of each file keeps what is reachable: with J the successor table and R = {0}, each
   round takes R := R + J(R) and J := J(J), so a chain of n records takes log2 n rounds of equi-joins;
3. fragments that are not reachable are payload of the reachable record before them; such records are put together
   again from their fragments (a second scan, only if there are any). Only these records and fragments are ordered, each
   split of a file by itself, with the last record before it carried in; so no archive is one task.

Defined cases: null html or url is empty; an empty table gives empty archives and an empty result; repeated page_ids
stay; a null page_id is written as an empty id and read back as null (and is never what others refer to); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffles_removed, small_batches, written

MAGIC = "WARC/1.1\r\n"
LEAST = 100
#: Payloads are written in so many parts, one after the other.
PARTS = 4
_HEADER = re.compile(rb"((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")
_FIELD = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write pages(page_id, url, html) to WARC files under path. One shuffle of the payloads, by their digest.

    The payloads go in ``PARTS`` parts by their hash, so that only a part of them lies in shuffle files beside the archives.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.pmod(F.xxhash64(html), F.lit(PARTS)).alias("part"))
    rows = pages.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    known = pages.where(f"octet_length(html) >= {least}")
    firsts = known.groupBy("part", F.sha2("html", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("part", "digest", "first")
    firsts = written(firsts, "warc-firsts")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uri(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), uri(F.col("first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("size").cast("string"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string")), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value")
    with shuffles_removed(pages.sparkSession):
        for part in range(PARTS):
            some = rows.where(F.col("part") == part).join(firsts.where(F.col("part") == part).drop("part"), "digest", "left")
            some.select(record).write.mode("append" if part else "errorifexists").option("lineSep", "\r\n\r\n").text(path)


def _page(uri: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", uri or b"")
    return int(m[1]) if m else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset within the block, fragment) of a task's rows, which come in file order."""
    at, rel = None, 0
    for b in batches:
        texts = b.column("value").cast(pa.binary())
        for f, k, t in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), texts, strict=True):
            if at != (f, k):
                at, rel = (f, k), 0
            yield f, k, rel, (raw := t.as_py())
            rel += len(raw) + len(MAGIC)


FRAGMENT = "file string, block long, rel long, size long, record boolean, whole boolean, succ long, type string, page_id long, refers_to long, n_bytes long, digest string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FRAGMENT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema, out = pa.schema(list(zip(names, kinds, strict=True))), []
    for file, block, rel, raw in _pieces(batches):
        out.append((file, block, rel, len(raw), *_read(raw)))
        if len(out) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)


def _read(raw: bytes) -> tuple:
    """(record, whole, succ, type, page_id, refers_to, n_bytes, digest) of what follows a magic; succ counts from the fragment's first byte."""
    m = _HEADER.match(raw)
    fields = dict(_FIELD.findall(m[1])) if m else {}
    length = fields.get(b"Content-Length", b"")
    if not length.isdigit():
        return (False, False, None, None, None, None, None, None)
    start, size = m.end(), int(length)
    whole = len(raw) == start + size + 4
    kind = fields.get(b"WARC-Type", b"").decode()
    n, digest = (size, hashlib.sha256(raw[start : start + size]).hexdigest() if whole else None) if kind == "response" else (int(fields.get(b"WARC-Payload-Length", b"0")), fields.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha256:"))
    return (True, whole, start + size + 4 + len(MAGIC), kind, _page(fields.get(b"WARC-Record-ID")), _page(fields.get(b"WARC-Refers-To")), n, digest)


def _raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f, k, r, raw in _pieces(batches):
        yield pa.RecordBatch.from_pydict({"file": pa.array([f]), "block": pa.array([k], pa.int64()), "rel": pa.array([r], pa.int64()), "raw": pa.array([raw], pa.binary())})


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) reachable from off = 0 by links(file, off, succ): pointer jumping, log2 of the longest chain rounds."""
    # only a successor that is a candidate itself is one
    ends = links.select("file", F.col("off").alias("succ"))
    jump = written(links.select("file", "off", "succ").join(ends, ["file", "succ"], "left_semi"), "warc-jump")
    found = links.where("off = 0").select("file", "off")
    n = -1
    while True:
        step = found.join(jump, ["file", "off"]).select("file", F.col("succ").alias("off"))
        found = written(found.unionByName(step).distinct(), "warc-found")
        n, before = found.count(), n
        if n == before:
            return found
        nxt = jump.select("file", F.col("off").alias("succ"), F.col("succ").alias("far"))
        jump = written(jump.join(nxt, ["file", "succ"]).select("file", "off", F.col("far").alias("succ")), "warc-jump")


def _owned(marked: DataFrame) -> DataFrame:
    """(file, block, rel, off, owner): records in more than one fragment, and their further fragments, with the record's offset.

    A fragment that is no record lies within the last record before it that is not whole. That is found in the
    fragment's own split, or is the last one of the splits before, of which a file has few.
    """
    some = marked.where("head is null or not whole").select("file", "block", "rel", "off", F.when(F.col("head"), F.col("off")).alias("begun"))
    splits = some.groupBy("file", "block").agg(F.max("begun").alias("last"))
    earlier = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.max("begun").over(Window.partitionBy("file", "block").orderBy("off"))
    carried = some.withColumn("begun", so_far).join(splits.select("file", "block", earlier.alias("carried")), ["file", "block"])
    return carried.select("file", "block", "rel", "off", F.coalesce("begun", "carried").alias("owner"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, type, page_id, refers_to, n_bytes, digest) of each record of the archives, payload digests recomputed for responses."""
    small_batches(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = written(lines.mapInArrow(_candidates, FRAGMENT), "warc-fragments")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    before = F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(blocks.select("file", "block", before.alias("base")), "warc-bases")
    # a fragment begins behind its magic; the empty one before a file's first magic has offset -10 and is no record
    placed = found.join(bases, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC)).withColumn("next", F.col("off") + F.col("size") + len(MAGIC))
    records = placed.where("record and off >= 0")
    heads = reachable(records.select("file", "off", (F.col("off") + F.col("succ")).alias("succ")))
    marked = written(placed.where("off >= 0").join(heads.withColumn("head", F.lit(True)), ["file", "off"], "left").drop("succ"), "warc-marked")
    out = ["file", "off", "type", "page_id", "refers_to", "n_bytes", "digest"]
    plain = marked.where("head and (whole or type <> 'response')").select(*out)
    broken = marked.where("head and not whole and type = 'response'")
    if broken.isEmpty():
        return plain
    need = _owned(marked).join(broken.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi").select("file", "block", "rel", "off", "owner")
    raws = lines.mapInArrow(_raws, "file string, block long, rel long, raw binary").join(need, ["file", "block", "rel"])
    # the header of the record is in its first fragment; the rest of its payload follows magic by magic
    whole = raws.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "raw"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.decode(p["raw"], "UTF-8")), MAGIC)
    payload = F.expr("substring(encode(text, 'UTF-8'), locate('\r\n\r\n', text) + 4 + octet_length(substring_index(text, '\r\n\r\n', 1)) - length(substring_index(text, '\r\n\r\n', 1)), n_bytes)")
    mended = whole.select("file", F.col("owner").alias("off"), text.alias("text")).join(broken.drop("digest"), ["file", "off"]).withColumn("digest", F.sha2(payload, 256))
    return plain.unionByName(mended.select(*out))


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    return read_warc(spark, path)
