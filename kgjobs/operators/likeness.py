"""Texts with like token sets: classes of equal sets, candidates by rare tokens within ranges of sizes, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokenize
from ..sources import scratch

#: The most frequent tokens, whose order is sent to the tasks; others are taken for rarer ones.
FREQUENT = 400_000
#: Tokens of prefixes, over all cells, for each slice that cells are dealt to.
SLICE = 8 << 20
#: Tokens of a batch of sets that a task orders at a time.
BATCH = 1 << 19
#: Words of sketches that are compared at a time.
WORDS = 2 << 20
#: Pairs of classes that are confirmed together, and those of one label from which they are dealt out.
GROUP, HEAVY = 50_000, 500_000
#: Classes up to which their names are broadcast.
NAMED = 2_000_000


def newness() -> Column:
    """Orders memories from the newest to those without a date."""
    return F.coalesce(F.datediff(F.lit("9999-12-31").cast("date"), "created"), F.lit(2**31 - 1))


def token_sets(memories: DataFrame, **more: Column) -> DataFrame:
    """(owner, id, age, tokens, size, cls, ...) of memories(owner, id, body, created), a written table without bodies.

    Tokens are 64-bit names in order; cls names the owner's class of equal sets, null without an owner or tokens.
    """
    tokens = F.coalesce(F.sort_array(F.transform(tokenize(F.col("body")), lambda t: F.xxhash64(t))), F.array().cast("array<long>"))
    sets = memories.select("owner", "id", newness().alias("age"), tokens.alias("tokens"), *[c.alias(name) for name, c in more.items()])
    named = F.when(F.col("owner").isNotNull() & (F.size("tokens") > 0), F.xxhash64("owner", "tokens"))
    path = scratch(memories.sparkSession, "token-sets")
    sets.withColumns({"size": F.size("tokens"), "cls": named}).write.parquet(path)
    return memories.sparkSession.read.parquet(path)


def _bounds(largest: int, above: float) -> np.ndarray:
    """Where ranges of sizes begin: each about as wide as sizes may differ."""
    ratio, out = max(1.25, 1 / max(above, 0.01)), [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.floor(out[-1] * ratio)))
    return np.array(out)


def _words(end: int) -> int:
    """Words of a sketch for sets of under ``end`` tokens: two bits a token, a power of two."""
    return max(1, 1 << max(0, (2 * end - 1).bit_length() - 6))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH tokens, or of one set."""
    for b in batches:
        end, lo = np.cumsum(b.column("size").to_numpy().astype(np.int64)), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BATCH, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _dealt(batches: Iterator[pa.RecordBatch], known: np.ndarray, rank: np.ndarray, bounds: np.ndarray, above: float, slices: int) -> Iterator[pa.RecordBatch]:
    """A row for each set, range of sizes and slice of tokens: the rarest tokens of the set, of which alike sets share one, and a sketch.

    The range is the set's own and each lower one with sets that may be like it.
    """
    for b in _parts(batches):
        size, cls = b.column("size").to_numpy().astype(np.int64), b.column("cls")
        flat = b.column("tokens").flatten().to_numpy()
        doc = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        place = np.where(known[at] == flat, rank[at] + 1, 0) if len(known) else np.zeros(len(flat), np.int64)
        order = np.argsort(doc * (len(known) + 2) + place, kind="stable")
        first = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chosen = first < (size - np.ceil(size * above).astype(np.int64) + 1)[doc]
        rare, rare_doc = flat[order][chosen], doc[chosen]
        part = ((rare >> 32) & 0x7FFFFFFF) % slices
        bucket, step = np.searchsorted(bounds, size, side="right") - 1, 0
        while True:
            into = bucket - step
            go = (into >= 0) & (bounds[np.maximum(into, 0) + 1] - 1 >= above * size) if step else into >= 0
            if not go.any():
                break
            for k in np.unique(into[go]):
                words = _words(int(bounds[k + 1]))
                rows, wide = np.flatnonzero(go & (into == k)), max(1, WORDS // 64 // words)
                for lo in range(0, len(rows), wide):
                    own = rows[lo : lo + wide]
                    local = np.full(len(size), -1)
                    local[own] = np.arange(len(own))
                    mine = local[doc] >= 0
                    bits = np.bincount(local[doc[mine]] * (64 * words) + (flat[mine] & (64 * words - 1)), minlength=len(own) * 64 * words)
                    sketch = np.packbits((bits & 1).astype(np.uint8).reshape(len(own), -1), axis=1)
                    for s in range(slices):
                        held = (local[rare_doc] >= 0) & (part == s)
                        n = np.bincount(local[rare_doc[held]], minlength=len(own))
                        some = np.flatnonzero(n)
                        if len(some):
                            ends = np.concatenate([[0], np.cumsum(n[some])])
                            take = pa.array(own[some])
                            yield pa.RecordBatch.from_arrays(
                                [b.column("owner").take(take), pa.array(np.full(len(some), k, np.int32)), pa.array(np.full(len(some), s, np.int32)), cls.take(take), pa.array(size[own[some]].astype(np.int32)), pa.array(np.full(len(some), step == 0)),
                                 pa.array([x.tobytes() for x in sketch[some]], pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rare[held]))],
                                names=["owner", "bucket", "slice", "cls", "size", "own", "sketch", "rare"],
                            )
            step += 1


def _near(cell: pa.Table, above: float) -> pa.Table:
    """(a, b): classes of a cell that share a rare token and whose sketches do not tell them apart; the smaller set is of the cell's own range."""
    cell = cell.combine_chunks()
    cls, first = np.unique(cell.column("cls").to_numpy(), return_index=True)
    cell, n = cell.take(pa.array(first)).combine_chunks(), len(cls)
    size, own = cell.column("size").to_numpy().astype(np.int64), cell.column("own").to_numpy()
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
    lists = cell.column("rare").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    token, doc = lists.flatten().to_numpy(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    order = np.lexsort((size[doc], token))
    token, doc = token[order], doc[order]
    group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]])) << 32
    # partners of a token's set stand behind it, up to the largest that may be like it
    largest = np.minimum(np.floor(size[doc] / above + 1e-9), 2**31) if above > 0 else np.full(len(doc), 2**31)
    end = np.searchsorted(group + size[doc], group + largest.astype(np.int64), side="right")
    count = np.where(own[doc], end - np.arange(len(doc)) - 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    share, lo, found, held = (1 - above) / (1 + above), 0, [], 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + WORDS // sketch.shape[1], side="right")) - 1)
        a = np.repeat(np.arange(lo, hi), count[lo:hi])
        x, y = doc[a], doc[a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])]
        apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        x, y = (z[apart < (size[x] + size[y]) * share + 1e-9] for z in (x, y))
        found.append(np.unique(np.minimum(x, y) * n + np.maximum(x, y)))
        held += len(found[-1])
        if held > WORDS:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2
        lo = hi
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pa.table({"a": cls[pairs // n], "b": cls[pairs % n]})


def _sure(sets: pa.Table, pairs: pa.Table, above: float) -> pa.Table:
    """Those of pairs(a, b) whose sets(cls, tokens) have a Jaccard likeness over ``above``."""
    at = dict(zip(sets.column("cls").to_pylist(), range(sets.num_rows), strict=True))
    lists = sets.column("tokens").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) if sets.num_rows else np.zeros(1, int)
    flat, ok = lists.flatten().to_numpy() if sets.num_rows else np.zeros(0, np.int64), []
    of = lambda c: flat[ends[at[c]] : ends[at[c] + 1]]
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        x, y = of(a), of(b)
        both = len(np.intersect1d(x, y, assume_unique=True))
        ok.append(both / (len(x) + len(y) - both) > above)
    return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def alike(sets: DataFrame, above: float) -> DataFrame:
    """(a, b), a < b, once: classes of one owner in token_sets whose Jaccard likeness is over ``above``, a written table.

    Tokens are ordered by how rare they are; likeness over ``above`` needs a common one among each side's rarest
    size - ceil(above size) + 1. Sets meet in cells of an owner and a range of sizes, which hold these tokens and a sketch
    of two bits a token: the parity of names that fall on a bit, which differs in no more places than the sets do. What
    is left is confirmed on whole sets, by groups of pairs around a common class, so a set goes there about once.
    """
    spark, base = sets.sparkSession, scratch(sets.sparkSession, "alike")
    some = sets.where("cls is not null")
    shape = some.agg(F.max("size").alias("largest"), F.sum(F.col("size") - F.ceil(F.col("size") * above) + 1).alias("rare")).first()
    if shape["largest"] is None or above >= 1:
        return spark.createDataFrame([], "a long, b long")
    often = some.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    top = often.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    names = top.column("token").to_numpy()
    by_name = np.argsort(names)
    sent = spark.sparkContext.broadcast((names[by_name], len(names) - 1 - by_name))  # the rarest first
    bounds, slices = _bounds(shape["largest"], above), -(-int(shape["rare"]) // SLICE)
    cells = some.select("owner", "cls", "size", "tokens").mapInArrow(lambda batches: _dealt(batches, *sent.value, bounds, above, slices), f"owner {sets.schema['owner'].dataType.simpleString()}, bucket int, slice int, cls long, size int, own boolean, sketch binary, rare array<long>")
    cells.groupBy("owner", "bucket", "slice").applyInArrow(lambda cell: _near(cell, above), "a long, b long").distinct().write.parquet(f"{base}/maybe")
    maybe = spark.read.parquet(f"{base}/maybe")
    n = maybe.count()
    if not n:
        return maybe
    ends = maybe.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(maybe.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    label = ends.groupBy("cls").agg(F.min("other").alias("least")).select(F.col("cls").alias("a"), F.least("cls", "least").alias("label"))
    named = maybe.join(label, "a")
    heavy = named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)  # few: each has so many pairs
    named = named.join(F.broadcast(heavy), "label", "left")
    salt = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("n") / HEAVY), F.lit(1)))
    named.select("a", "b", F.pmod(F.xxhash64("label", salt), F.lit(-(-n // GROUP))).alias("part")).write.parquet(f"{base}/named")
    named = spark.read.parquet(f"{base}/named")
    need = named.select("part", F.col("a").alias("cls")).unionByName(named.select("part", F.col("b").alias("cls"))).distinct()
    met = need.select("cls").distinct()
    met = F.broadcast(met) if n <= NAMED // 2 or met.count() <= NAMED else met
    whole = some.select("cls", "tokens").join(met, "cls", "left_semi").dropDuplicates(["cls"])
    met_in = need.join(whole, "cls").select(F.col("part").alias("at"), "cls", "tokens")
    sure = met_in.groupBy("at").cogroup(spark.read.parquet(f"{base}/named").groupBy("part")).applyInArrow(lambda x, y: _sure(x, y, above), "a long, b long")
    sure.write.parquet(f"{base}/sure")
    return spark.read.parquet(f"{base}/sure")
