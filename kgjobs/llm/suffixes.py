"""Suffix-array dedup: repeated byte strings of at least ``least`` bytes, by longest-previous-factor arrays.

Suffixes are sorted by their bytes, neighbours' common prefixes are measured, and in that order the previous and the
next smaller position give each suffix its longest previous factor: the longest match that begins earlier in the
corpus. Where it reaches ``least``, the suffix begins a later copy. The same with falling positions gives the longest
match that begins later, so that all copies, the first as well, can be told.

The order is never built over the whole corpus in one task. A string of ``least`` bytes holds at least one anchor, the
place of the least hash of its 32-byte grams, and equal strings hold it at the same place. Anchors only deal the
suffixes out:

1. each text gives its anchors (one in about ``least`` / 2 bytes; of runs of short period only those at the ends);
   anchors seen once are dropped;
2. each place of a repeated anchor gives its context: the bytes before it that strings around it can begin at, and the
   bytes after it that they can reach;
3. a task sorts whole groups of contexts of one anchor. The order of the suffixes that begin at the anchor is that of
   the bytes from there on. For those that begin d bytes earlier it is the same order within each group of contexts
   that agree on the d bytes before, so one sort by the bytes behind and one by the bytes before give every suffix
   array (``factors``). What a place repeats is one stretch around it;
4. an anchor with more than ``most`` places is dealt out instead: classes of neighbouring strings, then single strings,
   are grouped by a shuffle that pre-aggregates. Both are exact (64-bit names stand for strings here);
5. stretches are merged per text.

Texts are compared as UTF-8 bytes and never across their ends; equal texts are handled once, as one text with copies.

Defined cases: null text is empty; texts shorter than ``least`` keep everything; rows with equal doc_id and text are
copies of each other; a null doc_id sorts first; empty tables give empty results; other columns are ignored or kept,
and those named like an output give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, shuffles, small_batches, written

LEAST = 400
GRAM = 32
MOST = 10_000
#: Contexts that a task sorts at once, unless one anchor has more.
BATCH = 4000
#: Anchors are taken in so many parts, one after the other.
PARTS = 4
#: So many neighbouring begins make a class: all their strings hold one core.
WIDTH = 16
NO_ID = -(2**63)
#: More anchors than this are never called hot, so a broadcast of the hot ones stays below 8 MB.
HOT = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes (a power of two) along the last axis, by doubling."""
    h, k = _TABLE[b], 1
    while k < size:
        h = (h[..., :-k] * _BASE) ^ (h[..., k:] + (h[..., :-k] >> np.uint64(29)))
        k *= 2
    return mix64(h)


def anchors(b: np.ndarray, least: int) -> np.ndarray:
    """Places whose gram has the least hash of some string of ``least`` bytes (all of equal ones)."""
    if len(b) < least:
        return np.zeros(0, np.int64)
    h = gram_hashes(b, GRAM)
    w = least - GRAM + 1
    low = _sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    # h[i] is the least of a window that holds it if and only if the largest of those windows' minima equals it
    high = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum, np.uint64(0))
    return np.flatnonzero(high == h)


def anchor_names(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.int64)
    return gram_hashes(b[at[:, None] + np.arange(GRAM)], GRAM)[:, 0].view(np.int64)


def settle_runs(b: np.ndarray, at: np.ndarray, names: np.ndarray, lengths: list[int], keep_first: bool) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Which anchors are needed, and for each length the stretches that repeat themselves ("the the the ...").

    In a run of period p every string but those that begin in its first p bytes stands p bytes earlier as well, so what
    lies within the run needs no other text. A string that reaches over the run's begin or end holds the first or the
    last anchor of the run, one that begins in its first p bytes the first or the second. Runs that are just as long as
    a wanted string, up to a period more, keep all their anchors. Contexts hold only what the shortest length can have
    before an anchor, so for longer strings that reach over the end further anchors are kept, told from the end: each
    such string then has one as near to its begin.
    """
    least, top = min(lengths), max(lengths)
    keep, spans = np.ones(len(at), bool), [[] for _ in lengths]
    if len(at) < 4:
        return keep, spans
    gap = np.diff(at)
    same = (names[1:] == names[:-1]) & (gap <= GRAM)
    on = same[1:] & same[:-1] & (gap[1:] == gap[:-1])
    if not on.any():
        return keep, spans
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    for first, last in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
        p, begin, end = int(gap[first]), int(at[first]), int(at[last]) + GRAM
        # as far as the period goes; each step looks at a few times as many bytes
        step = GRAM
        while begin:
            low = max(0, begin - step)
            off = np.flatnonzero(b[low:begin] != b[low + p : begin + p])
            begin = low if not len(off) else low + int(off[-1]) + 1
            if len(off):
                break
            step *= 4
        step = GRAM
        while end < len(b):
            high = min(len(b), end + step)
            off = np.flatnonzero(b[end:high] != b[end - p : high - p])
            end = high if not len(off) else end + int(off[0])
            if len(off):
                break
            step *= 4
        if all(end - begin >= n + p or end - begin < n for n in lengths):
            keep[first + 2 : last] = False
            if top > least:
                back = np.arange(last, first, -max(1, (least - GRAM + 1) // p))
                keep[back[at[back] >= end - top]] = True
            for n, out in zip(lengths, spans, strict=True):
                if end - begin >= n + p:
                    out.append((begin + p if keep_first else begin, end))
    return keep, spans


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over every w neighbours: a prefix scan and a suffix scan within blocks of w."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, fill)]).reshape(-1, w)
    left = op.accumulate(pad, axis=1).ravel()
    right = op.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[w - 1 : w - 1 + n])


def _arrays(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


# Suffix order and factors -------------------------------------------------------------------------------------------


def _ranges(x: np.ndarray, op: np.ufunc, levels: int, fill: int) -> list[np.ndarray]:
    """op over x[i - 2^k + 1 .. i] for k = 0 to levels; ``fill`` where that leaves the array."""
    out = [x]
    for k in range(levels):
        y = np.full(len(x), fill, x.dtype)
        y[1 << k :] = op(out[-1][1 << k :], out[-1][: len(x) - (1 << k)])
        out.append(y)
    return out


def _smaller_before(pos: np.ndarray, link: np.ndarray, levels: int) -> np.ndarray:
    """For each entry of a suffix order the common prefix with the nearest one before it that has a smaller position.

    link[i] is the common prefix of entries i - 1 and i, -1 between groups; the result is -1 where there is none.
    """
    low, thin = _ranges(pos, np.minimum, levels, -1), _ranges(link, np.minimum, levels, -1)
    cur, best = np.arange(len(pos)), link.copy()
    best[:] = np.iinfo(link.dtype).max
    for k in range(levels, -1, -1):
        before = np.maximum(cur - 1, 0)
        skip = (cur >= 1 << k) & (low[k][before] >= pos)
        best = np.where(skip, np.minimum(best, thin[k][cur]), best)
        cur = np.where(skip, cur - (1 << k), cur)
    return np.minimum(best, link[cur])


def previous_factors(pos: np.ndarray, link: np.ndarray, largest: int) -> np.ndarray:
    """Longest previous factor of each entry of suffix orders that stand one behind the other (-1: none).

    The longest match that begins at a smaller position is with the previous or with the next smaller position.
    """
    levels = max(1, int(largest).bit_length())
    back = np.concatenate([link[:1], link[:0:-1]])
    return np.maximum(_smaller_before(pos, link, levels), _smaller_before(pos[::-1], back, levels)[::-1])


def _sorted_links(group: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, their first ``size`` bytes), and the common prefix of each with the one before (-1: other group)."""
    n, width = data.shape
    key = np.empty((n, width + 6), np.uint8)
    key[:, :4] = group.astype(">u4")[:, None].view(np.uint8)
    key[:, 4:-2] = data
    key[:, -2:] = size.astype(">u2")[:, None].view(np.uint8)  # a prefix stands before what continues it
    order = np.argsort(key.view(f"S{width + 6}").ravel(), kind="stable")
    rows, ends = data[order], size[order]
    link = np.full(n, -1, np.int64)
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), width)
    link[1:] = np.where(group[order][1:] == group[order][:-1], np.minimum(same, np.minimum(ends[1:], ends[:-1])), -1)
    return order, link


def factors(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, behind: np.ndarray, n_behind: np.ndarray, pos: np.ndarray, lengths: list[int], keep_first: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: how far before and behind its anchor each context repeats another of its group (-1: not at all).

    before holds the bytes before the anchor in falling order, behind those from it on. With keep_first only matches
    that begin earlier count (smaller pos), else also those that begin later.
    """
    n = len(group)
    right, link = _sorted_links(group, behind, n_behind)
    left, near = _sorted_links(group, before, n_before)
    rank = np.empty(n, np.int64)
    rank[right] = np.arange(n)
    deep = max(1, n.bit_length())
    thin = _ranges(link, np.minimum, deep, -1)
    span = np.array([0, *[k.bit_length() - 1 for k in range(1, n + 1)]])
    # groups of contexts that agree on d bytes before the anchor change only at common lengths that occur
    on = near >= 0
    steps = np.unique(group[left][on] * 65536 + near[on])
    of, first = np.unique(steps // 65536, return_index=True)
    count = np.diff(np.append(first, len(steps)))
    begin, many = np.zeros(int(group.max()) + 1 if n else 0, np.int64), np.zeros(int(group.max()) + 1 if n else 0, np.int64)
    begin[of], many[of] = first, count
    out = [(np.full(n, -1, np.int64), np.full(n, -1, np.int64)) for _ in lengths]
    for step in range(int(count.max()) if len(count) else 0):
        depth = np.where(many > step, (steps[np.minimum(begin + step, len(steps) - 1)]) % 65536, -1)
        d_left = depth[group[left]]
        cell = np.empty(n, np.int64)
        cell[left] = np.cumsum((near < d_left) | (d_left < 0))
        size = np.bincount(cell, minlength=n + 1)
        rows = right[(depth[group[right]] >= 0) & (size[cell[right]] > 1)]
        if not len(rows):
            continue
        rows = rows[np.argsort(cell[rows], kind="stable")]
        at = rank[rows]
        new = np.concatenate([[True], cell[rows][1:] != cell[rows][:-1]])
        gap = np.where(new, 1, at - np.concatenate([[0], at[:-1]]))
        k = span[gap]
        # least link over (previous rank, own rank]
        lcp = np.empty(len(rows), np.int64)
        for level in np.unique(k):
            m = k == level
            lcp[m] = np.minimum(thin[level][at[m]], thin[level][at[m] - gap[m] + (1 << level)])
        lcp[new] = -1
        far, d = previous_factors(pos[rows], lcp, size[cell[rows]].max()), depth[group[rows]]
        if not keep_first:
            far = np.maximum(far, previous_factors(n - pos[rows], lcp, size[cell[rows]].max()))
        for length, (a, b) in zip(lengths, out, strict=True):
            hit = (far >= 0) & (far + d >= length)
            r = rows[hit]
            a[r], b[r] = np.maximum(a[r], d[hit]), np.maximum(b[r], far[hit])
    return out


_CTX = {"anchor": pa.int64(), "left": pa.int32(), "bytes": pa.binary(), "doc_id": pa.int64(), "sha": pa.binary(), "places": pa.list_(pa.int32())}
_CTX_DDL = "anchor long, left int, bytes binary, doc_id long, sha binary, places array<int>"
_SPANS = "array<struct<begin:long,end:long>>"


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by the keys, equal rows alike; the first key counts most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _work(rows: pa.Table, reach: int, lengths: list[int], keep_first: bool) -> pa.RecordBatch:
    """Spans of the contexts of whole anchor groups, in one list a row for each length."""
    n, top = rows.num_rows, max(lengths)
    left = rows.column("left").to_numpy()
    raw = rows.column("bytes").to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, n)
    before, behind = np.zeros((n, reach), np.uint8), np.zeros((n, top), np.uint8)
    for k, (t, p) in enumerate(zip(raw, left.tolist(), strict=True)):
        b = np.frombuffer(t, np.uint8)
        before[k, :p] = b[:p][::-1]
        behind[k, : len(b) - p] = b[p:]
    anchor = rows.column("anchor").to_numpy()
    group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
    lists = rows.column("places").combine_chunks()
    places, n_places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _lengths(lists)
    first = np.cumsum(n_places) - n_places
    sha = np.array(rows.column("sha").to_pylist(), "S32")
    pos = _dense(rows.column("doc_id").to_numpy(), sha, places[first])
    found = factors(group, before, left.astype(np.int64), behind, sizes - left, pos, lengths, keep_first)
    row = np.repeat(np.arange(n), n_places)
    # a text that holds a context twice repeats it whole
    again = (n_places > 1)[row]
    if keep_first:
        again[first] = False
    out = []
    for length, (a, b) in zip(lengths, found, strict=True):
        whole = again & (sizes >= length)[row]
        a, b = np.where(whole, left[row], a[row]), np.where(whole, (sizes - left)[row], b[row])
        hit = b >= 0
        out.append(_span_lists(n, *merged(row[hit], (places - a)[hit], (places + b)[hit])))
    return pa.RecordBatch.from_arrays([rows.column("sha").combine_chunks(), *out], names=["sha", *[f"spans{k}" for k in range(len(lengths))]])


def repeats(docs: DataFrame, lengths: list[int], keep_first: bool = False, most: int = MOST) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Two tables for docs(doc_id, text), and tables that may be discarded once these two are used:

    rows(doc_id, sha, n_bytes, copies, first_doc): sha is the text's SHA-256, copies how many rows have that text,
    first_doc the smallest doc_id of those;
    spans(sha, spans0, spans1, ...): for each length the stretches of a text that other texts or places repeat (with
    keep_first, only those that stand earlier as well). Copies of a text do not count here.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least, top = min(lengths), max(lengths)
    reach = least - GRAM
    keyed = _keyed(docs)
    names_of = [f"spans{k}" for k in range(len(lengths))]
    some = " or ".join(f"size({c}) > 0" for c in names_of)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            places, sizes, own, times, twice, runs = [], [], [], [], [], [[] for _ in lengths]
            for t in texts:
                a = np.frombuffer(t.as_buffer(), np.uint8)
                at = anchors(a, least)
                every = anchor_names(a, at)
                keep, spans = settle_runs(a, at, every, lengths, keep_first)
                at = at[keep]
                sizes.append(len(a))
                places.append(at.astype(np.int32))
                names, of, n = np.unique(every[keep], return_inverse=True, return_counts=True)
                own.append(names)
                twice.append(n > 1)
                for x, out in zip(spans, runs, strict=True):
                    out.append([{"begin": i, "end": j} for i, j in x])
                # different contexts of each
                held, many = t.as_py(), np.flatnonzero(n[of] > 1)
                seen = {(k, min(p, reach), held[max(0, p - reach) : p + top]) for k, p in zip(of[many].tolist(), at[many].tolist(), strict=True)}
                n = np.where(n > 1, 0, n)
                np.add.at(n, np.fromiter((x[0] for x in seen), np.int64, len(seen)), 1)
                times.append(n.astype(np.int32))
            arrays = [pa.array(x, pa.list_(k)) for x, k in ((places, pa.int32()), (own, pa.int64()), (times, pa.int32()), (twice, pa.bool_()))]
            arrays += [pa.array(x, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))) for x in runs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(sizes, pa.int64()), *arrays], names=["doc_id", "sha", "n_bytes", "places", "own", "times", "twice", *names_of])

    found = keyed.mapInArrow(find, "doc_id long, sha binary, n_bytes long, places array<int>, own array<long>, times array<int>, twice array<boolean>, " + ", ".join(f"{c} {_SPANS}" for c in names_of))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "suffix-anchors")
    same = found.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row")).alias("first"))
    same = written(same.select("sha", "copies", F.col("first.doc_id").alias("first_doc"), "first.row"), "suffix-rows")
    light = found.select("doc_id", "sha", "n_bytes").join(same.drop("row"), "sha")
    # one row stands for all copies of a text
    firsts = written(found.where("size(own) > 0").join(same.select("row"), "row", "left_semi").drop("n_bytes"), "suffix-firsts")
    at = firsts.select("row", F.explode(F.arrays_zip("own", "times", "twice")).alias("x")).select("row", F.col("x.own").alias("anchor"), F.col("x.times").alias("n"), "x.twice")
    again = at.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.max("twice").alias("twice")).where("n > 1 or twice")
    again = written(again.select("anchor", "n", "texts"), "suffix-again")
    total = again.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    # at most HOT anchors have so many rows; theirs don't go through a shuffle by anchor
    hot = again.where(F.col("texts") > max(most, total // HOT)).select("anchor")
    cold = again.join(F.broadcast(hot), "anchor", "left_anti").select("anchor", (F.col("n") > most).alias("hot"))
    at = at.select("row", "anchor")
    todo = at.join(F.broadcast(hot), "anchor", "left_anti").join(cold, "anchor").unionByName(at.join(F.broadcast(hot), "anchor", "left_semi").withColumn("hot", F.lit(True)))
    todo = todo.groupBy("row").agg(F.collect_list(F.struct("anchor", "hot")).alias("again"))
    texts = keyed.join(todo.join(firsts.select("row", "sha", "doc_id", "places"), "row"), ["sha", "doc_id"])
    texts = written(texts.select("doc_id", "sha", "text", "again", "places"), "suffix-texts")
    some_hot = not again.where(F.col("n") > most).isEmpty()
    runs_within = written(firsts.where(some).select("sha", *names_of), "suffix-runs")
    for t in (firsts, again):
        discard(t)

    def contexts(part: int):
        """Contexts of the hot anchors (part -1), or of that part of the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for doc, sha, t, again, places in zip(b.column("doc_id").to_pylist(), b.column("sha").to_pylist(), b.column("text").cast(pa.binary()), b.column("again"), b.column("places"), strict=True):
                    which, hot = (x.to_numpy(zero_copy_only=False) for x in again.values.flatten())
                    which = np.sort(which[hot if part < 0 else ~hot & (which % PARTS == part)])
                    if not len(which):
                        continue
                    raw, seen = t.as_py(), {}
                    places = places.values.to_numpy()
                    names = anchor_names(np.frombuffer(raw, np.uint8), places)
                    keep = which[np.minimum(np.searchsorted(which, names), len(which) - 1)] == names
                    for p, anchor in zip(places[keep].tolist(), names[keep].tolist(), strict=True):
                        left = min(p, reach)
                        piece = raw[p - left : p + top]
                        seen.setdefault((anchor, left, piece), []).append(p)
                    rows += [(a, left, piece, doc, sha, places) for (a, left, piece), places in seen.items()]
                    if len(rows) > 4000:
                        yield _arrays(_CTX, rows)
                        rows = []
                yield _arrays(_CTX, rows)

        return texts.mapInArrow(run, _CTX_DDL)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) <= 2 * BATCH:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            # whole anchors only
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            begin = 0
            while len(anchor) - begin > 2 * BATCH and len(later := ends[ends > begin]):
                end = int(max(later[later <= begin + BATCH], default=later[0]))
                yield _work(rows.slice(begin, end - begin), reach, lengths, keep_first)
                begin = end
            held = rows.slice(begin).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield _work(rows.combine_chunks(), reach, lengths, keep_first)

    spans = [runs_within]
    for part in range(PARTS):  # so that only a part of all contexts is on disk at a time
        few = contexts(part).repartition(2 * shuffles(spark), "anchor").sortWithinPartitions("anchor")
        spans.append(written(few.mapInArrow(local, "sha binary, " + ", ".join(f"{c} {_SPANS}" for c in names_of)).where(some), "suffix-runs"))
    if some_hot:
        many = written(contexts(-1).withColumn("ctx", F.xxhash64("anchor", "left", "bytes")), "suffix-contexts")
        first = F.min(F.struct("doc_id", "sha", F.array_min("places").alias("place")))
        classes = many.groupBy("anchor", "ctx").agg(first.alias("who"), F.sum(F.size("places")).alias("n"), F.min(F.struct("left", "bytes")).alias("at"))
        classes = written(classes.select("anchor", "ctx", "who.doc_id", F.col("who.sha").alias("first_sha"), "who.place", "n", "at.left", "at.bytes"), "suffix-classes")
        for k, length in enumerate(lengths):
            runs, used = _dealt_out(classes, length, reach, top)
            hits = many.select("anchor", "ctx", "sha", "doc_id", "places").join(runs, ["anchor", "ctx"]).mapInArrow(_narrow(length, keep_first), f"sha binary, spans {_SPANS}").where("size(spans) > 0")
            spans.append(written(hits.select("sha", *[(F.col("spans") if c == names_of[k] else F.array().cast(_SPANS)).alias(c) for c in names_of]), "suffix-runs"))
            for t in used:
                discard(t)
        discard(many)
        discard(classes)
    discard(texts)
    tables, spans = [found, same, *spans], reduce(DataFrame.unionByName, spans)
    spans = spans.groupBy("sha").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in names_of])
    return light, spans, tables


# Anchors of very many places ----------------------------------------------------------------------------------------


def prefix_sums(ctx: np.ndarray) -> np.ndarray:
    """Sums over each row's first bytes, mixed, times growing powers."""
    power = np.full(ctx.shape[1], _BASE)
    power[:1] = 1
    sums = np.zeros((len(ctx), ctx.shape[1] + 1), np.uint64)
    np.cumsum(_TABLE[ctx] * np.multiply.accumulate(power), axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


def _inverses(n: int) -> np.ndarray:
    inverse = np.full(n, pow(int(_BASE), -1, 2**64), np.uint64)
    inverse[:1] = 1
    return np.multiply.accumulate(inverse)


def range_names(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of bytes ``begin`` to ``end`` of each row; both have one line a row and one column a name."""
    return mix64((np.take_along_axis(sums, end, 1) - np.take_along_axis(sums, begin, 1)) * _inverses(sums.shape[1])[begin])


def _aligned(part: list[dict], reach: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows with their anchors in one column, and the columns where each begins and ends."""
    data = np.zeros((len(part), reach + top), np.uint8)
    begin = np.array([reach - r["left"] for r in part], np.int64)
    end = begin + np.array([len(r["bytes"]) for r in part], np.int64)
    for k, (r, b, e) in enumerate(zip(part, begin.tolist(), end.tolist(), strict=True)):
        data[k, b:e] = np.frombuffer(r["bytes"], np.uint8)
    return data, begin[:, None], end[:, None]


_PIECE_DDL = "anchor long, ctx long, k int, core long, piece long, lo int, hi int, n long, doc_id long, first_sha binary, place int"
_WINDOW = {"anchor": pa.int64(), "k": pa.int32(), "piece": pa.int64(), "begin": pa.int32(), "name": pa.int64(), "n": pa.int64(), "doc_id": pa.int64(), "first_sha": pa.binary(), "place": pa.int32()}
_WINDOW_DDL = "anchor long, k int, piece long, begin int, name long, n long, doc_id long, first_sha binary, place int"


def _dealt_out(many: DataFrame, least: int, reach: int, top: int) -> tuple[DataFrame, list[DataFrame]]:
    """Runs of contexts whose anchor has very many: (anchor, ctx, runs), runs as distances before the anchor; tables used.

    The begins are taken in classes of ``WIDTH`` neighbours. All strings of a class hold its core, the bytes that they
    share, and lie in its piece, the bytes that they reach together. A core seen once repeats nothing. A core with one
    piece repeats as a whole, with one first copy. Only other pieces, once each and not once a context, are taken apart
    into strings. So a context costs a row a class and, where a shared passage begins or ends, a row a string.
    """
    at = np.arange(0, reach + 1, WIDTH)
    last = np.minimum(at + WIDTH - 1, reach)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                data, begin, end = _aligned(part.select(["left", "bytes"]).to_pylist(), reach, top)
                lo, hi = np.maximum(at, begin), np.minimum(last, end - least)
                i, k = np.nonzero(lo <= hi)
                sums, wide = prefix_sums(data), data.shape[1]
                core = range_names(sums, np.broadcast_to(last, lo.shape), np.broadcast_to(np.minimum(at + least, wide), lo.shape))[i, k]
                piece = range_names(sums, np.minimum(lo, wide), np.clip(hi + least, 0, wide))[i, k]
                piece = mix64(piece ^ (lo[i, k] * 1000 + hi[i, k]).astype(np.uint64))
                col = lambda c: part.column(c).take(pa.array(i))  # noqa: B023, E731
                arrays = [col("anchor"), col("ctx"), k.astype(np.int32), core.view(np.int64), piece.view(np.int64), lo[i, k].astype(np.int32), hi[i, k].astype(np.int32), col("n"), col("doc_id"), col("first_sha"), col("place")]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=["anchor", "ctx", "k", "core", "piece", "lo", "hi", "n", "doc_id", "first_sha", "place"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200).to_pylist()
                data, begin, end = _aligned(part, reach, top)
                every = np.broadcast_to(np.arange(reach + 1), (len(part), reach + 1))
                name = range_names(prefix_sums(data), every, every + least).view(np.int64)
                rows = []
                for r, of in zip(part, name, strict=True):
                    for x in r["todo"]:
                        rows += [(r["anchor"], x["k"], x["piece"], i, int(of[i]), x["n"], x["doc_id"], x["first_sha"], x["place"]) for i in range(x["lo"], x["hi"] + 1)]
                yield _arrays(_WINDOW, rows)

    parts = written(many.mapInArrow(pieces, _PIECE_DDL), "suffix-parts")
    key = ["anchor", "k", "core"]
    cores = parts.groupBy(*key).agg(F.sum("n").alias("m"), (F.min("piece") < F.max("piece")).alias("mixed")).where("m > 1").drop("m")
    # of equal pieces the first copy stands for all; its context is at hand for its bytes
    who = F.min(F.struct("doc_id", "first_sha", "place", "ctx")).alias("who")
    seen = parts.groupBy(*key, "piece", "lo", "hi").agg(F.sum("n").alias("n"), who).select(*key, "piece", "lo", "hi", "n", "who.*")
    seen = written(seen.join(cores, key), "suffix-pieces")
    run = [(F.lit(reach) - F.col("hi")).cast("int").alias("low"), (F.lit(reach) - F.col("lo")).cast("int").alias("high"), F.col("doc_id").alias("doc"), "first_sha", "place"]
    whole = seen.where("not mixed").select("anchor", "k", "piece", *run)
    todo = seen.where("mixed").groupBy("anchor", "ctx").agg(F.collect_list(F.struct("k", "piece", "lo", "hi", "n", "doc_id", "first_sha", "place")).alias("todo"))
    windows = many.select("anchor", "ctx", "left", "bytes").join(todo, ["anchor", "ctx"]).mapInArrow(strings, _WINDOW_DDL)
    windows = written(windows, "suffix-windows")
    shared = windows.groupBy("anchor", "begin", "name").agg(F.sum("n").alias("m"), F.min(F.struct("doc_id", "first_sha", "place")).alias("who")).where("m > 1").select("anchor", "begin", "name", "who")
    # two contexts share neighbouring begins, so what lies between two that have one first copy repeats as well
    hits = windows.select("anchor", "k", "piece", "begin", "name").join(shared, ["anchor", "begin", "name"])
    hits = hits.groupBy("anchor", "k", "piece", "who").agg(F.min("begin").alias("lo"), F.max("begin").alias("hi")).select("anchor", "k", "piece", "lo", "hi", "who.*")
    by_piece = whole.unionByName(hits.select("anchor", "k", "piece", *run))
    both = parts.select("anchor", "ctx", "k", "piece").join(by_piece, ["anchor", "k", "piece"])
    return both.groupBy("anchor", "ctx").agg(F.collect_list(F.struct("low", "high", "doc", "first_sha", "place")).alias("runs")), [parts, seen, windows]


def _narrow(least: int, keep_first: bool):
    """Spans of the rows of hits: each place of a context with each of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, runs = b.column("places"), b.column("runs")
            n_runs, n_places = _lengths(runs), _lengths(places)
            low, high, first_doc, first_sha, first_place = runs.flatten().flatten()
            low, high, first_doc, first_place = (x.to_numpy(zero_copy_only=False) for x in (low, high, first_doc, first_place))
            hit = np.repeat(np.arange(b.num_rows), n_places)
            place = np.repeat(places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n_runs[hit])
            many = n_runs[hit]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(n_runs) - n_runs)[hit], many)
            row = np.repeat(hit, many)
            begin, end = place - high[at], place - low[at] + least
            if keep_first:
                sha, other = np.array(b.column("sha").to_pylist(), "S32"), np.array(first_sha.to_pylist(), "S32")
                later = (first_doc[at] != b.column("doc_id").to_numpy(zero_copy_only=False)[row]) | (first_place[at] != place) | (other[at] != sha[row])
                begin, end, row = begin[later], end[later], row[later]
            yield pa.RecordBatch.from_arrays([b.column("sha"), _span_lists(b.num_rows, *merged(row, begin, end))], names=["sha", "spans"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sha) with the least long for a null doc_id."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each row's spans: row, begin, end, in order; touching ones join."""
    far = np.int64(2**40)  # beyond the length of any text
    key = row * far + begin
    order = np.argsort(key)
    key, last = key[order], np.maximum.accumulate((row * far + end)[order])
    new = np.flatnonzero(np.concatenate([[True] * bool(len(key)), key[1:] > last[:-1]]).astype(bool))
    stop = last[np.append(new[1:], len(key))[: len(new)] - 1]
    return key[new] // far, key[new] % far, stop % far


def _span_lists(n: int, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.ListArray:
    spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), spans)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _row_spans(lists: pa.ListArray, n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    begin, end = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    row, begin, end = merged(np.repeat(np.arange(n), _lengths(lists)), begin, end)
    return np.searchsorted(row, np.arange(n + 1)), list(zip(begin.tolist(), end.tolist(), strict=True))


OUTPUTS = {"kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_repeated": pa.int64()}


def cut_repeats(docs: DataFrame, keep_first: bool = False, least: int = LEAST, most: int = MOST, report: int | None = None) -> DataFrame:
    """docs without text, and kept (binary), n_bytes, n_removed, n_spans, kept_sha256, n_repeated; docs has doc_id and text.

    keep_first: the first copy of a repeated string (least doc_id, then place) stays; else all copies go.
    report: n_repeated counts the bytes in repeated strings of at least so many bytes (at most ``least``, the default).
    """
    report = min(report or least, least)
    lengths = sorted({least, report})
    light, spans, tables = repeats(docs, lengths, keep_first, most)
    removing, counting = f"spans{lengths.index(least)}", f"spans{lengths.index(report)}"

    # copies of a text repeat it whole
    whole = F.col("copies") > 1
    if keep_first:
        whole = whole & (F.col("doc_id") != F.col("first_doc"))
    plan = light.withColumn("_whole", whole & (F.col("n_bytes") >= report)).join(spans, "sha", "left").where(f"_whole or {counting} is not null")
    lists = [F.when(~(F.col("_whole") & (F.col("n_bytes") >= n)), F.col(c)).alias(a) for n, c, a in ((least, removing, "_spans"), (report, counting, "_counted"))]
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "_whole", *lists).dropDuplicates(["_id", "_sha"])
    plan = written(plan, "suffix-plan")
    for t in tables:
        discard(t)
    # docs' own columns stay aside, so that none of their names can clash
    others = [c for c in docs.columns if c != "text" and c not in OUTPUTS]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*others).alias("_row"), text.alias("_text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    rows = rows.join(plan, ["_id", "_sha"], "left").drop("_id", "_sha")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cuts, spans = _row_spans(b.column("_spans"), b.num_rows)
            counted, counts = _row_spans(b.column("_counted"), b.num_rows)
            for k, (t, all_of_it) in enumerate(zip(b.column("_text").cast(pa.binary()), b.column("_whole").to_pylist(), strict=True)):
                raw = t.as_py()
                gone = [(0, len(raw))] if all_of_it and len(raw) >= least else spans[cuts[k] : cuts[k + 1]]
                kept = b"".join(raw[a:e] for a, e in zip([0] + [e for _, e in gone], [a for a, _ in gone] + [len(raw)], strict=True)) if gone else raw
                repeated = len(raw) if all_of_it else sum(e - a for a, e in counts[counted[k] : counted[k + 1]])
                out.append((kept, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), repeated))
            new = _arrays(OUTPUTS, out)
            yield pa.RecordBatch.from_arrays([b.column("_row"), *new.columns], names=["_row", *OUTPUTS])

    schema = rows.select("_row").schema
    for c, kind in zip(OUTPUTS, ["binary", "long", "long", "long", "string", "long"], strict=True):
        schema = schema.add(c, kind)
    return rows.mapInArrow(cut, schema).select("_row.*", *OUTPUTS)
