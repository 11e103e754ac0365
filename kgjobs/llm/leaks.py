"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Texts are lower-cased runs of letters, digits and underscores. A window or item is a weighted multiset of its
``width``-word shingles. Of an item's shingles, one that df of all N items have weighs ln(1 + N / df); a shingle that the
item doesn't have weighs ln(1 + N). Similarity is the weighted Jaccard index, sum of min / sum of max. N and df are
counted once over the whole benchmark, so a pair's similarity doesn't depend on how items are dealt to parts.

Every window with as many words as an item (a whole document, where that is shorter) that shares a shingle with the
item gets a 64-bit SimHash; a window that shares none has similarity 0. Fingerprints are compared through ``BLOCKS``
blocks of bits: two within ``radius`` agree in some block up to radius // BLOCKS bits, so looking up each block's close
values finds every item within the radius. Those pairs are verified exactly.

Items are dealt to parts of at most about ``part_bytes`` of text by a hash of the item; a part's index is sent to the
tasks and the documents are scanned once per part. So what is broadcast is bounded however large the benchmark is.

Defined cases: null texts and texts without words match nothing; an item with fewer words than ``width`` is one shingle
of all its words; repeated rows give repeated results; repeated items likewise; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, written

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
PART_BYTES = 4 << 20
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CLOSE = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int, w: int) -> list[int]:
    """Names of the w-word shingles of words; of a text of n < w words the one of all its words."""
    if n < w:
        return [xxhash.xxh64_intdigest("\x1f".join(words), n)] if words else []
    return [xxhash.xxh64_intdigest("\x1f".join(words[i : i + w])) for i in range(len(words) - w + 1)]


def _signed(name: int) -> int:
    return name - 2**64 if name >= 2**63 else name


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(name) of each item's different shingles, and one null for each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[int | None] = []
            for t in b.column("text").to_pylist():
                w = tokens(t)
                out += [*{_signed(s) for s in shingles(w, len(w), width)}, None] if w else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["name"])

    return items.select("text").mapInArrow(run, "name long")


class Index:
    """Items of one part: shingles, weights, fingerprints, and blocks of those."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int, every: int, often: dict[int, int]) -> None:
        self.width, self.radius = width, radius
        self.ids = [i for i, _ in items]
        words = [tokens(t) for _, t in items]
        self.size = np.array([len(w) for w in words])
        self.vocab: dict[str, int] = {}
        for w in words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.bags = [Counter(self.shingles(w, len(w))) for w in words]
        self.weight = {s: math.log(1 + every / often.get(_signed(s), 1)) for b in self.bags for s in b}
        self.other = math.log(1 + every)
        self.total = np.array([sum(self.weight[s] * n for s, n in b.items()) for b in self.bags])
        self.has: dict[int, list[int]] = defaultdict(list)
        for k, b in enumerate(self.bags):
            for s in b:
                self.has[s].append(k)
        self.keys = np.unique(np.array([h for w in words for h in self._known(np.array([self.vocab[x] for x in w], np.int64))], np.uint64))
        self.short = min((len(w) for w in words if w), default=0) < width
        self.prints = self._print([self.bags[k] for k in range(len(items))])
        block = self.prints.view(np.uint8).reshape(-1, 8)
        # close[b][v]: items whose block b is within radius // BLOCKS of v
        self.close = [np.array([_CLOSE[v][block[:, b]] <= radius // BLOCKS for v in range(256)]) for b in range(BLOCKS)]
        self.of_size = {n: np.flatnonzero(self.size == n) for n in set(self.size.tolist())}

    def shingles(self, words: list[str], n: int) -> list[int]:
        return shingles(words, n, self.width)

    def _known(self, ids: np.ndarray) -> np.ndarray:
        w = self.width
        if len(ids) < w:
            return np.zeros(0, np.uint64)
        h = np.zeros(len(ids) - w + 1, np.uint64)
        for j in range(w):
            h = mix64(h * _PRIME + ids[j : len(ids) - w + 1 + j].astype(np.uint64) + np.uint64(1))
        return h

    def _signs(self, shingles: list[int]) -> np.ndarray:
        """+weight or -weight by bit, a row for each shingle."""
        h = np.array(shingles, np.uint64)
        bits = np.unpackbits(mix64(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
        return bits * np.array([self.weight.get(s, self.other) for s in shingles])[:, None]

    def _print(self, bags: list[Counter]) -> np.ndarray:
        out = np.zeros((len(bags), 64))
        for k, b in enumerate(bags):
            if b:
                s = list(b)
                out[k] = self._signs(s).T @ np.array([b[x] for x in s], float)
        return np.packbits(out > 0, axis=1).view(np.uint64).ravel()

    def similarity(self, bag: Counter, item: int) -> float:
        own = self.bags[item]
        both = sum(self.weight[s] * min(n, bag[s]) for s, n in own.items() if s in bag)
        total = sum((self.weight[s] if s in own else self.other) * n for s, n in bag.items()) + self.total[item] - both
        return both / total if total else 0.0

    def matches(self, text: str | None, least: float) -> list[tuple[int, int, int, float]]:
        """(item index, first word, words, similarity): the best window of each item that reaches ``least``, the first of equals."""
        words = tokens(text)
        if not words:
            return []
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        if not known.any():
            return []
        n, w = len(words), self.width
        hits: dict[int, set[int]] = defaultdict(set)  # item size -> shingle places
        if n >= w:
            h = self._known(ids)
            at = np.searchsorted(self.keys, h)
            ok = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h)) if len(self.keys) else []
            for p in ok:
                for k in self.has.get(self.shingles(words[p : p + w], w)[0], ()):
                    hits[int(self.size[k])].add(int(p))
        if self.short:
            for size in {s for s in self.of_size if 0 < s < w and s <= n}:
                for p in np.flatnonzero(known):
                    if p + size <= n and self.shingles(words[p : p + size], size)[0] in self.has:
                        hits[size].add(int(p))
        if n < w and self.shingles(words, n)[0] in self.has:
            hits[n].add(0)
        best: dict[int, tuple[float, int, int]] = {}
        for size, places in hits.items():
            wide = min(size, n)
            begins = sorted({b for p in places for b in range(max(0, p - wide + min(w, wide)), min(p, n - wide) + 1)})
            if not begins:
                continue
            items = self.of_size[size]
            lo, hi = begins[0], begins[-1] + wide
            grams = self.shingles(words[lo:hi], wide if wide < w else hi - lo) if wide >= w else [self.shingles(words[b : b + wide], wide)[0] for b in range(lo, hi - wide + 1)]
            span = max(1, wide - w + 1)
            sums = np.vstack([np.zeros(64), np.cumsum(self._signs(grams), axis=0)])
            b = np.array(begins) - lo
            prints = np.packbits(sums[b + span] - sums[b] > 1e-9, axis=1).view(np.uint64).ravel()
            block = prints.view(np.uint8).reshape(-1, 8)
            near = np.zeros((len(b), len(items)), bool)
            for k in range(BLOCKS):
                near |= self.close[k][block[:, k]][:, items]
            i, j = np.nonzero(near)
            ok = np.bitwise_count(prints[i] ^ self.prints[items[j]]) <= self.radius
            bags: dict[int, Counter] = {}
            for x, k in zip(i[ok].tolist(), items[j[ok]].tolist(), strict=True):
                bag = bags.get(x) or bags.setdefault(x, Counter(grams[b[x] : b[x] + span]))
                s = self.similarity(bag, k)
                if s >= least and (k not in best or (-s, begins[x]) < (-best[k][0], best[k][1])):
                    best[k] = (s, begins[x], wide)
        return [(k, at, wide, s) for k, (s, at, wide) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of the best window of each leaked item in each document."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes)
    ddl = "doc_id long, item_id long, first_word int, n_words int, similarity double"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    found = []
    counted = written(item_shingles(items, width).groupBy("name").agg(F.count("*").alias("n")), "leak-shingles")
    every = (counted.where("name is null").first() or (None, 0))[1]
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        rows = [(r.item_id, r.text) for r in own.collect()]
        # at most the part's own shingles
        often = {r.name: r.n for r in item_shingles(own, width).where("name is not null").distinct().join(counted.where("n > 1"), "name").collect()}
        rows = sorted((r for r in rows if tokens(r[1])), key=lambda r: (r[0] is not None, r[0], r[1]))
        if not rows:
            continue
        index = spark.sparkContext.broadcast((rows, width, radius, every, often))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = Index(*index.value)
            for b in batches:
                out = [(d, ix.ids[k], at, n, s) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, at, n, s in ix.matches(t, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found.append(docs.select("doc_id", "text").mapInArrow(scan, ddl))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ddl)
