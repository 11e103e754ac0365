"""Spelling variants: bidirectional FM-index search schemes over the delimited vocabulary.

``vocabulary`` counts words over whole texts, batch by batch and then in Spark. Two words are near if one inserted,
deleted or replaced code point turns one into the other. If m is the shorter one's length, such words share their first
m // 2 code points or their last m - m // 2. So there are two searches, one for each half: the half is matched exactly,
then the match is extended across the other half with one error. The index has a direction for each: suffixes of the
words to extend to the left, suffixes of the reversed words to extend to the right. It is split into shards by the half
that its words can be matched by, so near words meet in a shard for one of the halves at least (the second search
reports only what the first can't see). A shard is an FM-index of its words between delimiters: suffixes in order, the
symbol before each, and for each symbol the sorted ranks it stands at, so that extending an interval of suffix ranks is
two binary searches. All of a shard's queries move together, one code point a step; an error's symbols are read from the
interval where it is narrow, else all are tried.

A half that more than ``SHARD`` words share is dealt to cells, each with a part of its words as the index and a part of
them as queries. So no task holds more than some shards' worth of words, whatever half is frequent.

``near_words`` gives near words by word, ``variants`` each word's form (its near word of the largest count, if that is
``ratio`` times its own) and root (what forms lead to; counts grow by that ratio, so chains are short).

Defined cases: null text has no words; a null doc_id is written as nothing; repeated rows count again; ties of counts go
to the smallest word in code-point order; words of any length; other columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import ramp
from .common import arrow_batches, lower_ascii, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a shard's index, about; words counted at a time in a task.
SHARD, COUNTED = 40_000, 200_000
#: Letters of an interval that are read from it; where it is wider every letter is tried.
NARROW = 48


def planted(doc_id: int | None, run: str, every: int) -> str:
    """The run, less a code point where the row's and run's checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % every == 0 else run


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of ``shortest`` code points or more that occur ``least`` times or more, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, n in Counter(w for w in RUN.findall(lower_ascii(text or "")) if len(w) >= shortest).items():
                    held[planted(doc_id, word, every)] += n
            if len(held) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    with arrow_batches(docs.sparkSession):
        counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return written(counts.where((F.col("n") >= least) & (F.length("word") >= shortest)), "words")


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words on end, lengths)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


class Index:
    """FM-index of words between delimiters, for matches that grow to the left."""

    def __init__(self, words: list[str]):
        flat, size = codes(words)
        self.letters = np.unique(flat)
        self.n = len(flat) + len(words)
        ends = np.cumsum(size + 1) - 1
        text = np.zeros(self.n, np.int64)  # 0: the delimiter behind a word
        body = np.ones(self.n, bool)
        body[ends] = False
        text[body] = np.searchsorted(self.letters, flat) + 1
        self.word = np.repeat(np.arange(len(words)), size + 1)
        left = np.repeat(ends, size + 1) - np.arange(self.n)  # symbols up to the delimiter
        # ranks of suffixes up to their delimiter by doubling; equal ones are ordered by word
        rank, step = text, 1
        most = int(left.max(initial=0)) + 1
        while step < most:
            after = np.where(left >= step, rank[np.minimum(np.arange(self.n) + step, self.n - 1)] + 1, 0)
            _, rank = np.unique(rank * (self.n + 2) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank * len(words) + self.word, kind="stable")
        before = np.where(order == 0, 0, text[order - 1])  # at a word's first symbol: the delimiter of the word before
        self.suffix_word = self.word[order]
        self.before = before
        # the ranks at which a symbol stands, symbol by symbol: where symbol * n1 + rank falls in it is the next interval's bound
        at = np.argsort(before, kind="stable")
        self.at, self.n1 = at, self.n + 1
        self.key = before[at] * self.n1 + at
        self.sigma = len(self.letters) + 1
        # suffixes that begin with a symbol, in order, are those whose predecessor symbols stand in the same order
        self.first = np.searchsorted(np.sort(text), np.arange(self.sigma + 1))
        self.skip = self.first - np.searchsorted(self.key, np.arange(self.sigma + 1) * self.n1)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol on their left; empty for symbols (-1) that no word has."""
        s = np.maximum(symbol, 0)
        lo2 = np.searchsorted(self.key, s * self.n1 + lo) + self.skip[s]
        hi2 = np.searchsorted(self.key, s * self.n1 + hi) + self.skip[s]
        return lo2, np.where(symbol < 0, lo2, hi2)

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The word that an interval's match is the whole of, or -1: a suffix whose predecessor is a delimiter."""
        at = np.searchsorted(self.key, lo)  # delimiters come first among the keys
        safe = np.minimum(at, len(self.key) - 1)
        hit = (at < len(self.key)) & (self.key[safe] < np.minimum(hi, self.n1))
        return np.where(hit, self.suffix_word[self.at[safe]], -1)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter): the letters before each interval's suffixes, once each at least for those that occur."""
        wide = hi - lo > min(NARROW, self.sigma)
        w, k = np.flatnonzero(wide), np.flatnonzero(~wide)
        symbol = self.before[ramp(lo[k], (hi - lo)[k])]
        pair = np.unique(np.repeat(k, (hi - lo)[k]) * self.sigma + symbol)
        pair = np.concatenate([pair[pair % self.sigma > 0], (w[:, None] * self.sigma + np.arange(1, self.sigma)).ravel()])
        return pair // self.sigma, pair % self.sigma


def search(index: Index, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of words that one replaced code point, or one more in the word, makes of a query, left of its last ``exact`` ones.

    A pair may come more than once.
    """
    flat, size = codes(queries)
    at = np.searchsorted(index.letters, flat)
    known = index.letters[np.minimum(at, len(index.letters) - 1)] == flat if len(index.letters) else np.zeros(len(flat), bool)
    symbol, end = np.where(known, at + 1, -1), np.cumsum(size)
    q = np.arange(len(queries))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.first[1])  # suffixes that begin with a delimiter
    done = np.zeros(len(q), np.int64)
    late = [np.zeros(0, np.int64)] * 4  # matches that hold their error: query, lo, hi, symbols of the query done
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q) or len(late[0]):
        # those with an error go on exactly
        eq, elo, ehi, ed = late
        over = ed == size[eq]
        if over.any():
            word = index.whole(elo[over], ehi[over])
            found.append((eq[over][word >= 0], word[word >= 0]))
        eq, elo, ehi, ed = (x[~over] for x in (eq, elo, ehi, ed))
        elo, ehi = index.extend(symbol[end[eq] - 1 - ed], elo, ehi)
        live = ehi > elo
        late = [eq[live], elo[live], ehi[live], ed[live] + 1]
        # an error may be put wherever the exact part is done
        err = np.flatnonzero(done >= exact[q])
        if len(err):
            k, c = index.branches(lo[err], hi[err])
            k = err[k]
            nlo, nhi = index.extend(c, lo[k], hi[k])
            live = nhi > nlo
            k, c, nlo, nhi = k[live], c[live], nlo[live], nhi[live]
            left = done[k] < size[q[k]]
            own = np.where(left, symbol[np.maximum(end[q[k]] - 1 - done[k], 0)], 0)
            put, new = left & (c != own), c != own  # a letter more, equal to the next one, is the same as one further on
            late = [np.concatenate(x) for x in zip(late, (q[k][put], nlo[put], nhi[put], done[k][put] + 1), (q[k][new], nlo[new], nhi[new], done[k][new]), strict=True)]
        # and those without one go on exactly, while symbols are left
        more = done < size[q]
        q, lo, hi, done = q[more], lo[more], hi[more], done[more]
        lo, hi = index.extend(symbol[end[q] - 1 - done], lo, hi)
        live = hi > lo
        q, lo, hi, done = q[live], lo[live], hi[live], done[live] + 1
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (q, q)


def _near_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n), both ways, of a shard: rows (side, word, n, half, indexed, asked)."""
    side, none = int(shard.side.iloc[0]), pd.DataFrame({"word": pd.Series([], dtype=str), "near": pd.Series([], dtype=str), "near_n": pd.Series([], dtype="int64")})
    held, asked = shard[shard.indexed].drop_duplicates("word"), shard[shard.asked].drop_duplicates("word")
    if not len(held) or not len(asked):
        return none
    words, queries, n_words, n_queries = list(held.word), list(asked.word), held.n.to_numpy(), asked.n.to_numpy()
    turned = (lambda x: [w[::-1] for w in x]) if side == 0 else list
    q, w = search(Index(turned(words)), turned(queries), asked.half.to_numpy())
    pair = np.unique(q * len(words) + w)
    q, w = pair // len(words), pair % len(words)
    if side == 1:  # the first search finds those with the same first half
        ok = np.fromiter((queries[i][: len(queries[i]) // 2] != words[j][: len(queries[i]) // 2] for i, j in zip(q, w, strict=True)), bool, len(q))
        q, w = q[ok], w[ok]
    if not len(q):
        return none
    there = pd.DataFrame({"word": [queries[i] for i in q], "near": [words[j] for j in w], "near_n": n_words[w]})
    # words as long as the query are found from both sides, longer ones from the shorter side only
    longer = np.fromiter((len(words[j]) > len(queries[i]) for i, j in zip(q, w, strict=True)), bool, len(q))
    back = pd.DataFrame({"word": there.near[longer], "near": there.word[longer], "near_n": n_queries[q[longer]]})
    return pd.concat([there, back], ignore_index=True)


def near_words(words: DataFrame, shortest: int = 7, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n) for each near word of each of words(word, n): distinct words of ``shortest`` code points or more."""
    m = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= shortest)).alias("m")
    rows = words.select("word", "n", m)
    first = F.expr("m div 2").cast("int")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), first).alias("end"), first.alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", F.length("word") - F.col("m") + first + 1, F.col("m") - first).alias("end"), (F.col("m") - first).cast("int").alias("half"))))
    rows = rows.select("word", "n", "m", ends.alias("x")).select("word", "n", "m", "x.*").withColumn("asked", F.length("word") == F.col("m"))
    rows = written(rows, "halves")
    sizes = rows.groupBy("side", "m", "end").agg(F.count("*").alias("held"))
    # there are fewer such halves than rows / shard
    large = sizes.where(F.col("held") > shard).withColumn("parts", F.ceil(F.col("held") / shard).cast("int")).drop("held")
    rows = rows.join(F.broadcast(large), ["side", "m", "end"], "left")
    bins = max(1, -(-rows.count() // shard))
    alone = rows.where("parts is null").select("side", "word", "n", "half", F.lit(True).alias("indexed"), "asked", F.pmod(F.xxhash64("m", "end"), F.lit(bins)).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("k"))
    home = F.xxhash64("m", "end")
    part = lambda seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.where("parts is not null")
    held = dealt.select("side", "word", "n", "half", F.lit(True).alias("indexed"), F.lit(False).alias("asked"), home.alias("i"), part(1).alias("j"), every.alias("k"))
    asking = dealt.where("asked").select("side", "word", "n", "half", F.lit(False).alias("indexed"), "asked", home.alias("i"), every.alias("j"), part(2).alias("k"))
    shards = alone.unionByName(held).unionByName(asking)
    return shards.groupBy("side", "i", "j", "k").applyInPandas(_near_in_shard, "word string, near string, near_n long")


def variants(words: DataFrame, shortest: int = 7, ratio: int = 10, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n)."""
    # by count first, then by code points: what has the least (-count, word) is the best
    best = near_words(words, shortest, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    out = out.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    out = written(out, "forms")
    # roots: (word, where its forms have led so far); steps double each round
    roots = written(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
