"""LM scoring: a log-bilinear neural model learned in numpy with noise-contrastive estimation.

Tokens are lower-cased (A-Z) words, then one end token per document. Words fall into ``CLASSES`` classes: the most
frequent have one each, the others one of ``SUFFIXES`` by a hash of their last two characters. The model is

    P(w | v) = P(class of w | class of v) * (c_w + 0.1) / (c_class + 0.1 (V_class + 1))

(the second factor is 1 for words with a class of their own; an unseen word has c = 0). The class part is log-bilinear,
logit = q_v . r_w + b_w, normalised over all classes: one batched matrix product gives the table of log-probabilities
that every token is looked up in. It is learned by noise-contrastive estimation with the unigram as noise; as the
context is one class, the corpus enters through the counts of class pairs, so the estimate's expectations are taken
exactly, over all learning documents, and training costs the same at any size.

Spark gathers, over all learning documents: word counts (pre-aggregated in tasks, one shuffle), class sums, and counts
of class pairs (CLASSES squared at most). Texts are tokenised for the word counts and once more into a table of codes,
from which pairs and scores come. Of the counts, the ``FREQUENT`` most frequent words and the pair counts reach the
driver. Words beyond those are joined with their counts by a shuffle, so base scores are exact for any vocabulary.

Defined cases: null text is empty, an empty text is the end token alone; a null doc_id is never held out; repeated rows
each count; without learning documents every word is unseen (base: 0.1 / 0.1, that is 0 per token); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, lower_ascii, small_batches, written

CLASSES = 1024
SUFFIXES = 128
FREQUENT = 200_000
DIM = 24
NOISE = 10
STEPS = 150
#: Distinct words that a task adds up before it passes them on.
HOLD = 400_000
#: The end token; no word is empty.
END = ""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(False))


def tokens(text: str | None) -> list[str]:
    out = WORDS.findall(lower_ascii(text or ""))
    out.append(END)
    return out


def suffix_class(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(SUFFIXES)).cast("int")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over docs(text), end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                held.update(tokens(t))
            if len(held) > HOLD:
                yield out()
                held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon(dict):
    """word -> index into the frequent words, or -1 - suffix class; the latter are remembered up to HOLD words."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.size = len(words)
        self.rare: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        k = self.rare.get(word)
        if k is None:
            if len(self.rare) >= HOLD:
                self.rare.clear()
            k = self.rare[word] = -1 - zlib.crc32(word[-2:].encode()) % SUFFIXES
        return k


_lexicons: dict[str, Lexicon] = {}


def lexicon(key: str, words: list[str]) -> Lexicon:
    """The worker's copy for a model, built once."""
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(words)
    return _lexicons[key]


def classes_of(codes: np.ndarray, class_of: np.ndarray, own: int) -> np.ndarray:
    return np.where(codes >= 0, class_of[np.maximum(codes, 0)], own - 1 - codes)


def encoded(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, codes, rare) of docs(doc_id, text): indices of frequent words, -1 - suffix class for others, and those words."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = sent.value
        look = lexicon(key, words)
        for b in batches:
            codes, rare = [], []
            for t in b.column("text").to_pylist():
                w = tokens(t)
                c = np.fromiter(map(look.__getitem__, w), np.int32, len(w))
                codes.append(c)
                rare.append([{"word": x, "n": n} for x, n in Counter([w[i] for i in np.flatnonzero(c < 0).tolist()]).items()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codes, pa.list_(pa.int32())), pa.array(rare, kind)], names=["doc_id", "codes", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, codes array<int>, rare array<struct<word:string,n:long>>")


def flat_classes(lists: pa.ListArray, class_of: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch's texts one after the other, their classes and the classes before; every text ends with the end token."""
    codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    c = classes_of(codes, class_of, own)
    return codes, c, np.concatenate([c[-1:], c[:-1]])


def pair_counts(codes: DataFrame, sent, own: int) -> DataFrame:
    """(before, class, n) of neighbouring tokens' classes in codes(codes); the end token stands before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, size = sent.value, own + SUFFIXES
        total = np.zeros(size * size, np.int64)
        for b in batches:
            _, c, before = flat_classes(b.column("codes"), class_of, own)
            total += np.bincount(before * size + c, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], names=["before", "class", "n"])

    return codes.select("codes").mapInArrow(run, "before int, class int, n long").groupBy("before", "class").agg(F.sum("n").alias("n"))


def train(pairs: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS) -> np.ndarray:
    """Table of natural log P(class | class before) from pair counts, by noise-contrastive estimation.

    Maximises sum n(v, w) log s(x) + noise sum n(v) p(w) log s(-x), x = q_v . r_w + b_w - log(noise p(w)), with Adam.
    """
    size = len(pairs)
    n = pairs / max(1.0, pairs.sum())
    p = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
    context = n.sum(1, keepdims=True)
    r = np.random.default_rng(7)
    par = [r.normal(0, 0.1, (size, dim)), r.normal(0, 0.1, (size, dim)), np.log(p)]
    m, v = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
    # contexts are weighed up, so that rare ones learn as well
    boost = 1 / np.sqrt(context + 1e-7)
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(par[0] @ par[1].T + par[2] - np.log(noise * p), -30, 30)))
        g = (n * (1 - s) - noise * context * p * s) * boost
        grads = [g @ par[1] - 1e-6 * par[0], g.T @ par[0] - 1e-6 * par[1], g.sum(0)]
        for a, d, x, y in zip(par, grads, m, v, strict=True):
            x += 0.1 * (d - x)
            y += 0.01 * (d * d - y)
            a += 0.05 * min(1.0, 2 - 2 * step / steps) * (x / (1 - 0.9**step)) / (np.sqrt(y / (1 - 0.99**step)) + 1e-10)
    logit = par[0] @ par[1].T + par[2]
    top = logit.max(1, keepdims=True)
    return logit - top - np.log(np.exp(logit - top).sum(1, keepdims=True))


def score(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    counts = written(word_counts(docs.where(~held_out(F.col("doc_id")))), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(frequent).toArrow()  # bounded by ``frequent``
    words, c_of = top.column("word").to_pylist(), top.column("c").to_numpy().copy()
    own = min(classes - SUFFIXES, len(words))
    if END in words and words.index(END) >= own:  # the end token always has a class of its own
        k = words.index(END)
        words[own - 1], words[k], c_of[own - 1], c_of[k] = words[k], words[own - 1], c_of[k], c_of[own - 1]
    singles = words[:own]
    # bounded by the number of classes
    sums = {r.k: (r.n, r.v) for r in counts.where(~F.col("word").isin(singles) if singles else F.lit(True)).groupBy(suffix_class(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    class_of = np.array([k if k < own else own + zlib.crc32(w[-2:].encode()) % SUFFIXES for k, w in enumerate(words)], np.int64)
    if not len(class_of):
        class_of = np.zeros(1, np.int64)
    log_c = np.log10(c_of + 0.1) if len(words) else np.zeros(1)
    key = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    # texts are turned into codes once; learning and scoring read the codes
    codes = encoded(docs, spark.sparkContext.broadcast((key, words))).withColumn("row", F.monotonically_increasing_id())
    codes = written(codes, "lm-codes")
    pairs = np.zeros((own + SUFFIXES, own + SUFFIXES))
    counted = pair_counts(codes.where(~held_out(F.col("doc_id"))), spark.sparkContext.broadcast(class_of), own).toArrow()  # bounded by classes squared
    pairs[counted.column("before").to_numpy(), counted.column("class").to_numpy()] = counted.column("n").to_numpy()
    table = (train(pairs) / math.log(10)).astype(np.float32)
    share = np.array([math.log10(sums.get(k, (0, 0))[0] + 0.1 * (sums.get(k, (0, 0))[1] + 1)) for k in range(SUFFIXES)])
    model = spark.sparkContext.broadcast((table, class_of, log_c, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, class_of, log_c, share = model.value
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("codes")
            code, c, before = flat_classes(lists, class_of, own)
            sizes = pc.list_value_length(lists).to_numpy()
            begin = np.cumsum(sizes) - sizes
            of_class = table[before, c].astype(np.float64)
            known = np.where(code >= 0, log_c[np.maximum(code, 0)], 0.0)
            # a word of its own class has nothing to share; rare words' log c comes with the join: it is the same in both scores
            of_word = np.where(c < own, 0.0, known - share[np.maximum(c - own, 0)])
            sums = [np.add.reduceat(x, begin) for x in (known, of_class + of_word)]
            n_known = np.add.reduceat((code >= 0).astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(sizes.astype(np.int64)), pa.array(n_known), *map(pa.array, sums)], names=["doc_id", "row", "n_tokens", "n_known", "base", "s"])

    done = codes.select("doc_id", "row", "codes").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, s double")
    rare = codes.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    out = done.join(rare, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))).alias("base_score"), (F.col("s") + more).alias("score"))
