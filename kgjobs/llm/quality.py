"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Each word, and its shape (runs of letter case, digits and signs), has a sparse random index vector derived from its
hash. A word's vector is its index vector plus the normalised sum of its neighbours' over the learning rows. A document
is the mean of its words' vectors, with that mean's length, the share of distinct words and the log of their number. A
tanh layer and a logistic output, trained in numpy with Adam, give a logit; a temperature fitted on rows set aside makes
it a probability.

Only what is learned is bounded: at most about ``MOST_LABELLED`` labelled rows, chosen by a hash of doc_id, are read
for it. Vectors are built in tasks (SLOTS x DIM numbers each); features of the learning rows and the sums reach the
driver. Every document is then scored on its whole text, in one pass without a shuffle.

Defined cases: null text is empty, and an empty text is scored like any other; labels with a null quality teach
nothing; without labels every score is 0.5, with one class only the share of it; several labels of a document all
count; repeated rows are scored alike; other columns are ignored. Nothing but the text enters a score.

Toxicity (the pipeline's first stage) is a second network of the same kind on labels.toxic, from the same word vectors and
as large a sample. A few words in a long text vanish in a mean, so it also reads the telling words: those of at least
TELLING toxic learning rows whose log odds of being in a toxic row, less DEVIATIONS standard deviations, are above 0. The
network learns from each row by the words that the other half of the rows tells. Without toxic labels nothing is toxic.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, brought_back, discard, lower_ascii, set_aside, small_batches, written

MOST_LABELLED = 20_000
SLOTS = 1 << 14
DIM = 48
SPARSE = 4
HIDDEN = 24
EPOCHS = 40
THRESHOLD = 0.7
#: Words that a worker remembers, some 20 MB: workers live on, and what they hold adds to what later jobs need.
REMEMBER = 100_000
#: Pairs of neighbours that are summed at once.
PAIRS = 50_000
TELLING = 5
DEVIATIONS = 2.5
_RUN = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|([^\x00-\x7F]+)|(.)")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def shape(word: str) -> str:
    """Kinds of character runs: A upper, a lower, 0 digits, x other letters, signs as they are (at most 8 runs)."""
    return "".join("A" * (len(m[1]) > 1) + "A" if m[1] else "a" if m[2] else "0" if m[3] else "x" if m[4] else m[5] for m in islice(_RUN.finditer(word), 8))[:8]


def index_vectors() -> np.ndarray:
    """A sparse vector of SPARSE signs for each slot, from a fixed seed."""
    r = np.random.default_rng(11)
    out = np.zeros((SLOTS, DIM), np.float32)
    for _ in range(SPARSE):
        out[np.arange(SLOTS), r.integers(0, DIM, SLOTS)] += r.choice(np.array([-1, 1], np.float32), SLOTS)
    return out


class Slots(dict):
    """word -> slot of the word * SLOTS + slot of its shape, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        s = self[word] = zlib.crc32(lower_ascii(word).encode()) % SLOTS * SLOTS + zlib.crc32(b"shape" + shape(word).encode()) % SLOTS
        return s


_slots = Slots()


def _codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = WORDS.findall(text or "")
    both = np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))
    return both // SLOTS, both % SLOTS


def features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    words, shapes = _codes(text)
    n = len(words)
    if not n:
        return np.zeros(2 * DIM + 4, np.float32)
    # counts of slots times their vectors: bounded whatever the text's length
    a, na = np.unique(words, return_counts=True)
    b, nb = np.unique(shapes, return_counts=True)
    pooled = [na.astype(np.float32) @ vectors[a] / n, nb.astype(np.float32) @ vectors[b] / n]
    return np.concatenate([*pooled, [np.linalg.norm(pooled[0]), np.linalg.norm(pooled[1]), len(a) / n, math.log1p(n) / 8]]).astype(np.float32)


def _add_pairs(total: np.ndarray, index: np.ndarray, words: list[np.ndarray], others: list[np.ndarray]) -> None:
    """total[word] += index[other] for all pairs. The terms are small whole numbers, so sums are exact in any order."""
    at, what = np.concatenate(words), np.concatenate(others)
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    total[at[starts]] += np.add.reduceat(index[what[order]], starts, axis=0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), np.zeros((SLOTS, DIM), np.float32)
    words, others, held = [], [], 0
    for b in batches:
        for t in b.column("text").to_pylist():
            slots, _ = _codes(t)
            for k in range(0, len(slots) - 1, PAIRS):  # neighbours on either side, in slices
                w = slots[k : k + PAIRS + 1]
                words += [w[:-1], w[1:]]
                others += [w[1:], w[:-1]]
                held += 2 * len(w) - 2
                if held >= PAIRS:
                    _add_pairs(total, index, words, others)
                    words, others, held = [], [], 0
    if held:
        _add_pairs(total, index, words, others)
    yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})


def word_vectors(sample: DataFrame) -> np.ndarray:
    index = index_vectors()
    # six tables of SLOTS x DIM numbers (3 MB each), whatever the input
    parts = sample.repartition(6).mapInArrow(_neighbours, "total binary").collect()
    total = sum((np.frombuffer(r.total, np.float32).reshape(SLOTS, DIM) for r in parts), np.zeros((SLOTS, DIM), np.float32))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return index + 2.0 * total / np.maximum(norm, 1e-6) * (norm > 0)


class Network:
    """x -> logit / temperature of tanh(x W + b) v + c."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        r = np.random.default_rng(5)
        self.p = [r.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.2, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
        z = (x - self.mean) / self.std
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(r.permutation(learn), max(1, len(learn) // 128)):
                h = np.tanh(z[rows] @ self.p[0] + self.p[1])
                d = (_sigmoid(h @ self.p[2] + self.p[3]) - y[rows]) / len(rows)
                back = d[:, None] * self.p[2] * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                step += 1
                for p, g, a, b in zip(self.p, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logit, t = self.logit(x[aside]), np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, np.where(y[aside] > 0.5, -1, 1) * logit / k)) for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, column) of about ``most`` labelled documents outside the held-out fold, written, as it is read more than once."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(fold(F.col("doc_id"), 4) != 2)
    n = known.count()
    share = min(1.0, most / max(1, n))
    # about ``most`` rows of two numbers each: a bounded broadcast
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    return written(docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", column), f"{column}-sample")


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """A scorer (vectors, network) from labels(doc_id, quality) outside the held-out fold; network is a number where there is nothing to tell apart."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, "quality", most)
    vectors = word_vectors(sample)
    sent = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, sent.value).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    rows = sample.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    discard(sample)
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.x)))
    y = np.array([float(r.quality >= 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return vectors, float(y.mean()) if len(y) else 0.5
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float)
    aside = np.array([zlib.crc32(f"aside {r.doc_id}".encode()) % 5 == 0 for r in rows])
    return vectors, Network(x, y, aside)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double and predicted int."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            s = np.full(len(texts), network) if isinstance(network, float) else network.score(np.stack([features(t, vectors) for t in texts]).astype(float)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("_aside"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["_aside", "score", "predicted"])

    rows = set_aside(docs, "text")
    return brought_back(rows.mapInArrow(run, rows.select("_aside").schema.add("score", "double").add("predicted", "integer")), docs, "score", "predicted")


def bare_words(text: str | None) -> set[str]:
    """Words in lower case without signs around them, and the empty one."""
    return {lower_ascii(w).strip(string.punctuation) for w in set(WORDS.findall(text or ""))} | {""}


def _half(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) % 2


def _log_odds(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of a word in a toxic and b other rows, less DEVIATIONS standard deviations; at least 0, 0 if rare."""
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    return np.where(a >= TELLING, np.maximum(0, odds - DEVIATIONS * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), 0)


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a batch have a word, by half and label."""
    for b in batches:
        counts: dict[str, list[int]] = {}
        for d, t, toxic in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for w in bare_words(t):
                counts.setdefault(w, [0] * 4)[2 * _half(d) + (toxic >= 1)] += 1
        n = np.array(list(counts.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(n[:, k]) for k in range(4)]], names=["word", "n0", "n1", "n2", "n3"])


def telling_words(sample: DataFrame) -> list[dict[str, float]]:
    """word -> log odds from half 0 of sample(doc_id, text, toxic), from half 1, and from both."""
    spoken = sample.mapInArrow(_spoken, "word string, n0 long, n1 long, n2 long, n3 long")
    counted = spoken.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    rows = counted.where((F.col("n1") + F.col("n3") >= TELLING) | (F.col("word") == "")).orderBy("word").collect()
    if not rows:
        return [{}, {}, {}]
    n = np.array([r[1:] for r in rows], float)  # the empty word comes first and is in every row
    out = []
    for clean, toxic in ((n[:, 0], n[:, 1]), (n[:, 2], n[:, 3]), (n[:, 0] + n[:, 2], n[:, 1] + n[:, 3])):
        odds = _log_odds(toxic, clean, toxic[0], clean[0])
        out.append({r.word: float(o) for r, o in zip(rows, odds, strict=True) if o > 0})
    return out


def toxic_features(text: str | None, told: dict[str, float], x: np.ndarray) -> np.ndarray:
    """x = features(text, vectors), the highest log odds of a telling word, and the log of how many there are."""
    found = [told[w] for w in bare_words(text) if w in told]
    return np.concatenate([x, [max(found, default=0.0), math.log1p(len(found))]]).astype(np.float32)


def learn_toxic(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MOST_LABELLED):
    """A scorer (telling words, network) of toxicity from labels(doc_id, toxic) outside the held-out fold; network is a number as in learn()."""
    sample = _sample(docs, labels, "toxic", most)
    told = telling_words(sample)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, told = sent.value
        for b in batches:
            x = [toxic_features(t, told[1 - _half(d)], features(t, vectors)).tobytes() for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.binary())], names=["doc_id", "toxic", "x"])

    rows = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "doc_id long, toxic int, x binary").collect()
    discard(sample)
    rows.sort(key=lambda r: (r.doc_id, r.toxic, bytes(r.x)))
    y = np.array([float(r.toxic >= 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return told[2], float(y.mean()) if len(y) else 0.0
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float)
    aside = np.array([zlib.crc32(f"aside {r.doc_id}".encode()) % 5 == 0 for r in rows])
    return told[2], Network(x, y, aside)


def accepted(docs: DataFrame, model, toxic, threshold: float = THRESHOLD) -> DataFrame:
    """The docs whose quality scores at least threshold and whose toxicity scores less; features are made once for both."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, good), (told, bad) = sent.value
        for b in batches:
            texts = b.column("text").to_pylist()
            if not texts:
                continue
            x = [features(t, vectors) for t in texts]
            s = np.full(len(x), good) if isinstance(good, float) else good.score(np.stack(x).astype(float))
            u = np.full(len(x), bad) if isinstance(bad, float) else bad.score(np.stack([toxic_features(t, told, v) for t, v in zip(texts, x, strict=True)]).astype(float))
            yield b.filter(pa.array((s >= threshold) & (u < threshold)))

    return docs.mapInArrow(run, docs.schema)
