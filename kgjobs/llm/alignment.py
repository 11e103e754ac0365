"""Cross-tokenizer alignment: interval coalescing of two tokenizers' byte spans.

Vocabulary A is a byte-level BPE, vocabulary B a SentencePiece one. Both encode a space and the text, so their tokens
tile the same bytes. All tokens of both sides are lexsorted by start and the running maximum of their ends is taken;
where a start reaches the maximum before it a group begins (both sides end there). Within groups tokens are linked:

* ``end``: A and B tokens whose byte ranges end together;
* ``overlap``: A and B tokens whose byte ranges share a byte (``n_overlaps`` counts these in either mode).

``align`` gives a row per document with its groups and its distinct id pairs, from one Arrow pass over the texts; that
table is written, as the corpus-wide counts and the documents' sums over them both read it. ``with_counts`` sums. A pair
that holds one ``HOT``-th of all rows or more is hot: there are ``HOT`` of these at most, so their counts are broadcast
whatever the corpus's size, and what is shuffled to the counts of other pairs has no key of more than that share.

A's merges are those of its ranks (checked when the file is read), so tiktoken's encoder is used, being the faster one
of equal result. B's pieces hold no space behind another character (checked), so a run of spaces and what follows up to
the next space is segmented by itself, and each distinct one once.

Defined cases: null and empty texts, and those whose joined A or B bytes differ from a space and the text, have no
tokens: counts are 0 and the digest is ''. Strings of special tokens are ordinary text. Repeated rows and null ids stay
rows of their own. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, joined_by_share, written

#: Pairs that are broadcast, at most: each holds one HOT-th of the (document, pair) rows or more.
HOT = 200_000
#: Bytes of text that are aligned at a time, and chunks of B that are remembered.
SLICE, REMEMBERED = 1 << 20, 400_000
CHUNK = re.compile(" +[^ ]*")
MASK = (1 << 24) - 1


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """Vocabulary A."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        self.raw = {i: bytes(letters[c] for c in s) for s, i in model["vocab"].items() if all(c in letters for c in s)}
        ranks = {raw: i for i, raw in self.raw.items()}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"][a + b] != 256 + k:
                raise ValueError("ids of the byte-level vocabulary don't follow its merges")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the byte-level vocabulary lacks bytes")
        ranks = {raw: i for raw, i in ranks.items() if i < 256 + len(model["merges"])}
        self.encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(self.raw) + 1, np.int64)
        for i, raw in self.raw.items():
            self.sizes[i] = len(raw)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceSide:
    """Vocabulary B. Distinct chunks (spaces and what follows them) are encoded once and remembered, up to a number."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces hold spaces behind other characters")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.raw = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.space = self.sp.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.size, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per chunk, whether a chunk's bytes come back) of chunks that each begin with a space."""
        if len(self.number) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.forget()
        number = self.number
        new = [c for c in dict.fromkeys(chunks) if c not in number]
        if new:
            # the library puts a space before what it encodes, but not before nothing
            ids = [x if c != " " else [self.space] for c, x in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True)]
            raw = self.raw
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int64)])
            self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
            self.good = np.concatenate([self.good, np.fromiter((b"".join([raw[i] for i in x]) == c.encode() for c, x in zip(new, ids, strict=True)), bool, len(ids))])
        at = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
        begin, size = np.cumsum(self.size) - self.size, self.size[at]
        return self.flat[ramp(begin[at], size)], size, self.good[at]


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide, np.ndarray, np.ndarray]:
    """Both vocabularies, the decimal digits of each id (a row of bytes, the last for a separator) and their number."""
    left, right = ByteSide(a), PieceSide(b)
    n = max(len(left.sizes), len(right.sizes))
    digits = np.zeros((n, len(str(n - 1)) + 1), np.uint8)
    for i in range(n):
        digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
    return left, right, digits, (digits > 0).sum(1)


def ramp(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... (size[k] of them) for each k, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def coalesced(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the groups: tokens in order of start; a group breaks where a start reaches the running maximum of ends."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    return start[np.flatnonzero(np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]]))]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that shares a byte with it, and how many do."""
    first = np.searchsorted(b_end, a_start, side="right")
    return first, np.searchsorted(b_start, a_end, side="left") - first


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _align_slice(texts: list[str | None], vocabularies: tuple[str, str], link: str) -> dict[str, list | np.ndarray]:
    left, right, digits, width = sides(*vocabularies)
    n = len(texts)
    chunks = [CHUNK.findall(f" {t}") if t else [] for t in texts]
    b_ids, b_size, good = right.encode([c for x in chunks for c in x])
    per = np.fromiter(map(len, chunks), np.int64, n)
    of_chunk = np.repeat(np.arange(n), per)
    ok = np.bincount(of_chunk[~good], minlength=n) == 0
    ok &= per > 0
    b_doc = np.repeat(of_chunk, b_size)
    b_ids, b_doc = b_ids[ok[b_doc]], b_doc[ok[b_doc]]
    a = [left.encode(f" {t}") if k else np.zeros(0, np.int64) for t, k in zip(texts, ok, strict=True)]
    n_a = np.fromiter(map(len, a), np.int64, n)
    a_ids, a_doc = np.concatenate([*a, np.zeros(0, np.int64)]), np.repeat(np.arange(n), n_a)
    n_b = np.bincount(b_doc, minlength=n)
    # documents follow each other on one line of bytes; none crosses into the next
    a_end, b_end = np.cumsum(left.sizes[a_ids]), np.cumsum(right.sizes[b_ids])
    a_start, b_start = a_end - left.sizes[a_ids], b_end - right.sizes[b_ids]
    out = {"n_a": n_a, "n_b": n_b}
    if not len(a_ids):
        zero = np.zeros(n, np.int64)
        return out | {"n_groups": zero, "n_overlaps": zero, "sha": [""] * n, "pairs": [zero[:0]] * n, "times": [zero[:0]] * n}
    cut = coalesced(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
    a_group, b_group = np.searchsorted(cut, a_start, side="right") - 1, np.searchsorted(cut, b_start, side="right") - 1
    a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=len(cut))), np.cumsum(np.bincount(b_group, minlength=len(cut)))
    group_doc = a_doc[a_upto - 1]
    out["n_groups"] = np.bincount(group_doc, minlength=n)
    first, many = overlaps(a_start, a_end, b_start, b_end)
    out["n_overlaps"] = np.bincount(a_doc, weights=many, minlength=n).astype(np.int64)

    # the text of groups: A ids, then B ids of each; separators by what follows
    at_a = np.arange(len(a_ids)) + np.concatenate([[0], b_upto])[a_group]
    at_b = np.arange(len(b_ids)) + a_upto[b_group]
    ids, mark = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a_ids, b_ids
    mark[at_a[a_upto - 1]], mark[at_b[b_upto - 1]] = ord("|"), ord(";")
    size = width[ids]
    text = digits[ids]
    text[np.arange(len(ids)), size] = mark
    ends = np.concatenate([[0], np.cumsum(size + 1)])[np.cumsum(n_a + n_b)]
    flat = text[np.arange(text.shape[1]) <= size[:, None]].tobytes()
    out["sha"] = [hashlib.sha256(flat[lo : hi - 1]).hexdigest() if k else "" for lo, hi, k in zip([0, *ends[:-1]], ends, ok, strict=True)]

    if link == "end":
        i, j = a_upto - 1, b_upto - 1
    else:
        i, j = np.repeat(np.arange(len(a_ids)), many), ramp(first, many)
    # distinct (document, pair), and how often
    pair = a_ids[i] << 24 | b_ids[j]
    order = np.lexsort((pair, a_doc[i]))
    pair, doc = pair[order], a_doc[i][order]
    fresh = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
    times, bound = np.diff(np.append(fresh, len(pair))), np.cumsum(np.bincount(doc[fresh], minlength=n))[:-1]
    return out | {"pairs": np.split(pair[fresh], bound), "times": np.split(times, bound)}


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, link: str = "end") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, times), a written table: pairs are A id * 2^24 + B id."""
    if link not in ("end", "overlap"):
        raise ValueError(f"unknown link {link!r}")
    vocabularies = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                x = _align_slice(texts[lo:hi], vocabularies, link)
                links = [int(t.sum()) for t in x["times"]]
                lists = [pa.array(x[k], pa.list_(pa.int64())) for k in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), *(pa.array(x[k], pa.int64()) for k in ("n_a", "n_b", "n_groups")), pa.array(links, pa.int64()), pa.array(x["n_overlaps"], pa.int64()), pa.array(x["sha"], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"])

    with arrow_batches(docs.sparkSession):
        made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<long>")
        return written(made.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_rows, total, best): rows and links that hold an id pair, and whether no pair of its B id has more links. A written table."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.count("*").alias("n_rows"), F.sum("times").alias("total"))
    counts = written(counts.withColumn("b", F.col("pair").bitwiseAND(MASK)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    return written(counts.join(most, "b").select("pair", "n_rows", "total", (F.col("total") == F.col("most")).alias("best")), "pair-best")


def with_counts(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """aligned, less its pairs, with n_best (links whose pair has the most links of its B id) and count_sum (its links' counts)."""
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    each = joined_by_share(each, pair_counts(aligned), "pair", hot)
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "n_overlaps")


def alignments(docs: DataFrame, vocabularies: tuple[str, str] | None = None, link: str = "end") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps), one row per document."""
    return with_counts(align(docs, vocabularies, link))
