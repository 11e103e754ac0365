"""Token counts: offset-mapped attribution of a document's tokens to its sections.

Each document is encoded once, whole. A byte-level vocabulary's tokens tile the text's bytes, so the running sum of
their lengths is every token's span; a token's first character is the one that holds its first byte. Sections (lines,
with the newline that ends them) are spans of characters. The interval join is a binary search of token spans in
section bounds. A token that crosses a bound goes to one section by ``rule``:

* ``first``: the section of its first character;
* ``most``: the section that holds most of its bytes, the earlier of equals.

So section counts add up to the document's count.

Defined cases: null text is empty; an empty text has one empty section of 0 tokens; a last line without newline is a
section, an empty one behind a final newline is not; strings of special tokens are ordinary text; repeated rows stay;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """(encoding, bytes per token id) of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(raw: bytes, sizes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) in characters and token count of each line; sizes are the tokens' lengths in bytes."""
    a = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(a == 10) + 1
    if not len(ends) or ends[-1] < len(a):
        ends = np.append(ends, len(a))
    stop = np.cumsum(sizes)
    start = stop - sizes
    # a token may begin inside a character: its first character's first byte is no continuation byte
    lead = (a & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    head = np.flatnonzero(lead)[chars[start] - (~lead[start]).astype(np.int64)] if len(start) else start
    line = np.searchsorted(ends, head, side="right")
    if rule == "most" and len(start):
        last = np.searchsorted(ends, stop - 1, side="right")
        for k in np.flatnonzero(line != last):
            parts = [(min(stop[k], ends[x]) - max(start[k], ends[x - 1] if x else 0), -x) for x in range(line[k], last[k] + 1)]
            line[k] = -max(parts)[1]
    begins = np.concatenate([[0], ends[:-1]])
    return chars[begins], chars[ends], np.bincount(line, minlength=len(ends))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "first") -> DataFrame:
    """(doc_id, section, begin, end, n_tokens, doc_tokens): one row per line of each document; spans are half-open, in code points."""
    if rule not in ("first", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    vocabulary = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(vocabulary)
        for b in batches:
            ids, cols = b.column("doc_id"), []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for t in texts:
                cols.append(attribute(t.encode(), sizes[np.array(encoding.encode_ordinary(t), np.int64)], rule))
            n = np.array([len(c[0]) for c in cols], np.int64)
            if not len(n):
                continue
            at = np.repeat(np.arange(len(n)), n)
            section = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            begin, end, count = (np.concatenate([c[k] for c in cols]).astype(np.int64) for k in range(3))
            total = np.array([c[2].sum() for c in cols], np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(section.astype(np.int32)), pa.array(begin), pa.array(end), pa.array(count), pa.array(total[at])], names=["doc_id", "section", "begin", "end", "n_tokens", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, begin long, end long, n_tokens long, doc_tokens long")
