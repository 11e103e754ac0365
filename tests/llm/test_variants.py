import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kgjobs.llm import variants as v


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode()) & 0xFFFFFFFF
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n):
    out, form = {}, {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = [form[w], n[w], len(close), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def made(seed, n=400, alphabet="abcé"):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(alphabet, k=rng.randint(7, 11)))
        out.add(w)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            if len(w) >= 7:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize("shard", [v.SHARD, 30, 4])
def test_near_words_equal_brute_force(spark, shard):
    """Shards of all words, of some, and halves dealt to cells; runs of one letter give the same word in many ways."""
    words = sorted({*made(1), *made(2, 100, "xy"), "a" * 7, "a" * 8, "a" * 9, "ab" * 4, "ab" * 4 + "a", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499, "ÀÞ÷×ßÿþ", "ÀÞ÷×ßÿ÷"})
    n = {w: k % 7 + 2 for k, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((a, b, n[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b))
    assert sorted(map(tuple, v.near_words(df, shard=shard).collect())) == want and len(want) > 700


def test_index_intervals():
    words = made(3, 60)
    index = v.Index(words)
    text = "".join(w + "$" for w in words)
    suffixes = sorted((text[i : text.index("$", i)], text[:i].count("$"), i) for i in range(len(text)))
    assert index.suffix_word.tolist() == [w for _, w, _ in suffixes]
    lo, hi = np.array([0]), np.array([index.n])
    pattern = words[5][2:6]
    for c in reversed(pattern):
        lo, hi = index.extend(np.searchsorted(index.letters, [ord(c)]) + 1, lo, hi)
    assert (lo[0], hi[0]) == (min(k for k, s in enumerate(suffixes) if s[0].startswith(pattern)), max(k for k, s in enumerate(suffixes) if s[0].startswith(pattern)) + 1)


def test_variants_of_documents(spark):
    rng = random.Random(4)
    words = made(5, 150)
    text = lambda: " ".join((lambda w: rng.choice([w, w.upper(), w + "1", f"({w})"]))(words[min(int(rng.paretovariate(0.4)), len(words)) - 1]) for _ in range(60))
    rows = [(k if k % 50 else None, text()) for k in range(500)] + [(3, None), (4, ""), (5, "short words only"), (6, "Q" * 50_000), (6, "Q" * 50_000), (7, "naïveté naïvété NAÏVETÉ")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute(counted(rows))
    for shard in (v.SHARD, 40):
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in v.variants(v.vocabulary(df), shard=shard).collect()}
        assert got == want
    assert sum(x[0] is not None for x in want.values()) > 10 and any(x[1] != x[0] is not None for x in want.values())
    assert v.variants(v.vocabulary(df.limit(0))).count() == 0


def test_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = counted([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r["word"]: r for r in v.variants(v.vocabulary(docs)).collect()}
    assert {w: r["n"] for w, r in got.items()} == n
    for w in sorted(n)[::37]:
        assert got[w]["n_near"] == sum(abs(len(x) - len(w)) < 2 and near(w, x) for x in n)
