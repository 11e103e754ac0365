import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kgjobs.llm import lm


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]


@pytest.mark.parametrize("frequent", [40, 100_000])
def test_base_and_counts_equal_brute_force(spark, frequent):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 4) + r.choice(["", "X", str(r.randrange(40))]) for _ in range(r.randint(0, 30)))) for k in range(120)] + [(200, None), (201, ""), (7, "a b"), (7, "a b")]
    got = sorted(map(tuple, lm.score(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int"), frequent, classes=lm.SUFFIXES + 20).collect()))
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(x for d, t in rows if not held(d) for x in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d, held(d), len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks(t))) for d, t in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6
        assert g[6] < 0


def test_model_is_normalised_and_learns(spark):
    pairs = np.random.default_rng(0).integers(0, 50, (30, 30)) ** 2.0
    table = lm.train(pairs)
    assert np.allclose(np.exp(table).sum(1), 1)
    uni = np.log(pairs.sum(0) / pairs.sum())
    assert (pairs * table).sum() > (pairs * uni).sum()


def test_beats_base_on_held_out_text(spark):
    r = random.Random(2)
    tongues = [["".join(r.choice(a) for _ in range(r.randint(1, 3))) for _ in range(40)] for a in ("abcd", "efgh", "ijkl")]
    rows = [(k, " ".join(r.choice(w) for _ in range(40))) for k in range(400) for w in [tongues[k % 3]]]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] * 0.95


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_score_equals_the_models_own_probabilities(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(0, 30)))) for k in range(150)]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(x for d, t in rows if not held(d) for x in toks(t))
    top = sorted(c, key=lambda w: (-c[w], w))
    own = min(20, len(top))
    if top.index("") >= own:
        k = top.index("")
        top[own - 1], top[k] = top[k], top[own - 1]
    cls = lambda w: top.index(w) if w in top[:own] else own + zlib.crc32(w[-2:].encode()) % lm.SUFFIXES
    size = own + lm.SUFFIXES
    pairs = np.zeros((size, size))
    for d, t in rows:
        if not held(d):
            w = toks(t)
            for x, y in zip([""] + w, w):
                pairs[cls(x), cls(y)] += 1
    table = lm.train(pairs)
    total = lambda k: (sum(n for w, n in c.items() if cls(w) == k), sum(cls(w) == k for w in c))
    word = lambda w: 1.0 if cls(w) < own else (c[w] + 0.1) / (total(cls(w))[0] + 0.1 * (total(cls(w))[1] + 1))
    want = {d: sum(table[cls(x), cls(y)] / math.log(10) + math.log10(word(y)) for x, y in zip([""] + toks(t), toks(t))) for d, t in rows}
    for frequent in (25, 100_000):
        got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent, classes=lm.SUFFIXES + 20).collect()
        assert len(got) == len(rows) and all(abs(g.score - want[g.doc_id]) < 1e-3 for g in got)
