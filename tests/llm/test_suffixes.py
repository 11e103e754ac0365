import hashlib
import random
from collections import defaultdict

import pytest

from kgjobs.llm import suffixes


def brute(rows, least):
    seen = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(raws):
        for i in range(len(b) - least + 1):
            seen[b[i : i + least]].append((k, i))
    gone = [set() for _ in raws]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + least))
    out = []
    for (d, _), b, g in zip(rows, raws, gone):
        kept = bytes(c for i, c in enumerate(b) if i not in g)
        spans = sum(i - 1 not in g for i in g)
        out.append((d, len(b), len(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, rows = [text(30) for _ in range(3)], []
    for k in range(60):
        t = text(r.randint(0, 60))
        if k % 2:
            t += r.choice(common) + text(r.randint(0, 20))
        if k % 7 == 0:
            t = t + " " + t
        rows.append((k, t))
    for k, (period, n) in enumerate([("of ", 40), ("of ", 90), ("the ", 25), ("the ", 26), ("xyzé ", 17), ("xyzé ", 70), ("q", 64), ("q", 65), ("q", 120), ("abcabd", 40)]):
        rows.append((200 + k, text(r.randint(0, 30)) + (period * n)[r.randint(0, 3) :] + text(r.randint(0, 30))))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, "ab" * 200), (103, "a" * 300), (104, None), (105, ""), (106, "a" * 99), (107, common[0][5:])]
    return rows


@pytest.mark.parametrize("least,most", [(100, 2000), (100, 3), (64, 2000)])
def test_equals_brute_force(spark, least, most):
    rows = corpus(least + most)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sha string")
    got = suffixes.cut_repeats(df, least=least, most=most).drop("kept", "sha", "n_repeated").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, least)


def test_keep_first_leaves_one_copy(spark):
    r = random.Random(2)
    p = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(k, f"{k}" * 5 + p + f"{-k}" * 4) for k in range(5)] + [(9, "lone " + "".join(r.choice("xyz") for _ in range(300)))]
    got = {x.doc_id: x.kept.decode() for x in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True, least=100).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[5][1]
    assert all(len(got[k]) < 20 for k in range(1, 5))


@pytest.mark.parametrize("most", [2000, 3])
def test_keep_first_equals_brute_force(spark, most):
    rows = [r for r in corpus(5) if r[0] not in (100, 101)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    raws, least, seen, want = [(t or "").encode() for _, t in rows], 100, set(), []
    for b in raws:
        gone = set()
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone.update(range(i, i + least))
            seen.add(b[i : i + least])
        want.append(bytes(c for i, c in enumerate(b) if i not in gone))
    got = suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True, least=least, most=most).collect()
    assert [bytes(r.kept) for r in sorted(got)] == want


def test_empty(spark):
    assert suffixes.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [2000, 3])
def test_shorter_repeats_are_counted_in_the_same_pass(spark, most):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.cut_repeats(df, least=120, most=most, report=64).drop("kept").collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, 120)
    assert sorted(((r.doc_id, r.n_bytes, r.n_repeated) for r in got), key=str) == sorted(((d, n, gone) for d, n, gone, _, _ in brute(rows, 64)), key=str)


def test_strings_over_the_end_of_a_run_with_a_shorter_report(spark):
    """A long string that begins deep in a run and ends behind it is found though contexts are cut for the shorter length."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = []
    for period in ("q", "of ", "the same words again ", "x" * 30 + "é", text(32)):
        for size in (260, 399, 700):
            run, behind = (period * 700)[:size], text(150)
            rows += [(len(rows), text(50) + run + behind + text(40)), (len(rows) + 1, text(30) + run[size // 3 :] + behind), (len(rows) + 2, text(9) + run[7:] + behind[:140] + text(70))]
    got = suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=400, report=200).drop("kept", "n_repeated").collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(rows, 400)


def test_nulls_clashing_names_and_long_texts(spark):
    r = random.Random(4)
    p = "".join(r.choice("abcdefgh ") for _ in range(200))
    long = "".join(r.choice("abcdefgh ") for _ in range(300_000)) + p + "é" * 500
    rows = [(None, p + "x", 1, "a", 2), (None, None, 1, "b", 2), (3, "y" + p, 1, "c", 2), (3, "y" + p, 1, "c", 2), (4, long, 1, "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, sha string, n_bytes int")
    got = suffixes.cut_repeats(df, least=100).orderBy("sha").collect()
    assert [(x.doc_id, x.sha, x._id, x.n_bytes, x.n_removed) for x in got] == [
        (None, "a", 1, 201, 200), (None, "b", 1, 0, 0), (3, "c", 1, 201, 201), (3, "c", 1, 201, 201), (4, "d", 1, len(long.encode()), 200 + 1000)]


def test_factors_equal_a_direct_search():
    import numpy as np

    r = np.random.default_rng(3)
    n, reach, top = 120, 6, 10
    group = np.sort(r.integers(0, 8, n))
    before, behind = r.integers(0, 2, (n, reach)).astype(np.uint8), r.integers(0, 2, (n, top)).astype(np.uint8)
    n_before, n_behind = r.integers(0, reach + 1, n), r.integers(1, top + 1, n)
    before[np.arange(reach) >= n_before[:, None]] = 0
    behind[np.arange(top) >= n_behind[:, None]] = 0
    pos = r.permutation(n)
    same = lambda x, y, m: next((k for k in range(m) if x[k] != y[k]), m)
    for keep_first in (True, False):
        got = suffixes.factors(group, before, n_before, behind, n_behind, pos, [5, 9], keep_first)
        for least, (a, b) in zip([5, 9], got):
            for i in range(n):
                hits = [(x, y) for j in range(n) if j != i and group[j] == group[i] and (pos[j] < pos[i] or not keep_first)
                        for x, y in [(same(before[i], before[j], min(n_before[i], n_before[j])), same(behind[i], behind[j], min(n_behind[i], n_behind[j])))] if x + y >= least]
                assert (a[i], b[i]) == (max((x for x, _ in hits), default=-1), max((y for _, y in hits), default=-1))
