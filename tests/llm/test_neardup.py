import random
import re

import pytest

from kgjobs.llm import neardup
from kgjobs.llm.common import component_labels


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sorted((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, label))


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5))) for _ in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, passage = [], text(60)
    for k in range(12):
        base = text(r.choice([2, 3, 8, 40, 120, 300]))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t))
    rows += [" ".join(text(80) + passage) for _ in range(20)] + ["", None, "  \n", "One", "one", "a B c", "a b c"]
    r.shuffle(rows)
    return [(7 * k + 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("width,percent,block", [(3, 85, 256), (5, 80, 4)])
def test_equals_brute_force(spark, width, percent, block):
    rows = corpus(width)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, id int")
    got = neardup.near_components(df, width, percent, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, width, percent)


@pytest.mark.parametrize("rows_a_part", [8, neardup.HUB_ROWS])
def test_large_group_of_near_copies(spark, monkeypatch, rows_a_part):
    monkeypatch.setattr(neardup, "HUB_ROWS", rows_a_part)  # with 8, every group whose lists sum to over 64 rows is split
    r = random.Random(1)
    base = [str(r.randrange(10**6)) for _ in range(150)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(150)] = str(r.randrange(10**6))
        rows.append((k, " ".join(t)))
    got = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=16).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 85)


def test_empty_repeated_and_null(spark):
    schema = "doc_id long, text string"
    assert neardup.near_components(spark.createDataFrame([], schema)).count() == 0
    got = neardup.near_components(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (2, None)], schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 1, None, True), (2, 0, 2, True)]))


def test_chain_of_versions_in_random_order(spark):
    r = random.Random(6)
    n, words = 1000, [str(r.randrange(10**9)) for _ in range(6060)]
    ids = r.sample(range(5, 10**6), n)
    rows = [(d, " ".join(words[6 * k : 6 * k + 60])) for k, d in enumerate(ids)]  # 50 of 62 shingles shared with the next, 44 of 68 with the one after
    rows += [(1, "by itself"), (2, " ".join(words[-20:]) + " other")]
    got = {x.doc_id: x for x in neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[d].component_id for d in ids} == {min(ids)} and [d for d in ids if got[d].kept] == [min(ids)]
    assert got[1].kept and got[2].kept


def test_components_of_random_graphs(spark):
    r = random.Random(7)
    ids = r.sample(range(10**6), 600)
    edges = [(ids[k], ids[r.randrange(max(0, k - 3), k)]) for k in range(1, 400) if k % 100]  # four long trees
    edges += [(r.choice(ids[400:]), r.choice(ids[400:])) for _ in range(120)] + [(None, ids[0]), (ids[1], None)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = component_labels(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((x.id, x.label) for x in got) == sorted(label.items())


@pytest.mark.parametrize("hot", [10_000, 4])
def test_components_of_stars_and_paths(spark, hot):
    """A star of most nodes, paths and rings, with hubs and labels broadcast and not."""
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 2000)
    edges = [(ids[0], x) for x in ids[1:1200]] + [(ids[k], ids[k + 1]) for k in range(1200, 1500)] + [(ids[k], ids[1500 + (k - 1499) % 400]) for k in range(1500, 1900)] + [(5, 5), (None, 3)]
    got = {r.id: r.label for r in component_labels(spark.createDataFrame(edges, "a long, b long"), hot).collect()}
    groups = [ids[:1200], ids[1200:1500] + [ids[1500]] + ids[1501:1900]]
    assert got == {x: min(g) for g in groups for x in g}
