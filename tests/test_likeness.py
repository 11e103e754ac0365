"""Pairs of like token sets against brute force, in many slices, groups and sizes."""

import datetime
import random

import pytest

from kgjobs.operators import graph, likeness

MEMORY = "owner string, id long, body string, created date"


def memories(rng, n):
    day, rows, words = datetime.date(2024, 1, 1), [], [f"w{k}" for k in range(400)]
    for k in range(n):
        if rows and rng.random() < 0.6:  # a copy with some words changed, in another order and case
            body = (rng.choice(rows)[2] or "w1").lower().replace(",", " ").split()
            body = [w for w in body if rng.random() > 0.08] + [f"x{rng.randrange(9)}"] * (rng.random() < 0.5)
            rng.shuffle(body)
        else:
            body = rng.sample(words, rng.choice([1, 2, 5, 9, 40, 120]))
        rows.append((rng.choice(["u", "v", None] if rng.random() < 0.1 else ["u", "v"]), k, rng.choice([" ", ", "]).join(body).upper() if body else None, rng.choice([None, day, day + datetime.timedelta(rng.randrange(5))])))
    return rows


def brute(rows, above):
    sets = [(o, (0, 9**9) if c is None else (0, (datetime.date(9999, 12, 31) - c).days), k, frozenset((b or "").lower().replace(",", " ").split())) for o, k, b, c in rows]
    key = lambda x: (x[1], x[2])
    sets = sorted((x for x in sets if x[0] and x[3]), key=key)
    return [(x[0], x[2], y[2]) for i, x in enumerate(sets) for y in sets[i + 1 :] if x[0] == y[0] and len(x[3] & y[3]) / len(x[3] | y[3]) > above]


@pytest.mark.parametrize("above,slices,heavy", [(0.8, 10**9, 10**9), (0.8, 200, 40), (0.5, 500, 10**9), (0.95, 10**9, 7)])
def test_pairs_and_losers_equal_brute_force(spark, monkeypatch, above, slices, heavy):
    monkeypatch.setattr(likeness, "SLICE", slices)
    monkeypatch.setattr(likeness, "HEAVY", heavy)
    monkeypatch.setattr(likeness, "GROUP", 30)
    monkeypatch.setattr(likeness, "FREQUENT", 50)
    monkeypatch.setattr(likeness, "WORDS", 4096)
    rows = memories(random.Random(int(above * 100) + heavy), 260)
    df = spark.createDataFrame(rows, MEMORY)
    want = brute(rows, above)
    got = [tuple(x) for x in graph.similar_pairs(df, above).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40
    lost = set()
    for _, a, b in want:  # in the order of a; all pairs with an a have been seen when it comes
        if a not in lost:
            lost.add(b)
    assert {x.id for x in graph.dedupe_near(df, above).collect()} == {x[1] for x in rows} - lost


def test_new_facts_supersede_old_memories(spark):
    rows = memories(random.Random(5), 200)
    old, new = [x for x in rows if x[1] % 2], [x for x in rows if x[1] % 2 == 0 or x[1] < 9]  # some facts are there already
    every, pairs = graph.remember(spark.createDataFrame(old, MEMORY), spark.createDataFrame(new, MEMORY), 0.7)
    want = [(a, b) if a % 2 == 0 else (b, a) for _, a, b in brute(rows, 0.7) if (a + b) % 2]
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len(want) > 10
    assert every.count() == 200 and every.columns == ["owner", "id", "body", "created"]


def test_nothing_is_alike(spark):
    none = spark.createDataFrame([("u", 1, None, None), (None, 2, "a", None), ("u", 3, "--", None)], MEMORY)
    assert graph.similar_pairs(none, 0.8).count() == 0 and graph.dedupe_near(none, 0.8).count() == 3
    same = spark.createDataFrame([("u", 1, "a b", None), ("u", 2, "B a", None)], MEMORY)
    assert graph.similar_pairs(same, 1.0).count() == 0 and graph.dedupe_near(same, 1.0).count() == 2
