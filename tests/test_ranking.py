"""Keyword ranking by groups against brute force over all rules."""

import math
import random
import re

import pytest

from kgjobs.operators import ranking, retrieval


def tokens(s):
    return set(re.findall(r"[^\W_]+", s.lower()))


def brute(rules, queries, active, expanded, multipliers, w=0.5):
    """{query: [(id, score)]}, best first, of all rules that score and may be seen."""
    out = {}
    for q, task, concepts, user, heads, boxes in queries:
        said, named = tokens(task), {c.lower() for c in concepts}
        rows = []
        for i, priority, tags, triggers, domain, owner, head, box in rules:
            if owner not in (None, user) or head is not None and heads and head not in heads or box is not None and boxes is not None and box not in boxes:
                continue
            m = 2.0 * ((q, domain) in active)
            for kind, x in [("t", t.lower()) for t in tags] + [("g", t.lower()) for t in triggers]:
                whole, equal = bool(tokens(x)) and tokens(x) <= said, x in named
                own = (1 * whole + 2 * equal) if kind == "t" else 3 * equal or 1 * whole
                m += own or ((2 if kind == "t" else 3) * w * ((q, x) in expanded))
            if m:
                rows.append((i, {"Low": 1, "High": 3, "Critical": 4}.get(priority, 2) * math.log1p(m) * multipliers.get(i, 1.0)))
        out[q] = sorted(rows, key=lambda x: (-x[1], x[0]))
    return out


def made(seed, n=600):
    rng = random.Random(seed)
    words = ["red", "Blue", "deep blue", "c++", "x-ray view", "go", "sql"]
    tags = lambda: rng.choices(["common", "Common", *words, f"rare-{rng.randrange(150)}"], [6, 1, *[2] * len(words), 3], k=rng.randint(0, 4))
    rules = [(f"r{k:04}", rng.choice(["Low", "Medium", "High", "Critical", "odd"]), tags(), rng.sample(["go", "sql", "ray"], rng.randint(0, 2)), rng.choice(["d1", "d2", "tools.code"]), rng.choice([None, None, "u1", "u2"]), rng.choice([None, "git:a", "git:b"]), None) for k in range(n)]
    rules = [(*r[:7], r[4] if r[4].startswith("tools.") else None) for r in rules]
    queries = [(k, " ".join(rng.sample(["common", "red", "blue", "deep", "view", "x", "ray", "go", "rare", str(rng.randrange(150)), "zzz"], 5)), rng.sample(["SQL", "c++", "go", "nothing", "rare-7"], rng.randint(0, 2)), rng.choice([None, "u1", "u3"]), rng.choice([None, [], ["git:a"]]), rng.choice([None, [], ["tools.code"]])) for k in range(40)]
    return rules, queries, {(k, "d1") for k in range(0, 40, 3)}, {(k, rng.choice(["red", "sql", "common"])) for k in range(0, 40, 2)}, {f"r{k:04}": rng.choice([0.3, 0.9, 1.3]) for k in range(0, n, 4)}


@pytest.mark.parametrize("long_list", [0, 20, 10**6])
def test_k_best_equal_brute_force(spark, long_list):
    """All by groups, some, none: the same k best, the same distinct scores."""
    rules, queries, active, expanded, multipliers = made(1)
    want = brute(rules, queries, active, expanded, multipliers)
    r = spark.createDataFrame(rules, "id string, priority string, tags array<string>, triggers array<string>, domain string, owner string, head string, box string")
    q = spark.createDataFrame(queries, "query long, task string, concepts array<string>, user string, heads array<string>, boxes array<string>")
    pairs = {(k, f"r{j:04}") for k in range(40) for j in range(k, 600, 97)}
    args = dict(active=spark.createDataFrame(sorted(active), "query long, name string"), expanded=spark.createDataFrame(sorted(expanded), "query long, term string"), multipliers=spark.createDataFrame(list(multipliers.items()), "id string, multiplier double"), also=spark.createDataFrame(sorted(pairs), "query long, id string"))
    ranked, levels = ranking.keyword_topk(r, q, 7, **args, long_list=long_list)
    got = {}
    for x in ranked.collect():
        got.setdefault(x["query"], {})[x["id"]] = x["score"]
    for k, rows in want.items():
        keep = rows[:7] + [x for x in rows[7:] if (k, x[0]) in pairs]
        assert {i: round(s, 9) for i, s in got.get(k, {}).items()} == {i: round(s, 9) for i, s in keep}, k
    found = {}
    for x in levels.collect():
        found.setdefault(x["query"], set()).add(round(x["score"], 9))
    assert found == {k: {round(s, 9) for _, s in rows} for k, rows in want.items() if rows}

    # fused with semantic hits, against ranks over whole lists
    rng = random.Random(2)
    hits = [(k, i, round(rng.random(), 1)) for k, i in sorted(pairs) if k % 4]
    fused = ranking.fuse_topk(*ranking.keyword_topk(r, q, 7 + 7, **{**args, "also": spark.createDataFrame(hits, "query long, id string, score double")}, long_list=long_list), spark.createDataFrame(hits, "query long, id string, score double"), 7)
    plain = {}
    for x in fused.collect():
        plain.setdefault(x["query"], []).append((x["rank"], x["id"], round(x["score"], 9), x["hit"]))
    for k, rows in want.items():
        scores, mine = sorted({round(s, 9) for _, s in rows}, reverse=True), {i: s for a, i, s in hits if a == k and i in dict(rows)}
        near = sorted(set(mine.values()), reverse=True)
        value = lambda i, s: (1 / (61 + scores.index(round(s, 9))) + (1 / (61 + near.index(mine[i])) if i in mine else 0)) if mine else s  # noqa: B023, E731
        best = sorted(((i, value(i, s)) for i, s in rows), key=lambda x: (-x[1], x[0]))[:7]
        assert [(n, i, round(s, 9), bool(mine)) for n, (i, s) in enumerate(best, 1)] == sorted(plain.get(k, [])), k


def test_k_best_equal_keyword_score(spark):
    rules, queries, active, expanded, _ = made(3)
    r = spark.createDataFrame(rules, "id string, priority string, tags array<string>, triggers array<string>, domain string, a string, b string, c string")
    q = spark.createDataFrame([x[:3] for x in queries], "query long, task string, concepts array<string>")
    a, e = spark.createDataFrame(sorted(active), "query long, name string"), spark.createDataFrame(sorted(expanded), "query long, term string")
    want = retrieval.top_k(retrieval.keyword_score(r, q, a, e), 10).select("query", "id", "score").collect()
    for long_list in (5, 50):
        got = ranking.keyword_topk(r, q, 10, a, e, long_list=long_list)[0].collect()
        assert sorted((x[0], x[1], round(x[2], 9)) for x in got) == sorted((x[0], x[1], round(x[2], 9)) for x in want)
    assert ranking.keyword_topk(r.limit(0), q, 10)[0].count() == ranking.keyword_topk(r, q.limit(0), 10)[0].count() == 0


def test_common_terms_dont_meet_every_rule(spark):
    """20,000 rules with one tag and 50 queries that name it: queries meet groups and short lists only."""
    r = spark.range(20_000).selectExpr("cast(id as string) as id", "'High' as priority", "array('common', concat('t', id % 5), concat('own', id)) as tags")
    q = spark.range(50).selectExpr("id as query", "concat('common t', id % 5, ' own', id) as task", "array('x') as concepts")
    ranked, _ = ranking.keyword_topk(r, q, 10)
    got = ranked.collect()
    assert len(got) == 500
    base = spark.conf.get("spark.checkpoint.dir")
    import glob
    import os

    last = max(glob.glob(f"{base}/ranking-*"), key=os.path.getmtime)
    rows = lambda name: spark.read.parquet(f"{last}/{name}").count()
    assert rows("exact") <= 50 * 1 and rows("groups") <= 5 and rows("sums") <= 50 * 5
