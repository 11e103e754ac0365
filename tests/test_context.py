"""Operators whose queries have no SQL, or whose branches the driver tables don't reach."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgjobs.operators import checks, context, graph, ingest, retrieval


@pytest.mark.parametrize("n", [300, 3000])
def test_synthetic_corpus_is_found_again(spark, n):
    rules, cases = context.synthetic_corpus(spark, n, 20)
    kept, _ = context.compile_context(cases.select("query", "task", "concepts"), rules, spark.createDataFrame([], "src string, rel string, dst string"))
    ranked = kept.select(F.col("query").alias("case"), (F.row_number().over(__import__("pyspark").sql.Window.partitionBy("query").orderBy("pos"))).alias("rank"), "id")
    want = cases.select(F.col("query").alias("case"), F.explode("expected").alias("id"))
    small = want.groupBy("case").count().where("count <= 10").select("case")
    got = retrieval.retrieval_metrics(ranked, want.join(small, "case"), 10).agg(F.min("recall"), F.count("*")).first()
    assert got[0] == 1.0 and got[1] > 10


def test_synthetic_corpus_mixes_as_defined(spark):
    def mixed(i, salt):
        x = (i * 2654435761 + salt * 40503 + 2166136261) & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 2246822519 & 0xFFFFFFFF
        return x ^ x >> 13

    rules, cases = context.synthetic_corpus(spark, 500, 7, seed=3)
    topic = [mixed(i, 10) % 100 for i in range(500)]
    got = {r.n: r for r in rules.collect()}
    assert all(got[i].tags == [f"tag-{i % 12}", f"topic-{topic[i]}"] and got[i].domain == f"dom-{mixed(i, 6) % 24}" for i in range(500))
    order = list(dict.fromkeys(topic))
    want = {f"case-{j}": [f"bench-{i}" for i in range(500) if topic[i] == order[mixed(j, 14) % len(order)]][:20] for j in range(7)}
    assert {r.query: r.expected for r in cases.collect()} == want


def test_compile_context_expands_and_adds_world_knowledge(spark):
    rules = spark.createDataFrame([("a", "Rule", "d", "High", ["x"], "A" * 50), ("b", "Rule", "d", "Low", [], "B"), ("c", "Rule", "d", "Low", ["x"], "C"), ("w", "WorldKnowledge", "topics", "Low", [], "W"), ("big", "Rule", "d", "Critical", ["x"], "Z" * 13000)], "id string, type string, domain string, priority string, tags array<string>, body string")
    rel = spark.createDataFrame([("a", "CONFLICTS_WITH", "c"), ("a", "EXCEPTION_FOR", "b")], "src string, rel string, dst string")
    edges = spark.createDataFrame([("b", "REQUIRES", "a", None)], "src string, rel string, dst string, valid_until timestamp")
    q = spark.createDataFrame([(1, "about x", ["topic"])], "query long, task string, concepts array<string>")
    kept, text = context.compile_context(q, rules, rel, edges, world=rules.where("type = 'WorldKnowledge'"))
    assert [r.id for r in kept.orderBy("pos").collect()] == ["a", "b", "w"]
    got = text.first().text
    assert got.startswith("## Active Knowledge Rules\n\n### [Rule] a\n") and got.endswith("## Active Exceptions\n- Rule 'a' is an exception for 'b'")


def test_markdown_files_and_records(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("---\nid: r1\ntitle: T\ntags:\n  - one\n  - two\nappliesTo: [py, cs]\nvalidatorScript: |\n  import re\n\n  x = 1\npriority: High\n---\n\n# Body\ntext\n")
    (tmp_path / "bad.md").write_text("---\ntitle: no id\n---\nbody")
    (tmp_path / "none.md").write_text("just text")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.read_markdown_rules(spark, str(tmp_path)).collect()}
    r = got["a.md"]
    assert (r.id, r.tags, r.applies_to, r.script, r.priority, r.domain, r.body) == ("r1", ["one", "two"], ["py", "cs"], "import re\n\nx = 1", "High", "general", "# Body\ntext")
    assert got["bad.md"].id is None and got["none.md"].id is None
    (tmp_path / "t.csv").write_text('Key,Name,Note\nk1,"a ""b""",n\n,c\n')
    (tmp_path / "t.json").write_text('[{"id": "7", "text": "# hi\\nyou"}, {"x": "y"}]')
    csv = sorted((x.id, x.title, x.body) for x in ingest.import_records(spark, f"{tmp_path}/t.csv", "A B").collect())
    assert csv == [("upload:a-b:1", "c", "name: c"), ("upload:a-b:k1", 'a "b"', 'key: k1\nname: a "b"\nnote: n')]
    js = sorted((x.id, x.title, x.body) for x in ingest.import_records(spark, f"{tmp_path}/t.json", "j").collect())
    assert js == [("upload:j:1", "x: y", "x: y"), ("upload:j:7", "hi", "# hi\nyou")]


def test_checks_and_fixtures(spark):
    code = "try:\n  f()\nexcept ValueError:\n  pass\nexcept:\n  eval ('1'); obj.eval(2)\nq = \"SELECT 1\" + x\n"
    rows = [(rule, "b", 0, code) for rule in checks.APPLIES]
    got = sorted((r.rule, r.line, r.severity) for r in checks.check_code_blocks(spark.createDataFrame(rows, "rule string, id string, n int, code string")).collect())
    assert got == [("coding-no-bare-except", 3, "error"), ("coding-no-bare-except", 5, "warning"), ("security-no-eval-exec", 6, "error"), ("security-no-sql-string-concat", 7, "warning")]
    f = [("security-no-eval-exec", "pass", "regex.exec(x)"), ("security-no-eval-exec", "fail", "eval(x)"), ("coding-no-blocking-async", "fail", "await x")]
    assert {r.rule: r.verified for r in checks.verify_fixtures(spark.createDataFrame(f, "rule string, kind string, code string")).collect()} == {"security-no-eval-exec": True, "coding-no-blocking-async": False}


def test_containing_equals_a_plain_search(spark):
    r = random.Random(3)
    texts = [(k % 40, "".join(r.choice("abé😀 ") for _ in range(r.randint(0, 30)))) for k in range(80)] + [(99, None), (None, "abab")]
    needles = ["".join(r.choice("abé😀 ") for _ in range(r.randint(1, 6))) for _ in range(120)] + ["", "nowhere", texts[0][1], texts[0][1]]
    x, n = spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame([(v,) for v in needles], "needle string")
    for least in (1, 2, 4):
        want = {(k, v) for k, t in texts for v in needles if k is not None and t is not None and len(v) >= least and v in t}
        rows = [tuple(row) for row in context.containing(x.where("key is not null"), n, least).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert context.containing(x.limit(0), n).count() == 0 and context.containing(x, n.limit(0)).count() == 0


def test_violation_text(spark):
    rows = [("info", "r2", "b", 0, 3, "i", None), ("ERROR ", "r1", "b", 0, None, "e", " "), ("odd", "r3", "b", 0, 1, "o", "do x"), ("warning", "r4", "c", 0, 2, "w", "do y")]
    found = spark.createDataFrame(rows, "severity string, rule string, id string, n int, line int, message string, suggestion string")
    got = {r.id: r for r in checks.violation_text(checks.violation_report(found)).collect()}
    b = got["b"]
    assert (b.errors, b.warnings, b.infos, b.others) == (1, 0, 1, 1) and "**3 violation(s)** — 1 error, 0 warning, 1 info, 1 other." in b.text
    assert b.text.index("**Rule: r1** [ERROR ]\n- e\n\n") < b.text.index("**Rule: r2** [INFO] (line 3)\n- i\n\n") < b.text.index("**Rule: r3** [ODD] (line 1)\n- o\n- 💡 Suggestion: do x\n\n")
    assert "**1 violation(s)** — 0 error, 1 warning, 0 info." in got["c"].text and got["c"].text.endswith("fix errors first.\n")
    assert checks.violation_text(checks.violation_report(found.limit(0))).count() == 0


def test_near_memories_go_greedily(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    rows = [(f"u{k % 2}", k, " ".join(r.sample(words, r.randint(6, 10))), __import__("datetime").date(2024, 1, 1 + k % 5)) for k in range(80)]
    got = {x.id for x in graph.dedupe_near(spark.createDataFrame(rows, "owner string, id long, body string, created date"), 0.7).collect()}
    sets, kept = {i: set(re.findall(r"\w+", b)) for _, i, b, _ in rows}, []
    for o, i, _, _ in sorted(rows, key=lambda x: (-x[3].toordinal(), x[1])):
        if not any(o == p and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.7 for p, j in kept):
            kept.append((o, i))
    assert got == {i for _, i in kept} and 10 < len(got) < 75


def test_cycles_are_found(spark):
    rules = spark.createDataFrame([(k,) for k in range(8)], "id long")
    check = lambda edges: tuple(graph.validate_graph(rules, spark.createDataFrame(edges, "src long, dst long")).first())
    assert check([(0, 1), (1, 2), (3, 3), (2, 99)]) == (False, 1)
    assert check([(0, 1), (1, 2), (2, 0), (5, 6)]) == (True, 0)


def test_head_vectors_equal_plain_kmeans(spark):
    r = np.random.default_rng(2)
    rows = [(f"h{k % 3}", k, (r.normal(0, 1, 4) + 5 * (k % 4)).tolist()) for k in range(240)]
    got = {(x.head, x.ord): x.embedding for x in retrieval.build_head_vectors(spark.createDataFrame(rows, "head string, id long, embedding array<double>"), per=20).collect()}
    for h in ("h0", "h1", "h2"):
        v = np.array([e for g, _, e in rows if g == h])
        c = v[:1]
        while len(c) < 4:
            c = np.vstack([c, v[((v[:, None] - c) ** 2).sum(-1).min(1).argmax()]])
        for _ in range(10):
            near = ((v[:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.array([v[near == k].mean(0) for k in range(4) if (near == k).any()])
        want = c / np.linalg.norm(c, axis=1, keepdims=True)
        assert np.allclose(np.array([got[h, k] for k in range(len(c))]), want)


def test_verified_hmac(spark):
    import hashlib
    import hmac

    from kgjobs.functions import hmac_sha256

    x = spark.createDataFrame([("message é",), ("",)], "m string").select("m", hmac_sha256(b"key", F.col("m")).alias("h")).collect()
    assert all(r.h == hmac.new(b"key", r.m.encode(), hashlib.sha256).hexdigest() for r in x)


def test_every_branch_of_the_whole_compilation_is_fed():
    """The registered query's tables reach heads, toolboxes, domains, expansion, hits, edges of both depths, world, suppression and the budget."""
    duckdb = pytest.importorskip("duckdb")
    from kgjobs.plans import compilation

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "events", "part"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    names = ("hq", "bh", "act", "grown", "hits", "d1", "d2", "wor", "gone", "kept")
    n = con.execute(f"{compilation.CONTEXT} select {', '.join(f'(select count(*) from {x}) as {x}' for x in names)}, (select count(*) from rest) - (select count(*) from kept) as over, (select count(*) from kept where pos < 1000000), (select count(*) from kept where pos between 1000000 and 2000000), (select count(*) from kept where pos > 2000000)").fetchone()
    assert all(x > 0 for x in n), dict(zip(names, n, strict=False))


def test_protected_rules_stay(spark):
    from kgjobs.operators import rules

    active = spark.createDataFrame([(1, "a", "High"), (1, "b", "Low"), (1, "c", "Low"), (2, "b", "Low"), (2, "a", "High")], "query long, id string, priority string")
    rel = spark.createDataFrame([("a", "SUPERSEDES", "c"), ("b", "CONFLICTS_WITH", "a")], "src string, rel string, dst string")
    safe = spark.createDataFrame([(1, "b"), (2, "x")], "query long, id string")
    assert sorted((r.query, r.id) for r in rules.suppress_contradictions(active, rel, safe).collect()) == [(1, "a"), (1, "b"), (2, "a")]
    ranked = spark.createDataFrame([(1, 1, "a", 6), (1, 2, "b", 9), (1, 3, "c", 4), (1, 4, "d", 0), (1, 5, "e", 1)], "query long, pos long, id string, size long")
    kept = lambda *ids: sorted(r.id for r in rules.apply_budget(ranked, 10, spark.createDataFrame([(1, i) for i in ids], "query long, id string")).collect())
    assert kept("b") == ["a", "b"] and kept("e") == ["a", "c", "d", "e"] and kept("c") == ["a", "c", "d"]
