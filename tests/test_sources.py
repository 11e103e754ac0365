"""Files as sources and sinks."""

import csv
import io
import json
import os
import random

import pytest

from kgjobs.operators import ingest
from kgjobs.sources import records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def objects(seed, n=300):
    rng = random.Random(seed)
    odd = ['}{"', "\\", '\\"}', "[{", "é\n日", "a,b", "}" * 50, ""]
    return [{"k": k if k % 3 else None, "text": "".join(rng.choices(odd, k=rng.randint(0, 6))), "in": [{"x": rng.choice(odd)}, [1, {"y": 2}]], **({"long": "}x" * 9000} if k % 97 == 5 else {})} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_over_many_splits(spark, tmp_path, small_splits, indent):
    (tmp_path / "d").mkdir()
    want = []
    for f in range(3):
        rows = objects(f)
        (tmp_path / "d" / f"{f}.json").write_text(json.dumps([*rows[:100], "no object", [{"nested": 1}], {}, 7, *rows[100:]], indent=indent, ensure_ascii=bool(f)))
        want += rows
    got = records.json_records(spark, f"{tmp_path}/d/*.json")
    assert got.rdd.getNumPartitions() > 1
    rows = sorted(got.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(900)) and [r["n"] for r in rows] == list(range(300)) * 3
    assert [json.loads(r["text"]) for r in rows] == want
    ids = [r["id"] for r in ingest.import_records(spark, f"{tmp_path}/d/*.json", "l").collect()]
    assert len(set(ids)) == 900


def test_csv_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(3)
    (tmp_path / "d").mkdir()
    want = []
    for f, names in enumerate((["Id", "Title", "body"], ["body", "Note"])):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(names)
        for k in range(400):
            row = [rng.choice(["a", 'q"x"', "two\nlines", ",", "é", "line\n\n\nmore " * 30, ""]) for _ in names][: rng.choice([1, 9, 9])]
            row[0] = row[0] or f"r{k}"
            w.writerow(row)
            want.append(dict(zip(names, row + [None] * 9, strict=False)))
        (tmp_path / "d" / f"{f}.csv").write_text(out.getvalue())
    got = sorted(records.csv_records(spark, f"{tmp_path}/d/*.csv").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(800)) and [r["fields"] for r in got] == want
    assert records.csv_records(spark, f"{tmp_path}/d/0.csv").count() == 400


def test_lines_of_two_files_have_different_ids(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.jsonl").write_text('{"x": "1"}\n{broken\n7\n{"x": "2"}\n')
    assert sorted(r["id"] for r in ingest.import_records(spark, f"{tmp_path}/*.jsonl", "l").collect()) == [f"upload:l:{k}" for k in range(4)]


RULE = "id string, title string, type string, domain string, priority string, tags array<string>, body string"


def test_rule_files_are_all_there_or_none(spark, tmp_path):
    rows = [("git:a:b", "T", "Rule", "d 1", "High", ["x"], "body"), ("git-a:b", "T", "Rule", "d 1", "High", [], None), ("ü", "T", "Rule", None, "Low", [], "")]
    df = spark.createDataFrame(rows, RULE)
    out = tmp_path / "out"
    ingest.write_rules_by_domain(df, str(out))
    names = sorted(str(p.relative_to(out)) for p in out.rglob("*.md"))
    assert len(names) == 3 and names[1:] == ["d-1/git-a-b.md", "general/ü.md"] and names[0].startswith("d-1/git-a-b-")
    assert {r["id"] for r in ingest.read_markdown_rules(spark, str(out)).collect()} == {"git:a:b", "git-a:b", "ü"}
    ingest.write_rules_by_domain(df.limit(1), str(out))
    assert len(list(out.rglob("*.md"))) == 1
    with pytest.raises(Exception):
        ingest.write_rules_by_domain(df, str(out), overwrite=False)
    # a task that fails for good leaves the target as it was, and nothing beside it
    bad = ingest.rule_files(df).selectExpr("domain", "case when file like 'ü%' then '' else file end as file", "text").repartition(3)
    with pytest.raises(Exception):
        bad.write.format("rule_files").mode("overwrite").save(str(out))
    assert len(list(out.rglob("*.md"))) == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]
    ingest.write_rules_by_domain(df.limit(0), str(out))
    assert out.is_dir() and not list(out.rglob("*.md"))


def test_front_matter_with_fixtures_and_relations():
    text = """\ufeff---
id: r
title: "A title"
priority: critical
validatorFixtures:
  pass:
    - |
      try:
          x()
      except ValueError:

          log()
    - 'one line'
  fail:
    - >
      folded
      text
implies: [a, 'b']
related:
  - c
  - "d"
created: 2024-13-01
validatorEnabled: False
---
# Head

text
"""
    f = ingest.parse_rule(text)
    assert f["validatorFixtures"] == {"pass": ["try:\n    x()\nexcept ValueError:\n\n    log()", "one line"], "fail": ["folded text"]}
    assert (f["implies"], f["related"], f["title"], f["body"]) == (["a", "b"], ["c", "d"], "A title", "# Head\n\ntext")
    assert ingest._typed(f, "created", "created", "date") is None and ingest._typed(f, "priority", "priority", "string") == "Critical" and ingest._typed(f, "script_enabled", "validatorEnabled", "boolean") is False
    assert ingest.parse_rule("---\nid: x\n---\n# heading is no title") is None and ingest.parse_rule("---\nid: x\ntitle: y") is None


def test_relations_and_fixtures_of_files(spark):
    df = spark.createDataFrame([("r", "---\nid: r\ntitle: t\nrequires: [a, b]\nconflictsWith: a\nvalidatorFixtures:\n  pass:\n    - ok\n  fail:\n    - bad\n---\n")], "path string, text string")
    rules = ingest.parse_rules(df)
    assert sorted(map(tuple, ingest.relations_of(rules).collect())) == [("r", "CONFLICTS_WITH", "a"), ("r", "REQUIRES", "a"), ("r", "REQUIRES", "b")]
    assert sorted(map(tuple, ingest.fixtures_of(rules).collect())) == [("r", "fail", "bad"), ("r", "pass", "ok")]


def test_bundles_of_any_number_of_documents(spark, tmp_path, small_splits):
    rows = [(f"r{k}", "t", "Rule", "d", "Low", ["}{"], '"}\\' * (k % 50)) for k in range(500)]
    df = spark.createDataFrame(rows, RULE)
    for parts in (1, 7):
        path = f"{tmp_path}/b{parts}"
        ingest.export_bundle(df.repartition(parts), path)
        docs = [json.loads(p.read_text()) for p in (tmp_path / f"b{parts}").glob("part-*")]
        assert sum(len(x["rules"]) for x in docs) == 500 and len(docs) == parts and all(x["schemaVersion"] == 1 for x in docs)
        back = ingest.import_bundle(spark, path, RULE)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    ingest.export_bundle(df.limit(0).coalesce(1), f"{tmp_path}/none")
    assert ingest.import_bundle(spark, f"{tmp_path}/none", RULE).count() == 0


@pytest.mark.parametrize("span", [1, 7, 10**6])
def test_audit_chain_equals_a_walk_along_each_file(spark, tmp_path, small_splits, span):
    import base64
    import hashlib
    import hmac

    from kgjobs.operators import graph

    rng, key, want = random.Random(9), b"k" * 32, []
    (tmp_path / "logs").mkdir()
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        lines, prev, seq = [], "", 0
        for k in range(150):
            seq += rng.choice([1, 1, 1, 1, 2])
            entry = json.dumps({"seq": seq, "ts": "t", "metadata": {"a": "ü}" * 20}, "prev_hash": "cut" if rng.random() < 0.05 else prev})
            h = hashlib.sha256(entry.encode()).hexdigest()
            mac = base64.b64encode(hmac.digest(key, entry.encode(), "sha256")).decode()
            signed = {"entry": entry if rng.random() > 0.03 else "{", "mac": mac if rng.random() > 0.05 else "AAAA", "entry_hash": h if rng.random() > 0.03 else None}
            lines.append("no json" if rng.random() < 0.06 or k < 2 * (day[-1] == "3") else json.dumps(signed))
            prev = h
        (tmp_path / "logs" / f"audit-{day}.jsonl").write_text("\n\n".join(lines) + "\n")
        expected, last = 1, None
        for n, line in enumerate(lines, 1):
            try:
                s = json.loads(line)
                e = json.loads(s["entry"])
            except ValueError:
                want.append((f"audit-{day}.jsonl", n, "PARSE_ERROR"))
                expected += 1
                continue
            if s["mac"] != base64.b64encode(hmac.digest(key, s["entry"].encode(), "sha256")).decode():
                want.append((f"audit-{day}.jsonl", n, "HMAC_INVALID"))
            if e["seq"] != expected:
                want.append((f"audit-{day}.jsonl", n, "SEQ_GAP"))
            if last is not None and e["prev_hash"] != last:
                want.append((f"audit-{day}.jsonl", n, "CHAIN_BROKEN"))
            expected, last = e["seq"] + 1, s["entry_hash"]
    (tmp_path / "logs" / "other.txt").write_text("x\n")
    lines = ingest.audit_lines(spark, str(tmp_path / "logs"))
    assert lines.count() == 450
    entries = ingest.read_audit_log(lines).withColumnRenamed("entry_hash", "stored_hash")
    got = sorted(map(tuple, graph.verify_chain(entries, key, span).collect()))
    assert got == sorted(want) and {x[2] for x in got} == {"PARSE_ERROR", "HMAC_INVALID", "SEQ_GAP", "CHAIN_BROKEN"}


def test_a_file_is_written_row_by_row(spark, tmp_path):
    from kgjobs.sources.rule_files import RuleFiles

    spark.dataSource.register(RuleFiles)
    rows = spark.range(3000).selectExpr("'d' as domain", "concat('f', id % 5) as file", "id", "repeat(cast(id as string), 50) as text").repartition(3, "file").sortWithinPartitions("file", "id")
    rows.select("domain", "file", "text").write.format("rule_files").option("between", "\n\n").mode("overwrite").save(f"{tmp_path}/out")
    for k in range(5):  # the last row alone was left before
        assert (tmp_path / "out" / "d" / f"f{k}").read_text() == "\n\n".join(str(i) * 50 for i in range(k, 3000, 5))
    torn = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2"), ("d", "a", "3")], "domain string, file string, text string").coalesce(1)
    with pytest.raises(Exception, match="not in a row"):
        torn.write.format("rule_files").option("between", "").mode("overwrite").save(f"{tmp_path}/torn")
    assert not list(tmp_path.glob("torn*"))


def test_folders_are_listed_by_tasks(spark, tmp_path):
    from kgjobs.sources.rule_files import file_texts

    want = {}
    for k in range(60):
        p = tmp_path / "top" / "/".join("abü"[: k % 4]) / f"{'_' * (k % 7 == 0)}{k}.{'md' if k % 5 else 'txt'}"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xef\xbb\xbf" * (k % 2) + f"text {k}\r\nü".encode() * (k % 3))
        if k % 7 and k % 5 and p.stat().st_size:
            want[f"file://{p}"] = p.read_bytes().decode()
    (tmp_path / "top" / ".hidden").mkdir()
    (tmp_path / "top" / ".hidden" / "x.md").write_text("x")
    for folder in (f"{tmp_path}/top", f"file://{tmp_path}/top"):
        got = file_texts(spark, folder, ".md")
        assert {x.path: x.text for x in got.collect()} == want
        assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()  # whose index the driver holds
    assert file_texts(spark, f"{tmp_path}/t*p/a", ".md").count() == sum("/a/" in x for x in want)  # a pattern is left to Spark


def test_written_files_are_read_back_by_tasks(spark):
    from kgjobs import plans, queries  # noqa: F401

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no driver tables")
    plan = queries.QUERIES["write_rules_by_domain"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan text" not in plan  # the driver listed all files before
