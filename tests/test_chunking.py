"""Chunks against what must hold of them on driver texts, and small cases by hand."""

import os

import pytest

from kgjobs.operators import chunking

DATA = "/root/testdata/sf0.001"


def test_small_cases():
    assert chunking.chunks_of("short", "prose", 10, 0) == ["short"]
    assert chunking.chunks_of("", "prose", 10, 0) == [""]
    assert chunking.chunks_of("aaaa bbbb cccc", "prose", 10, 2) == ["aaaa bbbb ", "b cccc"]
    table = "| h |\n|---|\n" + "".join(f"| {i} |\n" for i in range(9))
    parts = chunking.chunks_of(table, "table", 30, 5)
    assert all(p.startswith("| h |\n|---|\n") and len(p) <= 30 for p in parts)
    assert "".join(p.removeprefix("| h |\n|---|\n") for p in parts) == table.removeprefix("| h |\n|---|\n")
    fenced = "intro words\n```py\nx = 1\n```\nafter it all"
    assert "```py\nx = 1\n```\n" in chunking.chunks_of(fenced, "markdown", 20, 4)


def test_nulls_and_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b " * 10, "z")], "id long, text string, style string")
    rows = chunking.chunk_documents(docs, 12, 0).collect()
    assert [(r.id, r.ordinal, r.chunk) for r in rows if r.id] == [(1, 0, ""), (2, 0, "")]
    assert "".join(r.chunk for r in sorted((r for r in rows if r.id is None), key=lambda r: r.ordinal)) == "a b " * 10


def test_styles(spark):
    cases = [
        ("plain words", None, "prose"), (None, None, "prose"), (" \n\n", "x.md", "prose"), ("", "x.PY", "code"), ("words", "a/b.Md", "markdown"), ("words", "dir.d/name", "prose"),
        ("| a |\n|b\n  |c\nd\ne\nf", None, "table"), ("|a\n|b\n|c\nd\ne\nf\ng", None, "markdown"), ("|a\nb", "x.txt", "markdown"), ("  # h\nx", None, "markdown"), ("x ``` y ``` z", None, "markdown"), ("one ``` alone", None, "prose"),
        ("let a = 1\nx;\n}", None, "code"), ("let a = 1\nx;\n}", "x.txt", "prose"), ("let \nimport\nx;\n}", None, "prose"), ("x;\ny;\nz;\n" + "a\n" * 5, None, "prose"), ("x;\ny;\nz;\n" + "a\n" * 4, None, "code"),
    ]
    rows = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(cases)], "id int, text string, name string")
    from pyspark.sql import functions as F

    from kgjobs.functions import detect_style

    got = dict(rows.select("id", detect_style(F.col("text"), F.col("name"))).collect())
    assert [got[k] for k in range(len(cases))] == [want for _, _, want in cases]
    by_name = chunking.chunk_documents(rows.where("id = 12"), 5, 0)
    assert {r.style for r in by_name.collect()} == {"code"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_lossless_without_overlap(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id as id", "text")
    got = {}
    for r in chunking.chunk_documents(docs, 300, 0, "prose").collect():
        assert len(r.chunk) <= 300 or r.chunk.startswith("|")
        got.setdefault(r.id, []).append((r.ordinal, r.chunk))
    for r in docs.collect():
        text = "".join(c for _, c in sorted(got[r.id]))
        assert text == r.text or len(r.text) > 300 and ("|" in r.text or text.split() == r.text.split())
