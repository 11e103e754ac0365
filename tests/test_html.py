"""Entities against Python's own decoder."""

import html
import random
from html.entities import name2codepoint

from pyspark.sql import functions as F

from kgjobs import functions as fn


def test_entities(spark):
    rng = random.Random(1)
    # the two that HTML 5 maps to other characters are left out
    names = [f"&{n};" for n in name2codepoint if n not in ("lang", "rang")] + ["&apos;", "&#39;", "&#x1F600;", "&#128512;", "&#xe9;", "&#X41;"]
    texts = ["".join(rng.choices([*names, "a", " & ", "&;", "&amp;lt;", "é", "&amp"], k=8)) for _ in range(400)] + names
    stay = ["&nosuch;", "&#0;", "&#xD800;", "&#1114112;", "&#x110000;", "& amp;", "&#;", "&#x;", "fish&chips;", ""]
    got = spark.createDataFrame([(t,) for t in texts + stay], "t string").select("t", fn.decode_entities(F.col("t")).alias("x")).collect()
    for r in got[: len(texts)]:
        # the reader of browsers also takes names without their semicolon
        assert r.x == html.unescape(r.t.replace("&amp", "\1").replace("\1;", "&amp;")).replace("\1", "&amp"), r.t
    assert all(r.x == r.t for r in got[len(texts) :])


def test_pages(spark):
    page = "<html><STYLE a>p{}</style><script>if (a<b) x('</p>')\n</Script><body><p title='x'>a&nbsp;&lt;b&gt;</p>　c<br/>\n\t&#x1F600;&eacute;</body>"
    assert spark.createDataFrame([(page,), (None,)], "h string").select(fn.html_to_text(F.col("h")).alias("t")).collect() == [("a <b> c 😀é",), (None,)]
