import random
import re
from collections import Counter, defaultdict

import pytest

from kgjobs.llm import thresholds as th


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(lines), len(covered)


def brute(rows, least):
    """{row: (counts, base_failed, failed)}: quartiles from sorted lists of bucketed values."""
    got = [counts(t or "") for _, t, _, _ in rows]
    base = [c[0] < 50 or 100 * c[5] > 50 * c[0] for c in got]
    value = lambda c: {"word_length": 100 * c[1] // max(c[0], 1), "symbols": 1000 * c[2] // max(c[1], 1), "repeated_lines": 1000 * c[3] // max(c[4], 1), "repeated_words": 1000 * c[5] // max(c[0], 1)}
    held = defaultdict(list)
    for (_, _, lang, source), c, b in zip(rows, got, base, strict=True):
        if not b:
            for rule, v in value(c).items():
                v -= v % 2 ** max(v.bit_length() - 7, 0)
                for key in ((lang, source, 0), (lang, None, 1), (None, None, 2)):
                    held[(*key, rule)].append(v)
    out = []
    for (_, _, lang, source), c, b in zip(rows, got, base, strict=True):
        failed = []
        for rule, v in value(c).items():
            x = sorted(next((h for key in ((lang, source, 0), (lang, None, 1)) if len(h := held[(*key, rule)]) >= least), held[(None, None, 2, rule)]))
            if x:
                q1, q3 = x[-(-len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
                s = max(q3 - q1, th.RULES[rule][3])
                if v > q3 + 3 * s or rule == "word_length" and v < q1 - 3 * s:
                    failed.append(rule)
        out.append((*c, b, failed, not b and not failed))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot"] * 4 + ["x", "y", None])
        size = (3, 5) if lang == "en" else (5, 9)
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(*size))) for _ in range(rng.randint(10, 160))]
        kind = rng.random()
        if kind < 0.08:
            words = [w + rng.choice("#*$%") * 3 for w in words]
        elif kind < 0.14:
            words = words[:20] * 5
        elif kind < 0.2:
            words = [w * 6 for w in words]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        rows.append((k, "\n".join(lines + lines[:3] * rng.choice([0, 0, 1])), lang, source))
    rows += [(None, None, "en", "hot"), (None, "", None, None), (7, "a a a a", "en", "hot"), (7, "a a a a", "en", "hot"), (8, " \n \t", "zz", "alone"), (9, "word\v" * 70, "zz", "alone"), (9, " ".join(f"ü{k}" for k in range(80)), "zz", "other")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    key = lambda r: (r[0] is None, str(r))
    for least in (20, 100, 10_000):
        want = sorted(((r[0], *b) for r, b in zip(rows, brute(rows, least), strict=True)), key=key)
        got = sorted(((*r[:8], list(r["failed"]), r["kept"]) for r in th.judged(df.repartition(5), least).collect()), key=key)
        assert got == want
        assert {x for r in got for x in r[8]} >= {"symbols", "word_length"} and sum(r[9] for r in got) > 300
    assert th.judged(df.limit(0)).count() == 0
    assert th.judged(df.select("doc_id", "text")).count() == len(rows)


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 3, ["a"] * 4, ["a", "b", "c", "x", "a", "b", "c"], ["a", "b"] * 4])
def test_repeated_words(words):
    assert th.repeated_words(words) == counts(" ".join(words))[5]


def test_a_long_text(spark):
    text = " ".join(f"w{k}" for k in range(300_000)) + " w1 w2 w3"
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    got = th.judged(df).first()
    assert (got["n_words"], got["n_repeat_words"], got["kept"]) == (300_003, 6, True)


def test_clean_documents_stay_and_junk_goes(spark):
    """Labelled documents of a given table: those of quality 1 that pass the fixed rules stay, nearly all others go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))

    kept = {(r["quality"], r["kept"]): r["count"] for r in th.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) == 0 and kept.get((0, False), 0) > 3 * kept.get((0, True), 0)
