import hashlib
import re
from collections import Counter

from kgjobs.llm import fingerprints


def weights(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {w: n * len(w) for w, n in Counter(w.lower() for w in words).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def like(a, b):
    if not a or not b:
        return float(a == b)
    marks = [[x[i : i + 6] for i in range(0, len(x), 6)] for x in (a, b)]
    return sum(p == q for p, q in zip(*marks, strict=True)) / len(marks[0])


def test_collision_rate_is_generalised_jaccard(spark):
    base = " ".join(f"word{k % 37}" for k in range(120))
    texts = [base, base + " " + "word3 " * 60, base[: len(base) // 2] + " fresh" * 30, "other words altogether here", " ".join(f"w{k}" for k in range(90)), " ".join(f"w{k}" for k in range(45, 135)), "w3 " * 40 + "w4 " * 10, "w3 " * 10 + "w4 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    marks = {r.id: r.fingerprint for r in fingerprints.sign(df, ["id"], 1024).collect()}
    for i in range(len(texts)):
        for j in range(i):
            # 4.2 standard deviations of 1024 samples at the worst, 0.5
            assert abs(like(marks[i], marks[j]) - jaccard(texts[i], texts[j])) < 0.066, (i, j)


ROWS = [(9, "the very last one of all documents"), (3, "a b c d e f g h i"), (3, "a b c d e f g h i"), (3, "zebra zebra"), (5, None), (4, ""), (None, "no id at all here"), (7, "  \n "), (8, "日本 🙂🙂 é " * 9), (1, "the very last one of all documents"), (2, "long text of words " * 20_000)]


def brute(rows, signed):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1]), reverse=True)
    out = []
    for at, (k, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, e, n = signed(text), signed(edited), signed(after)
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, like(a, e), like(a, n)))
    return out


def test_edits_equal_brute_force(spark):
    equal_brute_force(spark, ROWS)


def test_no_ids_at_all(spark):
    equal_brute_force(spark, [(None, t) for _, t in ROWS[:4]])


def equal_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, pos int, fingerprint string")
    got = [tuple(r) for r in fingerprints.fingerprint_edits(df).collect()]
    seen = {}
    brute(rows, lambda t: seen.setdefault(t, ""))  # first pass: which texts are signed
    pairs = list(enumerate(seen))
    signed = {r.id: r.fingerprint for r in fingerprints.sign(spark.createDataFrame(pairs, "id long, text string"), ["id"]).collect()}
    of = {t: signed.get(k, "") for k, t in pairs}
    want = brute(rows, of.__getitem__)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    row = fingerprints.fingerprint_edits(df).first()
    assert (row.doc_id, row.near_next) == (1, 1.0)
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0
