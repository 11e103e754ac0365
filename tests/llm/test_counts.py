import pytest

from kgjobs.llm import counts


def brute(text, rule):
    enc, _ = counts.encoder(counts.default_vocabulary())
    lines = text.splitlines(keepends=True) if "\n" in text else [text]
    lines = [x for x in text.split("\n")]
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, x in enumerate(lines) for _ in x.encode()]
    first = []  # byte -> first byte of its character
    for c in text:
        first += [len(first)] * len(c.encode())
    n, at = [0] * len(lines), 0
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        own = owner[at : at + size]
        n[owner[first[at]] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
        at += size
    out, at = [], 0
    for k, x in enumerate(lines):
        out.append((k, at, at + len(x), n[k], sum(n)))
        at += len(x)
    return out


@pytest.mark.parametrize("rule", ["first", "most"])
def test_equals_brute_force(spark, rule):
    texts = ["", "one line", "a\nb\n", "\n\n\n", "x \n\n  y\n\n\n\nzü日本\n🙂🙂 z\n", "é" * 50 + "\n" + "word " * 30, "<|endoftext|>\n", "\n" * 9 + "  " * 7 + "\n a"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(99, None, 5)], "doc_id long, text string, section int")
    got = sorted(tuple(r) for r in counts.count_tokens(df, rule=rule).collect())
    assert got == sorted([(k, *r) for k, t in enumerate(texts) for r in brute(t, rule)] + [(99, 0, 0, 0, 0, 0)])
    assert counts.count_tokens(df.limit(0)).count() == 0
