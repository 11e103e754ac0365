import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from kgjobs.llm import pieces  # noqa: E402


@pytest.fixture(scope="module")
def both():
    model = pieces.default_model()
    return pieces.load(model), sentencepiece.SentencePieceProcessor(model_file=model)


def texts():
    r = random.Random(5)
    sets = ["ab ", " ", "the in er\n", "éñüß dïe zu", "日本語 の x", "aeiouthnrst", "  \t\nxyz", "01 29.,;"]
    for n in [0, 1, 2, 5, 17, 60, 200, 700]:
        for chars in sets:
            yield "".join(r.choice(chars) for _ in range(n))
    yield "<s> </s> <unk> <0x0A> [INST]"
    yield "word " * 100 + "x" * 300 + " " * 50 + "\u0000\U0001f600 end"


def test_words_equal_the_library(both):
    p, sp = both
    for t in texts():
        got = np.frombuffer(p.text_ids((pieces.SPACE + t).replace(" ", pieces.SPACE)), "<i4").tolist() if t else []
        assert got == sp.encode(t), repr(t[:80])
        assert p.decode(np.array(got, int)) == t


@pytest.mark.parametrize(("chunk", "fan"), [(40, 2), (40, 32), (64, 3), (333, 2)])
def test_chunks_equal_the_library(spark, both, chunk, fan):
    _, sp = both
    rows = [(i % 50, t, "k") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_note string")
    got = sorted((r.doc_id, r.text, list(r.ids), r.n_tokens, r.round_trip) for r in pieces.encode(df, chunk=chunk, fan=fan).collect())
    want = sorted((d, t, sp.encode(t), len(sp.encode(t)), True) for d, t, _ in rows)
    assert got == want


def test_null_empty_and_space_mark(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (3, "a▁b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.round_trip) for r in pieces.encode(df).collect()}
    assert got[1] == (0, True) and got[None] == (0, True) and got[3][1] is False
    assert pieces.encode(df.limit(0)).count() == 0


def test_clashing_names_and_null_texts(spark):
    df = spark.createDataFrame([(1, "a b " * 3000, 5, "x"), (2, None, 6, "y"), (None, "a b", 7, "z")], "doc_id long, text string, n_tokens int, _row string")
    got = sorted(((r.doc_id, r._row, r.n_tokens > 0, r.round_trip) for r in pieces.encode(df, chunk=1000).collect()), key=str)
    assert got == sorted([(1, "x", True, True), (2, "y", False, True), (None, "z", True, True)], key=str)


def test_products_are_associative(both):
    p, _ = both
    text = pieces.SPACE + "the inner error of therein " * 40 + "  in\n" * 30
    text, side = text.replace(" ", pieces.SPACE), 32
    cuts = [(at, min(at + 50, len(text))) for at in range(0, len(text), 50)]
    made = []
    for lo, hi in cuts:
        left = min(lo, side)
        made.append(pieces._rows(pieces._matrix(p, text[lo - left : hi + side], left, left + hi - lo)))
    whole = pieces.product(made)
    for k in range(1, len(made)):
        assert pieces.combine(pieces.product(made[:k]), pieces.product(made[k:])) == whole


def test_a_text_of_millions_of_characters(spark, both):
    """At the shipped chunk, over several levels of products, beside copies and short texts."""
    _, sp = both
    r = random.Random(8)
    words = ["".join(r.choices("etaoin shrdlu", k=r.randint(1, 12))) for _ in range(5000)]
    text = " ".join(r.choices(words, k=250_000)) + "x" * 40_000 + " " * 20_000 + "日本" * 9_000
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    got = {x.doc_id: (list(x.ids), x.round_trip) for x in pieces.encode(df).collect()}
    assert len(text) > 33 * pieces.CHUNK
    assert got[1] == got[3] == (sp.encode(text), True) and got[2][0] == sp.encode("short")
