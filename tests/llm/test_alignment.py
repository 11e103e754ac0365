import hashlib
from collections import Counter

import pytest

from kgjobs.llm import alignment

TEXTS = ["", None, "plain words", " ", "  two  spaces  ", "tail ", "a\nb\n\tc", "ünï çödé 日本語 🙂🙂", "x▁y", "<|endoftext|> <s>[INST]</s>", "\x00nul", "ﬁ ligature ①", "word " * 300, "the cat sat on the mat, the end.", "the cat sat on the mat, the end.", "1234567890 " + "a" * 5000, " nbsp　wide", "é combining", "don't they've\r\n"]


def encoders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def spans(raws):
    at = 0
    for r in raws:
        yield at, at + len(r)
        at += len(r)


def brute(rows, link):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha, n_overlaps), from both libraries' own encoding of whole texts."""
    a, sp = encoders()
    letters = alignment.byte_letters()
    docs = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        x = a.encode(want.decode(), add_special_tokens=False).ids if text else []
        y = sp.encode(text) if text else []
        rx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ry = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [sp.id_to_piece(i)]]
        if b"".join(rx) != want or b"".join(ry) != want:
            docs.append((doc_id, [], [], [], [], "", 0))
            continue
        sx, sy = list(spans(rx)), list(spans(ry))
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if lo <= s < hi) for ids, at in ((x, sx), (y, sy))))
            lo = hi
        over = [(i, j) for i, (s, e) in zip(x, sx, strict=True) for j, (t, f) in zip(y, sy, strict=True) if s < f and t < e] if len(x) < 2000 else None
        ends = {e: j for j, (_, e) in zip(y, sy, strict=True)}
        same = [(i, ends[e]) for i, (_, e) in zip(x, sx, strict=True) if e in ends]
        docs.append((doc_id, x, y, groups, same if link == "end" else over, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(over)))
    count = Counter(p for d in docs for p in d[4])
    most = {}
    for (_, j), c in count.items():
        most[j] = max(most.get(j, 0), c)
    return [(d, len(x), len(y), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), sha, n) for d, x, y, g, k, sha, n in docs]


@pytest.mark.parametrize("link", ["end", "overlap"])
def test_equals_brute_force(spark, link):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(0, "the cat"), (0, "the cat")]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, row int, n_a int")
    key = lambda r: (r[0] is None, r)
    want = sorted(brute(rows, link), key=key)
    assert any(r[1] == 0 and r[0] == TEXTS.index("x▁y") for r in want)
    got = alignment.align(df, link=link)
    for hot in (alignment.HOT, 3):  # nearly all pairs broadcast; nearly all shuffled
        assert sorted(map(tuple, alignment.with_counts(got, hot).collect()), key=key) == want
    assert alignment.alignments(df.limit(0)).count() == 0


def test_whole_documents_as_by_the_libraries(spark):
    """Chunked and ranked encoding against the libraries', over a given table's texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    a, sp = encoders()
    x = {d: ([], []) if not t else (a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) for d, t in rows}
    for r in alignment.alignments(docs).collect():
        if r["n_a"]:
            assert (r["n_a"], r["n_b"]) == tuple(map(len, x[r["doc_id"]]))
    left, right, *_ = alignment.sides(*alignment.default_vocabularies())
    for d, t in rows:
        if t:
            assert left.encode(" " + t).tolist() == x[d][0]
            assert right.encode(alignment.CHUNK.findall(" " + t))[0].tolist() == x[d][1]


def test_a_long_text(spark):
    """Several slices in a batch and a text longer than a slice; copies have equal results."""
    text = "the quick brown fox, " * 80_000
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in alignment.alignments(df).collect()}
    assert got[1]["n_groups"] == got[3]["n_groups"] > 400_000 and got[1]["groups_sha256"] == got[3]["groups_sha256"] and got[2]["n_a"] == 1
