import random

import pytest

import corpus_pipeline
from kgjobs.llm import pieces

from . import test_leaks, test_neardup

sentencepiece = pytest.importorskip("sentencepiece")


def keep_first(rows, least):
    """Texts less every string of ``least`` bytes that begins earlier, by (doc_id, place)."""
    seen, out = set(), []
    for d, t in sorted(rows):
        b = t.encode()
        gone = set()
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            if s in seen:
                gone.update(range(i, i + least))
            seen.add(s)
        kept = bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if not gone or kept:
            out.append((d, kept))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(30)) for k in range(8)]
    passage, rows = [text(70) for _ in range(2)], []
    for k in range(80):
        t = text(r.randint(30, 150))
        if k % 5 == 0:
            t += " " + passage[k % 2] + " " + text(20)
        if k % 9 == 0:
            t += " " + items[k % 8][1] + " " + text(5)
        rows.append((k, t))
    rows += [(100 + k, rows[k][1] + " tail") for k in range(0, 20, 2)] + [(200, rows[1][1]), (201, "x"), (202, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {d for d, _, _, first in test_neardup.brute(rows, 5, 80) if first}
    want = keep_first([x for x in rows if x[0] in kept], corpus_pipeline.PASSAGE_BYTES)
    leaked = {d for d, _ in test_leaks.brute(want, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted((d, t, "en", f"s{d % 3}", len(t), sp.encode(t), len(sp.encode(t)), True) for d, t in want if d not in leaked)
    got = sorted((x.doc_id, x.text, x.lang, x.source, x.n_chars, list(x.ids), x.n_tokens, x.round_trip) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 50 < len(got) < 90


def test_stages_hold_null_ids_and_clashing_names(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item, a, b = text(30), text(60), text(60)
    rows = [(None, f"{text(20)} {item} {text(5)}"), (None, a), (1, a), (2, b), (2, f"{text(9)} {item}"), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, kept string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = sorted(((x.doc_id, x.text, x.n_bytes, x.kept) for x in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert clean == sorted([(None, a, 7, "k"), (1, a, 7, "k"), (2, b, 7, "k"), (3, None, 7, "k"), (4, "", 7, "k"), (4, "", 7, "k")], key=str)
    near = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and sorted((x.doc_id or 0, x.text or "") for x in near.collect()) == sorted([(0, rows[0][1]), (1, a), (2, b), (2, rows[4][1]), (3, ""), (4, "")])
    cut = corpus_pipeline.suffix_dedup_stage(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and {(x.n_bytes, x.kept) for x in cut.collect()} == {(7, "k")}
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert "ids" in corpus_pipeline.pieces_stage(spark, docs, str(tmp_path)).columns
    none = docs.limit(0)
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
