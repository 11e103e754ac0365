import random
import zlib

import corpus_pipeline
from kgjobs.llm import quality


def test_held_out_accuracy(spark):
    r = random.Random(3)
    good = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(800):
        bad = r.random() < 0.3
        words = [r.choice(good) for _ in range(r.randint(5, 60))]
        if bad:
            words = [w + r.choice(["***", "!!", "$$"]) for w in words] if k % 2 else [words[0].title()] * 30
        rows.append((k, " ".join(words), "src"))
        labels.append((k, int(not bad), 0))
    docs = spark.createDataFrame(rows + [(900, "", "s"), (901, None, "s")], "doc_id long, text string, quality string")
    lab = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(docs.select("doc_id", "text"), quality.learn(docs, lab)).collect()}
    assert len(got) == 802 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    held = [(got[k].predicted, q) for k, q, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.score(docs, quality.learn(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [x.predicted for x in quality.score(docs, quality.learn(docs, one)).collect()] == [1, 1]
    assert quality.score(docs.limit(0), quality.learn(docs, one)).count() == 0


def test_pipeline_drops_toxic_documents_of_good_quality(spark, tmp_path):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    rude = ["idiot", "scum", "moron", "clown", "trash"]
    rows, labels = [], []
    for k in range(1000):
        words = [r.choice(vocab) for _ in range(r.randint(40, 400))]
        toxic, good = r.random() < 0.15, r.random() < 0.9
        for w in r.sample(rude, 3) if toxic else []:
            words[r.randrange(len(words))] = r.choice([w, w.title(), w + ".", w + ","])
        rows.append((k, " ".join(words if good else [w + "$$" for w in words]), "en"))
        labels.append((k, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None, "en"), (2001, "", "en")], "doc_id long, text string, lang string")
    spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    kept = {x.doc_id for x in out.collect()}
    assert out.columns == docs.columns
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    share = lambda rows: sum(d in kept for d, _, _ in rows) / len(rows)
    assert share([x for x in held if x[1:] == (1, 1)]) < 0.1 and share([x for x in labels if x[1:] == (1, 1)]) < 0.1
    assert share([x for x in held if x[1:] == (1, 0)]) > 0.97 and share([x for x in labels if not x[1]]) < 0.1
    model = quality.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scored = {x.doc_id for x in quality.score(docs, model).where("predicted = 1").collect()}
    assert kept < scored  # toxicity only takes away, op8's score is of quality alone


def test_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, none)
    assert quality.accepted(docs, model, quality.learn_toxic(docs, none, model[0])).count() == 2
    every = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.accepted(docs, model, quality.learn_toxic(docs, every, model[0])).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 3), (None, None, "mine", 4), (1, "a b", "mine", 3)], "doc_id long, text string, score string, predicted int")
    model = quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_a_worker_remembers_few_words_and_reads_all_alike():
    """What a worker remembers stays small whatever it reads, and a word forgotten gets its slots again."""
    import numpy as np

    text = " ".join(f"w{k:x}" for k in range(250_000))
    first = quality._codes(text + " The end. w1 w2")
    assert len(quality._slots) <= 100_000
    for _ in range(2):
        again = quality._codes(text + " The end. w1 w2")
        assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    assert len(quality._slots) <= 100_000
