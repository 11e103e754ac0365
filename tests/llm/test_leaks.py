import math
import random
from collections import Counter

from kgjobs.llm import leaks


def brute(docs, items, width=5, least=0.8):
    words = {i: leaks.tokens(t) for i, t in items}
    words = {i: w for i, w in words.items() if w}
    bag = lambda w: Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)])
    bags = {i: bag(w) for i, w in words.items()}
    df = Counter(s for b in bags.values() for s in b)
    weigh = lambda s, b: math.log(1 + len(bags) / (df[s] if s in b else 1))
    out = {}
    for d, t in docs:
        w = leaks.tokens(t)
        for i, b in bags.items():
            n = min(len(words[i]), len(w))
            for a in range(len(w) - n + 1 if w else 0):
                c = bag(w[a : a + n])
                hi = sum(weigh(s, b) * max(b[s], c[s]) for s in b | c)
                s = sum(weigh(s, b) * min(b[s], c[s]) for s in b & c) / hi
                if s >= least and s > out.get((d, i), (0, 0, 0))[0] + 1e-12:
                    out[d, i] = (s, a, n)
    return {k: (a, n, round(s, 9)) for k, (s, a, n) in out.items()}


def test_equals_brute_force(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(90)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, text(r.choice([3, 6, 20, 20, 45]))) for k in range(25)]
    docs = []
    for k in range(60):
        t = text(r.randint(0, 80))
        if k % 2:
            x = list(r.choice(items)[1])
            if k % 3 and len(x) > 30:
                x[r.randrange(len(x))] = "zz"
            t += x + text(r.randint(0, 9))
        docs.append((k, ", ".join(t).title()))
    docs += [(100, None), (101, ""), (102, " ".join(items[4][1]))]
    items = [(k, " ".join(t)) for k, t in items] + [(99, None)]
    want = brute(docs, items)
    for part in (1 << 22, 300):
        got = leaks.find_leaks(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part).collect()
        assert {(g.doc_id, g.item_id): (g.first_word, g.n_words, round(g.similarity, 9)) for g in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert leaks.find_leaks(docs, none).count() == 0
    assert leaks.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
