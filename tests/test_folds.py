import random

from kgjobs.operators import feedback, rules


def operators_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_apply_budget_equals_the_loop(spark, capsys):
    r = random.Random(1)
    sizes = [0, 1, 2, 3, 5, 8, 40, 90, 100, 101]
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), k, f"i{k}", r.choice(sizes)) for k in range(3000)]
    rows += [("small", k, f"s{k}", 3) for k in range(50)] + [("large", 1, "x", 101)]
    r.shuffle(rows)
    want, used = [], {}
    for q, _, i, size in sorted(rows, key=lambda x: x[1]):
        if used.get(q, 0) + size <= 100:
            used[q] = used.get(q, 0) + size
            want.append((q, i))
    ranked = spark.createDataFrame(rows, "query string, pos long, id string, size long")
    got = rules.apply_budget(ranked, 100)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "WindowGroupLimit" in operators_of(got, capsys)  # an array never holds all of a query


def test_additive_confidence_equals_the_loop(spark, capsys):
    r = random.Random(2)
    rows = [(7 if r.random() < 0.6 else r.randrange(5), k, r.random() < 0.66) for k in range(4000)]
    rows += [(50, k, True) for k in range(30)] + [(51, k, False) for k in range(30)] + [(52, 1, None)]
    r.shuffle(rows)
    want = {}
    for rule, _, passed in sorted(rows, key=lambda x: x[1]):
        x = want.get(rule, 1.0)
        want[rule] = min(2.0, x + 0.1) if passed else max(0.1, x - 0.2)
    outcomes = spark.createDataFrame(rows, "rule_id long, seq long, passed boolean").repartition(5)
    got = feedback.additive_confidence(outcomes)
    assert {x.rule_id: round(x.multiplier, 6) for x in got.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert "rangepartitioning(rule_id" in operators_of(got, capsys)  # a rule's rows are dealt out by seq
