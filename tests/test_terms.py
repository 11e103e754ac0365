import datetime
import math

from pyspark.sql import functions as F

from kgjobs.operators import graph, retrieval, rules


def test_keyword_score_counts_triggers(spark):
    r = spark.createDataFrame([("a", "Low", ["x"], ["Cache Key", "auth"]), ("b", "High", ["auth"], None), ("c", "Low", [], ["cache miss"])], "id string, priority string, tags array<string>, triggers array<string>")
    q = spark.createDataFrame([(1, "the key of a cache", ["Auth"]), (2, "auth", ["auth"])], "query long, task string, concepts array<string>")
    got = {(x.query, x.id): round(x.score, 6) for x in retrieval.keyword_score(r, q).collect()}
    assert got == {(1, "a"): round(math.log1p(4), 6), (1, "b"): round(3 * math.log1p(2), 6), (2, "a"): round(math.log1p(3), 6), (2, "b"): round(3 * math.log1p(3), 6)}


def test_recall_ranks_superseded_memories_at_a_tenth(spark):
    day = datetime.date(2024, 1, 1)
    m = spark.createDataFrame([(1, "u", "alpha beta", day, True), (2, "u", "alpha", day, None), (3, "v", "alpha", day, False)], "id long, owner string, body string, created date, superseded boolean")
    q = spark.createDataFrame([(1, "u", ["alpha", "beta"])], "query long, owner string, terms array<string>")
    got = [(x.id, round(x.score, 6)) for x in graph.recall(m, q, F.lit("2024-01-01").cast("date")).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.2)]


def test_search_rules_by_type_and_tag(spark):
    r = spark.createDataFrame([("a", "Rule", "d", "then", ["X", "y"]), ("b", "Rule", "d", "then", None), ("c", "Guideline", "d", "then", ["x"])], "id string, type string, domain string, body string, tags array<string>")
    assert [x.id for x in rules.search_rules(r, "THEN", "d", "Rule", "x").collect()] == ["a"]
