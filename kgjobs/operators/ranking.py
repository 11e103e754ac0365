"""The k best rules a query by keyword score, without meeting every rule that shares a common term with it.

What a tag, trigger or domain counts for a query depends on its text only, so queries are weighed against distinct terms
first (``term_weights``). A rule then counts the sum over its terms. Terms of over ``LONG`` rules are long lists:

* rules met through a shorter list are candidates, at most ``LONG`` a query and term, and are scored exactly;
* by long lists alone, rules with the same priority, scope and long terms score alike but for their multiplier. Such
  rules are one group; it keeps its k best by multiplier, then id, and queries meet groups, not rules. Of these only the
  k best groups of a query by their best rule are opened.

A rule that a group leaves out has k rules of its group before it, so the k best are exact. Sums are whole multiples of
2^-20, so a score is the same by either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import priority_rank, tokenize
from ..sources import scratch
from .retrieval import held, top_k

#: Rules in a term's list beyond which they are met by groups.
LONG = 1_000
UNIT = 1 << 20
#: A rule's and a query's columns that decide whether the query may see the rule.
RULE_SCOPE = {"owner": "string", "head": "string", "box": "string"}
QUERY_SCOPE = {"user": "string", "heads": "array<string>", "boxes": "array<string>"}


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with null columns for those it lacks."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def visible() -> Column:
    """Whether a query (user, heads, boxes) may see a rule (owner, head, box).

    Rules without an owner are everyone's; rules below a head are seen if the query has no heads or names theirs, those of
    a toolbox if the query has no list of boxes or names theirs.
    """
    below = F.col("head").isNull() | F.col("heads").isNull() | (F.size("heads") == 0) | F.array_contains("heads", F.col("head"))
    boxed = F.col("box").isNull() | F.col("boxes").isNull() | F.array_contains("boxes", F.col("box"))
    return (F.col("owner").isNull() | F.col("owner").eqNullSafe(F.col("user"))) & F.coalesce(below, F.lit(False)) & F.coalesce(boxed, F.lit(False))


def rule_terms(rules: DataFrame) -> Column:
    """A rule's distinct (kind, term, times): t for tags, g for triggers, in lower case; d for its domain."""

    def counted(kind: str, column: str) -> Column:
        low = F.transform(F.coalesce(column, F.array().cast("array<string>")), F.lower)
        return F.transform(F.array_distinct(low), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), F.size(F.filter(low, lambda x: x == t)).cast("long").alias("times")))

    parts = [counted("t", "tags")] + ([counted("g", "triggers")] if "triggers" in rules.columns else [])
    if "domain" in rules.columns:
        parts.append(F.array(F.struct(F.lit("d").alias("kind"), F.col("domain").alias("term"), F.lit(1).cast("long").alias("times"))))
    return F.filter(F.concat(*parts), lambda x: x["term"].isNotNull())


def said_terms(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, term): terms(term) of one token or more whose tokens are all among asked(query, tokens), met by the token that the fewest queries have."""
    tokens = asked.select("query", "tokens", F.explode("tokens").alias("token"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("n"))
    need = terms.select("term").distinct().select("term", F.array_distinct(tokenize(F.col("term"))).alias("need")).where(F.size("need") > 0)
    rare = need.select("term", "need", F.explode("need").alias("token")).join(seen, "token").groupBy("term", "need").agg(F.count("*").alias("known"), F.min(F.struct("n", "token")).alias("at"))
    rare = rare.where(F.col("known") == F.size("need")).select("term", "need", F.col("at.token").alias("token"))
    return rare.join(tokens, "token").where(F.size(F.array_except("need", "tokens")) == 0).select("query", "term")


def term_weights(terms: DataFrame, queries: DataFrame, active: DataFrame | None = None, expanded: DataFrame | None = None, expanded_weight: float = 0.5) -> DataFrame:
    """(query, kind, term, c): what each of terms(kind, term) counts for queries(query, task, concepts), as a multiple of 2^-20.

    A tag counts 1 if the task has all its tokens and 2 if it is a concept, a trigger 3 if it is a concept, else 1 if the
    task has its tokens; what counts nothing so far counts expanded_weight times 2 (triggers: 3) if it is one of
    expanded(query, term). A domain of active(query, name) counts 2.
    """
    words = terms.where("kind in ('t', 'g')").select("term").distinct()
    mark = lambda df, name: df.select("query", "term", *[F.lit(int(n == name)).alias(n) for n in ("said", "named", "more")])
    named = queries.select("query", F.explode("concepts").alias("c")).select("query", F.lower("c").alias("term")).distinct().join(words, "term")
    found = [mark(said_terms(words, queries.select("query", tokenize(F.coalesce("task", F.lit(""))).alias("tokens"))), "said"), mark(named, "named")]
    if expanded is not None:
        found.append(mark(expanded.select("query", F.lower("term").alias("term")).distinct().join(words, "term"), "more"))
    flags = reduce(DataFrame.unionByName, found).groupBy("query", "term").agg(*[F.max(n).alias(n) for n in ("said", "named", "more")])
    tag = F.when(F.col("said") + F.col("named") > 0, F.col("said") + 2 * F.col("named")).otherwise(2 * expanded_weight * F.col("more"))
    trigger = F.when(F.col("named") > 0, 3).when(F.col("said") > 0, 1).otherwise(3 * expanded_weight * F.col("more"))
    c = F.round(F.when(F.col("kind") == "t", tag).otherwise(trigger) * UNIT).cast("long")
    out = terms.where("kind in ('t', 'g')").select("kind", "term").distinct().join(flags, "term").select("query", "kind", "term", c.alias("c"))
    if active is not None:
        out = out.unionByName(active.select("query", F.lit("d").alias("kind"), F.col("name").alias("term"), F.lit(2 * UNIT).cast("long").alias("c")).distinct())
    return out.where("c > 0")


def keyword_topk(rules: DataFrame, queries: DataFrame, k: int, active: DataFrame | None = None, expanded: DataFrame | None = None, expanded_weight: float = 0.5, multipliers: DataFrame | None = None, also: DataFrame | None = None, long_list: int = LONG) -> tuple[DataFrame, DataFrame]:
    """((query, id, score), (query, score)): each query's k best rules by ``keyword_score`` times multipliers(id, multiplier), and its distinct scores.

    rules and queries may have the columns of RULE_SCOPE and QUERY_SCOPE. Pairs of also(query, id) that score are among
    the rows whatever their rank. Ties go to the smaller id.
    """
    base = scratch(rules.sparkSession, "ranking")
    rules = with_columns(rules, RULE_SCOPE)
    rules = rules.join(multipliers.select("id", "multiplier"), "id", "left") if multipliers is not None else rules.withColumn("multiplier", F.lit(1.0))
    facts = ["weight", "multiplier", *RULE_SCOPE]
    post = rules.select("id", (priority_rank(F.col("priority")) + 1).alias("weight"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"), *RULE_SCOPE, F.explode(rule_terms(rules)).alias("x")).select("id", *facts, "x.*")
    seekers = with_columns(queries, QUERY_SCOPE).select("query", *QUERY_SCOPE)
    weights = term_weights(post.select("kind", "term").distinct(), queries, active, expanded, expanded_weight)
    weights = held(weights.join(seekers, "query"), f"{base}/weights")
    # only terms that some query names matter from here on
    post = held(post.join(weights.select("kind", "term").distinct(), ["kind", "term"]), f"{base}/postings")
    sizes = post.groupBy("kind", "term").agg(F.count("*").alias("n"))
    post = post.join(sizes.where(F.col("n") > long_list).select("kind", "term", F.lit(True).alias("long")), ["kind", "term"], "left").withColumn("long", F.coalesce("long", F.lit(False)))
    post = held(post, f"{base}/lists")
    met = lambda df: df.join(weights, ["kind", "term"]).where(visible())
    # 12 decimals: what is equal but for the order of its factors is one score
    scored = lambda multiplier: F.round(F.col("weight") * F.log1p(F.col("m") / F.lit(float(UNIT))) * F.col(multiplier), 12).alias("score")

    # by short lists
    pairs = met(post.where("not long")).select("query", "id")
    pairs = (pairs if also is None else pairs.unionByName(also.select("query", "id"))).distinct()
    own = weights.select("query", "kind", "term", "c", *QUERY_SCOPE)
    exact = pairs.join(post, "id").join(own, ["query", "kind", "term"]).where(visible())
    exact = exact.groupBy("query", "id", "weight", "multiplier").agg(F.sum(F.col("times") * F.col("c")).alias("m"))
    exact = held(exact.select("query", "id", scored("multiplier")), f"{base}/exact")

    # by long lists alone
    scope = ["signature", "weight", *RULE_SCOPE]
    alike = post.where("long").groupBy("id", *facts).agg(F.sort_array(F.collect_list(F.struct("kind", "term", "times"))).alias("signature"))
    alike = held(alike, f"{base}/alike")
    best = alike.withColumn("r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col("multiplier").desc(), "id"))).where(F.col("r") <= k)
    groups = best.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("r", "id", "multiplier"))).alias("first"))
    # the id of a group's best rule names the group
    groups = held(groups.withColumns({"group": F.col("first")[0]["id"], "most": F.col("first")[0]["multiplier"]}), f"{base}/groups")
    sums = met(groups.select("group", "weight", *RULE_SCOPE, F.explode("signature").alias("x")).select("group", "weight", *RULE_SCOPE, "x.*"))
    sums = held(sums.groupBy("query", "group", "weight").agg(F.sum(F.col("times") * F.col("c")).alias("m")), f"{base}/sums")
    opened = sums.join(groups.select("group", "most"), "group").select("query", F.col("group").alias("id"), "weight", "m", scored("most"))
    opened = top_k(opened, k).select("query", F.col("id").alias("group"), "weight", "m").join(groups.select("group", F.explode("first").alias("x")), "group")
    opened = opened.select("query", F.col("x.id").alias("id"), "weight", "m", F.col("x.multiplier").alias("multiplier")).select("query", "id", scored("multiplier"))

    # a rule met both ways has its exact score, never below that of its group
    every = exact.unionByName(opened).groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = top_k(every, k).select("query", "id", "score")
    if also is not None:
        ranked = ranked.unionByName(exact.join(also.select("query", "id").distinct(), ["query", "id"], "left_semi")).distinct()

    # distinct scores: of groups those multipliers that rules not met exactly have
    of_group = alike.join(groups.select(*[F.col(c).alias(f"_{c}") for c in scope], "group"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope]).select("id", "group", "multiplier")
    held_by = of_group.groupBy("group", "multiplier").agg(F.count("*").alias("n"))
    taken = exact.select("query", "id").join(of_group, "id").groupBy("query", "group", "multiplier").agg(F.count("*").alias("gone"))
    left = sums.join(held_by, "group").join(taken, ["query", "group", "multiplier"], "left").where(F.col("n") > F.coalesce("gone", F.lit(0)))
    levels = exact.select("query", "score").unionByName(left.select("query", scored("multiplier"))).distinct()
    return ranked, levels


def fuse_topk(ranked: DataFrame, levels: DataFrame, semantic: DataFrame, k: int, rrf: int = 60, w_keyword: float = 1.0, w_semantic: float = 1.0) -> DataFrame:
    """(query, id, score, hit): each query's k best by reciprocal ranks, from what ``keyword_topk`` gave with also = semantic.

    Ranks are dense: a keyword rank among all the query's scores, a semantic one among its hits of semantic(query, id,
    score) that score by keywords. k and the most hits of a query together must not exceed the k given there. hit says
    whether the query has such a hit at all; without one its scores stay.
    """
    places = levels.withColumn("rk", F.dense_rank().over(Window.partitionBy("query").orderBy(F.col("score").desc())))
    near = semantic.select("query", "id", F.col("score").alias("like")).join(ranked.select("query", "id"), ["query", "id"])
    near = near.withColumn("rs", F.dense_rank().over(Window.partitionBy("query").orderBy(F.col("like").desc()))).select("query", "id", "rs")
    both = ranked.join(places, ["query", "score"]).join(near, ["query", "id"], "left").join(near.select("query", F.lit(True).alias("hit")).distinct(), "query", "left")
    fused = F.lit(w_keyword) / (rrf + F.col("rk")) + F.coalesce(F.lit(w_semantic) / (rrf + F.col("rs")), F.lit(0.0))
    hit = F.coalesce("hit", F.lit(False))
    return top_k(both.select("query", "id", F.when(hit, fused).otherwise(F.col("score")).alias("score"), hit.alias("hit")), k)


def expand_terms(queries: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """(query, term): the ``most`` terms that rules with a term of the query name beside it, by number of rules, then by term.

    A rule's terms are its tags and triggers in lower case; a query has those whose tokens are all in its task or among
    its concepts. Rules with the same terms and scope are met as one, with their number.
    """
    asked = queries.select("query", F.array_union(tokenize(F.coalesce("task", F.lit(""))), F.transform("concepts", F.lower)).alias("tokens"))
    rules = with_columns(rules, RULE_SCOPE)
    terms = F.array_sort(F.array_distinct(F.transform(F.filter(rule_terms(rules), lambda x: x["kind"] != "d"), lambda x: x["term"])))
    alike = rules.select("id", *RULE_SCOPE, terms.alias("terms")).where(F.size("terms") > 0).groupBy("terms", *RULE_SCOPE).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    alike = held(alike, scratch(rules.sparkSession, "terms"))
    each = alike.select("id", "n", *RULE_SCOPE, F.explode("terms").alias("term"))
    said = said_terms(each, asked)
    hit = each.join(said, "term").join(with_columns(queries, QUERY_SCOPE).select("query", *QUERY_SCOPE), "query").where(visible()).select("query", "id").distinct()
    other = hit.join(each.select("id", "n", "term"), "id").join(said, ["query", "term"], "left_anti").groupBy("query", "term").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("query").orderBy(F.col("n").desc(), "term")
    return other.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query", "term")
