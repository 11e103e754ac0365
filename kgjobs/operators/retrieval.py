"""Ranking of rules for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import priority_rank, tokenize
from ..sources import scratch

#: Bytes of query vectors that one pass sends to the tasks.
QUERY_BYTES = 64 << 20
#: Scores of a block of queries against a batch of chunks that a task holds at a time.
SCORES = 4 << 20


def keyword_score(rules: DataFrame, queries: DataFrame, active: DataFrame | None = None, expanded: DataFrame | None = None, expanded_weight: float = 0.5) -> DataFrame:
    """(query, id, score): priority weight times ln(1 + matches) over tags(array) of rules and concepts of queries.

    A tag counts 1 if all its tokens are in the task and 2 if it is a concept; one of triggers(array, optional) of rules
    counts 3 if it is a concept, else 1 if all its tokens are in the task. What counts nothing so far counts
    ``expanded_weight`` times 2 (triggers: 3) if it is one of expanded(query, term). A rule whose domain is one of
    active(query, name) counts 2 more. Terms meet in an equi-join on tokens and on concepts, never rule by rule;
    queries(query, task, concepts).
    """
    tokens = queries.select("query", F.explode(tokenize(F.col("task"))).alias("token"))
    concepts = queries.select("query", F.explode("concepts").alias("concept")).select("query", F.lower("concept").alias("term")).distinct()

    def terms(column: str) -> DataFrame:
        return rules.select("id", F.posexplode(column).alias("n", "tag")).select("id", "n", F.lower("tag").alias("term"), F.array_distinct(tokenize(F.col("tag"))).alias("need"))

    def said(t: DataFrame) -> DataFrame:
        need = t.select("id", "n", F.size("need").alias("size"), F.explode("need").alias("token"))
        return need.join(tokens, "token").groupBy("query", "id", "n", "size").count().where("count = size").select("query", "id", "n")

    def beside(t: DataFrame, matched: DataFrame, weight: float) -> list[DataFrame]:
        if expanded is None:
            return []
        more = t.join(expanded.select("query", F.lower("term").alias("term")).distinct(), "term").select("query", "id", "n")
        return [more.join(matched, ["query", "id", "n"], "left_anti").withColumn("m", F.lit(weight * expanded_weight))]

    tags = terms("tags")
    whole, equal = said(tags), tags.join(concepts, "term").select("query", "id", "n")
    found = [whole.withColumn("m", F.lit(1.0)), equal.withColumn("m", F.lit(2.0)), *beside(tags, whole.unionByName(equal).distinct(), 2)]
    if "triggers" in rules.columns:
        triggers = terms("triggers")
        named = triggers.join(concepts, "term").select("query", "id", "n").withColumn("m", F.lit(3.0))
        either = named.unionByName(said(triggers).withColumn("m", F.lit(1.0))).groupBy("query", "id", "n").agg(F.max("m").alias("m"))
        found += [either, *beside(triggers, either, 3)]
    if active is not None:
        found.append(rules.select("id", F.col("domain").alias("name")).join(active.select("query", "name").distinct(), "name").select("query", "id", F.lit(-1).alias("n"), F.lit(2.0).alias("m")))
    total = reduce(DataFrame.unionByName, found).groupBy("query", "id").agg(F.sum("m").alias("m"))
    weight = rules.select("id", (priority_rank(F.col("priority")) + 1).alias("weight"))
    return total.join(weight, "id").select("query", "id", (F.col("weight") * F.log1p("m")).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col(by).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf_fuse(keyword: DataFrame, semantic: DataFrame, k: int = 60, w_keyword: float = 1.0, w_semantic: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion by dense ranks; only keyword candidates are fused."""
    rank = lambda d, name: d.withColumn(name, F.dense_rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).select("query", "id", name)
    both = rank(keyword, "rk").join(rank(semantic, "rs"), ["query", "id"], "left")
    return both.select("query", "id", (w_keyword / (k + F.col("rk")) + F.coalesce(w_semantic / (k + F.col("rs")), F.lit(0.0))).alias("score"))


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int | None = 100, above: float = 0.5) -> DataFrame:
    """(query, parent, score): best cosine per parent over each query's k nearest chunks (None: all) above the threshold.

    chunks(parent, chunk, embedding, owner if they have one), queries(query, embedding, user if owners count): chunks
    without an owner are everyone's. Queries go to the tasks in blocks of QUERY_BYTES; of each batch a task keeps the k
    best by score, then smallest chunk, so k rows a batch and query are shuffled. Scores of equal vectors are equal to
    the last bit, wherever they lie.
    """
    spark = chunks.sparkSession
    wide = queries.select(F.max(F.size("embedding"))).first()[0] or 1
    n = max(1, -(-queries.count() * wide * 8 // QUERY_BYTES))
    kinds = {"query": queries.schema["query"].dataType, **{c: chunks.schema[c].dataType for c in ("parent", "chunk")}}
    owned = "owner" in chunks.columns
    out = None
    for part in range(n):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == part).collect()
        users = [r["user"] if "user" in queries.columns else None for r in asked]
        sent = spark.sparkContext.broadcast(([r["query"] for r in asked], _unit(np.array([r.embedding for r in asked], float).reshape(len(asked), -1)), users))

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q, users = sent.value
            to = {c: to_arrow_type(t) for c, t in kinds.items()}
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                x, chunk = _unit(np.array(b.column("embedding").to_pylist(), float)), b.column("chunk").to_numpy(zero_copy_only=False)
                codes: dict = {}
                owner = np.array([-1 if o is None else codes.setdefault(o, len(codes)) for o in b.column("owner").to_pylist()]) if owned else None
                wide = max(1, SCORES // b.num_rows)  # queries at a time: a bounded matrix of scores
                for lo in range(0, len(names), wide):
                    rough = q[lo : lo + wide] @ x.T
                    if owned:
                        mine = np.array([codes.get(u, -2) if u is not None else -2 for u in users[lo : lo + wide]])
                        rough[(owner != -1) & (owner != mine[:, None])] = -np.inf
                    busy = np.flatnonzero(rough.max(axis=1) > above - 1e-9)
                    if not len(busy):
                        continue
                    best = [_best(rough[i], q[lo + i], x, chunk, k, above) for i in busy]
                    i, j = np.repeat(busy + lo, [len(at) for at, _ in best]), np.concatenate([at for at, _ in best])
                    yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in i], to["query"]), b.column("parent").take(pa.array(j)).cast(to["parent"]), b.column("chunk").take(pa.array(j)).cast(to["chunk"]), pa.array(np.concatenate([s for _, s in best]))], names=["query", "parent", "chunk", "score"])

        schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double"
        found = chunks.select("parent", "chunk", "embedding", *(["owner"] if owned else [])).mapInArrow(near, schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "chunk")
    best = out if k is None else out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return best.groupBy("query", "parent").agg(F.max("score").alias("score"))


def _best(rough: np.ndarray, v: np.ndarray, x: np.ndarray, chunk: np.ndarray, k: int | None, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of v's k best rows (None: all) of x above the threshold, by score, then chunk.

    A matrix product's last bits depend on a row's place, so it only tells which rows may count; these are summed alike.
    """
    least = above if k is None or len(rough) <= k else max(above, np.partition(rough, len(rough) - k)[len(rough) - k])
    at = np.flatnonzero(rough > least - 1e-9)
    score = (x[at] * v).sum(axis=1)
    order = np.lexsort((chunk[at], -score))[:k]
    order = order[score[order] > above]
    return at[order], score[order]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 0, x / np.maximum(norm, 1e-300), 0.0)


def representative_embedding(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("parent").agg(F.min_by("embedding", "chunk").alias("embedding"))


def embedding_coverage(chunks: DataFrame, current: str) -> DataFrame:
    """Per parent whether it is stale (a chunk with another or no fingerprint), then counts."""
    parents = chunks.groupBy("parent").agg(F.max(~F.col("fingerprint").eqNullSafe(F.lit(current))).alias("stale"))
    return parents.agg(F.count("*").alias("total"), F.count_if("stale").alias("pending"), F.count_if(~F.col("stale")).alias("embedded"))


#: Of a list of neighbours, how many are looked at first, then where these don't settle a query.
LOOKS = (4, 16)


def expand_graph(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int = 30, nodes: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """seeds(query, id) and at most ``most`` neighbours over open edges in either direction, nearest first, then by id.

    Open edges have no valid_until, or one after ``now``. With nodes(id, owner if owners count) neighbours must be among
    these and, where they have an owner, it must be the user of seeds(query, id, user). A node's list is cut to what any
    query can take of it, by owner and id, so a hub's whole star meets no query. A query looks for what it still lacks
    alone. Lists are in order, so once their beginnings hold that much up to the least of their ends, the rest of them
    can't count; only queries for which that isn't so look further into their lists.
    """
    spark, base = seeds.sparkSession, scratch(seeds.sparkSession, "expand")
    open_ = F.col("valid_until").isNull() if now is None else F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(now).cast("timestamp"))
    both = edges.where(open_).select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null")
    owned = nodes is not None and "owner" in nodes.columns
    owner = ["owner"] if owned else []
    if nodes is not None:
        both = both.join(nodes.select(F.col("id").alias("dst"), *owner), "dst")
    user = ["user"] if owned and "user" in seeds.columns else []
    seen = seeds.select("query", "id", *user).distinct()
    widest = seen.groupBy("query").count().agg(F.max("count").alias("n")).first()["n"] or 0
    # of what a query hasn't seen it takes the first ``most``, and it has seen so many at most
    cap = widest + most * depth
    first = F.dense_rank().over(Window.partitionBy("src", *owner).orderBy("dst"))
    both = both.withColumn("n", first).where(F.col("n") <= cap)
    lists = held(both.groupBy("src", *owner).agg(F.sort_array(F.collect_set("dst")).alias("near")), f"{base}/lists")
    state = seen.groupBy("query").agg(F.collect_set("id").alias("seen"), *[F.first(c).alias(c) for c in user])
    state = held(state.withColumns({"front": F.col("seen"), "need": F.lit(most)}), f"{base}/state-0")
    out = seen.select("query", "id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        todo, ended = state.where("need > 0 and size(front) > 0"), []
        for look in [*(n for n in LOOKS if d > 1 and n < cap), cap]:
            heads = lists.select(F.col("src").alias("id"), *owner, F.slice("near", 1, look).alias("head"), F.when((F.size("near") > look) & F.lit(look < cap), F.get("near", F.lit(look - 1))).alias("last"))
            met = todo.select("query", F.explode("front").alias("id"), *user).join(heads, "id")
            if owned:
                met = met.where(F.col("owner").isNull() | (F.col("owner") == F.col("user") if user else F.lit(False)))
            met = met.groupBy("query").agg(F.flatten(F.collect_list("head")).alias("got"), F.min("last").alias("last"))
            got = F.sort_array(F.array_except("got", "seen"))
            new = todo.join(met, "query").withColumn("got", F.when(F.col("last").isNull(), got).otherwise(F.filter(got, lambda x: x <= F.col("last"))))
            new = new.select("query", F.slice("got", F.lit(1), F.col("need")).alias("new"), (F.col("last").isNull() | (F.size("got") >= F.col("need"))).alias("enough"))
            new = held(new, f"{base}/new-{d}-{look}")
            ended.append(new.where("enough").select("query", "new"))
            rest = new.where("not enough").select("query")
            if look == cap or rest.isEmpty():
                break
            todo = todo.join(rest, "query", "left_semi")
        found = reduce(DataFrame.unionByName, ended)
        out = out.unionByName(found.select("query", F.explode("new").alias("id"), F.lit(d).alias("depth")))
        if d < depth:
            after = state.join(found, "query").select("query", F.concat("seen", "new").alias("seen"), *user, F.col("new").alias("front"), (F.col("need") - F.size("new")).alias("need"))
            state = held(after, f"{base}/state-{d}")
    return out


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per case recall, precision, reciprocal rank and nDCG at k of ranked(case, rank, id) against expected(case, id)."""
    want = expected.distinct().groupBy("case").agg(F.count("*").alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(expected.distinct(), ["case", "id"]).groupBy("case").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    h = F.coalesce("h", F.lit(0))
    return want.join(hits, "case", "left").select("case", (h / F.col("n")).alias("recall"), (h / F.lit(k)).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def stale_parents(chunks: DataFrame, current: str, attempts: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Parents to embed again: a chunk with another or no fingerprint, and fewer attempts(parent, n) than ``most``."""
    stale = chunks.groupBy("parent").agg(F.max(~F.col("fingerprint").eqNullSafe(F.lit(current))).alias("stale")).where("stale").select("parent")
    return stale if attempts is None else stale.join(attempts.where(F.col("n") >= most), "parent", "left_anti")


def apply_multipliers(scored: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Scores times the rule's multiplier(id, multiplier); without one they stay."""
    return scored.join(multipliers, "id", "left").select("query", "id", (F.col("score") * F.coalesce("multiplier", F.lit(1.0))).alias("score"))


def merge_active(*ranked: DataFrame) -> DataFrame:
    """(query, id) lists one after the other; an id stays where it comes first."""
    tagged = [d.select("query", "id", F.lit(n).alias("part"), "rank") for n, d in enumerate(ranked)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    first = out.groupBy("query", "id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.select("query", "id", "at.part", "at.rank")


def extraction_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case precision, recall and F1 of predicted(case, name) against gold(case, name) on lower-trimmed names; two empty sets are no case."""
    one = lambda d, c: d.select("case", F.lower(F.trim("name")).alias("name")).distinct().withColumn(c, F.lit(1))
    both = one(predicted, "p").join(one(gold, "g"), ["case", "name"], "full")
    n = both.groupBy("case").agg(F.count("p").alias("p"), F.count("g").alias("g"), F.count(F.col("p") + F.col("g")).alias("tp"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, p, g = F.col("tp"), F.col("p"), F.col("g")
    return n.select("case", part(tp, p).alias("precision"), part(tp, g).alias("recall"), part(2 * tp, p + g).alias("f1"))


def mmr_rerank(ranked: DataFrame, k: int = 15, weight: float = 0.7) -> DataFrame:
    """ranked(query, rank, id, score, embedding) by maximal marginal relevance: (query, rank, id).

    Only the first k of a query are reordered, so a group in a task has at most k rows; those without an embedding come behind.
    """

    def order(rows):
        import pandas as pd

        rows = rows.sort_values("rank")
        held = rows[rows["embedding"].notna()]
        if len(held) > 1:
            e, s = _unit(np.array(held["embedding"].tolist(), float)), held["score"].to_numpy(float)
            span = s.max() - s.min()
            relevance, near, picked = (s - s.min()) / (span or 1.0), np.zeros(len(s)), []
            like, left = e @ e.T, np.ones(len(s), bool)
            while left.any():
                best = int(np.argmax(np.where(left, weight * relevance - (1 - weight) * near, -np.inf)))
                near, left[best] = like[best] if not picked else np.maximum(near, like[best]), False
                picked.append(best)
            ids = [*held["id"].iloc[picked], *rows.loc[rows["embedding"].isna(), "id"]]
        else:
            ids = list(rows["id"])
        return pd.DataFrame({"query": rows["query"].iloc[0], "rank": range(1, len(ids) + 1), "id": ids})

    kind = {f.name: f.dataType.simpleString() for f in ranked.schema}
    top = ranked.where(F.col("rank") <= k)
    done = top.groupBy("query").applyInPandas(order, f"query {kind['query']}, rank {kind['rank']}, id {kind['id']}")
    return done.unionByName(ranked.where(F.col("rank") > k).select("query", "rank", "id"))


def head_of(rule_id: Column) -> Column:
    """First two segments of git: and upload: ids of three or more."""
    parts = F.split(rule_id, ":")
    return F.when(rule_id.rlike("^(git|upload):") & (F.size(parts) >= 3), F.concat_ws(":", F.slice(parts, 1, 2)))


def mark_dirty_heads(embedded: DataFrame) -> DataFrame:
    """Heads of embedded(id), leaves that have new embeddings."""
    return embedded.select(head_of(F.col("id")).alias("head")).where("head is not null").distinct()


def head_coverage(heads: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row (with_vectors, total) of heads(head) against vectors(head)."""
    have = vectors.select("head", F.lit(True).alias("has")).distinct()
    return heads.join(have, "head", "left").agg(F.count("has").alias("with_vectors"), F.count("*").alias("total"))


def top_heads(vectors: DataFrame, queries: DataFrame, k: int = 3, fetched: int = 24, above: float = 0.4) -> DataFrame:
    """(query, head, score): the k best heads by their best centroid among the ``fetched`` nearest of vectors(head, ord, embedding)."""
    chunks = vectors.select(F.col("head").alias("parent"), F.xxhash64("head", "ord").alias("chunk"), "embedding")
    near = vector_topk(chunks, queries, fetched, above).select("query", F.col("parent").alias("id"), "score")
    return top_k(near, k).select("query", F.col("id").alias("head"), "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty ones, unequal sizes or no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot / size).otherwise(0.0)


def vector_fallback(ranked: DataFrame | None, chunks: DataFrame, queries: DataFrame, most: int = 500, above: float = 0.5) -> DataFrame:
    """(query, id, score): best cosine over the chunks(parent, embedding) of the first ``most`` of ranked(query, rank, id).

    ranked None: every parent is a candidate of every query, by blocks of matrix products; ``above`` is 0 at least then.
    """
    if ranked is None:
        size, parts = F.size("embedding"), []
        for n in [r["n"] for r in queries.select(size.alias("n")).where("n > 0").distinct().collect()]:
            alike = chunks.where(size == n).select("parent", F.lit(0).alias("chunk"), "embedding")
            parts.append(vector_topk(alike, queries.where(size == n).select("query", "embedding"), None, above))
        kinds = f"query {queries.schema['query'].dataType.simpleString()}, parent {chunks.schema['parent'].dataType.simpleString()}, score double"
        both = reduce(DataFrame.unionByName, parts, chunks.sparkSession.createDataFrame([], kinds))
        return both.groupBy("query", F.col("parent").alias("id")).agg(F.max("score").alias("score"))
    first = ranked.where(F.col("rank") <= most).select("query", "id")
    both = first.join(chunks.select(F.col("parent").alias("id"), F.col("embedding").alias("v")), "id").join(queries.select("query", "embedding"), "query")
    return both.groupBy("query", "id").agg(F.max(cosine(F.col("embedding"), F.col("v"))).alias("score")).where(F.col("score") > above)


def build_head_vectors(leaves: DataFrame, rounds: int = 10, per: int = 50, most: int = 8) -> DataFrame:
    """(head, ord, embedding): k-means centroids of each head's leaves(head, id, embedding), k = n / per, 1 to ``most``, of length 1.

    Starts are the smallest id, then the leaf farthest from all starts so far (smallest id of equals); then up to
    ``rounds`` rounds of squared distances; empty clusters go. A round joins the heads' few centroids to their leaves
    and averages by an aggregation that starts in the tasks, so no head meets in one task. Each round is a written table.
    """
    spark, base = leaves.sparkSession, scratch(leaves.sparkSession, "heads")
    leaves = leaves.select("head", "id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sizes = leaves.groupBy("head").agg(F.least(F.greatest(F.floor(F.count("*") / per), F.lit(1)), F.lit(most)).alias("k"), F.min(F.struct("id", "v")).alias("at"))
    centers = held(sizes.select("head", "k", F.array("at.v").alias("c")), f"{base}/start-0")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
    v = F.col("v")
    for n in range(1, most):
        open_ = centers.where("size(c) < k")
        if open_.isEmpty():
            break
        far = leaves.join(open_, "head").select("head", "id", "v", F.array_min(F.transform("c", lambda x: apart(x, v))).alias("d"))
        pick = far.groupBy("head").agg(F.min(F.struct((-F.col("d")).alias("d"), "id", "v")).alias("at"))
        more = F.when(F.col("at").isNotNull(), F.array_append("c", F.col("at.v"))).otherwise(F.col("c"))
        centers = held(centers.join(pick, "head", "left").select("head", "k", more.alias("c")), f"{base}/start-{n}")
    clusters = centers.select("head", F.posexplode("c").alias("ord", "c"))
    for n in range(rounds):
        at = clusters.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("ord", "c"))).alias("cs"))
        near = leaves.join(at, "head").select("head", "v", F.array_min(F.transform("cs", lambda x: F.struct(apart(x["c"], v).alias("d"), x["ord"].alias("ord"))))["ord"].alias("ord"))
        part = near.select("head", "ord", F.posexplode("v").alias("i", "x")).groupBy("head", "ord", "i").agg(F.avg("x").alias("x"))
        mean = part.groupBy("head", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
        new = held(mean, f"{base}/round-{n}")
        moved = new.join(clusters.withColumnRenamed("c", "old"), ["head", "ord"], "left").where(F.col("old").isNull() | (apart(F.col("c"), F.col("old")) > 1e-18))
        clusters, done = new, moved.isEmpty()
        if done:
            break
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return clusters.withColumn("n", length).select("head", "ord", F.transform("c", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x)).alias("embedding"))


def held(df: DataFrame, path: str) -> DataFrame:
    """df written to a folder and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
