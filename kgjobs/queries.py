"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .adapters import model, oracle
from .operators import feedback, graph, retrieval, rules

NOW = "2024-03-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R, E, C, M, G = (oracle(x) for x in ("rules", "feedback", "chunks", "memories", "edges"))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


STATS = f"""(select rule_id, count(*) filter (kind = 'tdk' and positive) as tdk_pass, count(*) filter (kind = 'tdk' and not positive) as tdk_fail,
 count(*) filter (kind = 'user' and positive) as user_pos, count(*) filter (kind = 'user' and not positive) as user_neg,
 count(*) filter (kind = 'compliance' and positive) as comp, count(*) filter (kind = 'compliance' and not positive) as non_comp,
 count(*) as usage_count, max(ts) as last_feedback_at from (select distinct * from {E}) group by rule_id)"""
PART = "case when {a} + {b} = 0 then 1.0 else 0.3 + {a}::double / ({a} + {b}) end"
RAW = f"""case when usage_count < 3 then 1.0 else greatest(0.3, least(1.3, 0.5 * {PART.format(a="tdk_pass", b="tdk_fail")}
 + 0.3 * {PART.format(a="user_pos", b="user_neg")} + 0.2 * {PART.format(a="comp", b="non_comp")})) end"""
DECAYED = f"1 + (({RAW}) - 1) * pow(2.0, -greatest((epoch_us(timestamp '{NOW}') - epoch_us(last_feedback_at)) / 86400e6, 0) / 90)"


@query(f"select * exclude (last_feedback_at), epoch_us(last_feedback_at) as last_us from {STATS}")
def feedback_stats(spark, d):
    return feedback.feedback_stats(model(spark, d, "feedback")).withColumn("last_us", F.unix_micros(F.col("last_feedback_at").cast("timestamp"))).drop("last_feedback_at")


@query(f"select user_id, rule_id, count(*) as usage_count, count(*) filter (positive) as positives from (select distinct * from {E}) group by all")
def user_feedback_stats(spark, d):
    s = feedback.feedback_stats(model(spark, d, "feedback"), ["user_id", "rule_id"])
    return s.select("user_id", "rule_id", "usage_count", (F.col("tdk_pass") + F.col("user_pos") + F.col("comp")).alias("positives"))


@query(f"select rule_id, round({RAW}, 6) as multiplier from {STATS}")
def confidence_multiplier(spark, d):
    return rounded(feedback.feedback_stats(model(spark, d, "feedback")).select("rule_id", feedback.confidence_multiplier().alias("multiplier")), "multiplier")


@query(f"select rule_id, round({DECAYED}, 6) as multiplier from {STATS}")
def decayed_multiplier(spark, d):
    return rounded(feedback.feedback_stats(model(spark, d, "feedback")).select("rule_id", feedback.decayed_multiplier(NOW).alias("multiplier")), "multiplier")


@query(f"select rule_id, round(m, 6) as multiplier, case when abs(m - 1) < 0.001 then 'unchanged' when m > 1 then 'boosted' else 'degraded' end as change from (select rule_id, {DECAYED} as m from {STATS})")
def recalculate_all(spark, d):
    s = feedback.feedback_stats(model(spark, d, "feedback"))
    return rounded(feedback.recalculate_all(s, s.select("rule_id", F.lit(1.0).alias("multiplier")), NOW), "multiplier")


@query(f"select case when m < 0.7 then 'low' when m <= 1.0 then 'neutral' else 'boosted' end as bucket, count(*) as n from (select {RAW} as m from {STATS}) group by all")
def confidence_buckets(spark, d):
    m = feedback.feedback_stats(model(spark, d, "feedback")).select(feedback.confidence_multiplier().alias("m"))
    return m.groupBy(F.when(F.col("m") < 0.7, "low").when(F.col("m") <= 1.0, "neutral").otherwise("boosted").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"select user_id, rule_id, count(*) as n from (select distinct user_id, rule_id from {E}) join (select user_id as u, count(*) as k from {E} where kind = 'user' group by user_id) on u = user_id, range(k) group by all")
def propagate_feedback(spark, d):
    e = model(spark, d, "feedback").withColumn("conversation", F.col("user_id"))
    signals = e.where("kind = 'user'").select("conversation", F.when(F.col("positive"), "Positive").otherwise("Negative").alias("signal"))
    return feedback.propagate_feedback(signals, e).groupBy(F.col("conversation").alias("user_id"), "rule_id").agg(F.count("*").alias("n"))


@query(f"select rule_id, round(0.3 + 0.7 * avg(positive::int), 6) as multiplier from (select *, row_number() over (partition by rule_id order by event_id desc) as n from {E}) where n <= 20 group by rule_id")
def sliding_confidence(spark, d):
    e = model(spark, d, "feedback").select("rule_id", F.col("event_id").alias("seq"), F.col("positive").alias("passed"), F.lit("h").alias("hash"))
    return rounded(feedback.sliding_confidence(e), "multiplier")


@query(f"select rule_id, round(list_reduce([1.0::double] || list(case when positive then 0.1::double else -0.2::double end order by event_id), lambda a, x: case when x > 0 then least(2.0, a + 0.1) else greatest(0.1, a - 0.2) end), 6) as multiplier from {E} group by rule_id")
def additive_confidence(spark, d):
    e = model(spark, d, "feedback").select("rule_id", F.col("event_id").alias("seq"), F.col("positive").alias("passed"))
    return rounded(feedback.additive_confidence(e), "multiplier")


@query(f"select id, domain, type from {R} where (owner is null or owner = 'user-3') and coalesce(tenant, 'default') = 'default'")
def scope_rules(spark, d):
    return rules.scope_rules(model(spark, d, "rules"), "user-3").select("id", "domain", "type")


TOOLED = "case when split_part(id, ':', 3)::bigint % 9 = 0 then 'tools.code' when split_part(id, ':', 3)::bigint % 9 = 1 then 'tools.files' else domain end"


@query(f"select id from {R} where (owner is null or owner = 'user-3') and coalesce(tenant, 'default') = 'default' and (valid_until is null or valid_until > timestamp '{NOW}') and (id like 'git:src1:%' or id like 'git:src2:%') and {TOOLED} <> 'tools.files'")
def compilation_scope(spark, d):
    r = model(spark, d, "rules").withColumn("n", F.split("id", ":")[2].cast("long") % 9)
    r = r.withColumn("domain", F.when(F.col("n") == 0, "tools.code").when(F.col("n") == 1, "tools.files").otherwise(F.col("domain")))
    prefixes = spark.createDataFrame([("git:src1",), ("git:src2",)], "prefix string")
    return rules.compilation_scope(r, "user-3", NOW, prefixes, ["tools.code"]).select("id")


@query(f"select id from {R} where contains(lower(id), 'then') or contains(lower(body), 'then') or contains(lower(domain), 'then')")
def search_rules(spark, d):
    return rules.search_rules(model(spark, d, "rules"), "Then").select("id")


@query(f"select id, (select count(*) from {R}) as total from {R} order by id limit 200 offset 50")
def page_rules(spark, d):
    return rules.page_rules(model(spark, d, "rules"), skip=50).select("id", "total")


@query(f"select id from {R} where split_part(id, ':', 2) in ('src1', 'src4')")
def dataset_visibility(spark, d):
    grants = model(spark, d, "rules").where("domain in ('src1', 'src4')").select(F.concat(F.lit("git:"), "domain").alias("dataset"), F.lit("ann").alias("user"))
    return rules.dataset_visibility(model(spark, d, "rules"), grants, "ann").select("id")


@query(f"select coalesce(domain, '*') as domain, coalesce(type, '*') as type, count(*) as total, count(*) filter (owner is null) as global_rules, count(owner) as owned_rules from {R} where coalesce(tenant, 'default') = 'default' group by grouping sets ((domain), (type), ())")
def graph_stats(spark, d):
    return rules.rule_statistics(model(spark, d, "rules"))


@query(f"select domain, count(*) as n from {R} group by domain having count(*) <= 60")
def thin_domains(spark, d):
    return rules.thin_domains(model(spark, d, "rules"), 60)


@query(f"select id as src, 'RELATED' as rel, prior_id as dst from {R} where prior_id not in (select id from {R})")
def dangling_refs(spark, d):
    r = model(spark, d, "rules")
    return rules.dangling_refs(r, r.select(F.col("id").alias("src"), F.lit("RELATED").alias("rel"), F.col("prior_id").alias("dst")))


BATCH = f"(select id, tag_lang, domain, priority, split_part(id, ':', 3)::bigint % 4 <> 1 as allowed from {R})"


@query(f"""select 'a' as op, id, case when tag_lang <> 'en' and allowed then tag_lang || ',' || domain || ',EN' else tag_lang || ',' || domain end as tags, priority, case when tag_lang <> 'en' and allowed then 'updated' else 'skipped' end as status from {BATCH}
 union all select 'r', id, case when tag_lang = 'de' and allowed then domain else tag_lang || ',' || domain end, priority, case when tag_lang = 'de' and allowed then 'updated' else 'skipped' end from {BATCH}
 union all select 's', id, tag_lang || ',' || domain, case when allowed then 'High' else priority end, case when priority <> 'High' and allowed then 'updated' else 'skipped' end from {BATCH}""")
def batch_rule_update(spark, d):
    r = model(spark, d, "rules").select("id", F.array("tag_lang", "domain").alias("tags"), "priority")
    allowed = r.select("id", (F.split("id", ":")[2].cast("long") % 4 != 1).alias("allowed"))
    done = [rules.batch_rule_update(r, r, op, value, allowed).withColumn("op", F.lit(name)) for name, op, value in (("a", "AddTag", "EN"), ("r", "RemoveTag", "DE"), ("s", "SetPriority", "High"))]
    return done[0].unionByName(done[1]).unionByName(done[2]).withColumn("tags", F.array_join("tags", ","))


TOTALS = f"""select count(*) as total, count(*) filter (owner is null) as global_rules, count(owner) as owned_rules, count(*) filter (split_part(id, ':', 3)::bigint % 6 = 0) as with_validator,
 count(*) filter (id in (select parent from {C})) as with_chunks, (select count(*) from {R} where coalesce(tenant, 'default') = 'default' and domain <> 'src3') as edges from {R} where coalesce(tenant, 'default') = 'default'"""


@query(TOTALS)
def graph_totals(spark, d):
    r = model(spark, d, "rules").withColumn("script", F.when(F.split("id", ":")[2].cast("long") % 6 == 0, "x = 1"))
    edges = r.select(F.col("id").alias("src"), F.when(F.col("domain") == "src3", "HAS_CHUNK").otherwise("RELATED").alias("rel"), F.col("prior_id").alias("dst"))
    return rules.graph_totals(r, edges, model(spark, d, "chunks"))


WORDY = "[^\\p{L}\\p{Mn}\\p{Nd}\\p{Pc}]+"
STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@query(f"""select 'custom-tool-get-' || source || '-' || lang || '-' || doc_id as id, 'tool,custom-tool,get-' || source || '-' || lang || '-' || doc_id || ',x,' || lang as tags,
 list_sort(list_distinct(list_concat(list_filter(['get', source, lang, doc_id::varchar], lambda p: length(p) >= 3), list_filter(regexp_split_to_array(lower(text), '{WORDY}'), lambda w: length(w) >= 4 and w not in ({STOPS})), ['custom-tool']))) as concepts from documents""")
def tool_keywords(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    tools = x.select(F.concat(F.lit(" Get_"), "source", F.lit(". "), F.upper("lang"), F.lit("--!"), "doc_id").alias("name"), F.col("text").alias("description"), F.array(F.lit(" X "), F.lit(""), "lang", F.lit("Tool")).alias("tags"))
    return rules.tool_keywords(tools).select("id", F.array_join("tags", ",").alias("tags"), F.array_sort("concepts").alias("concepts"))


@query(f"select domain, id from {R} a where not exists (select 1 from {R} b where b.domain = a.domain and b.prior_id = a.id)")
def suppress_contradictions(spark, d):
    r = model(spark, d, "rules")
    relations = r.select(F.col("id").alias("src"), F.lit("SUPERSEDES").alias("rel"), F.col("prior_id").alias("dst"))
    return rules.suppress_contradictions(r.select(F.col("domain").alias("query"), "id", "priority"), relations).select(F.col("query").alias("domain"), "id")


@query(f"select domain, max(id) as id from {R} group by domain")
def dedupe_items(spark, d):
    return rules.first_per_id(model(spark, d, "rules").select("domain", "id"), "domain", F.col("id").desc())


@query("""with x as (select doc_id as id, sha256(text) as hash, case when doc_id % 10 = 0 then 'new' when doc_id % 10 = 1 then 'changed' else 'unchanged' end as status from documents)
 select id, status, case when status = 'new' then 'new' else 'changed' end as forced, case when status = 'unchanged' or id % 3 <> 0 then hash end as recorded from x""")
def incremental_sync(spark, d):
    """A tenth of the documents is new, a tenth has changed; of these, each third fails and is not recorded."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    manifest = docs.where("id % 10 <> 0").withColumn("hash", F.when(F.col("id") % 10 == 1, "old").otherwise(F.col("hash")))
    manifest = manifest.unionByName(docs.select((-1 - F.col("id")).alias("id"), "hash"))  # items that are no longer there
    status = rules.incremental_status(docs, manifest)
    forced = rules.incremental_status(docs, manifest, force=True).withColumnRenamed("status", "forced")
    recorded = rules.next_manifest(docs, status, docs.where("id % 3 = 0").select("id")).withColumnRenamed("hash", "recorded")
    return status.join(forced, "id").join(recorded, "id", "full")


@query("select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'))) as n_tokens from documents")
def tokenize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(fn.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query("select page_id, case when slug = '' then 'import' else slug end as slug from (select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug from pages)")
def slugify(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fn.slugify(F.col("url")).alias("slug"))


@query("select doc_id, ceil(length(text) / 4.0)::bigint as tokens from documents")
def estimate_tokens(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"select id, 'memory-' || owner || '-' || left(sha256(trim(body)), 16) as memory_id from {M}")
def memory_id(spark, d):
    return model(spark, d, "memories").select("id", fn.memory_id(F.col("owner"), F.col("body")).alias("memory_id"))


@query(f"select id, round(pow(2.0, -greatest(date_diff('day', created, date '2024-06-01'), 0) / 90.0), 6) as recency from {M}")
def recency_factor(spark, d):
    return rounded(model(spark, d, "memories").select("id", fn.recency_factor(F.col("created"), F.lit("2024-06-01").cast("date"), 90).alias("recency")), "recency")


@query(f"select id from (select *, row_number() over (partition by owner, trim(regexp_replace(lower(body), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) order by created desc nulls last, id) as n from {M}) where n = 1")
def dedupe_exact(spark, d):
    return graph.dedupe_exact(model(spark, d, "memories")).select("id")


@query(f"select id from {M} where pow(2.0, -greatest(date_diff('day', created, date '2024-06-01'), 0) / 30.0) > 0.05")
def prune_faded(spark, d):
    return graph.prune_faded(model(spark, d, "memories"), F.lit("2024-06-01").cast("date"), 30).select("id")


@query(f"select src, rel, dst from {G} where valid_from <= date '1996-06-01' and (valid_until is null or valid_until > date '1996-06-01')")
def edges_as_of(spark, d):
    return graph.edges_as_of(model(spark, d, "edges"), F.lit("1996-06-01").cast("date")).select("src", "rel", "dst")


@query(f"select distinct least(src, dst) as a, greatest(src, dst) as b from {G} where rel = 'CONFLICTS_WITH' and src <> dst")
def conflict_pairs(spark, d):
    return graph.conflict_pairs(model(spark, d, "edges"))


@query(f"select dst as id from {G} where src = 7 union select src from {G} where dst = 7")
def neighbors(spark, d):
    return graph.neighbors(model(spark, d, "edges"), 7)


@query(f"""with cur as (select * from {G}), dec as (select src, rel, dst from cur where dst % 2 = 0 union select src, rel, dst + 1000 from cur where dst % 10 = 1),
touched as (select distinct src, rel, true as t from dec)
select coalesce(c.src, x.src) as src, coalesce(c.rel, x.rel) as rel, coalesce(c.dst, x.dst) as dst, coalesce(c.valid_from, date '2024-01-01')::date as valid_from,
(case when x.src is not null then null when t.t and c.valid_until is null then date '2024-01-01' else c.valid_until end)::date as valid_until
from cur c full join dec x on c.src = x.src and c.rel = x.rel and c.dst = x.dst left join touched t on t.src = coalesce(c.src, x.src) and t.rel = coalesce(c.rel, x.rel)""")
def upsert_edges(spark, d):
    e = model(spark, d, "edges").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_until")})
    declared = e.where("dst % 2 = 0").select("src", "rel", "dst").unionByName(e.where("dst % 10 = 1").select("src", "rel", (F.col("dst") + 1000).alias("dst")))
    return graph.upsert_edges(e, declared, F.lit("2024-01-01").cast("date"))


@query(f"select parent, min(vec_id) as first_chunk from {C} group by parent")
def representative_embedding(spark, d):
    c = model(spark, d, "chunks").withColumnRenamed("vec_id", "chunk")
    rep = retrieval.representative_embedding(c)
    return rep.join(c, ["parent", "embedding"]).groupBy("parent").agg(F.min("chunk").alias("first_chunk"))


@query(f"select count(*) as total, count(*) filter (stale) as pending, count(*) filter (not stale) as embedded from (select parent, bool_or(fingerprint is distinct from 'now') as stale from {C} group by parent)")
def embedding_coverage(spark, d):
    return retrieval.embedding_coverage(model(spark, d, "chunks"), "now")


@query(f"""with q as (select vec_id as query, embedding as e from embeddings where vec_id % 20 = 0),
s as (select query, parent, c.vec_id, list_cosine_similarity(c.embedding::double[], q.e::double[]) as score from {C} c, q),
n as (select *, row_number() over (partition by query order by score desc, vec_id) as n from s where score > 0.5)
select query, parent, round(max(score), 6) as score from n where n <= 100 group by all""")
def vector_topk(spark, d):
    c = model(spark, d, "chunks").withColumnRenamed("vec_id", "chunk")
    q = c.where("chunk % 20 = 0").select(F.col("chunk").alias("query"), "embedding")
    return rounded(retrieval.vector_topk(c, q), "score")


@query(f"""with r as (select id, priority, [tag_lang, tag_source] as tags from {R}), q as (select item_id as query, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) as tokens from benchmark),
t as (select id, unnest(tags) as tag from r), m as (select query, id, count(*) as m from q, t where list_contains(tokens, lower(tag)) group by all)
select query, id, round((case priority when 'Low' then 1 when 'High' then 3 when 'Critical' then 4 else 2 end) * ln(1 + m), 6) as score from m join r using (id)""")
def keyword_score(spark, d):
    r = model(spark, d, "rules").select("id", "priority", F.array("tag_lang", "tag_source").alias("tags"))
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query"), F.col("text").alias("task"), F.array().cast("array<string>").alias("concepts"))
    return rounded(retrieval.keyword_score(r, q), "score")


@query(f"""with k as (select tag_lang as query, id, length(body) % 50 as score from {R}), s as (select tag_lang as query, id, length(body) % 7 as score from {R} where length(body) % 3 = 0),
rk as (select query, id, dense_rank() over (partition by query order by score desc) as rk from k), rs as (select query, id, dense_rank() over (partition by query order by score desc) as rs from s)
select query, id, round(1.0 / (60 + rk) + coalesce(1.0 / (60 + rs), 0), 6) as score from rk left join rs using (query, id)""")
def rrf_fuse(spark, d):
    r = model(spark, d, "rules").select(F.col("tag_lang").alias("query"), "id", F.length("body").alias("n"))
    return rounded(retrieval.rrf_fuse(r.select("query", "id", (F.col("n") % 50).alias("score")), r.where("n % 3 = 0").select("query", "id", (F.col("n") % 7).alias("score"))), "score")


@query(f"""with r as (select domain as c, id, row_number() over (partition by domain order by length(body) desc, id) as rank, priority from {R}), x as (select c, id from r where priority = 'High'),
n as (select c, count(*) as n from x group by c), h as (select c, count(*) as h, min(rank) as f, sum(1 / log2(rank + 1)) as dcg from r where priority = 'High' and rank <= 10 group by c)
select c as "case", round(coalesce(h, 0) / n, 6) as recall, round(coalesce(h, 0) / 10, 6) as precision, round(coalesce(1 / f, 0), 6) as mrr,
round(coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(n, 10) + 1)]), 0), 6) as ndcg from n left join h using (c)""")
def retrieval_metrics(spark, d):
    r = model(spark, d, "rules").select(F.col("domain").alias("query"), "id", F.length("body").alias("score"), "priority")
    ranked = retrieval.top_k(r, 10).select(F.col("query").alias("case"), "rank", "id")
    return rounded(retrieval.retrieval_metrics(ranked, r.where("priority = 'High'").select(F.col("query").alias("case"), "id"), 10), "recall", "precision", "mrr", "ndcg")


BY_USER = STATS.replace("select rule_id,", "select user_id, rule_id,").replace("group by rule_id", "group by user_id, rule_id")


@query(f"""with u as (select user_id, rule_id, usage_count as n, {RAW} as own from {BY_USER}), w as (select rule_id, {DECAYED} as world from {STATS})
 select user_id, rule_id, round(case when n >= 3 then 0.6 * own + 0.4 * coalesce(world, 1.0) else coalesce(world, 1.0) end, 6) as multiplier from u left join w using (rule_id)""")
def user_multipliers(spark, d):
    return rounded(feedback.user_multipliers(model(spark, d, "feedback"), NOW), "multiplier")


@query(f"""with both_ as (select distinct src as a, dst as b from {G} where valid_until is null union select dst, src from {G} where valid_until is null), s as (select distinct src as query from {G}),
 d1 as (select query, b as id, row_number() over (partition by query order by b) as k from s join both_ on a = query where b <> query qualify k <= 30),
 n2 as (select distinct d1.query, b as id from d1 join both_ on a = d1.id where b <> d1.query and (d1.query, b) not in (select (query, id) from d1)),
 d2 as (select query, id, row_number() over (partition by query order by id) as k from n2 qualify k <= 30),
 e as (select query, id, depth, row_number() over (partition by query order by depth, id) as k from (select query, id, 1 as depth from d1 union all select query, id, 2 from d2))
 select query, query as id, 0 as depth from s union all select query, id, depth from e where k <= 30""")
def expand_graph(spark, d):
    e = model(spark, d, "edges")
    return retrieval.expand_graph(e.select(F.col("src").alias("query"), F.col("src").alias("id")).distinct(), e)


@query(f"""with recursive o as (select domain as query, id, length(body) + length(id) + length(type) + 16 as size, priority = 'Critical' and split_part(id, ':', 3)::bigint % 5 = 0 as safe, row_number() over (partition by domain order by id) as n from {R}),
 b as (select query, 0::bigint as n, 0::bigint as used, null::varchar as id, false as kept from (select distinct query from o)
  union all select b.query, o.n, b.used + case when safe or b.used + o.size <= 12000 then o.size else 0 end, o.id, safe or b.used + o.size <= 12000 from b join o on o.query = b.query and o.n = b.n + 1)
 select query, id from b where kept""")
def apply_budget(spark, d):
    r = model(spark, d, "rules")
    safe = r.where((F.col("priority") == "Critical") & (F.split("id", ":")[2].cast("long") % 5 == 0)).select(F.col("domain").alias("query"), "id")
    sized = r.select(F.col("domain").alias("query"), F.col("id").alias("pos"), "id", (F.length("body") + F.length("id") + F.length("type") + 16).cast("long").alias("size"))
    return rules.apply_budget(sized, protected=safe)


STYLED_TEXT = """case doc_id % 7 when 0 then concat('  # h', chr(10), text) when 1 then concat('| a |', chr(10), ' | b', chr(10), '|', chr(10), lang) when 2 then concat('let a = 1', chr(10), 'def f(', chr(10), 'x }', chr(10), chr(10), source) when 3 then concat('a ```', text, '``` b') else text end"""
STYLED_NAME = "case doc_id % 5 when 0 then 'a.b/C.PY' when 1 then 'x.mdx' when 2 then 'notes.txt' when 3 then 'no extension' end"


@query(f"""with x as (select doc_id, {STYLED_TEXT} as text, {STYLED_NAME} as name from documents), l as (select doc_id, text, case when contains(name, '.') then lower(regexp_extract(name, '\\.[^.]*$')) end as ext, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\\S')) as f from x),
 c as (select *, len(list_filter(f, lambda s: starts_with(ltrim(s), '|'))) as t, len(list_filter(f, lambda s: starts_with(ltrim(s), '#'))) as h, len(list_filter(f, lambda s: regexp_matches(s, '[;{{}}]\\s*$|^\\s*(import|from|def|class|function|public|private|const|var|let|func) \\s*\\S'))) as k from l)
 select doc_id, case when ext = '.py' then 'code' when len(f) = 0 then 'prose' when t >= 3 and t >= len(f) * 0.5 then 'table' when ext = '.mdx' or h > 0 or t > 0 or regexp_matches(text, '(?s)```.*```') then 'markdown' when ext is null and k >= greatest(3, len(f) * 0.4) then 'code' else 'prose' end as style from c""")
def detect_style(spark, d):
    """Documents as they are, or with headings, tables, code or fences, with and without names of files."""
    x = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{STYLED_TEXT} as text", f"{STYLED_NAME} as name")
    return x.select("doc_id", fn.detect_style(F.col("text"), F.col("name")).alias("style"))


@query("""with b as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as t from pages)
 select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')) as text from b""")
def html_to_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fn.html_to_text(F.col("html")).alias("text"))


@query(f"""select o_orderpriority as norm, count(distinct o_custkey) as mentions from orders group by all""")
def ingest_entities(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.lit("concept").alias("type"), F.col("o_orderpriority").alias("description"))
    return graph.ingest_entities(o).select(F.upper("norm").alias("norm"), "mentions")
