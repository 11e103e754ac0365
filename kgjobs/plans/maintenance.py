"""Chunks, graph upkeep, memories, audits and evaluation over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..adapters import model
from ..operators import chunking, feedback, graph, ingest, retrieval
from ..queries import DECAYED, NOW, QUERIES, RAW, SQL, STATS, C, E, G, M, R, query, rounded
from ..sources import scratch
from ..sources.rule_files import RuleFiles

AT = f"timestamp '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@query()
def chunk_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return chunking.chunk_documents(docs.select(F.col("doc_id").alias("id"), "text"))


def _deleted(spark, d):
    r = model(spark, d, "rules").withColumns({"valid_until": F.col("valid_until").cast("timestamp"), "deleted_at": F.lit(None).cast("timestamp")})
    return r, graph.soft_delete(r, r.where("type = 'Rule'").select("id"), now())


@query(f"select id, type = 'Rule' as deleted, epoch_us(case when type = 'Rule' then coalesce(valid_until, {AT}) else valid_until end) as until_us from {R}")
def soft_delete(spark, d):
    return _deleted(spark, d)[1].select("id", F.col("deleted_at").isNotNull().alias("deleted"), F.unix_micros("valid_until").alias("until_us"))


@query(f"select id, type = 'Rule' and priority <> 'Low' as deleted, epoch_us(case when type = 'Rule' and priority <> 'Low' then coalesce(valid_until, {AT}) else valid_until end) as until_us from {R}")
def restore(spark, d):
    r, gone = _deleted(spark, d)
    back = graph.restore(gone, r.where("priority = 'Low'").select("id"))
    return back.select("id", F.col("deleted_at").isNotNull().alias("deleted"), F.unix_micros("valid_until").alias("until_us"))


@query(f"select id from {R} where not starts_with(id, 'git:src1:')")
def delete_subtree(spark, d):
    return graph.delete_subtree(model(spark, d, "rules"), "git:src1").select("id")


@query(f"select distinct owner from {R} where type = 'Guideline' and owner is not null")
def list_owners(spark, d):
    return graph.list_owners(model(spark, d, "rules"), "Guideline")


@query("""with recursive e as (select 'all' as parent, r_name as child from region union select r_name, n_name from region join nation on n_regionkey = r_regionkey
 union select distinct n_name, c_mktsegment || n_nationkey from customer join nation on c_nationkey = n_nationkey),
 t as (select * from e union select t.parent, e.child from t join e on t.child = e.parent) select parent, child from t""")
def domain_closure(spark, d):
    region, nation, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "customer"))
    placed = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
    edges = region.select(F.lit("all").alias("parent"), F.col("r_name").alias("child"))
    edges = edges.unionByName(region.join(nation, region["r_regionkey"] == nation["n_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    edges = edges.unionByName(placed.select(F.col("n_name").alias("parent"), F.concat("c_mktsegment", F.col("n_nationkey").cast("string")).alias("child")).distinct())
    return graph.descendants(edges)


@query(f"""select id, epoch_us(case when valid_until is null and b is not null then {AT} else valid_until end) as until_us, case when valid_until is null then b end as invalidated_by
 from {R} r left join (select prior_id as p, min(id) as b from {R} where valid_until is null group by prior_id) on p = r.id""")
def invalidate_superseded(spark, d):
    r = model(spark, d, "rules").withColumn("valid_until", F.col("valid_until").cast("timestamp"))
    done = graph.invalidate_superseded(r, r.select(F.col("id").alias("src"), F.col("prior_id").alias("dst")), now())
    return done.select("id", F.unix_micros("valid_until").alias("until_us"), "invalidated_by")


@query(f"""with r as (select *, split_part(id, ':', 3)::bigint as n from {R}), g as (select a.id, min(b.id) as by_ from r a join r b on b.n = a.n + 1 and b.valid_until is null and a.valid_until is null group by a.id),
 e as (select b.id as src, case when b.n % 3 = 0 then 'RELATED' else 'SUPERSEDES' end as rel, a.id as dst from r a join r b on b.n = a.n + 1)
 select src, rel, dst, src in (select id from g) or (dst in (select id from g) and rel <> 'SUPERSEDES') as closed from e""")
def close_edges(spark, d):
    """Every rule is superseded by the next one; the edges of rules that this closes."""
    r = model(spark, d, "rules").withColumns({"n": F.split("id", ":")[2].cast("long"), "valid_until": F.col("valid_until").cast("timestamp")})
    links = r.select(F.col("id").alias("src"), (F.col("n") - 1).alias("n"), F.when(F.col("n") % 3 == 0, "RELATED").otherwise("SUPERSEDES").alias("rel")).join(r.select(F.col("id").alias("dst"), "n"), "n")
    done = graph.invalidate_superseded(r, links.select("src", "dst"), now())
    edges = graph.close_edges(links.select("src", "rel", "dst", F.lit(None).cast("timestamp").alias("valid_until")), done, now())
    return edges.select("src", "rel", "dst", F.col("valid_until").isNotNull().alias("closed"))


RELATIONS = "select lower(p_brand) as src, lower(p_type) as dst, count(*) as weight from lineitem join part on l_partkey = p_partkey group by all"


def _relations(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    r = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.col("l_orderkey").alias("seq"), F.lit("made as").alias("description"))
    names = part.select(F.explode(F.array("p_brand", "p_type")).alias("name")).select(F.lower(F.trim("name")).alias("norm")).distinct()
    return graph.ingest_relations(r, names)


@query(RELATIONS)
def ingest_relations(spark, d):
    return _relations(spark, d).select("src", "dst", "weight")


@query(f"with r as ({RELATIONS}) select distinct name, other from (select src as name, dst as other from r union all select dst, src from r) where name in (select lower(p_brand) from part)")
def related_entities(spark, d):
    return graph.related_entities(_relations(spark, d), spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("name")).distinct())


@query(f"""with q as (select conv_id as query, 'u' || (conv_id % 10) as owner, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-zà-ÿ ]', '', 'g'), ' '), lambda x: length(x) > 2))) as term from conversations where turn = 0),
 h as (select query, m.id, created, count(*) as n from q join {M} m on m.owner = q.owner and contains(lower(body), term) group by all),
 s as (select *, pow(2.0, -greatest(date_diff('day', created, date '2024-06-01'), 0) / 90.0) as recency from h), t as (select *, n * recency * case when id % 3 = 0 then 0.1 else 1.0 end as score from s),
 k as (select *, row_number() over (partition by query order by round(score, 12) desc, recency desc, id) as rank from t)
 select query, rank, id, round(score, 6) as score from k where rank <= 10""")
def recall(spark, d):
    """The words of every conversation's first row are looked for in all its owner's memories, a third of them superseded."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("turn = 0")
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ ]", ""), " ")
    asked = c.select(F.col("conv_id").alias("query"), F.concat(F.lit("u"), F.col("conv_id") % 10).alias("owner"), F.array_distinct(F.filter(words, lambda x: F.length(x) > 2)).alias("terms"))
    m = model(spark, d, "memories").withColumn("superseded", F.col("id") % 3 == 0)
    return rounded(graph.recall(m, asked, F.lit("2024-06-01").cast("date")), "score")


@query(f"select rule_id, round(m, 2) as multiplier from (select rule_id, {RAW} as m from {STATS}) where m < 0.7")
def low_confidence(spark, d):
    m = feedback.feedback_stats(model(spark, d, "feedback")).select("rule_id", feedback.confidence_multiplier().alias("multiplier"))
    return feedback.low_confidence(m)


@query(f"select rule_id, age_days from (select rule_id, ((epoch_us({AT}) - epoch_us(last_feedback_at)) // 86400000000)::bigint as age_days from {STATS}) where age_days > 30")
def stale_rules(spark, d):
    return feedback.stale_rules(feedback.feedback_stats(model(spark, d, "feedback")), NOW, 30)


@query(f"select rule_id, kind = 'tdk' as positive, count(*) as n from {E} where kind in ('tdk', 'user') group by all")
def rating_events(spark, d):
    said = F.when(F.col("kind") == "tdk", "helpful").when(F.col("kind") == "user", "outdated").otherwise("unknown")
    e = feedback.rating_events(model(spark, d, "feedback").select("rule_id", said.alias("rating")))
    return e.groupBy("rule_id", "positive").agg(F.count("*").alias("n"))


@query(f"select distinct parent from {C} where fingerprint is distinct from 'now'")
def stale_embeddings(spark, d):
    return retrieval.stale_parents(model(spark, d, "chunks"), "now")


@query(f"select id, round((length(body) % 50) * coalesce(m, 1), 6) as score from {R} r left join (select rule_id, {DECAYED} as m from {STATS}) f on f.rule_id = split_part(r.id, ':', 3)::bigint")
def apply_multipliers(spark, d):
    r = model(spark, d, "rules").select(F.col("tag_lang").alias("query"), F.split("id", ":")[2].cast("long").alias("id"), (F.length("body") % 50).alias("score"), F.col("id").alias("rule"))
    m = feedback.feedback_stats(model(spark, d, "feedback")).select(F.col("rule_id").alias("id"), feedback.decayed_multiplier(NOW).alias("multiplier"))
    done = retrieval.apply_multipliers(r, m).join(r.select("id", "rule"), "id")
    return rounded(done.select(F.col("rule").alias("id"), "score"), "score")


@query(f"""with a as (select domain as query, id, row_number() over (partition by domain order by length(body) desc, id) as rank from {R}), b as (select domain as query, id, row_number() over (partition by domain order by id) as rank from {R})
 select b.query, b.id, case when a.rank is null then 1 else 0 end as part, coalesce(a.rank, b.rank) as rank from b left join (select * from a where rank <= 15) a using (query, id)""")
def merge_active(spark, d):
    r = model(spark, d, "rules").select(F.col("domain").alias("query"), "id", F.length("body").alias("score"))
    by_id = r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return retrieval.merge_active(retrieval.top_k(r, 15), by_id)


@query("""with p as (select distinct l_orderkey as k, l_partkey as v from lineitem where l_quantity > 10), g as (select distinct l_orderkey as k, l_partkey as v from lineitem where l_discount > 0.02),
 n as (select coalesce(p.k, g.k) as k, count(p.v) as p, count(g.v) as g, count(p.v + g.v) as tp from p full join g on p.k = g.k and p.v = g.v group by 1)
 select k as "case", round(case when p > 0 then tp / p else 0 end, 6) as precision, round(case when g > 0 then tp / g else 0 end, 6) as recall, round(2 * tp / (p + g), 6) as f1 from n""")
def extraction_scores(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    named = lambda on: lines.where(on).select(F.col("l_orderkey").alias("case"), F.col("l_partkey").cast("string").alias("name"))
    return rounded(retrieval.extraction_scores(named("l_quantity > 10"), named("l_discount > 0.02")), "precision", "recall", "f1")


@query("select event_type, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95 from events group by event_type")
def percentile_nearest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) within group (order by value)").alias(c) for c, p in (("p50", 0.5), ("p95", 0.95))])


@query(f"select count(*) as cases, round(avg(recall), 5) as recall, round(avg(precision), 5) as precision, round(avg(mrr), 5) as mrr, round(avg(ndcg), 5) as ndcg from ({SQL['retrieval_metrics']})")
def benchmark_report(spark, d):
    m = QUERIES["retrieval_metrics"](spark, d)
    return m.agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


KEY = b"a key of the log"
CHAIN = """with l as (select 'audit-2024-01-' || lpad((user_id % 28 + 1)::varchar, 2, '0') || '.jsonl' as file, row_number() over (partition by user_id % 28 order by event_id) as line, event_id, sha256(event_id::varchar) as h, event_id % 90 <> 3 as parsed from events),
 s as (select *, case when event_id % 70 = 0 then line + 5 else line end as seq from l),
 b as (select *, last_value(case when parsed then {'line': line, 'seq': seq, 'h': h} end ignore nulls) over (partition by file order by line rows between unbounded preceding and 1 preceding) as p from s)
 select file, line, 'PARSE_ERROR' as issue from b where not parsed union all select file, line, 'HMAC_INVALID' from b where parsed and event_id % 60 = 7
 union all select file, line, 'SEQ_GAP' from b where parsed and seq <> coalesce(p.seq + line - p.line, line) union all select file, line, 'CHAIN_BROKEN' from b where parsed and event_id % 50 = 0 and p.h is not null"""


@query(CHAIN)
def verify_audit_chain(spark, d):
    """The events as signed lines of daily logs, some broken, forged, out of order or cut from the chain; written as files, read and checked."""
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 28 + 1).alias("day"), "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("entry_hash"), (F.col("event_id") % 90 != 3).alias("parsed"))
    w = Window.partitionBy("day").orderBy("event_id")
    before = F.last(F.when(F.col("parsed"), F.col("entry_hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"line": F.row_number().over(w), "before": F.coalesce(before, F.lit(""))})
    entry = F.to_json(F.struct((F.col("line") + F.when(F.col("event_id") % 70 == 0, 5).otherwise(0)).alias("seq"), F.when(F.col("event_id") % 50 == 0, "edited").otherwise(F.col("before")).alias("prev_hash")))
    mac = F.when(F.col("event_id") % 60 == 7, "forged").otherwise(F.base64(F.unhex(fn.hmac_sha256(KEY, F.col("entry")))))
    lines = e.withColumn("entry", entry).withColumn("mac", mac).withColumn("text", F.when(F.col("parsed"), F.to_json(F.struct("entry", "mac", "entry_hash"))).otherwise("{broken"))
    path = scratch(spark, "audit")
    spark.dataSource.register(RuleFiles)
    # the window has dealt the lines by days, so a day is in one task and is written line by line
    days = lines.sortWithinPartitions("day", "line").select(F.lit("2024").alias("domain"), F.format_string("audit-2024-01-%02d.jsonl", "day").alias("file"), "text")
    days.write.format("rule_files").option("between", "\n\n").mode("overwrite").save(path)
    entries = ingest.read_audit_log(ingest.audit_lines(spark, path))
    return graph.verify_chain(entries.withColumnRenamed("entry_hash", "stored_hash"), KEY, span=100)


@query("""with c as (select event_id as seq, unnest([event_id - 3, event_id - 10, event_id + 1]) as ref from events), l as (select event_id, case event_type when 'error' then 1 when 'signup' then 2 else 4 end as label from events)
 select seq, bit_or(label) as label from c join l on l.event_id = ref where ref < seq group by seq having bit_or(label) & 3 <> 0""")
def taint_check(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    call = lambda shift: F.concat(F.lit("call_"), (F.col("event_id") + shift).cast("string"))
    calls = e.select(F.lit(0).alias("session"), F.col("event_id").alias("seq"), F.concat_ws(" ", call(-3), call(-10), call(1)).alias("args"))
    label = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(4)
    labels = e.select(F.lit(0).alias("session"), call(0).alias("call_id"), F.col("event_id").alias("seq"), label.alias("label"))
    return graph.taint_check(calls, labels, 3).select("seq", "label")


# one pick a round: relevance against the likeness to what has been picked
@query("""with recursive r as (select label as query, vec_id as id, embedding::double[] as e, embedding[1]::double as score, row_number() over (partition by label order by embedding[1]::double desc, vec_id) as rank from embeddings),
 c as (select *, coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 1.0) as rel from r where rank <= 15 window w as (partition by query)),
 s as (select a.query, a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as sim from c a join c b on a.query = b.query),
 g as (select distinct query, 0::bigint as n, []::bigint[] as got from c union all
  select query, n + 1, list_append(got, arg_max(id, score)) from (select g.query, g.n, g.got, c.id, 0.7 * any_value(c.rel) - 0.3 * coalesce(max(s.sim) filter (list_contains(g.got, s.b)), 0.0) as score from g join c on c.query = g.query join s on s.query = g.query and s.a = c.id where not list_contains(g.got, c.id) group by g.query, g.n, g.got, c.id) group by query, n, got)
 select query, n as rank, got[-1] as id from g where n > 0 union all select query, rank, id from r where rank > 15""")
def mmr_rerank(spark, d):
    """Each label's vectors by their first value; the first 15 are reordered, all others keep their places."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("score"), "embedding")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id")))
    return retrieval.mmr_rerank(ranked)


@query(f"select src, min(dst) as first, max(dst) as last, count(*) as n from {G} where valid_until is null group by src")
def open_targets(spark, d):
    return model(spark, d, "edges").where("valid_until is null").groupBy("src").agg(F.min("dst").alias("first"), F.max("dst").alias("last"), F.count("*").alias("n"))
