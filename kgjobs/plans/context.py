"""Context compilation and its parts over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import model
from ..functions import tokenize
from ..operators import context, graph, retrieval
from ..queries import R, query, rounded

TOOLBOX_ROWS = ", ".join(f"('{box}', '{word}')" for box, words in context.TOOLBOXES.items() for word in words)
TOOLBOX_NAMES = ", ".join(f"('{box}')" for box in context.TOOLBOXES)


@query(f"""with k(toolbox, word) as (values {TOOLBOX_ROWS}), b(toolbox) as (values {TOOLBOX_NAMES}), q as (select event_id as query, event_type as task from events),
 h as (select distinct task, toolbox from (select distinct task from q), k where contains(task, word)),
 a as (select task, toolbox from h union all select task, toolbox from (select distinct task from q where task not in (select task from h)), b union all select distinct task, 'custom-tools' from q)
 select query, toolbox from q join a using (task)""")
def resolve_toolboxes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return context.resolve_toolboxes(e.select(F.col("event_id").alias("query"), F.col("event_type").alias("task")))


def _places(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    tree = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    names = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))).withColumn("label", F.concat(F.lit("the "), "name"))
    return names, tree


CUSTOMER = "(select c_custkey as query, 'trade with ' || lower(n_name) as task, case when c_custkey % 10 = 0 then lower(r_name) else c_mktsegment end as concept from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query(f"""with q as {CUSTOMER}, n as (select n_name as name from nation union select r_name from region),
 h as (select distinct query, name from q, n where concept in (lower(name), 'the ' || lower(name)) or contains(task || chr(10) || lower(concept), lower(name)) and length(name) >= 4)
 select query, name from h union select query, n_name from h join region on r_name = name join nation on n_regionkey = r_regionkey""")
def activate_domains(spark, d):
    names, tree = _places(spark, d)
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    q = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    concept = F.when(F.col("c_custkey") % 10 == 0, F.lower("r_name")).otherwise(F.col("c_mktsegment"))
    q = q.select(F.col("c_custkey").alias("query"), F.concat(F.lit("trade with "), F.lower("n_name")).alias("task"), F.array(concept).alias("concepts"))
    return context.activate_domains(q, names, graph.descendants(tree))


@query("select r_name as parent, list_sort(list(n_name)) as children from region join nation on n_regionkey = r_regionkey group by 1")
def domain_tree(spark, d):
    _, tree = _places(spark, d)
    return graph.domain_tree(tree)


TERMS = f"(select id, unnest(list_distinct([lower(tag_lang), lower(domain), lower(type)])) as term from {R})"
TOKENS = "(select item_id as query, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'))) as term from benchmark)"
EXPANDED = f"""(select query, term, n from (select query, term, count(*) as n, row_number() over (partition by query order by count(*) desc, term) as r from
 (select distinct query, id from {TERMS} join {TOKENS} using (term)) join {TERMS} using (id) where (query, term) not in (select (query, term) from {TOKENS}) group by query, term) where r <= 3)"""


def _asked(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query"), F.col("text").alias("task"))
    return b.withColumns({"concepts": F.array().cast("array<string>"), "terms": tokenize(F.col("task"))})


def _tagged(spark, d):
    return model(spark, d, "rules").withColumns({"tags": F.array("tag_lang", "tag_source"), "terms": F.array("tag_lang", "domain", "type")})


@query(f"select * from {EXPANDED}")
def expand_query(spark, d):
    return context.expand_query(_asked(spark, d), _tagged(spark, d).select("id", "terms"), 3)


@query(f"""with x as {EXPANDED}, k as {TOKENS}, t as (select id, priority, unnest([{{'n': 1, 'tag': tag_lang}}, {{'n': 2, 'tag': domain}}], recursive := true) from {R}),
 w as (select query, id, n, 1.0 as m from t join k on k.term = lower(tag)),
 e as (select x.query, t.id, t.n, 1.0 as m from t join x on x.term = lower(tag) where (x.query, t.id, t.n) not in (select (query, id, n) from w)),
 a as (select query, id, 0 as n, 2.0 as m from {R} join (select item_id as query, 'src' || (item_id % 20) as domain from benchmark) using (domain)),
 s as (select query, id, sum(m) as m from (from w union all from e union all from a) group by all)
 select query, id, round((case priority when 'Low' then 1 when 'High' then 3 when 'Critical' then 4 else 2 end) * ln(1 + m), 6) as score from s join {R} using (id)""")
def keyword_score_expanded(spark, d):
    q, r = _asked(spark, d), _tagged(spark, d)
    expanded = context.expand_query(q, r.select("id", "terms"), 3)
    active = q.select("query", F.concat(F.lit("src"), F.col("query") % 20).alias("name"))
    return rounded(retrieval.keyword_score(r, q, active, expanded), "score")


@query(f"""with h as (select distinct p_partkey as query, id from part join {R} on contains(lower(domain), 'src' || (p_partkey % 25)) or contains(lower(tag_lang), 'src' || (p_partkey % 25)))
 select query, id from (select *, row_number() over (partition by query order by id) as r from h) where r <= 10""")
def fetch_world_knowledge(spark, d):
    q = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("query"), F.array(F.concat(F.lit("SRC"), F.col("p_partkey") % 25)).alias("concepts"))
    return context.fetch_world_knowledge(q, _tagged(spark, d).select("id", "domain", F.array("tag_lang").alias("tags")))


def _relations(r):
    rel = F.when(F.col("priority") == "High", "EXCEPTION_FOR").otherwise("CONFLICTS_WITH")
    return r.select(F.col("id").alias("src"), rel.alias("rel"), F.col("prior_id").alias("dst"))


PAIRS = "with r as (select *, case when priority = 'High' then 'EXCEPTION_FOR' else 'CONFLICTS_WITH' end as rel from {r}) select a.tag_lang as query, a.id, b.id as other from r a join r b on b.id = a.prior_id and b.tag_lang = a.tag_lang where a.rel = '{rel}'"


@query(PAIRS.format(r=R, rel="CONFLICTS_WITH"))
def detect_conflicts(spark, d):
    r = model(spark, d, "rules")
    return context.active_pairs(r.select(F.col("tag_lang").alias("query"), "id"), _relations(r), "CONFLICTS_WITH")


@query(PAIRS.format(r=R, rel="EXCEPTION_FOR"))
def detect_exceptions(spark, d):
    r = model(spark, d, "rules")
    return context.active_pairs(r.select(F.col("tag_lang").alias("query"), "id"), _relations(r), "EXCEPTION_FOR")


FOUND = "(select query, norm from (select query, norm, row_number() over (partition by query order by norm) as r from (select distinct p_partkey as query, string_split(p_name, ' ')[2] as term from part), (select distinct lower(p_name) as norm from part) where contains(norm, term)) where r <= {n})"


def _entities(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    q = p.select(F.col("p_partkey").alias("query"), F.array(F.upper(F.split("p_name", " ")[1])).alias("terms"))
    return q, p.groupBy(F.lower("p_name").alias("norm")).agg(F.min("p_name").alias("name"), F.min("p_type").alias("type")), p.select(F.lower("p_name").alias("name"), F.col("p_brand").alias("other"))


@query(f"select * from {FOUND.format(n=20)}")
def find_entities(spark, d):
    q, e, _ = _entities(spark, d)
    return context.find_entities(q, e)


@query(f"""with e as (select lower(p_name) as norm, min(p_name) as name, min(p_type) as type from part group by 1),
 n as (select norm, string_agg(other, ', ' order by other) as near from (select norm, other, row_number() over (partition by norm order by other) as r from (select distinct lower(p_name) as norm, lower(p_brand) as other from part)) where r <= 5 group by 1)
 select query, '## Verwandte Entitäten (Wissensgraph)' || chr(10) || string_agg('- **' || name || '** (' || type || ') → ' || near, chr(10) order by norm) as text from {FOUND.format(n=5)} join e using (norm) join n using (norm) group by query""")
def entity_context(spark, d):
    return context.entity_context(*_entities(spark, d))


COMPILED = f"""with recursive r as (select *, [tag_lang, tag_source] as tags from {R}), k as {TOKENS},
 t as (select id, unnest(tags) as tag from r), m as (select query, id, count(*) as m from t join k on k.term = lower(tag) group by all),
 s as (select query, id, round((case priority when 'Low' then 1 when 'High' then 3 when 'Critical' then 4 else 2 end) * ln(1 + m), 9) as score from m join r using (id)),
 top as (select * from (select *, row_number() over (partition by query order by score desc, id) as pos from s) where pos <= 15),
 a as (select query, pos, id, length(body) + length(id) + length(type) + 16 as size, type, body from top join r using (id)
  where (query, id) not in (select (query, prior_id) from top join r using (id) where priority <> 'Low')),
 o as (select *, row_number() over (partition by query order by pos) as n from a),
 b as (select query, 0::bigint as n, 0::bigint as used, false as kept from (select distinct query from o)
  union all select b.query, o.n, b.used + case when b.used + o.size <= 12000 then o.size else 0 end, b.used + o.size <= 12000 from b join o on o.query = b.query and o.n = b.n + 1)"""


def _compiled(spark, d):
    r = _tagged(spark, d).drop("owner", "tenant", "valid_until")
    supersedes = r.where("priority <> 'Low'").select(F.col("id").alias("src"), F.lit("SUPERSEDES").alias("rel"), F.col("prior_id").alias("dst"))
    return context.compile_context(_asked(spark, d), r, supersedes)


@query(COMPILED + " select query, pos, id from o join b using (query, n) where kept")
def compile_context(spark, d):
    return _compiled(spark, d)[0]


@query(COMPILED + """ select query, sha256(regexp_replace('## Active Knowledge Rules' || chr(10) || chr(10) || string_agg('### [' || type || '] ' || id || chr(10) || case when trim(body) <> '' then body || chr(10) else '' end || chr(10), '' order by pos), '\\s+$', '')) as text_sha256
 from o join b using (query, n) where kept group by query""")
def format_context(spark, d):
    return _compiled(spark, d)[1].select("query", F.sha2("text", 256).alias("text_sha256"))
