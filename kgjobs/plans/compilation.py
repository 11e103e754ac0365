"""Context compilation with every table given: heads, scope, toolboxes, domains, expansion, multipliers, vectors, edges, world and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import model
from ..operators import context, feedback, ranking
from ..queries import DECAYED, NOW, STATS, R, query, rounded
from .context import TOOLBOX_NAMES, TOOLBOX_ROWS

NEAR, NEAR_HEAD, NEAREST = 0.2, 0.25, 100

#: Queries, rules and the tables beside them, as Spark's below.
TABLES = f"""with recursive q as (select item_id as query, text || ' src' || (item_id % 20) || case when item_id % 6 = 0 then ' run a script' else '' end as task,
  case item_id % 4 when 0 then ['SRC' || (item_id % 20), 'guideline', 'ring'] when 1 then ['DE', 'widget'] else ['src' || (item_id % 20)] end as concepts, 'user-' || (item_id % 7) as usr,
  case when item_id % 8 <> 7 then e.embedding end as embedding from benchmark left join embeddings e on vec_id = item_id * 2),
 d as (select *, split_part(id, ':', 3)::bigint as n from {R}),
 r as (select d.* replace (case when n % 17 = 0 then 'tools.code' when n % 17 = 1 then 'tools.browser' else domain end as domain), round(m, 6) as mult, lower(type) as trigger from d left join (select rule_id, {DECAYED} as m from {STATS}) f on f.rule_id = d.n),
 link as (select a.id as src, case a.priority when 'High' then 'EXCEPTION_FOR' when 'Critical' then 'SUPERSEDES' else 'CONFLICTS_WITH' end as rel, b.id as dst, case a.n % 6 when 0 then timestamp '2024-01-01' when 1 then timestamp '2024-12-01' end as until from d a join d b on b.n = a.n + 5),
 v as (select d.id as parent, d.owner, 'git:' || split_part(d.id, ':', 2) as head, vec_id, embedding from embeddings join d on vec_id = n)"""

SCORED = f"""{TABLES},
 hv as (select query, head, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as s from q, v where q.embedding is not null),
 hn as (select *, row_number() over (partition by query order by s desc) as k from hv where s > {NEAR_HEAD}),
 hq as (select query, list(head) as heads from (select query, head, row_number() over (partition by query order by max(s) desc, head) as k from hn where k <= 24 group by query, head) where k <= 3 group by query),
 kw(toolbox, word) as (values {TOOLBOX_ROWS}), boxnames(toolbox) as (values {TOOLBOX_NAMES}),
 said as (select query, lower(task || chr(10) || array_to_string(concepts, chr(10))) as t from q),
 bh as (select distinct query, toolbox from said, kw where contains(t, word)),
 boxes as (select query, toolbox from bh union all select query, toolbox from q, boxnames where query not in (select query from bh)),
 dom as (select distinct source as name from documents), below as (select 'src' || k as parent, 'src' || (k + 1) as child from range(0, 20, 4) t(k)),
 hitdom as (select distinct query, name from q, dom where len(list_filter(concepts, lambda c: lower(c) in (lower(name), 'the ' || lower(name)))) > 0) ,
 subdom as (select distinct query, name from said, dom where contains(t, lower(name)) and length(name) >= 4),
 act0 as (select query, name from hitdom union select query, name from subdom), act as (select query, name from act0 union select query, child from act0 join below on parent = name),
 tok as (select query, unnest(list_distinct(regexp_extract_all(lower(task), '[\\p{{L}}\\p{{Nd}}]+'))) as w from q), con as (select distinct query, lower(unnest(concepts)) as w from q),
 vis as (select q.query, r.id, r.priority, r.mult, [lower(tag_lang), lower(tag_source)] as tags, trigger, domain from q, r left join hq on hq.query = q.query
   where (owner is null or owner = usr) and coalesce(tenant, 'default') = 'default' and (valid_until is null or valid_until > timestamp '{NOW}')
   and (not starts_with(domain, 'tools.') or (q.query, domain) in (select (query, toolbox) from boxes)) and (heads is null or list_contains(heads, 'git:' || split_part(r.id, ':', 2)))),
 vt as (select distinct query, id, unnest(list_append(tags, trigger)) as w from vis), both_ as (select * from tok union select * from con),
 grown as (select query, w from (select query, w, row_number() over (partition by query order by count(*) desc, w) as k from vt where (query, id) in (select (query, id) from vt join both_ using (query, w)) and (query, w) not in (select (query, w) from both_) group by query, w) where k <= 2),
 parts as (select query, id, unnest([{{'k': 't', 'w': tags[1]}}, {{'k': 't', 'w': tags[2]}}, {{'k': 'g', 'w': trigger}}], recursive := true) from vis),
 worth as (select p.query, p.id, case when k = 't' then case when tok.w is null and con.w is null then 1.0 * (grown.w is not null)::int else (tok.w is not null)::int + 2 * (con.w is not null)::int end
    else case when con.w is not null then 3 when tok.w is not null then 1 else 1.5 * (grown.w is not null)::int end end as c
   from parts p left join tok on tok.query = p.query and tok.w = p.w left join con on con.query = p.query and con.w = p.w left join grown on grown.query = p.query and grown.w = p.w
   union all select vis.query, id, 2 from vis join act on act.query = vis.query and act.name = vis.domain),
 kwd as (select w.query, w.id, round((case priority when 'Low' then 1 when 'High' then 3 when 'Critical' then 4 else 2 end) * ln(1 + sum(c)) * coalesce(mult, 1.0), 12) as score from worth w join vis using (query, id) group by w.query, w.id, priority, mult having sum(c) > 0)"""

CONTEXT = f"""{SCORED},
 near as (select query, parent as id, max(s) as s from (select query, parent, s, row_number() over (partition by query order by s desc, vec_id) as k from
   (select query, parent, vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as s from q, v where q.embedding is not null and (owner is null or owner = usr)) where s > {NEAR}) where k <= {NEAREST} group by query, parent),
 hits as (select query, id, dense_rank() over (partition by query order by round(s, 12) desc) as rs from near join kwd using (query, id)),
 kr as (select *, dense_rank() over (partition by query order by score desc) as rk from kwd),
 fused as (select kr.query, kr.id, case when kr.query in (select query from hits) then 1.0::double / (60 + rk) + coalesce(1.0::double / (60 + rs), 0) else score end as f, kr.query in (select query from hits) as hit from kr left join hits using (query, id)),
 ft as (select *, row_number() over (partition by query order by f desc, id) as rank from fused qualify rank <= 15),
 fe as (select ft.*, ft.id in (select parent from v) as has, count(*) filter (ft.id in (select parent from v)) over (partition by query) as n_has from ft),
 seeds as (select query, id, row_number() over (partition by query order by case when hit and n_has > 1 and not has then 1 else 0 end, rank) as rank from fe),
 arc as (select distinct a, b from (select src as a, dst as b, until from link union all select dst, src, until from link) where until is null or until > timestamp '{NOW}'),
 seenby as (select q.query, r.id from q, r where (owner is null or owner = usr) and coalesce(tenant, 'default') = 'default'),
 d1 as (select query, id from (select *, row_number() over (partition by query order by id) as k from (select distinct s.query, b as id from seeds s join arc on a = s.id where (s.query, b) in (select (query, id) from seenby) and (s.query, b) not in (select (query, id) from seeds))) where k <= 30),
 d2 as (select query, id from (select *, row_number() over (partition by query order by id) as k from (select distinct s.query, b as id from d1 s join arc on a = s.id where (s.query, b) in (select (query, id) from seenby) and (s.query, b) not in (select (query, id) from seeds union all select (query, id) from d1))) where k <= 30),
 ext as (select query, id, depth, row_number() over (partition by query order by depth, id) as k from (select *, 1 as depth from d1 union all select *, 2 from d2)),
 wor as (select query, id, row_number() over (partition by query order by id) as rank from (select distinct con.query, r.id from con, r where r.type = 'Constraint' and (contains(lower(domain), con.w) or contains(lower(tag_lang), con.w)) and con.w <> '') qualify rank <= 10),
 graphed as (select query, id, row_number() over (partition by query order by depth, id) as rank from (select query, id, 0 as depth from seeds union all select query, id, depth from ext where k <= 30)),
 act_all as (select query, id, min(p) as pos from (select query, id, rank as p from seeds union all select query, id, 1000000 + rank from graphed union all select query, id, 2000000 + rank from wor) group by query, id),
 ranks as (select a.*, case priority when 'Low' then 0 when 'High' then 2 when 'Critical' then 3 else 1 end as pr from act_all a join r using (id)),
 fights as (select x.query, x.id, y.id as other, rel, x.pr as p1, y.pr as p2 from ranks x join link on src = x.id join ranks y on y.query = x.query and y.id = dst),
 gone as (select query, other as id from fights where rel = 'SUPERSEDES' union select query, case when p1 < p2 then id else other end from fights where rel = 'CONFLICTS_WITH' and p1 <> p2),
 rest as (select query, pos, id, type, body, length(coalesce(body, '')) + length(id) + length(type) + 16 as size from ranks join r using (id) where (query, id) not in (select (query, id) from gone)),
 o as (select *, row_number() over (partition by query order by pos) as n from rest),
 b as (select query, 0::bigint as n, 0::bigint as used, false as kept from (select distinct query from o)
  union all select b.query, o.n, b.used + case when b.used + o.size <= 12000 then o.size else 0 end, b.used + o.size <= 12000 from b join o on o.query = b.query and o.n = b.n + 1),
 kept as (select query, pos, id, type, body from o join b using (query, n) where b.kept)"""

TEXT = f"""{CONTEXT},
 lines as (select query, string_agg('### [' || type || '] ' || id || chr(10) || case when trim(body) <> '' then body || chr(10) else '' end || chr(10), '' order by pos) as a from kept group by query),
 cross_ as (select x.query, x.id, y.id as other, rel from kept x join link on src = x.id join kept y on y.query = x.query and y.id = dst),
 bl as (select query, '## Rule Conflicts' || chr(10) || string_agg('- Rule ''' || id || ''' conflicts with ''' || other || '''' || chr(10), '' order by id, other) || chr(10) as b from cross_ where rel = 'CONFLICTS_WITH' group by query),
 cl as (select query, '## Active Exceptions' || chr(10) || string_agg('- Rule ''' || id || ''' is an exception for ''' || other || '''' || chr(10), '' order by id, other) || chr(10) as c from cross_ where rel = 'EXCEPTION_FOR' group by query),
 rt as (select query, regexp_replace('## Active Knowledge Rules' || chr(10) || chr(10) || a || coalesce(b, '') || coalesce(c, ''), '\\s+$', '') as text from lines left join bl using (query) left join cl using (query)),
 ents as (select lower(p_name) as norm, min(p_name) as name, min(p_type) as type from part group by 1),
 rel5 as (select norm, string_agg(other, ', ' order by other) as near from (select norm, other, row_number() over (partition by norm order by other) as k from (select distinct lower(p_name) as norm, lower(p_brand) as other from part)) where k <= 5 group by 1),
 ef as (select query, norm from (select *, row_number() over (partition by query order by norm) as k from (select distinct con.query, norm from con, ents where contains(norm, con.w))) where k <= 5),
 et as (select query, '## Verwandte Entitäten (Wissensgraph)' || chr(10) || string_agg('- **' || name || '** (' || type || ') → ' || near, chr(10) order by norm) as named from ef join ents using (norm) join rel5 using (norm) group by query)
 select query, sha256(concat_ws(chr(10) || chr(10), text, named)) as text_sha256 from rt full join et using (query)"""


def _queries(spark, d):
    b, e = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("benchmark", "embeddings"))
    i, own = F.col("item_id"), F.concat(F.lit("src"), F.col("item_id") % 20)
    task = F.concat("text", F.lit(" "), own, F.when(i % 6 == 0, " run a script").otherwise(""))
    concepts = F.when(i % 4 == 0, F.array(F.upper(own), F.lit("guideline"), F.lit("ring"))).when(i % 4 == 1, F.array(F.lit("DE"), F.lit("widget"))).otherwise(F.array(own))
    b = b.join(e.select((F.col("vec_id") / 2).alias("at"), "embedding"), i == F.col("at"), "left")
    return b.select(i.alias("query"), task.alias("task"), concepts.alias("concepts"), F.concat(F.lit("user-"), i % 7).alias("user"), F.when(i % 8 != 7, F.col("embedding")).alias("embedding"))


def _rules(spark, d):
    r = model(spark, d, "rules").withColumn("n", F.split("id", ":")[2].cast("long"))
    domain = F.when(F.col("n") % 17 == 0, "tools.code").when(F.col("n") % 17 == 1, "tools.browser").otherwise(F.col("domain"))
    return r.withColumns({"domain": domain, "tags": F.array("tag_lang", "tag_source"), "triggers": F.array("type")})


def _given(spark, d):
    """The tables beside queries and rules, by the names of compile_context's arguments."""
    r = _rules(spark, d)
    m = feedback.feedback_stats(model(spark, d, "feedback")).select(F.col("rule_id").alias("n"), feedback.decayed_multiplier(NOW).alias("multiplier"))
    rel = F.when(F.col("priority") == "High", "EXCEPTION_FOR").when(F.col("priority") == "Critical", "SUPERSEDES").otherwise("CONFLICTS_WITH")
    until = F.when(F.col("n") % 6 == 0, "2024-01-01").when(F.col("n") % 6 == 1, "2024-12-01").cast("timestamp")
    links = r.select(F.col("id").alias("src"), rel.alias("rel"), (F.col("n") + 5).alias("n"), until.alias("valid_until")).join(r.select(F.col("id").alias("dst"), "n"), "n").drop("n")
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "n").join(r.select("n", "id", "owner"), "n")
    names = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("name")).distinct()
    k = F.col("id")
    p = spark.read.parquet(f"{d}/part.parquet")
    return dict(
        edges=links, multipliers=rounded(m.join(r.select("n", "id"), "n").select("id", "multiplier"), "multiplier"), world=r.where("type = 'Constraint'").select("id", "domain", F.array("tag_lang").alias("tags")),
        chunks=vectors.select(F.col("id").alias("parent"), F.col("n").alias("chunk"), "embedding", "owner"), heads=vectors.select(F.concat(F.lit("git:"), F.split("id", ":")[1]).alias("head"), F.col("n").alias("ord"), "embedding"),
        domains=names.withColumn("label", F.concat(F.lit("the "), "name")), closure=spark.range(0, 20, 4).select(F.concat(F.lit("src"), k).alias("parent"), F.concat(F.lit("src"), k + 1).alias("child")),
        entities=p.groupBy(F.lower("p_name").alias("norm")).agg(F.min("p_name").alias("name"), F.min("p_type").alias("type")), related=p.select(F.lower("p_name").alias("name"), F.col("p_brand").alias("other")),
    )


def _whole(spark, d):
    given = _given(spark, d)
    relations = given["edges"].select("src", "rel", "dst")
    # by relevance alone, which SQL can say; tests hold the reranker itself against brute force
    return context.compile_context(_queries(spark, d), _rules(spark, d), relations, **given, expansion=2, now=NOW, nearest=NEAREST, above=NEAR, above_head=NEAR_HEAD, diversity=1.0)


@query(CONTEXT + " select query, pos, id from kept")
def compile_context_whole(spark, d):
    return _whole(spark, d)[0]


@query(TEXT)
def format_context_whole(spark, d):
    return _whole(spark, d)[1].select("query", F.sha2("text", 256).alias("text_sha256"))


TOPK = f"""{TABLES},
 tok as (select query, unnest(list_distinct(regexp_extract_all(lower(task), '[\\p{{L}}\\p{{Nd}}]+'))) as w from q), con as (select distinct query, lower(unnest(concepts)) as w from q),
 parts as (select id, unnest([{{'k': 't', 'w': lower(tag_lang)}}, {{'k': 't', 'w': lower(tag_source)}}, {{'k': 'g', 'w': trigger}}], recursive := true) from r),
 met as (select query, id, k, w, 1 as said, 0 as named from parts join tok using (w) union all select query, id, k, w, 0, 1 from parts join con using (w)),
 worth as (select query, id, case when k = 't' then max(said) + 2 * max(named) when max(named) > 0 then 3 else 1 end as c from met group by query, id, k, w),
 s as (select query, id, round((case priority when 'Low' then 1 when 'High' then 3 when 'Critical' then 4 else 2 end) * ln(1 + sum(c)) * coalesce(mult, 1.0), 12) as score from worth join r using (id) group by query, id, priority, mult)
 select query, id, round(score, 6) as score, row_number() over (partition by query order by score desc, id) as rank from s qualify rank <= 10"""


@query(TOPK)
def keyword_topk(spark, d):
    r = _rules(spark, d).drop("owner", "domain")
    m = _given(spark, d)["multipliers"]
    ranked, _ = ranking.keyword_topk(r, _queries(spark, d).drop("user"), 10, multipliers=m)
    return rounded(ranking.top_k(ranked, 10), "score").select("query", "id", "score", "rank")
