"""Memories, recycle bin, graph checks, head vectors and code checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import model
from ..functions import memory_id
from ..operators import checks, graph, retrieval
from ..queries import C, M, R, query, rounded
from .maintenance import AT, _deleted


@query(f"select id from {R} where not (type = 'Rule' and priority = 'Low')")
def purge(spark, d):
    r, gone = _deleted(spark, d)
    chunks = r.select(F.col("id").alias("parent"))
    left, _ = graph.purge(gone, chunks, r.where("priority = 'Low'").select("id"))
    return left.select("id")


@query(f"select id, epoch_us({AT}) as deleted_us, left(trim(regexp_extract(body, '^\\s*([^\\n]*)', 1)), 120) as preview from {R} where type = 'Rule'")
def list_deleted(spark, d):
    return graph.list_deleted(_deleted(spark, d)[1]).select("id", F.unix_micros("deleted_at").alias("deleted_us"), "preview")


@query("""with e as (select o_orderkey as src, o_orderkey + case when o_orderkey % 97 = 2 then -2 else 1 end as dst from orders where o_orderkey % 4 <> 3 union select o_orderkey, -o_custkey from orders),
 n as (select src, dst from e where src <> dst)
 select exists (select 1 from n a join n b on b.src = a.dst join n c on c.src = b.dst join n f on f.src = c.dst where f.dst = a.src or c.dst = a.src) as cyclic, (select count(distinct dst) from e where dst not in (select o_orderkey from orders)) as missing""")
def validate_graph(spark, d):
    """Orders imply the next one, in chains of four, and now and then the one two before, which closes a chain to a ring; all imply ids that are no order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    chain = o.where(k % 4 != 3).select(k.alias("src"), (k + F.when((k % 97 == 2), -2).otherwise(1)).alias("dst"))
    return graph.validate_graph(o.select(k.alias("id")), chain.unionByName(o.select(k.alias("src"), (-F.col("o_custkey")).alias("dst"))))


#: Whole documents as memories; near copies among them are alike.
NOTES = "(select lang as owner, doc_id as id, date '2024-01-01' + (doc_id % 9)::int * 20 as created, text as body from documents)"
SETS = f"t as (select owner, id, created, list_distinct(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{Nd}}]+')) as t from {NOTES})"
ALIKE = "len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) > 0.8"
PAIRS = f"p as (select a.id as a, b.id as b from t a join t b on a.owner = b.owner and (a.created > b.created or (a.created = b.created and a.id < b.id)) and len(a.t) >= 0.8 * len(b.t) and len(b.t) >= 0.8 * len(a.t) and {ALIKE})"
# one after the other, newest first: what is like one kept so far goes
GREEDY = f"""with recursive {SETS}, {PAIRS}, o as (select id, row_number() over (order by created desc, id) as n from t where id in (select b from p)),
 g as (select 0::bigint as n, []::bigint[] as gone union all select o.n, case when exists (select 1 from p where p.b = o.id and not list_contains(g.gone, p.a)) then list_append(g.gone, o.id) else g.gone end from g join o on o.n = g.n + 1),
 lost as (select unnest(gone) as id from (select gone from g order by n desc limit 1))"""


def _notes(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    return x.select(F.col("lang").alias("owner"), F.col("doc_id").alias("id"), F.expr("date_add(date '2024-01-01', cast(doc_id % 9 * 20 as int))").alias("created"), F.col("text").alias("body"))


@query(f"with {SETS}, {PAIRS} select a, b from p")
def similar_memories(spark, d):
    return graph.similar_pairs(_notes(spark, d), 0.8).select("a", "b")


@query(f"{GREEDY} select id from {NOTES} where id not in (select id from lost)")
def dedupe_near(spark, d):
    return graph.dedupe_near(_notes(spark, d), 0.8).select("id")


UNIQUE = f"(select * from (select *, row_number() over (partition by owner, trim(regexp_replace(lower(body), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) order by created desc, id) as n from {NOTES}) where n = 1)"


@query(f"""{GREEDY.replace(NOTES, UNIQUE)}, k as (select * from {UNIQUE} where id not in (select id from lost))
 select (select count(distinct owner) from {NOTES}) as users, (select count(*) from {NOTES}) - (select count(*) from {UNIQUE}) as exact, (select count(*) from {UNIQUE}) - (select count(*) from k) as near,
 (select count(*) from k where pow(2.0, -greatest(date_diff('day', created, date '2024-06-01'), 0) / 30.0) <= 0.05) as faded""")
def consolidate_all(spark, d):
    return graph.consolidate_all(_notes(spark, d), F.lit("2024-06-01").cast("date"), 30, 0.8)


@query(f"with {SETS} select a.id as id, b.id as old from t a join t b on a.owner = b.owner and a.id % 2 = 1 and b.id % 2 = 0 and len(a.t) >= 0.8 * len(b.t) and len(b.t) >= 0.8 * len(a.t) and {ALIKE}")
def remember(spark, d):
    """Documents of odd ids are new facts to those of even ones."""
    m = _notes(spark, d)
    return graph.remember(m.where("id % 2 = 0"), m.where("id % 2 = 1"), 0.8)[1]


@query(f"select id from {M} where owner || chr(0) || trim(body) not in (select owner || chr(0) || trim(body) from {M} where id % 3 = 0)")
def forget(spark, d):
    m = model(spark, d, "memories")
    named = m.withColumn("memory_id", memory_id(F.col("owner"), F.col("body")))
    return graph.forget(named, m.where("id % 3 = 0").select("owner", F.concat(F.lit(" "), "body", F.lit(" ")).alias("content"))).select("id")


@query(f"""with f as (select 'dangling' as category, id as item from {R} where prior_id not in (select id from {R}) union all select 'global', id from {R} where owner is null union all select 'thin', domain from {R} group by domain having count(*) <= 60),
 n as (select *, count(*) over (partition by category) as n, row_number() over (partition by category order by item) as rank from f) select category, n, n > 50 as truncated, rank, item from n where rank <= 50""")
def coverage_report(spark, d):
    r = model(spark, d, "rules")
    lost = r.join(r.select(F.col("id").alias("prior_id")), "prior_id", "left_anti").select(F.lit("dangling").alias("category"), F.col("id").alias("item"))
    thin = r.groupBy("domain").agg(F.count("*").alias("n")).where("n <= 60").select(F.lit("thin").alias("category"), F.col("domain").alias("item"))
    return graph.coverage_report(lost.unionByName(r.where("owner is null").select(F.lit("global").alias("category"), F.col("id").alias("item"))).unionByName(thin))


@query(f"select distinct array_to_string(string_split(id, ':')[1:2], ':') as head from {R} where priority = 'High'")
def mark_dirty_heads(spark, d):
    return retrieval.mark_dirty_heads(model(spark, d, "rules").where("priority = 'High'").select("id"))


@query(f"select (select count(distinct array_to_string(string_split(id, ':')[1:2], ':')) from {R} where priority = 'High') as with_vectors, (select count(distinct domain) from {R}) as total")
def head_coverage(spark, d):
    r = model(spark, d, "rules")
    return retrieval.head_coverage(retrieval.mark_dirty_heads(r), retrieval.mark_dirty_heads(r.where("priority = 'High'")))


def _leaves(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("git:h"), "label").alias("head"), F.col("vec_id").alias("id"), "embedding")


@query()
def build_head_vectors(spark, d):
    v = retrieval.build_head_vectors(_leaves(spark, d), per=10)
    return v.select("head", "ord", F.round(F.col("embedding")[0], 4).alias("x"))


@query("""with v as (select 'git:h' || label as head, vec_id as ord, embedding::double[] as e from embeddings), q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 20 = 0),
 s as (select query, head, ord, list_cosine_similarity(v.e, q.e) as score from v, q), n as (select *, row_number() over (partition by query order by score desc, ord) as n from s where score > 0.4),
 h as (select query, head, max(score) as score from n where n <= 24 group by all) select query, head, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, head) as r from h) where r <= 3""")
def top_heads(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = _leaves(spark, d).withColumnRenamed("id", "ord")
    return rounded(retrieval.top_heads(v, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")), "score")


@query(f"""with q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 20 = 0),
 s as (select query, c.parent as id, max(list_cosine_similarity(c.embedding::double[], q.e)) as score from {C} c, q group by all) select query, id, round(score, 6) as score from s where score > 0.3""")
def vector_fallback(spark, d):
    """Every parent is a candidate of every query."""
    c, e = model(spark, d, "chunks"), spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return rounded(retrieval.vector_fallback(None, c, q, above=0.3), "score")


CODE = """concat('text', chr(10), '```', case doc_id % 5 when 0 then 'py' when 1 then 'C#' when 2 then 'ts' when 3 then '' else 'rust' end, chr(10), 'x = eval(', lang, '); debugger', chr(10), 'except:', chr(10), '  y.Result', chr(10), '```', chr(10), 'more ```JS', chr(10), 'console.log("SELECT " + ', source, ')', chr(10), '```')"""


def _blocks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id as id", f"{CODE} as text")
    return checks.extract_code_blocks(docs)


@query("""select doc_id as id, 0 as n, case doc_id % 5 when 0 then 'py' when 2 then 'ts' when 3 then '' else 'rust' end as lang, 'x = eval(' || lang || '); debugger' || chr(10) || 'except:' || chr(10) || '  y.Result' || chr(10) as code from documents where doc_id % 5 <> 1
 union all select doc_id, 1, 'js', 'console.log("SELECT " + ' || source || ')' || chr(10) from documents where doc_id % 5 <> 1 union all select doc_id, 0, '', 'more ' from documents where doc_id % 5 = 1""")
def extract_code_blocks(spark, d):
    return _blocks(spark, d)


def _rules(spark):
    rows = [(rule, langs, True) for rule, langs in checks.APPLIES.items()] + [("any", [], True), ("off", [], False)]
    return spark.createDataFrame(rows, "rule string, applies_to array<string>, enabled boolean")


PAIRED = f"""with b as (select doc_id as id, 0 as n, case doc_id % 5 when 0 then 'python' when 2 then 'typescript' when 3 then '' else 'rust' end as lang from documents where doc_id % 5 <> 1
 union all select doc_id, 1, 'javascript' from documents where doc_id % 5 <> 1 union all select doc_id, 0, '' from documents where doc_id % 5 = 1), r(rule, lang) as (values {", ".join(f"('{r}', '{x}')" for r, langs in checks.APPLIES.items() for x in langs)}, ('any', null)),
 p as (select distinct rule, id, n, b.lang from b join r on r.lang is null or b.lang = '' or r.lang = b.lang)"""


@query(PAIRED + " select rule, id, n from p")
def rule_block_pairs(spark, d):
    return checks.rule_block_pairs(_rules(spark), _blocks(spark, d))


def _found(spark, d):
    blocks = _blocks(spark, d)
    return checks.check_code_blocks(checks.rule_block_pairs(_rules(spark), blocks).join(blocks, ["id", "n"]))


# each rule has findings: where, how bad and what is said of them
FOUND_SQL = PAIRED + """, s(rule, line, severity, message) as (values
 ('coding-no-bare-except', 2, 'warning', 'Bare except catches everything, incl. SystemExit/KeyboardInterrupt'), ('coding-no-blocking-async', 3, 'warning', 'Blocking .Result on a Task'),
 ('coding-no-leftover-debug', 1, 'warning', ''), ('security-no-eval-exec', 1, 'error', 'eval() executes arbitrary code — a code-injection / RCE risk'),
 ('security-no-sql-string-concat', 1, 'warning', 'SQL query built by string concatenation — a SQL-injection risk')),
 f as (select rule, id::varchar as id, n, line, severity, case when message <> '' then message when n = 1 then 'Leftover console.log/debug/info — use a real logger or remove it' else 'Leftover debugger statement — remove before committing' end as message
  from p join s using (rule) where id % 5 <> 1 and case when rule = 'security-no-sql-string-concat' then n = 1 when rule = 'coding-no-leftover-debug' then true else n = 0 end)"""
ADVICE = ", a(rule, suggestion) as (values " + ", ".join("('{}', '{}')".format(r, x.replace("'", "''")) for r, x in checks.SUGGESTIONS.items()) + ")"


@query(FOUND_SQL + ADVICE + " select rule, id, n, line, severity, message, suggestion from f join a using (rule)")
def check_code_blocks(spark, d):
    return _found(spark, d)


@query(FOUND_SQL + ADVICE + """, e as (select id, severity, case severity when 'error' then 0 else 1 end as rank, rule, n, line, message, '**Rule: ' || rule || '** [' || upper(severity) || '] (line ' || line || ')' || chr(10) || '- ' || message || chr(10) || '- 💡 Suggestion: ' || suggestion || chr(10) || chr(10) as entry from f join a using (rule)),
 z as (select id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, 0::bigint as infos, 0::bigint as others, string_agg(entry, '' order by rank, rule, n, line, message) as entries from e group by id)
 select id, errors, warnings, infos, others, '⚠️ **Code Review Required — Knowledge Base Violations**' || chr(10) || chr(10) || '**' || (errors + warnings) || ' violation(s)** — ' || errors || ' error, ' || warnings || ' warning, 0 info.' || chr(10) || chr(10)
  || 'The following issues were detected in your last response:' || chr(10) || chr(10) || entries || 'Please revise your response to address these violations — fix errors first.' || chr(10) as text from z""")
def violation_report(spark, d):
    return checks.violation_text(checks.violation_report(_found(spark, d)))


@query(PAIRED + " select rule, id, n, upper(sha256(rule || chr(0) || id || chr(0) || n || chr(0) || 'v1')) as key, case when id % 2 = 0 then id % 4 = 0 end as passed from p")
def reuse_results(spark, d):
    """Texts of even ids have a verdict, by rule, block and version; the others are left to check."""
    blocks = _blocks(spark, d)
    work = checks.rule_block_pairs(_rules(spark), blocks).withColumn("key", checks.result_key(F.col("rule"), F.col("id").cast("string"), F.col("n").cast("string"), F.lit("v1")))
    reused, todo = checks.reuse_results(work, work.where("id % 2 = 0").select("key", (F.col("id") % 4 == 0).alias("passed")))
    return reused.unionByName(todo.withColumn("passed", F.lit(None).cast("boolean"))).select("rule", "id", "n", "key", "passed")
