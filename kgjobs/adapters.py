"""Driver tables in the shape of the knowledge model. Each adapter is a list of SQL expressions that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULES = [
    "concat('git:', source, ':', cast(doc_id as string)) as id",
    "case doc_id % 3 when 0 then 'Rule' when 1 then 'Guideline' else 'Constraint' end as type",
    "source as domain",
    "case doc_id % 4 when 0 then 'Low' when 1 then 'Medium' when 2 then 'High' else 'Critical' end as priority",
    "lang as tag_lang",
    "source as tag_source",
    "case when doc_id % 5 <> 0 then concat('user-', cast(doc_id % 7 as string)) end as owner",
    "case when doc_id % 13 = 0 then cast(null as string) else 'default' end as tenant",
    "case when doc_id % 11 = 0 then cast('2024-01-15 00:00:00' as timestamp) end as valid_until",
    "concat('git:', source, ':', cast(doc_id - 20 as string)) as prior_id",
    "text as body",
]
FEEDBACK = [
    "event_id",
    "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as rule_id",
    "user_id",
    "ts",
    "case event_type when 'click' then 'tdk' when 'error' then 'tdk' when 'view' then 'compliance' else 'user' end as kind",
    "case event_type when 'click' then true when 'purchase' then true when 'view' then value >= 100 else false end as positive",
]
CHUNKS = ["concat('git:src', cast(label as string), ':', cast(vec_id % 50 as string)) as parent", "vec_id", "embedding", "case when vec_id % 13 = 0 then cast(null as string) when vec_id % 7 = 0 then 'old' else 'now' end as fingerprint"]
MEMORIES = ["concat('u', cast(conv_id % 10 as string)) as owner", "conv_id * 1000 + turn as id", "text as body", "date_add(date '2024-01-01', cast(turn * 20 as int)) as created"]
EDGES = [
    "l_partkey as src",
    "case l_partkey % 3 when 0 then 'REQUIRES' when 1 then 'CONFLICTS_WITH' else 'SUPERSEDES' end as rel",
    "l_suppkey as dst",
    "min(l_shipdate) as valid_from",
    "case when max(l_returnflag) = 'R' then max(l_shipdate) end as valid_until",
]
SOURCES = {"rules": ("documents", RULES, ""), "feedback": ("events", FEEDBACK, ""), "chunks": ("embeddings", CHUNKS, ""), "memories": ("conversations", MEMORIES, ""), "edges": ("lineitem", EDGES, "group by l_partkey, l_suppkey")}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One model table over the driver tables of sf_dir."""
    table, columns, tail = SOURCES[name]
    sql = f"select {', '.join(columns)} from {{t}} {tail}"
    return spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def oracle(name: str, **names: str) -> str:
    """The same table as a DuckDB sub-query."""
    table, columns, tail = SOURCES[name]
    text = f"(select {', '.join(columns)} from {table} {tail})"
    return text.replace("date_add(date '2024-01-01', cast(turn * 20 as int))", "cast(date '2024-01-01' + cast(turn * 20 as int) as date)")
