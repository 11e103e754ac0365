"""The operators' registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, counts, fingerprints, leaks, lm, neardup, pieces, quality, suffixes, thresholds, variants, warc
from .common import table

LF = "chr(10)"
PROBE = "</s>[INST] ok [/INST]"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_and_read(spark, table(spark, sf_dir, "pages"))
    return back.selectExpr("page_id", "n_bytes as payload_bytes", "digest as payload_digest", "type as record_type", "refers_to")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # n_repeated: bytes in repeated strings of at least 200 bytes; passages of little over 50 words may stay below 400
    return suffixes.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report=200).drop("kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{PROBE}' as text")
    return chat.chat_digest(chat.format_chats(rows.unionByName(probe)))


ORACLES = {
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)""",
    "op9_chat_format": """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(role, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|AND\\])', '\\1\\\\\\2\\3', 'g') as er,
             regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|AND\\])', '\\1\\\\\\2\\3', 'g') as et,
             role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as fresh from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(et) + case when fresh then 9 + length(er) + 11 else 5 end)::bigint as formatted_chars
from e group by conv_id""",
    "op12_quality_rules": """
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
pos as (select r, ws, unnest(range(1, len(ws) - 1)) as p from w where len(ws) > 2),
win as (select r, p, count(*) over (partition by r, ws[p], ws[p + 1], ws[p + 2]) as k from pos),
rep as (select r, count(distinct p + o)::bigint as n from win, (values (0), (1), (2)) as s(o) where k > 1 group by r),
lines as (select r, line, row_number() over (partition by r, line) as k from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ln as (select r, count(*) as n_lines, count(*) filter (where k > 1) as n_dup_lines from lines group by r),
m as (select d.r, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0)::bigint as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from d join w using (r) left join ln using (r) left join rep using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
v as (select r, lang, source, base_failed, rule, case rule when 'word_length' then 100 * word_chars // greatest(n_words, 1) when 'symbols' then 1000 * n_symbols // greatest(word_chars, 1)
             when 'repeated_lines' then 1000 * n_dup_lines // greatest(n_lines, 1) else 1000 * n_repeat_words // greatest(n_words, 1) end as x
      from f, (values ('word_length'), ('symbols'), ('repeated_lines'), ('repeated_words')) as rules(rule)),
b as (select *, x - x % (1::bigint << greatest(length(bin(x)) - 7, 0)) as bucket from v where not base_failed),
l as (select lang, source, 0 as level, rule, bucket from b union all select lang, null, 1, rule, bucket from b union all select null, null, 2, rule, bucket from b),
c as (select *, count(*) over (partition by lang, source, level, rule) as docs, count(*) over (partition by lang, source, level, rule order by bucket) as seen from l),
q as (select lang, source, level, rule, max(docs) as docs, min(bucket) filter (where 4 * seen >= docs) as q1, min(bucket) filter (where 4 * seen >= 3 * docs) as q3 from c group by 1, 2, 3, 4),
cut as (select lang, source, level, rule, docs, q1 - 3 * greatest(q3 - q1, s) as low, q3 + 3 * greatest(q3 - q1, s) as high
        from q join (values ('word_length', 50), ('symbols', 10), ('repeated_lines', 150), ('repeated_words', 150)) as spreads(rule, s) using (rule)),
own as (select v.r, v.rule, v.x, coalesce(a.low, g.low, e.low) as low, coalesce(a.high, g.high, e.high) as high
        from v left join cut a on a.level = 0 and a.docs >= 100 and a.rule = v.rule and a.lang is not distinct from v.lang and a.source is not distinct from v.source
               left join cut g on g.level = 1 and g.docs >= 100 and g.rule = v.rule and g.lang is not distinct from v.lang
               left join cut e on e.level = 2 and e.rule = v.rule),
bad as (select r, bool_or(x > high or (rule = 'word_length' and x < low)) as beyond from own group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(beyond, false) as kept from f join bad using (r)""",
}


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), link="end")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = thresholds.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.vocabulary(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_near_dedup": op1_near_dedup, "op2_decontaminate": op2_decontaminate, "op3_warc": op3_warc, "op4_suffix_dedup": op4_suffix_dedup, "op5_token_counts": op5_token_counts, "op6_lm_score": op6_lm_score, "op7_fingerprints": op7_fingerprints, "op8_quality": op8_quality, "op9_chat_format": op9_chat_format, "op10_pieces": op10_pieces, "op11_alignment": op11_alignment, "op12_quality_rules": op12_quality_rules, "op13_variants": op13_variants}


def oracle_sql() -> dict[str, str]:
    return ORACLES
