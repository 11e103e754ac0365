"""Scopes, searches, health and statistics of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dataset_of, priority_rank


def in_scope(user: str | None, tenant: str = "default") -> Column:
    return (F.col("owner").isNull() | (F.col("owner") == F.lit(user))) & (F.coalesce("tenant", F.lit("default")) == tenant)


def not_deleted(rules: DataFrame) -> DataFrame:
    """Rules but for soft-deleted ones, where rules have deleted_at."""
    return rules.where("deleted_at is null") if "deleted_at" in rules.columns else rules


def scope_rules(rules: DataFrame, user: str | None, domain: str | None = None, kind: str | None = None, tenant: str = "default") -> DataFrame:
    out = not_deleted(rules).where(in_scope(user, tenant))
    out = out.where(F.col("domain") == domain) if domain else out
    return out.where(F.col("type") == kind) if kind else out


def compilation_scope(rules: DataFrame, user: str | None, now: str, prefixes: DataFrame | None = None, toolboxes: list[str] | None = None) -> DataFrame:
    """Candidates for retrieval: in scope, not expired, of no toolbox but those named, and below one of the prefixes if there are any.

    An id is cut to all it lies below, so prefixes of any number meet it in an equi-join.
    """
    out = not_deleted(rules).where(in_scope(user)).where(F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(now).cast("timestamp")))
    if toolboxes is not None:
        out = out.where(~F.col("domain").startswith("tools.") | F.col("domain").isin(toolboxes))
    if prefixes is None:
        return out
    bound = F.col("id").rlike("^(git|upload):")
    parts = F.split("id", ":")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    below = out.where(bound).select("id", F.explode(above).alias("prefix")).join(prefixes.select("prefix"), "prefix", "left_semi").select("id").distinct()
    return out.where(~bound).unionByName(out.where(bound).join(below, "id", "left_semi"))


def rule_heads(rules: DataFrame) -> DataFrame:
    return rules.where(~(F.col("id").rlike("^(git|upload):") & (F.size(F.split("id", ":")) >= 3)))


def search_rules(rules: DataFrame, query: str | None = None, domain: str | None = None, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """By a substring of id, body or domain in any case, by domain, by type and by a tag in any case (tags(array))."""
    out = rules.where(F.col("type") == kind) if kind else rules
    out = out.where(F.exists("tags", lambda x: F.lower(x) == tag.lower())) if tag else out
    if query:
        q = query.lower()
        out = out.where(F.lower("id").contains(q) | F.lower("body").contains(q) | F.lower("domain").contains(q))
    return out.where(F.col("domain") == domain) if domain else out


def page_rules(rules: DataFrame, skip: int | None = None, take: int | None = None) -> DataFrame:
    """A page of rules by id, each row with the total of all."""
    take = take if take is not None else 200 if skip is not None else 1000
    skip = skip or 0
    if not 1 <= take <= 1000 or skip < 0:
        raise ValueError("take is 1 to 1000, skip at least 0")
    page = rules.orderBy("id").offset(skip).limit(take)
    return page.join(F.broadcast(rules.agg(F.count("*").alias("total"))))  # one row


def dataset_visibility(rules: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    """Rules outside any dataset and those of datasets granted to the user."""
    mine = grants.where(F.col("user") == user).select("dataset").distinct()
    keyed = rules.withColumn("dataset", dataset_of(F.col("id")))
    return keyed.where("dataset is null").unionByName(keyed.join(mine, "dataset", "left_semi").select(keyed.columns))


def rule_statistics(rules: DataFrame) -> DataFrame:
    """Counts by domain, by type and in all, in one pass."""
    t = rules.where(F.coalesce("tenant", F.lit("default")) == "default")
    aggs = [F.count("*").alias("total"), F.count_if(F.col("owner").isNull()).alias("global_rules"), F.count_if(F.col("owner").isNotNull()).alias("owned_rules")]
    return t.groupingSets([["domain"], ["type"], []], "domain", "type").agg(*aggs).select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("type", F.lit("*")).alias("type"), "total", "global_rules", "owned_rules")


def graph_totals(rules: DataFrame, edges: DataFrame, chunks: DataFrame, tenant: str = "default") -> DataFrame:
    """One row (total, global_rules, owned_rules, with_validator, with_chunks, edges) of rules(id, owner, tenant, script), edges(src, rel, dst) but for HAS_CHUNK, and chunks(parent)."""
    t = rules.where(F.coalesce("tenant", F.lit("default")) == tenant)
    have = chunks.select(F.col("parent").alias("id"), F.lit(True).alias("chunked")).distinct()
    own = t.select("id", "owner", "script").join(have, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("owner").isNull()).alias("global_rules"), F.count("owner").alias("owned_rules"), F.count_if(F.trim(F.coalesce("script", F.lit(""))) != "").alias("with_validator"), F.count("chunked").alias("with_chunks"))
    inside = edges.where("rel <> 'HAS_CHUNK'").join(t.select(F.col("id").alias("src")), "src", "left_semi")
    return own.join(F.broadcast(inside.agg(F.count("*").alias("edges"))))  # a row each


def thin_domains(rules: DataFrame, most: int = 2) -> DataFrame:
    return rules.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") <= most)


def dangling_refs(rules: DataFrame, relations: DataFrame) -> DataFrame:
    """relations(src, rel, dst) whose target is no rule."""
    return relations.join(rules.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "rel", "dst")


def batch_rule_update(rules: DataFrame, ids: DataFrame, op: str, value: str, allowed: DataFrame | None = None) -> DataFrame:
    """(id, tags, priority, status) of the rules(id, tags, priority) that ids(id) name: updated, or skipped where nothing changes or allowed(id, allowed) says no.

    op is AddTag, RemoveTag (tags in any case) or SetPriority.
    """
    has = F.exists("tags", lambda t: F.lower(t) == value.lower())
    if op == "SetPriority":
        tags, priority, same = F.col("tags"), F.lit(value), F.col("priority") == value
    elif op == "AddTag":
        tags, priority, same = F.array_append("tags", F.lit(value)), F.col("priority"), has
    elif op == "RemoveTag":
        tags, priority, same = F.filter("tags", lambda t: F.lower(t) != value.lower()), F.col("priority"), ~has
    else:
        raise ValueError(f"unknown operation {op!r}")
    asked = rules.join(ids.select("id").distinct(), "id", "left_semi")
    if allowed is not None:
        asked = asked.join(allowed.select("id", "allowed"), "id", "left")
        same = same | ~F.coalesce("allowed", F.lit(False))
    keep = lambda new, old: F.when(same, F.col(old)).otherwise(new).alias(old)
    return asked.select("id", keep(tags, "tags"), keep(priority, "priority"), F.when(same, "skipped").otherwise("updated").alias("status"))


def suppress_contradictions(active: DataFrame, relations: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """active(query, id, priority) less superseded rules and the lower side of conflicts, judged on the original set; protected(query, id) stay."""
    a = active.select("query", "id", priority_rank(F.col("priority")).alias("rank"))
    b = a.select("query", F.col("id").alias("other"), F.col("rank").alias("other_rank"))
    pairs = a.join(relations.withColumnsRenamed({"src": "id", "dst": "other"}), "id").join(b, ["query", "other"])
    gone = pairs.where("rel = 'SUPERSEDES'").select("query", F.col("other").alias("id"))
    fights = pairs.where("rel = 'CONFLICTS_WITH' and rank <> other_rank").select("query", F.when(F.col("rank") < F.col("other_rank"), F.col("id")).otherwise(F.col("other")).alias("id"))
    gone = gone.unionByName(fights)
    gone = gone if protected is None else gone.join(protected.select("query", "id"), ["query", "id"], "left_anti")
    return active.join(gone, ["query", "id"], "left_anti")


def apply_budget(ranked: DataFrame, most: int = 12_000, protected: DataFrame | None = None) -> DataFrame:
    """ranked(query, pos, id, size): in order, what still fits is kept and what doesn't is passed over; sizes are at least 0.

    protected(query, id) are kept in any case, and what comes behind them has so much less room. Once a size doesn't fit
    it never does again, so of each size s only the first most / s rows can be kept. Those are at most about
    most * ln(most) a query, whatever the input, and only they meet in one array. Size 0 fits wherever the room isn't overdrawn.
    """
    ranked = ranked.select("query", "pos", "id", "size", F.lit(0).cast("long").alias("base"))
    always = None
    if protected is not None:
        marked = ranked.join(protected.select("query", "id", F.lit(True).alias("safe")).distinct(), ["query", "id"], "left")
        before = Window.partitionBy("query").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.coalesce(F.sum(F.when(F.col("safe"), F.col("size"))).over(before), F.lit(0))
        marked = marked.withColumn("base", taken.cast("long"))
        always = marked.where("safe").select("query", "id")
        ranked = marked.where("safe is null").select("query", "pos", "id", "size", "base")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    keep = lambda acc, x: F.when(acc["used"] + x["base"] + x["size"] <= most, F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)
    nth = F.row_number().over(Window.partitionBy("query", "size").orderBy("pos", "id"))
    # the fixed bound lets Spark cut each task's rows before the shuffle
    able = ranked.where(F.col("size").between(1, most) & (F.col("base") + F.col("size") <= most)).withColumn("nth", nth).where((F.col("nth") <= most) & (F.col("nth") * F.col("size") <= most))
    rows = able.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size", "base"))).alias("rows"))
    kept = rows.select("query", F.explode(F.aggregate("rows", zero, keep)["ids"]).alias("id"))
    empty = ranked.where((F.col("size") == 0) & (F.lit(most) >= 0))
    if always is None:
        return kept.unionByName(empty.select("query", "id"))
    # what protected rules overdraw, nothing behind them fits, not even size 0
    taken = ranked.where("size > 0").join(kept, ["query", "id"], "left_semi").unionByName(empty)
    used = F.sum("size").over(Window.partitionBy("query").orderBy("pos", "id"))
    empty = taken.withColumn("used", used).where((F.col("size") == 0) & (F.col("used") + F.col("base") <= most))
    return kept.unionByName(empty.select("query", "id")).unionByName(always)


def first_per_id(items: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in source order."""
    w = Window.partitionBy(key).orderBy(order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def incremental_status(items: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """items(id, hash) against manifest(id, hash): new, changed or unchanged; with ``force`` nothing counts as unchanged."""
    m = manifest.withColumnRenamed("hash", "known")
    same = F.lit(not force) & (F.col("known") == F.col("hash"))
    return items.join(m, "id", "left").select("id", F.when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("status"))


def next_manifest(items: DataFrame, statuses: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, hash) to compare the next run with: items(id, hash) of statuses(id, status) less those of failed(id), which are tried again.

    What was unchanged is carried on whatever failed says, as it was not imported; what is no longer among the items goes.
    """
    lost = statuses.where("status <> 'unchanged'").join(failed.select("id"), "id", "left_semi").select("id")
    return items.select("id", "hash").join(lost, "id", "left_anti")


# Words that say nothing of a tool.
STOP_WORDS = [
    "the", "and", "for", "that", "this", "with", "from", "into", "will", "have", "been", "does", "each", "than", "also", "more", "some",
    "der", "die", "das", "und", "für", "mit", "von", "aus", "wird", "eine", "einer", "einem", "einen", "sind", "kann", "nach",
    "über", "oder", "aber", "wenn", "dann", "auch", "noch", "nicht",
]


def kebab(name: Column) -> Column:
    """A tool's name in lower case, with single hyphens for what parts it and nothing but a-z, 0-9 between them."""
    out = F.regexp_replace(F.regexp_replace(F.trim(name), r"[\s_.\-]+", "-"), r"[^a-zA-Z0-9\-]", "")
    return F.lower(F.btrim(F.regexp_replace(out, "-{2,}", "-"), F.lit("-")))


def tool_concepts(name: Column, description: Column) -> Column:
    """Parts of a tool's name from 3 characters on, words of its description from 4 on that are no stop words, and custom-tool; each once."""
    parts = F.transform(F.split(F.trim(name), r"[\s_.\-]+"), lambda p: F.lower(F.regexp_replace(p, r"[^a-zA-Z0-9\-]", "")))
    words = F.transform(F.split(F.coalesce(description, F.lit("")), r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]+"), F.lower)
    stop = F.array(*map(F.lit, STOP_WORDS))
    said = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    return F.array_distinct(F.concat(F.filter(parts, lambda p: F.length(p) >= 3), said, F.array(F.lit("custom-tool"))))


def tool_keywords(tools: DataFrame) -> DataFrame:
    """tools(name, description, tags) as rules (id, tags, concepts): the id by the name, tags in lower case behind tool, custom-tool and the name."""
    own = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    tags = F.array_distinct(F.concat(F.array(F.lit("tool"), F.lit("custom-tool"), kebab(F.col("name"))), F.filter(own, lambda t: t != "")))
    return tools.select(F.concat(F.lit("custom-tool-"), kebab(F.col("name"))).alias("id"), tags.alias("tags"), tool_concepts(F.col("name"), F.col("description")).alias("concepts"))
