"""What one query's context is made of, for tables of queries: scopes, expansions, sections and the text itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .ranking import expand_terms, fuse_topk, keyword_topk
from .retrieval import expand_graph, head_of, held, merge_active, mmr_rerank, representative_embedding, top_heads, top_k, vector_topk
from .rules import apply_budget, not_deleted, suppress_contradictions

# The words that call for each toolbox.
TOOLBOXES = {
    "tools.browser": "browser navigate click fill screenshot page html dom element webpage webseite seite formular eingabe button link url browsen automatisierung".split(),
    "tools.code": "python code script execute ausführen shell bash terminal command befehl programmieren interpreter pip run compile debug".split(),
    "tools.custom": ["custom tool", "eigenes tool", "plugin", "erstellen", "installieren", "benutzerdefiniert", "erweiterung", "addon"],
    "tools.devops": "docker container image deploy deployment devops orchestrierung service infrastruktur build".split(),
    "tools.files": "datei file upload download senden send anhang attachment verzeichnis ordner directory pfad path".split(),
    "tools.knowledge": "wissen knowledge akg regel rule kontext context kompilieren compile analyse codebase repository repo".split(),
    "tools.memory": "merken remember erinnern recall vergessen forget gedächtnis memory speichern store nutzer user userdata learning lernen".split(),
    "tools.multiagent": "recherche research parallel agent hand hands autonom autonomous workflow skill multi-agent delegieren delegate dag".split(),
    "tools.scheduling": ["trigger", "schedule", "zeitplan", "timer", "cron", "intervall", "benachrichtigung", "notification", "alarm", "erinnerung", "reminder", "task queue", "warteschlange"],
    "tools.security": "credential passwort password schlüssel key api-key token secret geheimnis zugang access".split(),
    "tools.web": "suche search web internet fetch http api request url website online googl bing herunterladen abrufen abfragen".split(),
}
ALWAYS = "custom-tools"


def _said(queries: DataFrame) -> Column:
    """Task and concepts in lower case, one a line."""
    return F.lower(F.concat_ws("\n", F.coalesce("task", F.lit("")), *([F.array_join("concepts", "\n")] if "concepts" in queries.columns else [])))


def toolboxes_of(queries: DataFrame) -> Column:
    """Toolboxes with a word in the task or a concept, all if none has."""
    said = _said(queries)
    called = F.array_compact(F.array(*[F.when(reduce(Column.__or__, [said.contains(w) for w in words]), F.lit(name)) for name, words in TOOLBOXES.items()]))
    every = F.array(*map(F.lit, TOOLBOXES))
    return F.array_append(F.when(F.size(called) > 0, called).otherwise(every), F.lit(ALWAYS))


def resolve_toolboxes(queries: DataFrame) -> DataFrame:
    """(query, toolbox) of queries(query, task, concepts)."""
    return queries.select("query", F.explode(toolboxes_of(queries)).alias("toolbox"))


#: Characters of the pieces by which needles find the texts that may contain them.
GRAM = 3


def _pieces(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters, none of a shorter text."""
    all_ = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(all_))


def containing(texts: DataFrame, needles: DataFrame, least: int = 1) -> DataFrame:
    """(key, needle) where needles(needle) of at least ``least`` characters occur in texts(key, text); a key may have several texts.

    A needle is looked up by that of its pieces which the fewest keys have, and the text confirms; a text gives a row a
    character at most, however long the needles are, and only pieces that are asked for are kept. Needles shorter than a
    piece are met as they are. Null texts contain nothing.
    """
    needles = needles.where(F.length("needle") >= least).select("needle").distinct()
    held = lambda size: texts.select("key", F.explode(_pieces(F.col("text"), size)).alias("piece"))
    need = needles.select("needle", F.explode(_pieces(F.col("needle"), GRAM)).alias("piece"))
    asked = held(GRAM).join(need.select("piece").distinct(), "piece", "left_semi").distinct()
    often = asked.groupBy("piece").agg(F.count("*").alias("n"))
    # a piece that no text has rules the needle out
    rare = need.join(often, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("at")).where("at.n > 0")
    maybe = rare.select("needle", F.col("at.piece").alias("piece")).join(asked, "piece").select("key", "needle")
    found = [maybe.join(texts.select("key", "text"), "key").where(F.contains("text", "needle")).select("key", "needle")]
    found += [held(k).withColumnRenamed("piece", "needle").join(needles.where(F.length("needle") == k), "needle").select("key", "needle") for k in range(max(1, least), GRAM)]
    return reduce(DataFrame.unionByName, found).distinct()


def activate_domains(queries: DataFrame, domains: DataFrame, closure: DataFrame) -> DataFrame:
    """(query, name): domains(name, label) that a concept equals or, from 4 characters on, task or concepts contain, and all below them.

    closure(parent, child) holds descendants at any depth; case doesn't matter.
    """
    names = domains.select("name", F.lower("name").alias("needle")).unionByName(domains.select("name", F.lower("label").alias("needle"))).where("needle <> ''").distinct()
    equal = queries.select("query", F.explode("concepts").alias("c")).select("query", F.lower("c").alias("needle"))
    inside = containing(queries.select(F.col("query").alias("key"), _said(queries).alias("text")), names, 4).withColumnRenamed("key", "query")
    hit = equal.unionByName(inside).join(names, "needle").select("query", "name").distinct()
    below = hit.join(closure.withColumnRenamed("parent", "name"), "name").select("query", F.col("child").alias("name"))
    return hit.unionByName(below).distinct()


def expand_query(queries: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """(query, term, n): the ``most`` terms that rules(id, terms) with a term of queries(query, terms) name beside it."""
    have = rules.select("id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    asked = queries.select("query", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    hit = have.join(asked, "term").select("query", "id").distinct()
    other = hit.join(have, "id").join(asked, ["query", "term"], "left_anti").groupBy("query", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy(F.col("n").desc(), "term")
    return other.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def fetch_world_knowledge(queries: DataFrame, world: DataFrame, most: int = 10) -> DataFrame:
    """(query, id): the first ``most`` of world(id, domain, tags) whose domain or a tag contains a concept of the query."""
    asked = queries.select("query", F.explode("concepts").alias("c")).select("query", F.lower("c").alias("needle")).where("needle <> ''").distinct()
    texts = world.select(F.col("id").alias("key"), F.explode(F.array_append("tags", F.col("domain"))).alias("text")).where("text is not null").select("key", F.lower("text").alias("text"))
    # a query takes the first ``most`` of all its concepts' rows, so of each concept no more than its first ones
    each = Window.partitionBy("needle").orderBy("key")
    first = containing(texts, asked).withColumn("r", F.row_number().over(each)).where(F.col("r") <= most)
    hit = first.join(asked, "needle").select("query", F.col("key").alias("id")).distinct()
    w = Window.partitionBy("query").orderBy("id")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def active_pairs(active: DataFrame, relations: DataFrame, rel: str) -> DataFrame:
    """(query, id, other): relations(src, rel, dst) of one kind with both ends in active(query, id)."""
    r = relations.where(F.col("rel") == rel).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()
    return active.select("query", "id").join(r, "id").join(active.select("query", F.col("id").alias("other")), ["query", "other"], "left_semi").select("query", "id", "other")


def find_entities(queries: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """(query, norm): the first ``most`` entities(norm) whose name contains a term of queries(query, terms).

    Where entities have an owner, only those without one and those of the query's user are found.
    """
    asked = queries.select("query", F.explode("terms").alias("t")).select("query", F.lower(F.trim("t")).alias("needle")).where("needle <> ''").distinct()
    hit = containing(entities.select(F.col("norm").alias("key"), F.col("norm").alias("text")).distinct(), asked).join(asked, "needle").select("query", F.col("key").alias("norm")).distinct()
    if "owner" in entities.columns:
        seekers = queries.select("query", "user" if "user" in queries.columns else F.lit(None).cast("string").alias("user"))
        hit = hit.join(entities.select("norm", "owner").distinct(), "norm").join(seekers, "query").where("owner is null or owner = user").select("query", "norm").distinct()
    w = Window.partitionBy("query").orderBy("norm")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def entity_context(queries: DataFrame, entities: DataFrame, related: DataFrame, most: int = 5, each: int = 5) -> DataFrame:
    """(query, text): up to ``most`` entities(norm, name, type) a query, each with up to ``each`` of related(name, other)."""
    found = find_entities(queries, entities, most).join(entities.select("norm", "name", "type", *[c for c in ("owner",) if c in entities.columns]), "norm")
    if "owner" in entities.columns:
        seekers = queries.select("query", "user" if "user" in queries.columns else F.lit(None).cast("string").alias("user"))
        found = found.join(seekers, "query").where("owner is null or owner = user").groupBy("query", "norm").agg(F.min(F.struct("name", "type")).alias("x")).select("query", "norm", "x.*")
    w = Window.partitionBy("query", "norm").orderBy("other")
    near = found.select("query", "norm").join(related.select(F.col("name").alias("norm"), F.lower("other").alias("other")).distinct(), "norm").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    near = near.groupBy("query", "norm").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("near"))
    line = F.concat(F.lit("- **"), "name", F.lit("** ("), "type", F.lit(")"), F.when(F.col("near").isNotNull(), F.concat(F.lit(" → "), "near")).otherwise(""))
    lines = found.join(near, ["query", "norm"], "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("norm", line.alias("line")))).alias("lines"))
    return lines.select("query", F.concat_ws("\n", F.lit("## Verwandte Entitäten (Wissensgraph)"), F.col("lines.line")).alias("text"))


def format_context(active: DataFrame, conflicts: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(query, text) from active(query, pos, id, type, body), conflicts and exceptions(query, id, other); what is active has been cut to a budget."""
    body = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.concat("body", F.lit("\n"))).otherwise("")
    rule = F.concat(F.lit("### ["), "type", F.lit("] "), "id", F.lit("\n"), body, F.lit("\n"))
    rules = active.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "id", rule.alias("text")))).alias("x")).select("query", F.concat(F.lit("## Active Knowledge Rules\n\n"), F.array_join("x.text", "")).alias("a"))

    def section(pairs: DataFrame, title: str, line: Column, name: str) -> DataFrame:
        x = pairs.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("id", "other", F.concat(F.lit("- "), line, F.lit("\n")).alias("text")))).alias("x"))
        return x.select("query", F.concat(F.lit(f"## {title}\n"), F.array_join("x.text", ""), F.lit("\n")).alias(name))

    fights = section(conflicts, "Rule Conflicts", F.concat(F.lit("Rule '"), "id", F.lit("' conflicts with '"), "other", F.lit("'")), "b")
    excepted = section(exceptions, "Active Exceptions", F.concat(F.lit("Rule '"), "id", F.lit("' is an exception for '"), "other", F.lit("'")), "c")
    all_ = rules.join(fights, "query", "left").join(excepted, "query", "left")
    return all_.select("query", F.rtrim(F.regexp_replace(F.concat_ws("", "a", "b", "c"), r"\s+$", "")).alias("text"))


def scoped(rules: DataFrame, tenant: str = "default", now: str | None = None, prune: bool = False) -> DataFrame:
    """rules that some query may see, with the columns that say which: owner, box (a toolbox's domain) and, to prune by heads, head.

    Soft-deleted rules, those of other tenants and those no longer valid at ``now`` are left out. Rules of a repository or
    an upload lie below a head; a head itself has none and is not seen by queries that name heads.
    """
    out = not_deleted(rules)
    out = out.where(F.coalesce("tenant", F.lit("default")) == tenant) if "tenant" in rules.columns else out
    if now is not None and "valid_until" in rules.columns:
        out = out.where(F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(now).cast("timestamp")))
    out = out.withColumn("box", F.when(F.col("domain").startswith("tools."), F.col("domain")))
    return out.withColumn("head", F.when(F.col("id").rlike("^(git|upload):"), F.coalesce(head_of(F.col("id")), F.lit("")))) if prune else out


def compile_context(
    queries: DataFrame,
    rules: DataFrame,
    relations: DataFrame,
    edges: DataFrame | None = None,
    multipliers: DataFrame | None = None,
    world: DataFrame | None = None,
    top: int = 15,
    most: int = 12_000,
    *,
    chunks: DataFrame | None = None,
    heads: DataFrame | None = None,
    domains: DataFrame | None = None,
    closure: DataFrame | None = None,
    entities: DataFrame | None = None,
    related: DataFrame | None = None,
    expansion: int = 0,
    expanded_weight: float = 0.5,
    now: str | None = None,
    tenant: str = "default",
    nearest: int = 100,
    above: float = 0.5,
    above_head: float = 0.4,
    diversity: float = 0.7,
) -> tuple[DataFrame, DataFrame]:
    """Active rules (query, pos, id) and texts (query, text) for queries(query, task, concepts, user and embedding if they have them).

    In order, each step where its tables are given:

    1. heads(head, ord, embedding): the three nearest of a query prune the repositories and uploads it looks into; a
       query near none looks into all;
    2. rules in scope: owner, tenant, validity, toolboxes, heads (``scoped``, ``ranking.visible``);
    3. domains(name, label) with closure(parent, child) that are active, and ``expansion`` terms that go with the query's;
    4. keyword scores, times multipliers(id, multiplier);
    5. chunks(parent, chunk, embedding): the ``nearest`` fuse with the keyword ranks, and the first ``top`` are dealt
       anew by maximal marginal relevance;
    6. the ``top`` are seeds: edges(src, rel, dst, valid_until) add neighbours and world(id, domain, tags) adds knowledge
       behind them; superseded and weaker conflicting rules go, and what fits the budget stays;
    7. entities(norm, name, type) that the concepts name, with related(name, other), close the text.

    What later steps read more than once is written. Bodies are joined last, to active rules only.
    """
    spark = rules.sparkSession
    base = scratch(spark, "context")
    near = queries.where("embedding is not null") if "embedding" in queries.columns else None
    asked = queries
    if heads is not None and near is not None:
        found = top_heads(heads, near, above=above_head).groupBy("query").agg(F.array_sort(F.collect_set("head")).alias("heads"))
        asked = asked.join(found, "query", "left")
    asked = held(asked.withColumn("boxes", toolboxes_of(queries)), f"{base}/queries")
    seen = scoped(rules, tenant, now, prune=heads is not None)
    active_domains = activate_domains(asked, domains, closure) if domains is not None else None
    expanded = held(expand_terms(asked, seen, expansion), f"{base}/expanded") if expansion else None
    semantic = None
    if chunks is not None and near is not None:
        semantic = held(vector_topk(chunks, near, nearest, above).select("query", F.col("parent").alias("id"), "score"), f"{base}/semantic")
    ranked, levels = keyword_topk(seen, asked, top + (nearest if semantic is not None else 0), active_domains, expanded, expanded_weight, multipliers, semantic)
    if semantic is None:
        seeds = top_k(ranked, top).select("query", "id", "rank")
    else:
        fused = held(fuse_topk(ranked, levels, semantic, top), f"{base}/fused")
        first = fused.where("hit").join(representative_embedding(chunks).withColumnRenamed("parent", "id"), "id", "left")
        seeds = mmr_rerank(first.select("query", "rank", "id", "score", "embedding"), top, diversity).unionByName(fused.where("not hit").select("query", "rank", "id"))
    users = [c for c in ("user",) if c in queries.columns]
    order = [held(seeds, f"{base}/seeds")]
    if edges is not None:
        nodes = not_deleted(rules)
        nodes = nodes.where(F.coalesce("tenant", F.lit("default")) == tenant) if "tenant" in rules.columns else nodes
        nodes = nodes.select("id", *[c for c in ("owner",) if c in rules.columns])
        near_by = expand_graph(order[0].select("query", "id").join(asked.select("query", *users), "query"), edges, nodes=nodes, now=now)
        w = Window.partitionBy("query").orderBy("depth", "id")
        order.append(near_by.withColumn("rank", F.row_number().over(w)).select("query", "id", "rank"))
    if world is not None:
        w = Window.partitionBy("query").orderBy("id")
        order.append(fetch_world_knowledge(asked, world).withColumn("rank", F.row_number().over(w)).select("query", "id", "rank"))
    active = held(merge_active(*order), f"{base}/active")
    active = active.select("query", (F.col("part") * 1_000_000 + F.col("rank")).cast("long").alias("pos"), "id").join(rules.select("id", "priority"), "id")
    active = suppress_contradictions(active, relations)
    sized = active.join(rules.select("id", (F.length(F.coalesce("body", F.lit(""))) + F.length("id") + F.length("type") + 16).cast("long").alias("size")), "id")
    kept = sized.join(apply_budget(sized.select("query", "pos", "id", "size"), most), ["query", "id"], "left_semi").select("query", "pos", "id")
    kept = held(kept, f"{base}/kept")
    full = kept.join(rules.select("id", "type", "body"), "id")
    texts = format_context(full, active_pairs(kept, relations, "CONFLICTS_WITH"), active_pairs(kept, relations, "EXCEPTION_FOR"))
    if entities is not None:
        named = entity_context(asked.select("query", F.col("concepts").alias("terms"), *users), entities, related)
        texts = texts.join(named.withColumnRenamed("text", "named"), "query", "full").select("query", F.concat_ws("\n\n", "text", "named").alias("text"))
    return kept, texts


def synthetic_corpus(spark, rules: int, cases: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """rules(id, n, type, domain, priority, tags, triggers, body) and cases(query, task, concepts, expected), the same for equal arguments."""
    mask = 0xFFFFFFFF

    def mixed(index: Column, salt: int) -> Column:
        x = (index * 2654435761 + (salt * 40503 + 2166136261)).bitwiseAND(F.lit(mask))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
        # the product of two 32-bit numbers, by halves, to stay within a long
        low, high = x.bitwiseAND(F.lit(0xFFFF)) * 2246822519, F.shiftrightunsigned(x, 16) * 2246822519
        x = (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(mask))
        return x.bitwiseXOR(F.shiftrightunsigned(x, 13))

    topics, i = max(1, rules // 5), F.col("i")
    made = spark.range(rules).withColumnRenamed("id", "i").withColumns({"topic": mixed(i, seed + 7) % topics, "domain": F.concat(F.lit("dom-"), mixed(i, seed + 3) % 24)})
    about = F.concat(F.lit("topic-"), "topic")
    body = F.format_string("Synthetic benchmark rule %d about topic-%d. Applies in domain %s. Filler concept c%d and c%d for keyword scoring.", "i", "topic", "domain", i % 97, i % 89)
    out = made.select(F.concat(F.lit("bench-"), "i").alias("id"), F.col("i").alias("n"), F.lit("Rule").alias("type"), "domain", F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High"))), (i % 3 + 1).cast("int")).alias("priority"), F.array(F.concat(F.lit("tag-"), i % 12), about).alias("tags"), F.array(about).alias("triggers"), body.alias("body"), "topic")
    # topics in the order of their first rules; their number is all the cases need
    first = out.groupBy("topic").agg(F.min("n").alias("first"), F.slice(F.array_sort(F.collect_list("n")), 1, 20).alias("expected"))
    # written in order, so that a row's place is its place in its partition behind all partitions before
    path = scratch(spark, "topics")
    first.orderBy("first").withColumn("m", F.monotonically_increasing_id()).write.parquet(path)
    first = spark.read.parquet(path)
    part = F.shiftright("m", 33)
    sizes = {r.p: r.n for r in first.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, n = [], 0
    for p in sorted(sizes):
        before.append((p, n))
        n += sizes[p]
    order = first.join(spark.createDataFrame(before or [(0, 0)], "p long, before long"), part == F.col("p")).withColumn("at", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    asked = spark.range(max(0, min(cases, n))).withColumnRenamed("id", "j").withColumn("at", mixed(F.col("j"), seed + 11) % max(1, n))
    name = F.concat(F.lit("topic-"), "topic")
    expected = F.transform("expected", lambda x: F.concat(F.lit("bench-"), x.cast("string")))
    done = asked.join(order, "at").select(F.concat(F.lit("case-"), "j").alias("query"), F.concat(F.lit("Guidance and rules on "), name, F.lit(" for this task.")).alias("task"), F.array(name).alias("concepts"), expected.alias("expected"))
    return out.drop("topic"), done
