"""Sources as items, items as rules: files, records, payloads, links and hierarchies."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import glob_regex
from ..sources.records import csv_records, json_records
from ..sources.rule_files import RuleFiles, file_texts

# What of a repository is read.
EXTENSIONS = (
    "md markdown mdx txt rst adoc cs fs vb razor cshtml xaml csproj fsproj props targets ts tsx js jsx mjs cjs vue svelte css scss sass less html htm java kt kts scala groovy "
    "py rb php go rs swift dart lua r jl pl c h cpp cc cxx hpp hh sh bash zsh ps1 psm1 bat cmd tf sql graphql gql proto json jsonc yaml yml toml ini xml"
).split()
IGNORED_DIRECTORIES = ".git node_modules bower_components vendor dist build out bin obj target packages .vs .vscode .idea __pycache__ .pytest_cache .mypy_cache coverage .next .nuxt .svelte-kit .terraform venv .venv".split()
IGNORED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml composer.lock cargo.lock poetry.lock gemfile.lock go.sum".split()
IGNORED_ENDINGS = (".min.js", ".min.css", ".map")

ID, BODY, TITLE = ("id", "key", "uuid"), ("body", "content", "text", "document", "description"), ("title", "name", "summary")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def filter_repo_files(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """files(path) that are sources or documents, in no ignored directory, no lock files, bundles or maps; of ``globs`` any must match."""
    parts = F.transform(path_parts(F.col("path")), F.lower)
    name = F.element_at(parts, -1)
    ok = (F.size(parts) > 0) & ~F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(IGNORED_DIRECTORIES)) & ~name.isin(IGNORED_FILES)
    for ending in IGNORED_ENDINGS:
        ok = ok & ~name.endswith(ending)
    ok = ok & name.contains(".") & F.substring_index(name, ".", -1).isin(EXTENSIONS)
    if globs:
        any_of = F.lit(False)
        for g in globs:
            any_of = any_of | F.replace("path", F.lit("\\"), F.lit("/")).rlike(glob_regex(g))
        ok = ok & any_of
    return files.where(ok)


def front_matter(text: Column) -> tuple[Column, Column]:
    """The ``key: value`` map between a first line --- and the next, and the rest; without it an empty map and the text."""
    clean = F.regexp_replace(text, "\r\n", "\n")
    pattern = r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)(.*)\z"
    has = clean.rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(clean, pattern, 1), "\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.btrim(F.trim(F.substr(x, F.instr(x, ":") + 1)), F.lit("\"'"))))
    # of equal keys the first stays
    keys = F.transform(entries, lambda e: e["col1"])
    once = F.filter(entries, lambda e, i: F.array_position(keys, e["col1"]) == i + 1)
    return F.when(has, F.map_from_entries(once)).otherwise(F.create_map().cast("map<string,string>")), F.when(has, F.regexp_extract(clean, pattern, 2)).otherwise(clean)


def first_heading(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^\s*# (.*)$", 1)
    return F.when(text.rlike(r"(?m)^\s*# (.*)$"), F.trim(found))


def markdown_links(docs: DataFrame) -> DataFrame:
    """(path, target) of docs(path, text): links to .md files in the repository, relative to the file's folder."""
    raw = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("link"))
    bare = raw.withColumn("link", F.regexp_extract(F.trim("link"), r"^([^#\s]*)", 1)).where("lower(link) like '%.md' and not contains(link, '://') and not startswith(link, '/')")
    folder = F.slice(path_parts(F.col("path")), F.lit(1), F.greatest(F.size(path_parts(F.col("path"))) - 1, F.lit(0)))
    # .. takes a folder back; a link above the root has none to take
    step = lambda acc, x: F.when(acc.isNull() | (x == "."), acc).when(x != "..", F.array_append(acc, x)).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    whole = F.aggregate(path_parts(F.col("link")), folder, step)
    return bare.select("path", F.array_join(whole, "/").alias("target")).where("target is not null").distinct()


def path_tags(path: Column) -> Column:
    """Lower-cased folder names, then what file name and folders mark: readme, contributing, gitlab, adr; each once, in order."""
    parts = F.transform(path_parts(path), F.lower)
    name, clean = F.element_at(parts, -1), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    marks = [F.when(name.startswith("readme"), "readme"), F.when(name.startswith("contributing"), "contributing"), F.when(clean.startswith(".gitlab/"), "gitlab"), F.when(clean.contains("/adr/") | clean.startswith("adr/"), "adr")]
    return F.array_distinct(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array_compact(F.array(*marks))))


def repo_parts(url: Column) -> Column:
    """struct(host, groups, repo) of a URL or user@host:group/repo; user names and .git are dropped."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^[^/@]*@", "")
    parts = F.filter(F.split(F.regexp_replace(bare, r"^([^/:]+):(?!\d+(/|$))", "$1/"), "/"), lambda x: x != "")
    n = F.size(parts)
    repo = F.when(n > 1, F.regexp_replace(F.element_at(parts, -1), r"\.git$", ""))
    return F.struct(F.lower(F.get(parts, F.lit(0))).alias("host"), F.when(n > 2, F.slice(parts, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")).alias("groups"), repo.alias("repo"))


def repo_hierarchy(urls: DataFrame) -> DataFrame:
    """(node, parent) of urls(url): root, hosts, groups below groups, repositories; each once."""
    u = urls.select(repo_parts(F.col("url")).alias("r")).where("r.host is not null")
    path = F.concat(F.array("r.host"), "r.groups", F.when(F.col("r.repo").isNotNull(), F.array("r.repo")).otherwise(F.array().cast("array<string>")))
    levels = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.array_join(F.slice("path", F.lit(1), i), "/").alias("node"), F.when(i == 1, "root").otherwise(F.array_join(F.slice("path", F.lit(1), i - 1), "/")).alias("parent")))
    return u.select(path.alias("path")).distinct().select(F.explode(levels).alias("x")).select("x.node", "x.parent").distinct()


def repo_files(files: DataFrame) -> DataFrame:
    """(node, parent) of files(url, path): a node for each file below its repository, and those of ``repo_hierarchy`` above it; each once."""
    u = files.select(repo_parts(F.col("url")).alias("r"), "path").where("r.repo is not null")
    repo = F.array_join(F.concat(F.array("r.host"), "r.groups", F.array("r.repo")), "/")
    name = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^/+", "")
    below = u.select(F.concat(repo, F.lit("/"), name).alias("node"), repo.alias("parent"), name.alias("name")).where("name <> ''").select("node", "parent").distinct()
    return repo_hierarchy(files.select("url").distinct()).unionByName(below)


def map_items_to_rules(items: DataFrame, mappings: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """items(id, path, domain) with type, domain and priority: the first of mappings(glob, type, domain, priority) that matches the path."""
    which = F.coalesce(*[F.when(F.replace("path", F.lit("\\"), F.lit("/")).rlike(glob_regex(g)), F.lit(n)) for n, (g, *_) in enumerate(mappings)], F.lit(-1))
    pick = lambda k, default: F.coalesce(*[F.when(F.col("_m") == n, F.lit(m[k])) for n, m in enumerate(mappings)], default)
    parts = path_parts(F.col("path"))
    first = F.when(F.size(parts) > 1, parts[0])
    out = items.withColumn("_m", which)
    return out.select("id", pick(1, F.lit("WorldKnowledge")).alias("type"), F.coalesce("domain", pick(2, F.lit(None).cast("string")), first, F.lit("general")).alias("domain"), pick(3, F.lit("Medium")).alias("priority"))


def resolve_links(links: DataFrame, items: DataFrame) -> DataFrame:
    """links(src, kind, target) to items(id), each once; kinds other than supersedes and requires are related."""
    kind = F.when(F.lower("kind").isin("supersedes", "requires"), F.lower("kind")).otherwise("related")
    known = items.select(F.col("id").alias("dst")).distinct()
    return links.select("src", kind.alias("rel"), F.col("target").alias("dst")).join(known, "dst", "left_semi").select("src", "rel", "dst").distinct()


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes(id, status, error) by status, in one row."""
    return outcomes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "skipped", "failed")], F.count("error").alias("errors"))


def ingest_errors(outcomes: DataFrame) -> DataFrame:
    """(id, message) of outcomes(id, status, error) that failed; without a message it is empty."""
    return outcomes.where("status = 'failed'").select("id", F.coalesce("error", F.lit("")).alias("message"))


def upsert_rules(current: DataFrame, incoming: DataFrame, now: Column, replace: bool = False) -> DataFrame:
    """current and incoming(id, ..., valid_from): incoming fields win, the first-seen valid_from stays; with ``replace`` only incoming ids stay."""
    fields = [c for c in incoming.columns if c not in ("id", "valid_from")]
    new = incoming.select("id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = current.join(new, "id", "right" if replace else "full")
    return both.select("id", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.coalesce("valid_from", now).alias("valid_from"))


def _first(row: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.trim(F.element_at(row, n)) != "", F.element_at(row, n)) for n in names])


def items_of_records(records: DataFrame, label: str, domain: str | None = None) -> DataFrame:
    """records(n, fields map<string,string>) as items (id, title, body, domain): keys in any case, rows numbered by n."""
    row = F.col("row")
    lower = records.select("n", F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(e["key"]), e["value"]))).alias("row"))
    filled = F.filter(F.map_entries(row), lambda e: F.trim(e["value"]) != "")
    body = F.coalesce(_first(row, BODY), F.array_join(F.transform(F.array_sort(filled), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))
    key = F.coalesce(_first(row, ID), F.col("n").cast("string"))
    line = F.substring(F.trim(F.regexp_replace(F.regexp_extract("body", r"\A\s*([^\n]*)", 1), r"^#+\s*", "")), 1, 120)
    title = F.coalesce("named", F.when(line != "", line), F.concat(F.lit(f"{label} #"), "n"))
    items = lower.select("n", key.alias("key"), _first(row, TITLE).alias("named"), body.alias("body"))
    return items.select(F.concat(F.lit(f"upload:{label}:"), "key").alias("id"), title.alias("title"), "body", F.lit(domain).alias("domain"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(file, block, at) with n, their place over all files: a block of a file is ranked alone, behind what blocks before it hold."""
    inner = rows.withColumn("_r", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    # a row a split: few enough for one task to add up
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return inner.join(sizes, ["file", "block"]).withColumn("n", F.col("_before") + F.col("_r") - 1)


def import_records(spark: SparkSession, path: str, label: str, domain: str | None = None) -> DataFrame:
    """Items of .jsonl, .json (an array) or .csv files, a file or a pattern; what is no JSON object is left out, short CSV rows get nulls.

    A file of any size is read by as many tasks as it has splits; rows without a key are numbered over all files.
    """
    if path.endswith(".csv"):
        found = csv_records(spark, path).select(F.col("place").alias("n"), "fields")
    elif path.endswith(".json"):
        found = json_records(spark, path).select(F.col("place").alias("n"), F.from_json("text", "map<string,string>").alias("fields"))
    else:
        place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
        parsed = spark.read.text(path).select(*place, F.from_json("value", "map<string,string>").alias("fields"))
        found = _numbered(parsed.where("fields is not null and size(fields) > 0")).select("n", "fields")
    return items_of_records(found, slug_of(label), domain)


def slug_of(label: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", "-", label.lower()).strip("-") or "import"


def map_api_payload(payloads: DataFrame, label: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    """payloads(json) as items (id, title, body, url): the array at a dotted path, fields by dotted paths in each element."""
    each = payloads.select(F.posexplode(F.from_json(F.get_json_object("json", f"$.{items_path}"), "array<string>")).alias("n", "item"))
    at = lambda name: F.get_json_object("item", f"$.{fields[name]}") if name in fields else F.lit(None).cast("string")
    blank = lambda c: F.when(F.trim(c) != "", c)
    out = each.select(F.coalesce(blank(at("id")), F.col("n").cast("string")).alias("key"), blank(at("title")).alias("title"), blank(at("body")).alias("body"), at("url").alias("url"), "item")
    clean = F.regexp_replace(F.trim("key"), " ", "-")
    return out.select(F.concat(F.lit(f"{label}:"), F.when(clean == "", "item").otherwise(clean)).alias("id"), F.coalesce("title", "key").alias("title"), F.coalesce("body", "item").alias("body"), "url")


def import_text_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(source, label, texts): a source item and one item per text, related to its source."""
    line = F.substring(F.trim(F.regexp_replace(F.regexp_extract("text", r"\A\s*([^\n]*)", 1), r"^#+\s*", "")), 1, 120)
    each = blocks.select("source", "label", F.posexplode("texts").alias("i", "text"))
    items = each.select(F.concat_ws(":", "source", F.col("i").cast("string")).alias("id"), F.when(line != "", line).otherwise(F.concat("label", F.lit(" #"), F.col("i") + 1)).alias("title"), F.col("text").alias("body"), F.col("source").alias("related"))
    return items.unionByName(blocks.select(F.col("source").alias("id"), F.col("label").alias("title"), F.lit("").alias("body"), F.lit(None).cast("string").alias("related")))


def _plain(value: str) -> str:
    return value.strip().strip("\"'")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _block(lines: list[str], folded: bool) -> str:
    deep = min((_indent(x) for x in lines if x.strip()), default=0)
    return (" " if folded else "\n").join(x[deep:] for x in lines).strip("\n")


def _snippets(lines: list[str]) -> dict[str, list[str]]:
    """The lists below pass: and fail:, of inline values and of | or > blocks."""
    out: dict[str, list[str]] = {"pass": [], "fail": []}
    name, at = None, 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.strip() in ("pass:", "fail:"):
            name = line.strip()[:-1]
        elif name and line.lstrip().startswith("-"):
            value, deep = line.lstrip()[1:].strip(), _indent(line)
            if value in ("|", ">"):
                end = next((k for k in range(at, len(lines)) if lines[k].strip() and _indent(lines[k]) <= deep), len(lines))
                value, at = _block(lines[at:end], value == ">"), end
                out[name].append(value)
            else:
                out[name].append(_plain(value))
    return out


def parse_rule(text: str) -> dict | None:
    """Fields of a rule file: front matter with inline lists, ``- item`` lists, | or > blocks and snippets below pass: and fail:; None without id or title."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    if not lines or lines[0].strip() != "---":
        return None
    end = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
    if end is None:
        return None
    fields: dict = {}
    at = 1
    while at < end:
        key, colon, value = lines[at].partition(":")
        at += 1
        if not colon or not key.strip() or key[0].isspace() or key.startswith("#"):
            continue
        value = value.strip()
        block = []
        while at < end and (not lines[at].strip() or lines[at][0].isspace() or lines[at].startswith("- ")):
            block.append(lines[at])
            at += 1
        if value in ("|", ">"):
            out = _block(block, value == ">")
        elif value.startswith("[") and value.endswith("]"):
            out = [_plain(x) for x in value[1:-1].split(",") if x.strip()]
        elif not value and any(x.strip() in ("pass:", "fail:") for x in block):
            out = _snippets(block)
        elif not value and any(x.strip().startswith("- ") for x in block):
            out = [_plain(x.strip()[2:]) for x in block if x.strip().startswith("- ")]
        else:
            out = _plain(value)
        fields[key.strip()] = out
    if not all(isinstance(fields.get(k), str) and fields[k].strip() for k in ("id", "title")):
        return None
    return fields | {"body": "\n".join(lines[end + 1 :]).strip()}


#: Columns of a rule file: name, key in the front matter, and kind.
RULE_FIELDS = [
    ("id", "id", "string"), ("title", "title", "string"), ("type", "type", "string"), ("domain", "domain", "string"), ("priority", "priority", "string"),
    ("tags", "tags", "array<string>"), ("concepts", "concepts", "array<string>"), ("applies_to", "appliesTo", "array<string>"),
    ("implies", "implies", "array<string>"), ("requires", "requires", "array<string>"), ("conflicts_with", "conflictsWith", "array<string>"),
    ("exception_for", "exceptionFor", "array<string>"), ("supersedes", "supersedes", "array<string>"), ("related", "related", "array<string>"),
    ("author", "author", "string"), ("created", "created", "date"), ("owner", "ownerId", "string"), ("tenant", "tenantId", "string"),
    ("script", "validatorScript", "string"), ("script_enabled", "validatorEnabled", "boolean"), ("validator_type", "validatorType", "string"), ("validator_prompt", "validatorPrompt", "string"),
]
RELATIONS = {"implies": "IMPLIES", "requires": "REQUIRES", "conflicts_with": "CONFLICTS_WITH", "exception_for": "EXCEPTION_FOR", "supersedes": "SUPERSEDES", "related": "RELATED"}
RULE = "path string, " + ", ".join(f"{name} {kind}" for name, _, kind in RULE_FIELDS) + ", pass array<string>, fail array<string>, body string"
DEFAULTS = {"type": "Rule", "domain": "general", "tenant": "default"}


def _typed(fields: dict, name: str, key: str, kind: str):
    value = fields.get(key)
    if kind == "array<string>":
        return value if isinstance(value, list) else [value] if isinstance(value, str) and value else []
    if kind == "boolean":
        return str(value).lower() != "false"
    value = value if isinstance(value, str) and value.strip() else DEFAULTS.get(name)
    if kind == "date":
        try:
            return datetime.date.fromisoformat(value) if value else None
        except ValueError:
            return None
    return {"low": "Low", "high": "High", "critical": "Critical"}.get((value or "").lower(), "Medium") if name == "priority" else value


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules of files(path, text); id is null where a file is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "date": pa.date32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([("path", pa.string()), *((n, kinds[k]) for n, _, k in RULE_FIELDS), ("pass", kinds["array<string>"]), ("fail", kinds["array<string>"]), ("body", pa.string())])
        for b in batches:
            rows = []
            for path, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                f = parse_rule(t or "") or {}
                shown = f.get("validatorFixtures") if isinstance(f.get("validatorFixtures"), dict) else {}
                rows.append({"path": path, **{n: _typed(f, n, key, k) for n, key, k in RULE_FIELDS}, "pass": shown.get("pass", []), "fail": shown.get("fail", []), "body": f.get("body")})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "text").mapInArrow(run, RULE)


def read_markdown_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of all .md files below a folder; rejected files have no id."""
    return parse_rules(file_texts(spark, folder, ".md"))


def _named(column: str, name: str, mark: str, value: str) -> Column:
    """An array column's values as structs with a fixed mark."""
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(mark).alias(name), x.alias(value)))


def relations_of(rules: DataFrame) -> DataFrame:
    """(src, rel, dst), each once, of rules with the relation columns of RULE_FIELDS."""
    pairs = F.flatten(F.array(*[_named(c, "rel", rel, "dst") for c, rel in RELATIONS.items()]))
    return rules.select(F.col("id").alias("src"), F.explode(pairs).alias("x")).select("src", "x.rel", "x.dst").distinct()


def fixtures_of(rules: DataFrame) -> DataFrame:
    """(rule, kind, code): the snippets that a rule's check must pass and must not."""
    each = F.flatten(F.array(*[_named(k, "kind", k, "code") for k in ("pass", "fail")]))
    return rules.select(F.col("id").alias("rule"), F.explode(each).alias("x")).select("rule", "x.kind", "x.code")


def rule_as_markdown(rules: DataFrame) -> Column:
    """A rule as front matter and body: id, title, type, domain, priority and, where rules have them and they say something, the other fields."""
    have = lambda c, text, when: F.when(when, text) if c in rules.columns else F.lit(None).cast("string")
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    key = {name: k for name, k, _ in RULE_FIELDS}
    line = lambda c: F.concat(F.lit(f"{key[c]}: "), F.col(c).cast("string"))
    many = lambda c: have(c, F.concat(F.lit(f"{key[c]}: ["), F.array_join(c, ", "), F.lit("]")), F.size(c) > 0)
    one = lambda c, when=None: have(c, line(c), (filled(c) if c in rules.columns else F.lit(False)) if when is None else when)
    shown = lambda k: F.when(F.size(k) > 0, F.concat(F.lit(f"  {k}:\n"), F.array_join(F.transform(k, lambda x: F.concat(F.lit("    - |\n"), F.regexp_replace(x, "(?m)^", "      "))), "\n"))) if k in rules.columns else F.lit(None).cast("string")
    fixtures = F.concat_ws("\n", shown("pass"), shown("fail"))
    parts = [
        F.lit("---"), *map(line, ("id", "title", "type", "domain", "priority")), many("tags"), many("concepts"), many("applies_to"), one("author"), one("created"), one("owner"),
        one("tenant", F.col("tenant") != "default" if "tenant" in rules.columns else None), *map(many, RELATIONS), have("script_enabled", F.lit("validatorEnabled: false"), ~F.col("script_enabled") if "script_enabled" in rules.columns else F.lit(False)),
        one("validator_type"), one("validator_prompt"), have("script", F.concat(F.lit("validatorScript: |\n"), F.regexp_replace("script", "(?m)^", "  ")), filled("script") if "script" in rules.columns else F.lit(False)),
        F.when(fixtures != "", F.concat(F.lit("validatorFixtures:\n"), fixtures)), F.lit("---"), F.lit(""), F.concat(F.coalesce("body", F.lit("")), F.lit("\n")),
    ]
    return F.concat_ws("\n", *parts)


def rule_files(rules: DataFrame) -> DataFrame:
    """(domain, file, text): names keep letters, digits, - _ and dots; of ids with one name in a domain all but the smallest carry a hash."""
    safe = lambda c: F.regexp_replace(c, r"[^\p{L}\p{Nd}\-_.]", "-")
    named = rules.select("id", safe(F.coalesce("domain", F.lit("general"))).alias("domain"), safe(F.col("id")).alias("name"), rule_as_markdown(rules).alias("text"))
    first = F.row_number().over(Window.partitionBy("domain", "name").orderBy("id")) == 1
    return named.select("domain", F.concat("name", F.when(first, ".md").otherwise(F.concat(F.lit("-"), F.substring(F.sha2("id", 256), 1, 8), F.lit(".md")))).alias("file"), "text")


def write_rules_by_domain(rules: DataFrame, folder: str, overwrite: bool = True) -> None:
    """A Markdown file for each rule, in a folder for each domain; all of them or, if a task fails for good, none."""
    rules.sparkSession.dataSource.register(RuleFiles)
    rule_files(rules).write.format("rule_files").mode("overwrite" if overwrite else "append").save(folder)


def export_bundle(rules: DataFrame, folder: str) -> None:
    """Bundles {schemaVersion, rules: [...]}: each partition's rules are one whole document, a rule a line; coalesce(1) makes it one."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = '{"schemaVersion":1,"rules":['
        for b in batches:
            lines = b.column("value").to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("," if k or not head else "") + x for k, x in enumerate(lines)]) if not head else pa.array([head, *(("," if k else "") + x for k, x in enumerate(lines))])], names=["value"])
                head = ""
        yield pa.RecordBatch.from_arrays([pa.array([head + "]}"])], names=["value"])

    rules.select(F.to_json(F.struct(*rules.columns)).alias("value")).mapInArrow(document, "value string").write.text(folder)


def import_bundle(spark: SparkSession, folder: str, rule_ddl: str, keep_scripts: bool = False) -> DataFrame:
    """Rules of documents {schemaVersion, rules: [...]}, of any size and number in a file; scripts are dropped unless allowed."""
    out = json_records(spark, folder, depth=2).select(F.from_json("text", rule_ddl).alias("r")).select("r.*")
    return out if keep_scripts or "script" not in out.columns else out.withColumn("script", F.lit(None).cast("string"))


ENTRY = "seq long, ts string, event_type string, user string, description string, metadata map<string,string>, prev_hash string"


def audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, value): the lines but for empty ones of the daily logs audit-*.jsonl below a folder, counted from 1 in each file; a file is read by as many tasks as it has splits."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "audit-*.jsonl").text(folder).where("value <> ''")
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a split's rows have ids in a row, so its first id gives their places; a row a split
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_audit_log(lines: DataFrame) -> DataFrame:
    """lines(file, line, value): the signed entry and what is inside it; columns are null where a layer is no JSON."""
    signed = lines.select("file", "line", F.from_json("value", "entry string, mac string, entry_hash string").alias("s"))
    return signed.select("file", "line", "s.entry", "s.mac", "s.entry_hash", F.from_json("s.entry", ENTRY).alias("e")).select("file", "line", "entry", "mac", "entry_hash", "e.*")


def recent_audit(entries: DataFrame, issues: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` decoded entries(file, line, seq), with whether verify_chain found no issue(file, line)."""
    bad = issues.select("file", "line", F.lit(False).alias("valid")).distinct()
    return entries.where("seq is not null").orderBy(F.col("file").desc(), F.col("line").desc()).limit(most).join(bad, ["file", "line"], "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


def parse_extraction(replies: DataFrame) -> DataFrame:
    """replies(id, text): entities and relations of the JSON between the first { and the last }; relations need both names listed."""
    ddl = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,description:string,keywords:array<string>>>"
    j = replies.select("id", F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), ddl).alias("j"))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    e = F.transform(F.filter(F.coalesce("j.entities", F.array().cast("array<struct<name:string,type:string,description:string>>")), lambda x: filled(x["name"])), lambda x: F.struct(F.trim(x["name"]).alias("name"), F.when(filled(x["type"]), x["type"]).otherwise("concept").alias("type"), x["description"].alias("description")))
    out = j.withColumn("entities", e).withColumn("names", F.transform("entities", lambda x: F.lower(x["name"])))
    has = lambda c: F.array_contains("names", F.lower(F.trim(c)))
    r = F.filter(F.coalesce("j.relations", F.array().cast("array<struct<source:string,target:string,description:string,keywords:array<string>>>")), lambda x: filled(x["source"]) & filled(x["target"]) & F.coalesce(has(x["source"]) & has(x["target"]), F.lit(False)))
    return out.withColumn("relations", r).select("id", "entities", "relations")


def apply_enrichment(items: DataFrame, replies: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(id, body) with the reply's summary if it has one, and new links(src, dst): known, not itself, not there yet."""
    j = replies.select("id", F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), "summary string, related array<string>").alias("j")).select("id", "j.*")
    body = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary")).otherwise(F.col("body"))
    new = j.select(F.col("id").alias("src"), F.explode("related").alias("dst")).where("src <> dst").distinct()
    new = new.join(items.select(F.col("id").alias("dst")), "dst", "left_semi").join(links, ["src", "dst"], "left_anti").select("src", "dst")
    return items.join(j, "id", "left").select("id", body.alias("body")), new


# Patterns of prompt injection, in order.
INJECTIONS = [
    r"(?i)ignore (all |previous |above )*instructions?",
    r"(?i)disregard (all |previous |above )*instructions?",
    r"(?i)forget (all |previous |above )*instructions?",
    r"(?i)system prompt",
    r"(?i)you are now",
    r"(?i)act as (if )?",
    r"(?i)pretend (you are|to be)",
    r"(?i)new instructions?:",
    r"(?i)override (safety|instructions?)",
    r"(?i)jailbreak",
    r"<\|.*?\|>",
    r"\[INST\]|\[/INST\]",
]


def sanitize_text(text: Column, most: int = 32_000) -> Column:
    """struct(text, modified): cut at ``most`` characters with a mark, injections replaced."""
    out = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [TRUNCATED]"))).otherwise(text)
    for p in INJECTIONS:
        out = F.regexp_replace(out, p, "[FILTERED]")
    return F.struct(out.alias("text"), (~out.eqNullSafe(text)).alias("modified"))


def validate_text(text: Column, most: int = 20_000) -> Column:
    """Why a text is rejected: blank or too long; null if it isn't."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank").when(F.length(text) > most, "too long")


def write_permission(rules: DataFrame, roles: DataFrame, grants: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """(id, allowed) of rules(id, owner, dataset): an editor's grant on the dataset, else an editor's role for own and an owner's for other rules.

    roles(user, role) and grants(dataset, user, role); the roles are viewer, editor, owner. An admin may change all rules.
    """
    rank = lambda c: F.when(F.lower(c) == "owner", 2).when(F.lower(c) == "editor", 1).otherwise(0)
    own = roles.where(F.col("user") == user).agg(F.coalesce(F.max(rank("role")), F.lit(0))).first()[0]
    mine = grants.where(F.col("user") == user).groupBy("dataset").agg(F.max(rank("role")).alias("granted"))
    need = F.when(F.col("owner").eqNullSafe(F.lit(user)), 1).otherwise(2)
    return rules.join(mine, "dataset", "left").select("id", (F.lit(admin) | (F.coalesce("granted", F.lit(0)) >= 1) | (F.lit(own) >= need)).alias("allowed"))


