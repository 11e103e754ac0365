"""Code in texts against declared checks: pairs, findings, reuse, reports and fixtures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other names of languages.
ALIASES = {"py": "python", "python3": "python", "cs": "csharp", "c#": "csharp", "js": "javascript", "node": "javascript", "ts": "typescript", "sh": "bash", "shell": "bash", "zsh": "bash"}

# The bundled checks as (rule, pattern, message, severity, one finding a line).
_SQL = "(?:SELECT|INSERT|UPDATE|DELETE)"
CHECKS = [
    ("coding-no-bare-except", r"except\b[^:\n]*:\s*(#[^\n]*)?\n\s*pass\b", "Silently swallowed exception (except ...: pass) — handle or log it", "error", True),
    ("coding-no-bare-except", r"except\s*:", "Bare except catches everything, incl. SystemExit/KeyboardInterrupt", "warning", True),
    ("coding-no-blocking-async", r"\.GetAwaiter\(\)\.GetResult\(\)", "Blocking .GetAwaiter().GetResult() on async code", "warning", False),
    ("coding-no-blocking-async", r"\.Result\b", "Blocking .Result on a Task", "warning", False),
    ("coding-no-blocking-async", r"\.Wait\(\)", "Blocking .Wait() on a Task", "warning", False),
    ("coding-no-leftover-debug", r"\bconsole\.(?:log|debug|info)\s*\(", "Leftover console.log/debug/info — use a real logger or remove it", "warning", False),
    ("coding-no-leftover-debug", r"\bdebugger\b", "Leftover debugger statement — remove before committing", "warning", False),
    ("security-no-eval-exec", r"(?<![\w.])eval\s*\(", "eval() executes arbitrary code — a code-injection / RCE risk", "error", False),
    ("security-no-eval-exec", r"(?<![\w.])exec\s*\(", "exec() executes arbitrary code — a code-injection / RCE risk", "error", False),
    ("security-no-sql-string-concat", r"(?i)[\"'][^\n]*?\b" + _SQL + r"\b[^\n]*?[\"']\s*\+", "SQL query built by string concatenation — a SQL-injection risk", "warning", True),
    ("security-no-sql-string-concat", r"(?i)(?:f|\$)[\"'][^\n]*?\b" + _SQL + r"\b[^\n]*?\{", "SQL query built by string interpolation — a SQL-injection risk", "warning", True),
    ("security-no-sql-string-concat", r"(?i)`[^\n]*?\b" + _SQL + r"\b[^\n]*?\$\{", "SQL query built by template-literal interpolation — a SQL-injection risk", "warning", True),
    ("security-no-sql-string-concat", r"(?i)[\"'][^\n]*?\b" + _SQL + r"\b[^\n]*?[\"']\s*\.\s*format\s*\(", "SQL query built by .format() — a SQL-injection risk", "warning", True),
]
# What to do instead, by rule.
SUGGESTIONS = {
    "coding-no-bare-except": "Catch a specific exception type and handle it (log, re-raise, or recover).",
    "coding-no-blocking-async": "await the call instead — blocking on async code can deadlock and starves the thread pool.",
    "coding-no-leftover-debug": "Remove debug output or route it through the project's logging library.",
    "security-no-eval-exec": "Parse the input explicitly (e.g. ast.literal_eval / JSON.parse) instead of executing it.",
    "security-no-sql-string-concat": "Use parameterized queries / bound parameters instead of building SQL from strings.",
}
APPLIES = {
    "coding-no-bare-except": ["python"],
    "coding-no-blocking-async": ["csharp"],
    "coding-no-leftover-debug": ["javascript", "typescript"],
    "security-no-eval-exec": ["python", "javascript", "typescript"],
    "security-no-sql-string-concat": ["python", "csharp", "javascript", "typescript"],
}


def canonical(language: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)


def extract_code_blocks(docs: DataFrame) -> DataFrame:
    """(id, n, lang, code) of the fenced blocks of docs(id, text), in order."""
    pattern = F.lit(r"```([a-zA-Z0-9_+-]*)[ \t]*\r?\n([\s\S]*?)```")
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("lang"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("code"))
    return docs.select("id", F.posexplode(both).alias("n", "x")).select("id", "n", F.lower("x.lang").alias("lang"), F.col("x.code").alias("code"))


def rule_block_pairs(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rule, id, n): enabled rules(rule, applies_to, enabled) and blocks(id, n, lang) they apply to; no language on either side matches all.

    Languages meet in an equi-join; only rules without a language and blocks without one meet all of the other side.
    """
    r = rules.where("enabled").select("rule", F.coalesce("applies_to", F.array().cast("array<string>")).alias("applies_to"))
    named = r.select("rule", F.explode("applies_to").alias("lang")).select("rule", canonical(F.col("lang")).alias("lang")).distinct()
    b = blocks.select("id", "n", canonical(F.col("lang")).alias("lang"))
    langs = b.where("lang <> ''").select("lang").distinct()
    # a rule without a language is one of each language that occurs, a block without one is open to each rule
    every = r.where("size(applies_to) = 0").select("rule", F.lit(True).alias("_all")).join(langs.withColumn("_all", F.lit(True)), "_all").select("rule", "lang")
    open_ = r.select("rule", F.lit("").alias("lang"))
    return b.join(named.unionByName(every).unionByName(open_), "lang").select("rule", "id", "n").distinct()


FOUND = "rule string, id string, n int, message string, severity string, line int, suggestion string"


def check_code_blocks(pairs: DataFrame) -> DataFrame:
    """(rule, id, n, message, severity, line, suggestion) for pairs(rule, id, n, code): each finding of the rule's patterns, a block a task step."""
    kinds = pa.schema([("rule", pa.string()), ("id", pa.string()), ("n", pa.int32()), ("message", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("suggestion", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, re.compile(p), message, severity, once) for rule, p, message, severity, once in CHECKS]
        for b in batches:
            out = []
            for rule, key, n, code in zip(*(b.column(c).to_pylist() for c in ("rule", "id", "n", "code")), strict=True):
                seen: set[int] = set()
                for name, pattern, message, severity, once in compiled:
                    if name != rule:
                        continue
                    for m in pattern.finditer(code or ""):
                        line = code.count("\n", 0, m.start()) + 1
                        if once and line in seen:
                            continue
                        seen.add(line)
                        out.append({"rule": rule, "id": key, "n": n, "message": message, "severity": severity, "line": line, "suggestion": SUGGESTIONS[rule]})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return pairs.select("rule", F.col("id").cast("string").alias("id"), F.col("n").cast("int").alias("n"), "code").mapInArrow(run, FOUND)


def result_key(*fields: Column) -> Column:
    """Upper-case SHA-256 of fields joined by NUL."""
    return F.upper(F.sha2(F.concat_ws("\0", *[F.coalesce(f, F.lit("")) for f in fields]), 256))


def reuse_results(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """work(key, ...) with the cached verdict of cache(key, passed), and what is left to do."""
    return work.join(cache.select("key", "passed"), "key"), work.join(cache, "key", "left_anti")


def violation_report(found: DataFrame) -> DataFrame:
    """found with rank, its place by severity (error, warning, info, other), then rule, id, n and line."""
    kind = F.lower(F.trim("severity"))
    order = F.when(kind == "error", 0).when(kind == "warning", 1).when(kind == "info", 2).otherwise(3)
    return found.withColumn("rank", order).orderBy("rank", "rule", "id", "n", "line")


# The report's lines.
REPORT_HEAD = "⚠️ **Code Review Required — Knowledge Base Violations**"
REPORT_INTRO = "The following issues were detected in your last response:"
REPORT_END = "Please revise your response to address these violations — fix errors first."


def violation_text(report: DataFrame) -> DataFrame:
    """(id, errors, warnings, infos, others, text) of report(rank, rule, id, n, severity, line, message, suggestion): what is found in a text, as Markdown.

    Errors come first, then by rule, n, line and message. A finding without a line or suggestion has none in the text; a
    text's findings meet in one row, as they do in the answer that the report is for.
    """
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise("")
    advice = F.when(F.trim(F.coalesce("suggestion", F.lit(""))) != "", F.concat(F.lit("- 💡 Suggestion: "), "suggestion", F.lit("\n"))).otherwise("")
    entry = F.concat(F.lit("**Rule: "), "rule", F.lit("** ["), F.upper("severity"), F.lit("]"), line, F.lit("\n- "), "message", F.lit("\n"), advice, F.lit("\n"))
    count = lambda k: F.count_if(F.col("rank") == k)
    all_ = F.array_sort(F.collect_list(F.struct("rank", "rule", "n", F.col("line").alias("at"), "message", entry.alias("entry"))))
    r = report.groupBy("id").agg(*[count(k).alias(c) for k, c in enumerate(("errors", "warnings", "infos", "others"))], all_.alias("all"))
    other = F.when(F.col("others") > 0, F.format_string(", %d other", "others")).otherwise("")
    summary = F.concat(F.format_string("**%d violation(s)** — %d error, %d warning, %d info", F.size("all"), "errors", "warnings", "infos"), other, F.lit("."))
    text = F.concat(F.lit(f"{REPORT_HEAD}\n\n"), summary, F.lit(f"\n\n{REPORT_INTRO}\n\n"), F.array_join(F.col("all.entry"), ""), F.lit(f"{REPORT_END}\n"))
    return r.select("id", "errors", "warnings", "infos", "others", text.alias("text"))


def verify_fixtures(fixtures: DataFrame) -> DataFrame:
    """(rule, verified) of fixtures(rule, kind, code): snippets of kind pass give no finding, those of kind fail at least one."""
    keyed = fixtures.withColumn("id", F.sha2(F.concat_ws("\0", "kind", "code"), 256)).withColumn("n", F.lit(0)).distinct()
    bad = check_code_blocks(keyed).select("rule", "id", F.lit(True).alias("found")).distinct()
    ok = F.coalesce("found", F.lit(False)) == (F.col("kind") == "fail")
    return keyed.join(bad, ["rule", "id"], "left").groupBy("rule").agg(F.bool_and(ok).alias("verified"))
