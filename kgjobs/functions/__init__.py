"""Column functions on text, arrays, hashes and ages; all built-in expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"


def tokenize(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def matches_whole_tokens(phrase: Column, tokens: Column) -> Column:
    """Whether the phrase has tokens and all are among tokens."""
    p = tokenize(phrase)
    return (F.size(p) > 0) & (F.size(F.array_except(p, tokens)) == 0)


def extract_concepts(text: Column, limit: int | None = None) -> Column:
    """Lower-cased words of over three characters, stripped of . , ! ? quotes, distinct in order."""
    words = F.transform(F.split(text, " "), lambda w: F.lower(F.btrim(w, F.lit(".,!?\"'"))))
    found = F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))
    return F.slice(found, 1, limit) if limit else found


def slugify(text: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "import").otherwise(slug)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def normalize_memory(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def memory_id(user: Column, content: Column) -> Column:
    return F.concat(F.lit("memory-"), user, F.lit("-"), F.substring(F.sha2(F.trim(content), 256), 1, 16))


def recency_factor(created: Column, now: Column, half_life_days: float) -> Column:
    """2 ** (-age / half life), age in whole days and at least 0; 1 without a date or half-life."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.coalesce(F.pow(F.lit(2.0), -F.greatest(F.datediff(now, created), F.lit(0)) / F.lit(half_life_days)), F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def priority_rank(priority: Column) -> Column:
    """Low 0, Medium 1, High 2, Critical 3; anything else is Medium."""
    return F.when(priority == "Low", 0).when(priority == "High", 2).when(priority == "Critical", 3).otherwise(1)


# Extensions of code and of markup, and how a line of code begins.
CODE_EXTENSIONS = [
    ".cs", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rb", ".rs", ".cpp", ".cc", ".c",
    ".h", ".hpp", ".php", ".sql", ".sh", ".ps1", ".kt", ".swift", ".scala", ".r", ".m", ".lua",
]
MARKUP_EXTENSIONS = [".md", ".markdown", ".mdx"]
CODE_STARTS = ["import", "from", "def", "class", "function", "public", "private", "const", "var", "let", "func"]
#: A line that ends or begins like code; a word needs something behind it.
CODE_LINE = rf"[;{{}}]\s*$|^\s*#include|^\s*({'|'.join(CODE_STARTS)}) \s*\S"


def detect_style(text: Column, name: Column | None = None) -> Column:
    """prose, markdown, code or table: by the extension of the file's name if it says so, else by the lines.

    Lines that begin with | make a table if they are three and half of all that aren't blank; one of them, a line that
    begins with #, or a fence that closes make markdown. What begins or ends like code makes code where no extension
    speaks against it. A null text, or one of blanks, is prose, but for a name of code.
    """
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.[^.]*$", 0)) if name is not None else F.lit("")
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"\S"))
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    filled, table = F.size(lines), count(r"^\s*\|")
    marked = (count(r"^\s*#") > 0) | whole.rlike("(?s)```.*```") | (table > 0)
    code = (ext == "") & (count(CODE_LINE) >= F.greatest(F.lit(3), filled * 0.4))
    return (
        F.when(ext.isin(CODE_EXTENSIONS), "code").when(filled == 0, "prose").when((table >= 3) & (table * 2 >= filled), "table")
        .when(ext.isin(MARKUP_EXTENSIONS) | marked, "markdown").when(code, "code").otherwise("prose")
    )


def glob_regex(glob: str) -> str:
    """An anchored, case-insensitive Java regex: ** any run (with a following slash), * a run within a name, ? one character of it."""
    out, i, special = "(?i)^", 0, set(".^$+{}[]()|\\")
    glob = glob.replace("\\", "/")
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in special else "") + glob[i], i + 1
    return out + "$"


#: An entity: a name, or a decimal or hexadecimal number, up to its semicolon.
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def decode_entities(text: Column) -> Column:
    """Named entities of HTML 4, apos, and numeric ones as their characters; what is no entity stays as it is."""
    known = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, code)])

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, f"^{ENTITY}", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7))
        code = F.when(name.startswith("#"), number.cast("int")).otherwise(F.element_at(known, name))
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((name != "") & ok, F.concat(char, F.substr(part, F.length(name) + 3))).otherwise(part)

    parts = F.split(text, f"(?={ENTITY})")
    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags to blanks, entities decoded, white space of any kind collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")
    return F.btrim(F.regexp_replace(decode_entities(bare), r"(?U)\s+", " "))


def dataset_of(rule_id: Column) -> Column:
    """First two segments of git: and upload: ids, null if the second is empty."""
    parts = F.split(rule_id, ":")
    return F.when(parts[0].isin("git", "upload") & (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != ""), F.concat_ws(":", F.slice(parts, 1, 2)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in lower hex from two hashes over padded keys."""
    pad = key.ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(k ^ 0x36 for k in pad)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(k ^ 0x5C for k in pad)), inner), 256)
