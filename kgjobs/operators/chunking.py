"""Documents to chunks: blocks of code, table and text, cut at the widest separator that fits."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect_style

# Separators by style, widest first.
PROSE = ["\n\n", "\n", ". ", " ", ""]
MARKDOWN = ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ", ""]
CODE = ["\nclass ", "\ndef ", "\nfunc ", "\nfunction ", "\npublic ", "\nprivate ", "\n\n", "\n", " ", ""]

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def chunk_documents(docs: DataFrame, most: int = 1200, overlap: int = 150, style: str | None = None) -> DataFrame:
    """docs(id, text, and where it has one name) to (id, ordinal, style, chunk); lengths in code points, a null text is one empty chunk.

    ``style`` holds for all documents; without it the file's name and the lines say what a document is.
    Rows never leave their partition: one Arrow pass, a document at a time.
    """
    lap = max(0, min(overlap, most // 2 - 1))
    text = F.coalesce("text", F.lit(""))
    styled = docs.select("id", text.alias("text"), (F.lit(style) if style else detect_style(text, F.col("name") if "name" in docs.columns else None)).alias("style"))
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (body, how) in enumerate(zip(b.column("text").to_pylist(), b.column("style").to_pylist(), strict=True)):
                found = chunks_of(body, how, most, lap)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array([i] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), pa.array([how] * len(found), pa.string()), pa.array(found, pa.string())], names=["id", "ordinal", "style", "chunk"])

    return styled.mapInArrow(cut, f"id {kind}, ordinal int, style string, chunk string")


def chunks_of(text: str, style: str, most: int, overlap: int) -> list[str]:
    if len(text) <= most or not text.strip():
        return [text]
    ladder, out = MARKDOWN if style == "markdown" else PROSE, []
    small = lambda block: len(block[1]) <= most
    for fits, group in itertools.groupby(blocks_of(text, style), small):
        if fits:  # whole blocks, packed without overlap
            out += packed((body for _, body in group), most, 0)
        for kind, body in () if fits else group:
            out += table_parts(body, most) if kind == "table" else packed(units_of(body, most, CODE if kind == "code" else ladder), most, overlap)
    return [c for c in out if c.strip()] or [text]


def blocks_of(text: str, style: str) -> list[tuple[str, str]]:
    """(kind, text) of fenced code, runs of table lines and the rest, in order; code as a whole is one block."""
    if style == "code":
        return [("code", text)]
    labelled, inside, fences = [], False, 0
    for line in LINE.findall(text):
        head = line.lstrip()
        fence = head.startswith("```")
        fences += fence and not inside
        label = ("code", fences) if inside or fence else ("table" if head.startswith("|") else "text", 0)
        inside ^= fence
        labelled.append((label, line))
    return [(label[0], "".join(x for _, x in run)) for label, run in itertools.groupby(labelled, lambda x: x[0])]


def units_of(text: str, most: int, ladder: list[str]) -> Iterator[str]:
    """Parts no longer than most, each cut behind the first separator of the ladder that makes it short enough."""
    if len(text) <= most:
        yield text
    elif ladder:
        pattern = f"(?s).*?{re.escape(ladder[0])}|.+" if ladder[0] else "(?s)."
        for part in re.findall(pattern, text):
            yield from units_of(part, most, ladder[1:])
    else:
        yield from (text[i : i + most] for i in range(0, len(text), most))


def packed(units: Iterable[str], most: int, overlap: int) -> Iterator[str]:
    """Units joined as long as they fit; the next piece starts with the last one's tail if there is room for it."""
    held = ""
    for unit in units:
        if held and len(held) + len(unit) > most:
            yield held
            tail = held[-overlap:] if overlap else ""
            held = tail if len(tail) + len(unit) <= most else ""
        held += unit
    if held:
        yield held


def table_parts(text: str, most: int) -> Iterator[str]:
    """Rows in pieces that repeat the header (two lines where the second is a rule)."""
    lines = LINE.findall(text)
    n = 2 if len(lines) > 1 and re.fullmatch(r"[|: -]*-[|: -]*", lines[1].strip()) else 1
    head, rows = "".join(lines[:n]), lines[n:]
    if not rows:
        yield text
    room = max(1, most - len(head))
    yield from (head + body for body in packed(rows, room, 0))
