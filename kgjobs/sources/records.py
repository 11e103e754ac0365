"""Records of large JSON arrays and CSV files, found inside Spark's own file splits.

Spark's text reader deals a file to tasks at any place, also inside a record. What a split means depends on how it is
entered: inside a string or quotes or not, and how deep. So each split first says, for either way to enter it, how it is
left. Folding these few words a split in file order gives each split's true entry; then every task cuts its splits into
whole records and the two pieces at their ends, and pieces of one record are joined by a small shuffle. Places are
counted over all files in the order of their names, so no two records have the same one.

A JSON file is read in fragments that end with }, a CSV file by lines; records that span splits may be of any length.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
EMPTY = re.compile(r"\{\s*\}")


class Json:
    """Objects that lie ``depth`` brackets deep; state is (inside a string, depth)."""

    fragments = {"lineSep": "}"}
    end = "}"

    def __init__(self, depth: int = 1):
        self.depth = depth

    def through(self, text: str, state: tuple[bool, int]) -> Iterator[tuple[int, int, bool]]:
        """(place behind a bracket, depth behind it, whether it opens); the state at the end is left in ``state``."""
        inside, depth, at = *state, 0
        if inside:
            m = STRING_END.match(text)
            if not m:
                self.state = state
                return
            at, inside = m.end(), False
        for m in TOKEN.finditer(text, at):
            c = m[0]
            if c[0] == '"':
                if len(c) == 1:  # a string that doesn't end here
                    inside = True
                    break
                continue
            depth += 1 if c in "{[" else -1
            yield m.end(), depth, c == "{", c in "{["
        self.state = (inside, depth)

    def cut(self, text: str, state: tuple[bool, int], open_: bool) -> Iterator[tuple[int, bool]]:
        """Places where a record begins (True) or ends (False)."""
        for at, depth, brace, opens in self.through(text, state):
            if opens and brace and depth == self.depth + 1:
                open_ = True
                yield at - 1, True
            elif not opens and depth == self.depth and open_:
                open_ = False
                yield at, False

    def keep(self, record: str) -> bool:
        return not EMPTY.fullmatch(record)


class Csv:
    """Lines, of which those between quotes belong together; state is (inside quotes, 0)."""

    fragments: dict[str, str] = {}
    end = "\n"

    def through(self, text: str, state: tuple[bool, int]) -> Iterator[tuple]:
        self.state = (state[0] ^ (text.count('"') % 2 == 1), 0)
        return iter(())

    def cut(self, text: str, state: tuple[bool, int], open_: bool) -> Iterator[tuple[int, bool]]:
        self.through(text, state)
        if not state[0]:
            yield 0, True
        if not self.state[0]:
            yield len(text), False

    def keep(self, record: str) -> bool:
        return bool(record.strip())


def _read(spark: SparkSession, path: str, kind) -> DataFrame:
    text = spark.read.options(**kind.fragments).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, block), fragment) row by row; a split's rows come one after the other."""
    for b in batches:
        yield from zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True), b.column("value").to_pylist(), strict=True)


def _exits(kind):
    """Per split how it is left, entered outside (a) and inside (b) of quotes at depth 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []

        def row():
            (file, block), ((a, da), (b, db)) = now, states
            return pa.RecordBatch.from_pylist([{"file": file, "block": block, "a": a, "da": da, "b": b, "db": db}])

        for split, text in _splits(batches):
            if split != now:
                if now:
                    yield row()
                now, states = split, [(False, 0), (True, 0)]
            for k in range(2):
                for _ in kind.through(text + kind.end, states[k]):
                    pass
                states[k] = kind.state
        if now:
            yield row()

    return run


def _pieces(kind, entries: dict[tuple[str, int], tuple[bool, int]]):
    """(file, block, ord, text, begins, ends): whole records, and pieces of those that split boundaries cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush():
            nonlocal rows, size
            out = pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("ord", pa.int32()), ("text", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_())]))
            rows, size = [], 0
            return out

        now, held = None, []

        def put(ends: bool):
            nonlocal n, size
            text = "".join(held).removesuffix("\n") if ends else "".join(held)
            if not (begins and ends) or kind.keep(text):
                rows.append({"file": now[0], "block": now[1], "ord": n if begins else -1, "text": text, "begins": begins, "ends": ends})
                n += begins
                size += len(text)
            held.clear()

        open_ = begins = False
        n = 0
        for split, text in _splits(batches):
            if split != now:
                if now and open_:
                    put(False)
                now, n, state, begins = split, 0, entries[split], False
                open_ = bool(state[0]) or state[1] > getattr(kind, "depth", 0)
            text, at = text + kind.end, 0
            for place, opens in kind.cut(text, state, open_):
                if opens:
                    open_ = begins = True
                    at = place
                else:
                    held.append(text[at:place])
                    put(True)
                    open_ = False
            if open_:
                held.append(text[at:])
            state = kind.state
            if size > 4 << 20:
                yield flush()
        if now and open_:
            put(False)
        yield flush()

    return run


def records(spark: SparkSession, path: str, kind) -> DataFrame:
    """(file, n, place, text) of a path's records: n counts them in their file, place over all files, both from 0."""
    read = _read(spark, path, kind)
    left = read.mapInArrow(_exits(kind), "file string, block long, a boolean, da long, b boolean, db long").collect()  # a row a split, like the splits that the driver plans
    entries: dict[tuple[str, int], tuple[bool, int]] = {}
    file, state = None, (False, 0)
    for r in sorted(left, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, state = r["file"], (False, 0)
        entries[r["file"], r["block"]] = state
        state = (r["b"], state[1] + r["db"]) if state[0] else (r["a"], state[1] + r["da"])
    base = scratch(spark, "records")
    read.mapInArrow(_pieces(kind, entries), "file string, block long, ord int, text string, begins boolean, ends boolean").write.parquet(base)
    pieces = spark.read.parquet(base)
    # again a row a split: how many records begin in it, and whether one goes on behind it or has come into it
    sizes = pieces.groupBy("file", "block").agg(F.count_if("begins").alias("n"), F.max(F.col("begins") & ~F.col("ends")).alias("opens"), F.max(~F.col("begins")).alias("goes_on"), F.max(~F.col("begins") & F.col("ends")).alias("closes")).collect()
    at, rows, file, place, n, owner = {}, [], None, 0, 0, None
    for r in sorted(sizes, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, n, owner = r["file"], 0, None
        rows.append((r["file"], r["block"], n, place, owner if r["goes_on"] else None))
        owner = None if r["closes"] else owner
        owner = (n + r["n"] - 1, place + r["n"] - 1) if r["opens"] else owner
        n, place = n + r["n"], place + r["n"]
    known = spark.createDataFrame([(a, b, c, d, *(e or (None, None))) for a, b, c, d, e in rows], "file string, block long, first_n long, first_place long, owner_n long, owner_place long")
    own = F.col("begins")
    placed = pieces.join(F.broadcast(known), ["file", "block"]).select("file", "block", F.when(own, F.col("first_n") + F.col("ord")).otherwise(F.col("owner_n")).alias("n"), F.when(own, F.col("first_place") + F.col("ord")).otherwise(F.col("owner_place")).alias("place"), "text", "begins", "ends")
    placed = placed.where("n is not null")  # what goes on from no record: the inside of elements that are no objects
    whole = placed.where("begins and ends").select("file", "n", "place", "text")
    parts = placed.where("not (begins and ends)").groupBy("file", "n", "place").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    return whole.unionByName(parts.select("file", "n", "place", F.array_join("x.text", "").alias("text")))


def json_records(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, n, place, text) of the objects in a JSON array, or ``depth`` brackets deep in what else the files hold."""
    return records(spark, path, Json(depth))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, place, fields map<string,string>) of CSV rows behind each file's header; short rows get nulls."""
    rows = records(spark, path, Csv())
    headers = {r["file"]: next(csv.reader([r["text"]])) for r in rows.where("n = 0").select("file", "text").collect()}  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("file", pa.string()), ("n", pa.int64()), ("place", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            out = []
            for r in b.to_pylist():
                values = next(csv.reader(r["text"].splitlines(keepends=True)), [])
                r["fields"] = [(k, values[i] if i < len(values) else None) for i, k in enumerate(headers[r["file"]])]
                out.append({k: r[k] for k in kind.names})
            yield pa.RecordBatch.from_pylist(out, kind)

    order = {f: k for k, f in enumerate(sorted(headers))}
    # a file's header is no record: one less for each file so far
    before = F.element_at(F.create_map(*[F.lit(x) for f, k in order.items() for x in (f, k + 1)]), F.col("file")) if order else F.lit(0)
    body = rows.where("n > 0").select("file", (F.col("n") - 1).alias("n"), (F.col("place") - before).alias("place"), "text")
    return body.mapInArrow(run, "file string, n long, place long, fields map<string,string>")
