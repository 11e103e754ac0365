"""A sink of rule files: one Markdown file a row, a folder a domain, all there or none.

    spark.dataSource.register(RuleFiles)
    df.write.format("rule_files").mode("overwrite").save(path)      # df(domain, file, text)

With option("between", "\\n") rows of one file that follow each other in a task are parts of it, in their order, with that
text between them, so a file of any length is written row by row; all its rows must be in one task and in a row.

Tasks write below a folder of the job beside the target; the commit renames it to the target, an abort removes it. So
readers never see half an export, and what a failed or repeated task wrote is gone or the same. The file system is that of
the path's URI; it must be able to rename a folder.
"""

from __future__ import annotations

import itertools
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import scratch

COLUMNS = ("domain", "file", "text")
#: Bytes of texts that a task holds, and files that it reads.
TEXTS, FILES = 16 << 20, 20_000


@dataclass
class Written(WriterCommitMessage):
    files: int


class RuleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rule_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"rule_files lacks {', '.join(missing)}")
        return RuleWriter(self.options["path"], overwrite, self.options.get("between"))


class RuleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, between: str | None = None):
        self.path, self.overwrite, self.between = path.rstrip("/"), overwrite, between
        self.staging = f"{self.path}.{uuid.uuid4().hex}"

    def _at(self, uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, base = self._at(self.staging)
        made, closed, current, out, n = set(), set(), None, None, 0
        try:
            for row in iterator:
                domain, file, text = (row[c] for c in COLUMNS)
                if self.between is not None and (domain, file) == current:
                    out.write((self.between + (text or "")).encode())
                    continue
                if not domain or not file or "/" in domain or domain in (".", ".."):
                    raise ValueError(f"no file can be named after domain {domain!r} and file {file!r}")
                if domain not in made:
                    store.create_dir(f"{base}/{domain}", recursive=True)
                    made.add(domain)
                if out is not None:
                    out.close()
                if self.between is not None:
                    closed.add(current)
                    if (domain, file) in closed:
                        raise ValueError(f"the rows of {file!r} are not in a row")
                out, current, n = store.open_output_stream(f"{base}/{domain}/{file}"), (domain, file), n + 1
                out.write((text or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = self._at(self.staging)
        target = self._at(self.path)[1]
        store.create_dir(base, recursive=True)  # there may have been no row
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(base)
                raise FileExistsError(f"{self.path} exists; write with mode overwrite to replace it")
            store.delete_dir(target)
        store.move(base, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = self._at(self.staging)
        for _ in range(10):  # tasks that still ran when another failed may make the folder anew
            if store.get_file_info(base).type != fs.FileType.NotFound:
                store.delete_dir(base)
            time.sleep(0.2)


def _entries(store, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, but for what Spark's readers take for hidden."""
    from pyarrow import fs

    shown = lambda name: not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:  # one after the other, however many there are
            yield from ((x.path, x.is_dir()) for x in found if shown(x.name))
    else:
        yield from ((x.path, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(folder)) if shown(x.base_name))


def file_texts(spark: SparkSession, folder: str, ending: str = "") -> DataFrame:
    """(path, text) of all files below a folder whose names end so, each a row; as with Spark's reader an empty file is none.

    Folders are listed by tasks, a level at a time, and their names lie in written tables, so the driver holds none. Where
    only Spark can open the store, or it is no folder but a pattern, Spark's reader is used, which lists on the driver.
    """
    from pyarrow import fs

    try:
        store, top = fs.FileSystem.from_uri(folder)
        known = store.get_file_info(top).type == fs.FileType.Directory
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        known = False
    if not known:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
        return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    before = folder[: -len(top)] if folder.endswith(top) and "://" in folder else "file://"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for at in b.column("path").to_pylist():
                found = _entries(store, at)
                while part := list(itertools.islice(found, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.bool_())], names=["path", "folder"])

    base, level, n, todo = scratch(spark, "listed"), 0, 1, spark.createDataFrame([(top,)], "path string")
    while n:
        todo.repartition(min(n, 1000)).mapInArrow(listed, "path string, folder boolean").write.parquet(f"{base}/{level}")
        todo = spark.read.parquet(f"{base}/{level}").where("folder").select("path")
        n, level = todo.count(), level + 1
    files = spark.read.parquet(*[f"{base}/{k}" for k in range(level)]).where(~F.col("folder") & F.col("path").endswith(ending)).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            names, texts, held = [], [], 0
            for at in b.column("path").to_pylist():
                with store.open_input_stream(at) as f:
                    text = f.read().decode(errors="replace")
                if text:
                    names.append(before + at)
                    texts.append(text)
                held += len(text)
                if held >= TEXTS:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
                    names, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    parts = max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES))
    return files.repartition(parts).mapInArrow(read, "path string, text string")
