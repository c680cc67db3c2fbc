"""Folders of text files as a Python data source, ``docfs``: a batch listing and a stream of changes.

Spark's own file sources leave out names that begin with a dot or an underscore and can't skip folders, hence this.
A listing has no contents; these are read in parallel, file by file, for the rows that need them.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import BinaryType, StructField, StructType

from glintdex.functions import text as T
from glintdex.functions.text import EXTENSIONS, IGNORED

LISTING = "path string, file_name string, size_bytes long, last_modified long, supported boolean, error string"
EVENTS = "op string, " + LISTING


def suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


def walk(root: str, ignored: tuple[str, ...]) -> Iterator[tuple]:
    """Files under ``root`` in folders that are neither ignored nor hidden; links are not followed."""
    root = os.path.abspath(root)

    def closed(name: str) -> bool:
        return name in ignored or name.startswith(".")

    if closed(os.path.basename(root)):
        return
    errors: list[tuple] = []
    for folder, inner, names in os.walk(root, onerror=lambda e: errors.append((e.filename, None, None, None, False, str(e)))):
        inner[:] = sorted(d for d in inner if not closed(d) and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                s = os.lstat(path)
                yield path, name, s.st_size, s.st_mtime_ns // 1_000_000, suffix(name) in EXTENSIONS, None
            except OSError as e:
                yield path, name, None, None, False, str(e)
    yield from errors


class _Batch(DataSourceReader):
    """A partition for the files of the root and one for each folder in it."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        self.ignored = tuple(json.loads(options.get("ignored", json.dumps(IGNORED))))

    def partitions(self) -> list[InputPartition]:
        closed = os.path.basename(self.root) in self.ignored or os.path.basename(self.root).startswith(".")
        if closed or not os.path.isdir(self.root):
            return [InputPartition(None)]
        return [InputPartition(""), *(InputPartition(d.name) for d in sorted(os.scandir(self.root), key=lambda d: d.name) if d.is_dir(follow_symlinks=False))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        if partition.value:
            yield from walk(os.path.join(self.root, partition.value), self.ignored)
            return
        for path, *rest in walk(self.root, self.ignored):
            if os.path.dirname(path) != self.root:
                break
            yield path, *rest


class _Changes(SimpleDataSourceStreamReader):
    """Each batch compares a new listing with the last one, so nothing is missed and folders may come and go."""

    def __init__(self, options: dict):
        self.roots = [os.path.abspath(os.path.expanduser(p)) for p in json.loads(options.get("paths", "null")) or [options["path"]]]
        self.ignored = tuple(json.loads(options.get("ignored", json.dumps(IGNORED))))

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def _now(self) -> dict[str, tuple]:
        return {r[0]: r for root in self.roots if os.path.isdir(root) for r in walk(root, self.ignored) if r[4]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = json.loads(start["seen"]), self._now()
        rows = [("create" if p not in before else "modify", *r) for p, r in now.items() if before.get(p) != r[3]]
        rows += [("delete", p, os.path.basename(p), None, None, True, None) for p in before if p not in now]
        return iter(rows), {"seen": json.dumps({p: r[3] for p, r in sorted(now.items())})}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after, now = json.loads(start["seen"]), json.loads(end["seen"]), self._now()
        for p, t in after.items():
            if before.get(p) != t:
                yield ("create" if p not in before else "modify", *now[p]) if p in now else ("delete", p, os.path.basename(p), None, None, True, None)
        for p in before:
            if p not in after:
                yield "delete", p, os.path.basename(p), None, None, True, None


class DocFs(DataSource):
    """Options: path (or paths, a JSON list, for the stream), ignored (a JSON list of folder names)."""

    @classmethod
    def name(cls) -> str:
        return "docfs"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


class DocFsChanges(DocFs):
    """The stream, whose rows also say what happened."""

    @classmethod
    def name(cls) -> str:
        return "docfs_changes"

    def schema(self) -> str:
        return EVENTS


def register(spark: SparkSession) -> None:
    """Spark plans Python sources in processes that may lack this package, so their classes travel by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(DocFs)
    spark.dataSource.register(DocFsChanges)


def listing(spark: SparkSession, path: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    register(spark)
    return spark.read.format("docfs").option("path", path).option("ignored", json.dumps(ignored)).load()


def read_bytes(files: DataFrame) -> DataFrame:
    """``files`` with ``bytes``, null where a file can't be read."""
    names = files.columns
    at = names.index("path")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                try:
                    with open(one.column(at)[0].as_py(), "rb") as f:
                        found = f.read()
                except OSError:
                    found = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([found], pa.binary())], [*names, "bytes"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("bytes", BinaryType())]))


def pdf_text(data: bytes | None) -> str | None:
    """The text layer, by pypdf where that is installed; encrypted files have none; None if it can't be read."""
    try:
        import io

        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(data))
        return "" if reader.is_encrypted else "\n".join(p.extract_text() for p in reader.pages)
    except Exception:
        return None


def corpus(files: DataFrame, max_text: int, max_pdf: int) -> DataFrame:
    """Listed files as the index wants them.  Large files are not opened."""
    from glintdex.operators.index import is_large

    @F.pandas_udf("string")
    def of_pdf(data: pd.Series) -> pd.Series:
        return data.map(pdf_text)

    own = files.where("supported").withColumn("extension", T.extension(F.col("file_name")))
    own = own.withColumn("big", is_large(F.col("extension"), F.col("size_bytes"), max_text, max_pdf))
    keep = ["path", "file_name", "extension", "size_bytes", "last_modified"]
    opened = read_bytes(own.where("not big").select(*keep).repartition("path"))
    plain = opened.where("extension != '.pdf'").select(*keep, T.decode_text(F.col("bytes")).alias("content"))
    pdf = opened.where("extension = '.pdf'").select(*keep, of_pdf("bytes").alias("content"))
    return plain.union(pdf).union(own.where("big").select(*keep, F.lit(None).cast("string").alias("content")))
