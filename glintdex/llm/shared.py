"""What the training-data operators have in common: scratch tables, tables by name, column names, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="glintdex-")
        spark.sparkContext.setCheckpointDir(base)
    # A path without a scheme is the default file system's.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


_KEPT: dict[tuple, object] = {}


def kept_by_worker(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: the last large object asked for, and no other."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class Scratch:
    """Written tables that cut lineage: they are in the shared folder, so a lost executor loses none of them.

    ``keep`` writes a DataFrame and reads it again; ``drop`` deletes what no later plan reads; the rest goes when the
    driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/glintdex/{uuid.uuid4().hex}", {}

    def path(self, name: str) -> str:
        """A new path in the shared folder, deleted when the driver's JVM ends."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        self._fs(path).deleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        return path

    def _fs(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                self._fs(path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def slices(batch: pa.RecordBatch, text: int, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows whose texts, in column ``text``, have about ``size`` bytes; a longer text is a part."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have in any spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def narrow(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the columns named by ``kinds``, cast to those types; whatever else ``df`` has can't clash."""
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, told without counting further than that."""
    return df.limit(rows + 1).count() <= rows
