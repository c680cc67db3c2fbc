"""Index snapshots: versioned Parquet folders, a manifest each, and a pointer to the current one.

A snapshot is written beside the old one and then pointed at, so readers see the one or the other.  Pointers are
numbered, and the highest one counts; a new one appears by the rename of a finished file to a name that was not there,
so at no time there is none.  Paths may be in any file system that Spark reaches.  One writer at a time holds the lock
file.
"""

from __future__ import annotations

import json
import os
import re
import socket
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintdex.operators.index import Index

FORMAT = 2
_NAMES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "ARRAY<INT>": T.ArrayType(T.IntegerType())}


def _schema(ddl: str) -> T.StructType:
    """Spark's own parser needs a session, which there may not be yet."""
    return T.StructType([T.StructField(name, _NAMES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


SCHEMAS = {
    "docs": _schema("doc_id BIGINT, path STRING, file_name STRING, extension STRING, size_bytes BIGINT, last_modified BIGINT, indexed_at BIGINT, token_count INT"),
    "postings": _schema("term STRING, doc_id BIGINT, positions ARRAY<INT>, freq INT"),
    "vocab": _schema("term STRING, df BIGINT, cf BIGINT, term_len INT"),
    "stats": _schema("n BIGINT, avgdl DOUBLE, tokens BIGINT"),
    "content": _schema("doc_id BIGINT, content STRING"),
}


class Missing(Exception):
    """There is no snapshot."""


class Corrupted(Exception):
    """The snapshot that the pointer names has no manifest, or none of this format; a failed read is an error of its own."""


class Locked(Exception):
    """Another process writes."""


class Store:
    """Snapshots under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _write(self, path: str, text: str) -> None:
        out = self._fs().create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _pointers(self) -> list[int]:
        """The numbers of all pointers, in order."""
        if not self._fs().exists(self._path(self.root)):
            return []
        names = (status.getPath().getName() for status in self._fs().listStatus(self._path(self.root)))
        return sorted(int(m[1]) for name in names if (m := re.fullmatch(r"CURRENT-(\d+)", name)))

    def exists(self) -> bool:
        return bool(self._pointers())

    def manifest(self) -> dict:
        numbers = self._pointers()
        if not numbers:
            raise Missing(self.root)
        name = self._read(f"{self.root}/CURRENT-{numbers[-1]}").strip()
        path = f"{self.root}/{name}/manifest.json"
        if not name or not self._fs().exists(self._path(path)):
            raise Corrupted(f"no manifest of {name}")
        try:
            found = json.loads(self._read(path))
        except ValueError as e:
            raise Corrupted(str(e)) from e
        if not isinstance(found, dict) or found.get("format") != FORMAT or set(found.get("tables", [])) - set(SCHEMAS):
            raise Corrupted(f"another format than {FORMAT}")
        return found | {"name": name}

    def is_corrupted(self) -> bool:
        """False if there is none; reads the manifest and every table's first footer.  Errors of the file system are raised."""
        try:
            found = self.manifest()
        except Missing:
            return False
        except Corrupted:
            return True
        for t in found["tables"]:
            path = f"{self.root}/{found['name']}/{t}"
            if not self._fs().exists(self._path(path)):
                return True
            try:
                self.spark.read.schema(SCHEMAS[t]).parquet(path).isEmpty()
            except Exception as e:
                if any(x in str(e) for x in ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FAILED_READ_FILE.PARQUET", "CORRUPT")):
                    return True
                raise
        return False

    def size(self) -> int:
        """Bytes on disk of the current snapshot."""
        return self._fs().getContentSummary(self._path(f"{self.root}/{self.manifest()['name']}")).getLength()

    def delete(self) -> None:
        self._fs().delete(self._path(self.root), True)

    def load(self) -> Index:
        """Lazy: nothing is read but the manifest."""
        found = self.manifest()
        tables = {t: self.spark.read.schema(SCHEMAS[t]).parquet(f"{self.root}/{found['name']}/{t}") for t in found["tables"]}
        totals = (found["n"], found["avgdl"]) if "n" in found else None
        return Index(tables["docs"], tables["postings"], tables["vocab"], tables["stats"], tables.get("content"), totals)

    def save(self, index: Index) -> Index:
        """Postings and vocabulary are sorted by term, so that a term's lookup reads few row groups.

        Vocabulary and statistics are worked out from the tables just written.
        """
        from glintdex.operators.index import stats_of, vocab_of

        name = f"v-{uuid.uuid4().hex}"
        base = f"{self.root}/{name}"

        def put(table: str, df: DataFrame) -> DataFrame:
            fit = df.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]))
            fit.write.option("compression", "zstd").parquet(f"{base}/{table}")
            return self.spark.read.schema(SCHEMAS[table]).parquet(f"{base}/{table}")

        docs = put("docs", index.docs)
        postings = put("postings", index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        put("vocab", vocab_of(postings).repartitionByRange("term").sortWithinPartitions("term"))
        totals = put("stats", stats_of(docs).coalesce(1)).first()
        tables = ["docs", "postings", "vocab", "stats"]
        if index.content is not None:
            put("content", index.content)
            tables.append("content")
        self._write(f"{base}/manifest.json", json.dumps({"format": FORMAT, "tables": tables, "n": totals["n"], "avgdl": totals["avgdl"]}))
        try:
            old = self.manifest()["name"]
        except (Missing, Corrupted):
            old = None
        number = (self._pointers() or [0])[-1] + 1
        self._write(f"{self.root}/next-{name}", name)
        if not self._fs().rename(self._path(f"{self.root}/next-{name}"), self._path(f"{self.root}/CURRENT-{number}")):
            raise Locked(f"another writer made snapshot {number}")
        self._retire(number, keep={old, name})
        return self.load()

    def _retire(self, number: int, keep: set[str | None]) -> None:
        """Deletes pointers before the last two, and snapshots but the two that readers may have open."""
        for n in self._pointers():
            if n < number - 1:
                self._fs().delete(self._path(f"{self.root}/CURRENT-{n}"), False)
        for status in self._fs().listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                self._fs().delete(status.getPath(), True)


@contextmanager
def lock(path: str):
    """A file that names its process; one left by a process that is gone is taken over."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for _ in range(2):
        try:
            with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(f"{os.getpid()}@{socket.gethostname()}")
            break
        except FileExistsError:
            with open(path) as f:
                pid, _, host = f.read().partition("@")
            if host == socket.gethostname() and not (pid.isdigit() and os.path.exists(f"/proc/{pid}")):
                os.unlink(path)
                continue
            raise Locked(f"{path}: {pid}@{host}") from None
    else:
        raise Locked(path)
    try:
        yield
    finally:
        os.unlink(path)
