"""The engine: one home folder with configuration, history and index; the commands of the command line as methods."""

from __future__ import annotations

import os
from contextlib import ExitStack
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintdex import ship
from glintdex.functions import text as T
from glintdex.operators import index as I
from glintdex.operators import search as S
from glintdex.operators import statistics
from glintdex.plans.spec import Filters, QuerySpec, parse_since, parse_size
from glintdex.sources import docfs, settings
from glintdex.sources.storage import Corrupted, Missing, Store, lock
from glintdex.streaming import watch as W


@dataclass(frozen=True)
class ScanResult:
    """What a scan did.  ``indexed`` includes the updated; ``new`` doesn't."""

    indexed: int
    updated: int
    removed: int
    skipped: int
    metadata_only: int
    errors: int
    directories: int = 0

    @property
    def new(self) -> int:
        return self.indexed - self.updated

    @property
    def total_processed(self) -> int:
        return self.indexed + self.skipped + self.metadata_only


class Watch:
    """A running stream that holds the lock until it has ended."""

    def __init__(self, query: StreamingQuery, held: ExitStack):
        self.query, self._held = query, held

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        try:
            return self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        finally:
            if not self.query.isActive:
                self._held.close()

    def stop(self) -> None:
        try:
            self.query.stop()
        finally:
            self._held.close()


class Engine:
    """``root``: the index's folder, on storage that driver and executors share; by default in ``home``, which only
    serves where they are one machine."""

    def __init__(self, spark: SparkSession, home: str, root: str | None = None):
        self.spark, self.home = spark, settings.expand(home)
        ship(spark)
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster the index needs a shared folder, as root")
        self.store = Store(spark, root or f"file://{self.home}/index")
        self._lock = os.path.join(self.home, "index.lock")

    @property
    def config(self) -> settings.Config:
        return settings.load(self.home)

    def index(self) -> I.Index:
        """The current index; a corrupt one is deleted, and there is none then."""
        try:
            return self.store.load()
        except Corrupted:
            self.store.delete()
            raise Missing(self.store.root) from None

    def _index_or_empty(self) -> I.Index:
        try:
            return self.index()
        except Missing:
            kinds = "doc_id long, path string, file_name string, extension string, size_bytes long, last_modified long, content string"
            return I.build(self.spark.createDataFrame([], kinds))

    def count_indexable(self, path: str) -> int:
        return docfs.listing(self.spark, settings.expand(path), tuple(self.config.ignored)).where("supported").count()

    def add(self, path: str) -> ScanResult:
        """Scans a folder: what is new or changed is indexed, what is gone leaves, the rest stays as it is."""
        root = settings.expand(path)
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        with lock(self._lock):
            config = self.config
            config.add(root)
            settings.save(self.home, config)
            return self._scan(root, config)

    def _scan(self, root: str, config: settings.Config) -> ScanResult:
        index = self._index_or_empty()
        listed = docfs.listing(self.spark, root, tuple(config.ignored)).persist()
        # Whether a file is gone is told by the file, not by the listing: one that became ignored stays.
        under = index.docs.where(T.path_under(F.col("path"), root)).select("path", "doc_id", "last_modified")
        gone = self._gone(under)
        acted = I.changes(listed.where("error is null").select("path", "last_modified", "supported"), under.join(gone, "path", "left_anti")).where("action != 'removed'").persist()
        todo = listed.join(acted.where("action in ('new', 'updated')").select("path", "action"), "path")
        limits = {"max_text": config.max_text_bytes, "max_pdf": config.max_pdf_bytes}
        files = docfs.corpus(todo, config.max_text_bytes, config.max_pdf_bytes).persist()
        judged = files.select("path", I.is_large(F.col("extension"), F.col("size_bytes"), *limits.values()).alias("large"), T.is_blank(F.col("content")).alias("blank"))
        action = F.when(F.col("large"), "metadata").when(F.col("blank"), "error")
        counted = acted.join(judged, "path", "left").select(F.coalesce(action, F.col("action")).alias("action"))
        counts = I.counters(counted).first().asDict()
        counts["updated"] = acted.where("action = 'updated'").count()
        counts["removed"] = gone.count()
        counts["errors"] += listed.where("error is not null").count()
        folders = listed.select(T.parent_dir(F.col("path"))).distinct().count()
        out = gone.select("path").union(acted.where("action = 'updated'").select("path"))
        drop = index.docs.join(out, "path", "left_semi").select("doc_id")
        start = (index.docs.agg(F.max("doc_id")).first()[0] or 0) + 1
        self.store.save(I.add(I.remove(index, drop), I.assign_ids(files, start), **limits))
        for df in (listed, acted, files):
            df.unpersist()
        return ScanResult(**counts, directories=folders)

    def _gone(self, docs: DataFrame) -> DataFrame:
        @F.pandas_udf("boolean")
        def there(paths: pd.Series) -> pd.Series:
            return paths.map(os.path.exists)

        return docs.where(~there("path")).select("path")

    def remove(self, path: str) -> int:
        """Forgets a folder and its documents; returns how many."""
        root = settings.expand(path)
        with lock(self._lock):
            config = self.config
            if not config.remove(root):
                raise KeyError(root)
            settings.save(self.home, config)
            index = self._index_or_empty()
            gone = index.docs.where(T.path_under(F.col("path"), root)).select("doc_id")
            n = gone.count()
            self.store.save(I.remove(index, gone))
            return n

    def spec(self, query: str, fuzzy=False, prefix=False, regex=False, ext=None, min_size=None, modified_after=None, now=None) -> QuerySpec:
        size = parse_size(min_size) if isinstance(min_size, str) else min_size
        since = parse_since(modified_after, now) if isinstance(modified_after, str) else modified_after
        return QuerySpec(query, fuzzy, prefix, regex, Filters(ext, size, since))

    def search(self, query: str, **options) -> DataFrame:
        """All results, best first."""
        found = S.search(self.index(), self.spec(query, **options))
        settings.remember(self.home, query)
        return found

    def top(self, query: str, k: int = S.SNIPPETS, before: str = "", after: str = "", **options) -> DataFrame:
        """The best results with snippets."""
        return S.top(self.index(), self.spec(query, **options), k, before, after)

    def explain(self, query: str, **options) -> dict:
        return S.explain(self.index(), self.spec(query, **options))

    def stats(self) -> dict[str, DataFrame]:
        index = self.index()
        return {"overview": statistics.overview(index), "extensions": statistics.extensions(index), "top_terms": statistics.top_terms(index), "largest": statistics.largest_files(index)}

    def history(self, n: int = 20) -> list[str]:
        return settings.history(self.home, n)

    def clear_history(self) -> None:
        settings.clear_history(self.home)

    def location(self) -> dict:
        """Where the index is, and its bytes on disk."""
        return {"index": self.store.root, "bytes": self.store.size()}

    def watch(self, checkpoint: str | None = None, **options) -> Watch:
        """Follows the watched folders that exist.  The lock is held until the stream ends."""
        config = self.config
        paths = [p for p in config.watched if os.path.isdir(p)]
        if not paths:
            raise Missing("no folders to watch")
        with ExitStack() as held:
            held.enter_context(lock(self._lock))
            if not self.store.exists():
                self.store.save(self._index_or_empty())
            query = W.watch(self.store, paths, config, checkpoint or f"{self.store.root}-watch", **options)
            return Watch(query, held.pop_all())

    def reset(self) -> None:
        with lock(self._lock):
            self.store.delete()
            settings.delete(self.home)
