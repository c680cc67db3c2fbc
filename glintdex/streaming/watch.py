"""Keeps an index current: a stream of file changes, applied batch by batch as upserts and removals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintdex.operators import index as I
from glintdex.sources import docfs
from glintdex.sources.scratch import written
from glintdex.sources.settings import Config
from glintdex.sources.storage import Store


def apply_events(store: Store, events: DataFrame, config: Config, on_event: Callable[[str, str], None] | None = None) -> None:
    """One batch of changes becomes one new snapshot.  Blank files leave the index; files that can't be read do too.

    Applying a batch again changes nothing, since each path is replaced by what it now is.
    """
    events = events.persist()
    try:
        if events.isEmpty():
            return
        index = store.load()
        known = index.docs.join(events.select("path"), "path", "left_semi").select("doc_id")
        # Files may change again while they are read, so one reading is written and serves for all that follows.
        files = written(store.spark, docfs.corpus(events.where("op != 'delete'"), config.max_text_bytes, config.max_pdf_bytes), "files")
        start = (index.docs.agg(F.max("doc_id")).first()[0] or 0) + 1
        limits = {"max_text": config.max_text_bytes, "max_pdf": config.max_pdf_bytes}
        store.save(I.add(I.remove(index, known), I.assign_ids(files, start), **limits))
        if on_event:
            for row in events.select("op", "path").toLocalIterator():
                on_event({"create": "Indexed", "modify": "Updated", "delete": "Removed"}[row["op"]], row["path"])
    finally:
        events.unpersist()


def watch(store: Store, paths: list[str], config: Config, checkpoint: str, on_event: Callable[[str, str], None] | None = None, available_now: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """The running stream over ``paths``.  Its first batch holds all files, as no listing came before it."""
    spark = store.spark
    docfs.register(spark)
    stream = spark.readStream.format("docfs_changes").option("paths", json.dumps(paths)).option("ignored", json.dumps(config.ignored)).load()
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_events(store, batch, config, on_event)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
