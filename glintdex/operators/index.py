"""The index: documents, positional postings, vocabulary and corpus statistics, all DataFrames.

Postings of a document come of its own row alone, so documents are dealt once by id and their tokens never cross the
network: grouping by (document, term) is already satisfied by that dealing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintdex.functions import text as T
from glintdex.sources.scratch import written

DOC_COLUMNS = ["doc_id", "path", "file_name", "extension", "size_bytes", "last_modified", "indexed_at", "token_count"]
MAX_TEXT, MAX_PDF = 15 << 20, 5 << 20


@dataclass(frozen=True)
class Index:
    """``postings``: term, doc_id, positions (from 0, ascending), freq.  ``stats``: one row of n, avgdl, tokens."""

    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    #: doc_id and text, for snippets.
    content: DataFrame | None = None
    #: n and avgdl, where they are known without a query: from a stored index.
    totals: tuple[int, float] | None = None

    def with_totals(self, hits: DataFrame) -> DataFrame:
        """``hits`` with n and avgdl, as constants or from the one row of ``stats``."""
        if self.totals is None:
            return hits.crossJoin(F.broadcast(self.stats.select("n", "avgdl")))
        return hits.withColumns({"n": F.lit(self.totals[0]).cast("long"), "avgdl": F.lit(float(self.totals[1]))})


def is_large(ext: Column, size: Column, max_text: int = MAX_TEXT, max_pdf: int = MAX_PDF) -> Column:
    return F.when(ext == ".pdf", size > max_pdf).otherwise(size > max_text)


def all_tokens(corpus: DataFrame, max_text: int = MAX_TEXT, max_pdf: int = MAX_PDF) -> DataFrame:
    """``corpus`` with ``large`` and ``tokens``: those of the content, then those of the file name; large, blank and
    unread files have the latter only."""
    large = is_large(F.col("extension"), F.col("size_bytes"), max_text, max_pdf)
    names = T.tokenize_filename(F.col("file_name"))
    tokens = F.when(F.col("large"), names).otherwise(F.concat(T.tokenize(F.col("content")), names))
    return corpus.withColumn("large", large).withColumn("tokens", tokens)


def with_tokens(corpus: DataFrame, max_text: int = MAX_TEXT, max_pdf: int = MAX_PDF) -> DataFrame:
    """The same without blank and unread files, unless they are large."""
    return all_tokens(corpus, max_text, max_pdf).where(F.col("large") | ~T.is_blank(F.col("content")))


def assign_ids(corpus: DataFrame, start: int = 1, key: str = "path") -> DataFrame:
    """``doc_id`` by the order of ``key`` from ``start``, each id once, without bringing rows together.

    Rows are sorted by ranges of the key, numbered within their range and written once, to the shared folder: ranges
    and numbers are only settled when they are worked out, so all that follows reads what was written.
    """
    spark = corpus.sparkSession
    # The upper bits are the range, the lower 33 the row's number in it.
    placed = corpus.repartitionByRange(key).sortWithinPartitions(key).withColumn("at__", F.monotonically_increasing_id())
    placed = written(spark, placed, "ids").withColumn("part__", F.shiftright("at__", 33))
    # A row for each range.
    counts = placed.groupBy("part__").agg(F.count("*").alias("rows__"))
    before = counts.select("part__", F.coalesce(F.sum("rows__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    nth = F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "part__").withColumn("doc_id", F.col("before__") + nth + F.lit(start)).drop("part__", "at__", "before__")


def postings_of(tokenized: DataFrame) -> DataFrame:
    """One row for each (term, document) of ``tokenized`` (doc_id, tokens)."""
    dealt = tokenized.select("doc_id", "tokens").repartition("doc_id")
    exploded = dealt.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    grouped = exploded.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", F.col("doc_id").cast("long").alias("doc_id"), "positions", F.size("positions").alias("freq"))


def docs_of(tokenized: DataFrame, now: int | None = None) -> DataFrame:
    """The metadata rows of ``tokenized``."""
    stamp = F.unix_millis(F.current_timestamp()) if now is None else F.lit(now)
    own = tokenized.withColumn("indexed_at", stamp.cast("long")).withColumn("token_count", F.size("tokens"))
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), *DOC_COLUMNS[1:])


def vocab_of(postings: DataFrame) -> DataFrame:
    """term, documents and occurrences, and the term's length, which scans can prune by."""
    counted = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("cf"))
    return counted.withColumn("term_len", F.length("term"))


def stats_of(docs: DataFrame) -> DataFrame:
    """Documents, mean length of those that have tokens (1 if none), tokens."""
    some = F.when(F.col("token_count") > 0, F.col("token_count"))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg(some), F.lit(1.0)).alias("avgdl"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


def build(corpus: DataFrame, max_text: int = MAX_TEXT, max_pdf: int = MAX_PDF, now: int | None = None) -> Index:
    """Of ``corpus``: doc_id, path, file_name, extension, size_bytes, last_modified, content."""
    tokenized = with_tokens(corpus, max_text, max_pdf)
    docs, postings = docs_of(tokenized, now), postings_of(tokenized)
    return Index(docs, postings, vocab_of(postings), stats_of(docs), corpus.select("doc_id", "content"))


def remove(index: Index, gone: DataFrame) -> Index:
    """Without the documents whose ids ``gone`` has; terms that only they had go too."""
    docs, postings = (df.join(gone.select("doc_id"), "doc_id", "left_anti") for df in (index.docs, index.postings))
    postings = postings.select("term", "doc_id", "positions", "freq")
    content = index.content and index.content.join(gone.select("doc_id"), "doc_id", "left_anti")
    return Index(docs.select(*DOC_COLUMNS), postings, vocab_of(postings), stats_of(docs), content)


def add(index: Index, corpus: DataFrame, **limits) -> Index:
    """With the documents of ``corpus``, whose ids the index doesn't have."""
    new = build(corpus, **limits)
    docs, postings = index.docs.unionByName(new.docs), index.postings.unionByName(new.postings)
    content = index.content and index.content.unionByName(new.content)
    return Index(docs, postings, vocab_of(postings), stats_of(docs), content)


def upsert(index: Index, corpus: DataFrame, **limits) -> Index:
    """``corpus`` in place of what the index has at its paths; new ids follow the highest one."""
    gone = index.docs.join(corpus.select("path"), "path", "left_semi").select("doc_id")
    start = (index.docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    return add(remove(index, gone), assign_ids(corpus.drop("doc_id"), start), **limits)


def changes(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """``listing`` (path, last_modified, supported) against the index: ``action`` for each path on either side.

    A file whose time is not after the indexed one is skipped; so is an unsupported one.
    """
    old = docs.select("path", F.col("last_modified").alias("was"), "doc_id")
    both = listing.join(old, "path", "full_outer")
    action = (
        F.when(F.col("last_modified").isNull(), "removed")
        .when(~F.col("supported"), "skipped")
        .when(F.col("was").isNull(), "new")
        .when(F.col("last_modified") <= F.col("was"), "skipped")
        .otherwise("updated")
    )
    return both.select("path", "doc_id", "last_modified", "was", action.alias("action"))


def deleted(docs: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Documents under ``root`` whose file is gone from ``existing`` (an unfiltered listing)."""
    return docs.where(T.path_under(F.col("path"), root)).join(existing.select("path"), "path", "left_anti")


def counters(acted: DataFrame) -> DataFrame:
    """One row of counts over ``action``; an updated document counts as indexed too."""
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    return acted.agg(
        count("new", "updated").alias("indexed"),
        count("updated").alias("updated"),
        count("removed").alias("removed"),
        count("skipped").alias("skipped"),
        count("metadata").alias("metadata_only"),
        count("error").alias("errors"),
    )
