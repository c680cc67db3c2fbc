"""Boilerplate lines by site-relative frequency, in DataFrame operations alone.

Within a site (host), the share of its pages that contain a line tells boilerplate from content: lines in more than
``ratio`` of a site's pages, and in at least ``least`` of them, are dropped wherever they stand on that site.  A line
counts once for a page, and equal texts on a site are one page, so copies of a document don't make its content
boilerplate; blank lines neither count nor go.

Lines travel as two 64-bit hashes, first with their page's to leave out copies, then with counts; texts don't, since
they are cleaned where they are.  Copies are left out and counts summed before and after each shuffle, so a line on every page of a third of the corpus is one row from each task.  A site has
at most (lines per page) / ``ratio`` boilerplate lines; the list of all of them is broadcast if it has at most
``small`` rows.  Beyond that, pages are joined with their site's list after each site's pages are dealt to ``deals``
parts, with which the list, short for any site, is repeated.

Defined results: a null text stays null and has no lines; a null host is a site of its own; the ends of lines are
line feeds alone; repeated rows all stay, and count as one page; texts are read whole; an empty table gives no rows; all other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import Scratch, fresh, is_small

RATIO, LEAST = 0.05, 5


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("i"))


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host`` and ``line`` (a struct of two hashes) of every boilerplate line, with distinct pages that have it and all distinct pages."""
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n", -1), _has_word), _hash))
    own = pages.select(F.col(host).alias("host"), _hash(F.col(text)).alias("page"), hashes.alias("lines")).distinct()
    counted = own.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("with_line")).where(F.col("with_line") >= least)
    totals = own.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    return counted.join(totals, counted.host.eqNullSafe(totals.site)).where(F.col("with_line") > F.lit(ratio) * F.col("pages")).select("host", "line", "with_line", "pages")


def drop_boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, least: int = LEAST, small: int = 200_000, deals: int = 256, report: bool = False
) -> DataFrame:
    """``pages`` without the boilerplate lines in ``text``; with ``report``, also ``n_lines`` and ``n_dropped``."""
    site, lines, bad, kept, deal, which = fresh(pages, "site__", "lines__", "bad__", "kept__", "deal__", "which__")
    found = boilerplate(pages, host, text, ratio, least).groupBy(F.col("host").alias(site)).agg(F.collect_set("line").alias(bad))
    per_site = Scratch(pages.sparkSession).keep(found, "boilerplate")
    few = is_small(per_site.select(F.explode(bad)), small)
    if few:
        joined = pages.join(F.broadcast(per_site), pages[host].eqNullSafe(per_site[site]), "left")
    else:
        listed = per_site.select("*", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias(which))
        # Rows in turn, not by text, so that copies don't come together.
        dealt = pages.withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(deals)).cast("int"))
        joined = dealt.join(listed, dealt[host].eqNullSafe(listed[site]) & (dealt[deal] == listed[which]), "left")
    stays = F.filter(F.col(lines), lambda line: ~(_has_word(line) & F.array_contains(F.col(bad), _hash(line))))
    clean = F.when(F.col(bad).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn(lines, F.split(F.col(text), "\n", -1)).withColumn(kept, stays)
    kinds = dict(pages.dtypes)
    out = [clean.cast(kinds[c]).alias(c) if c == text else F.col(c) for c in pages.columns]
    if report:
        n, m = fresh(pages, "n_lines", "n_dropped")
        size = F.coalesce(F.size(lines), F.lit(0))
        size = F.when(F.col(text).isNull(), 0).otherwise(size)
        left = F.when(F.col(bad).isNull() | F.col(text).isNull(), size).otherwise(F.size(kept))
        out += [size.cast("long").alias(n), (size - left).cast("long").alias(m)]
    return joined.select(*out)


def by_source(docs: DataFrame, report: bool = False) -> DataFrame:
    """Documents by their source."""
    return drop_boilerplate(docs, "source", "text", report=report)


#: The same in DuckDB's SQL, with the lines and texts themselves in place of hashes.
ORACLE = f"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
own AS (SELECT DISTINCT source, text, lines FROM split),
each_line AS (SELECT source, text, unnest(lines) AS line FROM own),
worded AS (SELECT DISTINCT source, text, line FROM each_line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
counted AS (SELECT source, line, count(*) AS with_line FROM worded GROUP BY source, line),
totals AS (SELECT source, count(*) AS pages FROM own GROUP BY source),
bad AS (SELECT c.source, list(line) AS bad FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE with_line >= {LEAST} AND with_line > {RATIO} * pages GROUP BY c.source)
SELECT s.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(lines, lambda x: list_contains(bad, x))), 0) AS BIGINT) AS n_dropped,
       CASE WHEN bad IS NULL OR s.text IS NULL THEN s.text
            ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, x)), chr(10)) END AS text
FROM split s LEFT JOIN bad b ON s.source IS NOT DISTINCT FROM b.source
"""
