"""Search: each mode makes (term, weight) rows of the vocabulary; one scoring plan serves all modes but phrases."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintdex.functions import text as T
from glintdex.operators.index import Index
from glintdex.plans.spec import Filters, QuerySpec

K1, B = 1.5, 0.75
FUZZY_WEIGHTS = (1.0, 0.75, 0.5)
BOOST, PHRASE_BOOST = 3.0, 2.0
SNIPPETS = 10
#: Matched terms up to so many are sent to the postings' scan as a list, which Parquet prunes by; more are joined.
LISTED = 500
#: What a batch asks for is broadcast up to so many rows; more are joined by sorting.
ASKED = 100_000


def bm25(freq: Column, df: Column, n: Column, length: Column, avgdl: Column) -> Column:
    """Zero unless all counts are positive; documents without tokens count as of mean length."""
    own = F.when(length > 0, length.cast("double")).otherwise(F.floor(F.greatest(F.lit(1.0), avgdl)).cast("double"))
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    score = idf * (freq * (K1 + 1)) / (freq + K1 * ((1 - B) + B * own / avgdl))
    return F.when((freq > 0) & (df > 0) & (n > 0), score).otherwise(0.0)


def filename_boost(file_name: Column, term: Column) -> Column:
    return F.when(F.contains(F.lower(file_name), term), BOOST).otherwise(1.0)


def keyword_terms(index: Index, terms: list[str]) -> DataFrame:
    """Each term weighs as often as it was asked for."""
    count = Counter(terms)
    weights = F.create_map(*(F.lit(x) for t, k in count.items() for x in (t, float(k)))) if count else F.lit(None).cast("map<string,double>")
    return index.vocab.where(F.col("term").isin(list(count))).select("term", "df", F.element_at(weights, F.col("term")).alias("weight"))


def prefix_terms(index: Index, prefixes: list[str]) -> DataFrame:
    """Terms that begin with a prefix, weighed by the share of the term that it covers, summed over prefixes."""
    own = [p for p in prefixes if p.strip()]
    hit, weight = F.lit(False), F.lit(0.0)
    for p in own:
        begins = F.col("term").startswith(p)
        hit, weight = hit | begins, weight + F.when(begins, F.lit(float(len(p))) / F.col("term_len")).otherwise(0.0)
    return index.vocab.where(hit).select("term", "df", weight.alias("weight"))


def autocomplete(index: Index, prefix: str) -> DataFrame:
    """Terms that begin with ``prefix``, shortest first."""
    if not prefix or not prefix.strip():
        return index.vocab.where("false").select("term", "term_len")
    return index.vocab.where(F.col("term").startswith(prefix)).select("term", "term_len").orderBy("term_len", "term")


def fuzzy_terms(index: Index, terms: list[str]) -> DataFrame:
    """Terms within two edits, by ``FUZZY_WEIGHTS``, summed over the terms asked for; lengths are compared first."""
    hit, weight = F.lit(False), F.lit(0.0)
    for t in terms:
        near = F.col("term_len").between(len(t) - 2, len(t) + 2)
        d = F.when(near, F.levenshtein(F.col("term"), F.lit(t), 2)).otherwise(-1)
        w = F.lit(0.0)
        for k, v in enumerate(FUZZY_WEIGHTS):
            w = F.when(d == k, v).otherwise(w)
        hit, weight = hit | (near & (F.levenshtein(F.col("term"), F.lit(t), 2) >= 0)), weight + w
    return index.vocab.where(hit).select("term", "df", weight.alias("weight"))


def fuzzy_candidates(index: Index, term: str) -> DataFrame:
    """term and distance, up to two."""
    near = F.col("term_len").between(len(term) - 2, len(term) + 2)
    return index.vocab.where(near).select("term", F.levenshtein(F.col("term"), F.lit(term), 2).alias("distance")).where("distance >= 0")


def valid_pattern(index: Index, pattern: str) -> bool:
    """Whether the pattern compiles by itself, in the dialect that matches it."""
    jvm = index.vocab.sparkSession._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def regex_terms(index: Index, pattern: str) -> DataFrame:
    """Terms that the whole pattern matches, whatever the case; none if it is invalid."""
    if not valid_pattern(index, pattern):
        return index.vocab.where("false").select("term", "df", F.lit(1.0).alias("weight"))
    return index.vocab.where(F.col("term").rlike(rf"(?i)\A(?:{pattern})\z")).select("term", "df", F.lit(1.0).alias("weight"))


def settled(index: Index, matches: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """Matched terms of a stored index as constants with their list, if there are at most ``LISTED``; else as they were.

    The first job reads the vocabulary alone; the second one then prunes the postings by these terms.
    """
    if index.totals is None:
        return matches, None
    few = matches.select("term", "df", "weight").limit(LISTED + 1).collect()
    if len(few) > LISTED:
        return matches, None
    rows = [(r["term"], r["df"], float(r["weight"])) for r in few]
    return matches.sparkSession.createDataFrame(rows, "term string, df long, weight double"), [r[0] for r in rows]


def score(index: Index, matches: DataFrame, filters: Filters | None = None, listed: list[str] | None = None) -> DataFrame:
    """doc_id and score: the sum over matched terms of BM25 x weight x file-name boost.

    Filters act on documents before the join; statistics and document frequencies don't depend on them.
    """
    docs = apply_filters(index.docs, filters).select("doc_id", "file_name", "token_count")
    postings = index.postings.select("term", "doc_id", "freq")
    if listed is not None and len(listed) <= LISTED:
        postings = postings.where(F.col("term").isin(listed))
    hits = index.with_totals(postings.join(matches, "term").join(docs, "doc_id"))
    one = bm25(F.col("freq"), F.col("df"), F.col("n"), F.col("token_count"), F.col("avgdl")) * F.col("weight") * filename_boost(F.col("file_name"), F.col("term"))
    return hits.groupBy("doc_id").agg(F.sum(one).alias("score"))


def phrase_candidates(index: Index, terms: list[str]) -> DataFrame:
    """Documents that have all the terms, with each one's positions as ``p0``, ``p1``, ..., by distinct term."""
    own = list(dict.fromkeys(terms))
    found = index.postings.where(F.col("term").isin(own))
    slots = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{k}") for k, t in enumerate(own)]
    return found.groupBy("doc_id").agg(F.count("*").alias("terms"), *slots).where(F.col("terms") == len(own)).drop("terms")


def phrase_scores(index: Index, terms: list[str], filters: Filters | None = None) -> DataFrame:
    """doc_id and score of documents in which the terms follow one another: twice the sum of their BM25."""
    own = list(dict.fromkeys(terms))
    slot = {t: k for k, t in enumerate(own)}
    near = phrase_candidates(index, terms)
    follow = F.exists(F.col("p0"), lambda x: _all(F.array_contains(F.col(f"p{slot[t]}"), x + i) for i, t in enumerate(terms) if i))
    df = index.vocab.where(F.col("term").isin(own)).agg(*(F.max(F.when(F.col("term") == t, F.col("df"))).alias(f"d{k}") for k, t in enumerate(own)))
    docs = apply_filters(index.docs, filters).select("doc_id", "token_count")
    hits = index.with_totals(near.where(follow).join(docs, "doc_id").crossJoin(F.broadcast(df)))
    total = F.lit(0.0)
    for t in terms:
        k = slot[t]
        total = total + bm25(F.size(f"p{k}"), F.col(f"d{k}"), F.col("n"), F.col("token_count"), F.col("avgdl"))
    return hits.select("doc_id", (total * PHRASE_BOOST).alias("score"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def apply_filters(docs: DataFrame, filters: Filters | None) -> DataFrame:
    if filters is None:
        return docs
    if filters.extension is not None:
        docs = docs.where(F.lower("extension") == filters.extension.lower())
    if filters.min_size is not None:
        docs = docs.where(F.col("size_bytes") >= filters.min_size)
    if filters.modified_after is not None:
        docs = docs.where(F.col("last_modified") >= filters.modified_after)
    return docs


def scores(index: Index, spec: QuerySpec) -> DataFrame:
    """doc_id and score by the query's mode; none if its text has no terms."""
    parsed = spec.parsed()
    if not parsed.terms:
        return score(index, keyword_terms(index, []), spec.filters, [])
    if spec.mode == "regex":
        matches, listed = settled(index, regex_terms(index, spec.raw))
        return score(index, matches, spec.filters, listed)
    if spec.mode == "phrase":
        return phrase_scores(index, parsed.terms, spec.filters)
    if spec.mode == "fuzzy":
        matches, listed = settled(index, fuzzy_terms(index, parsed.terms))
        return score(index, matches, spec.filters, listed)
    if spec.mode == "prefix":
        matches, listed = settled(index, prefix_terms(index, parsed.terms))
        return score(index, matches, spec.filters, listed)
    return score(index, keyword_terms(index, parsed.terms), spec.filters, parsed.terms)


RESULT = ["doc_id", "score", "path", "file_name", "extension", "size_bytes", "last_modified"]


def search(index: Index, spec: QuerySpec) -> DataFrame:
    """All results, best first, ties by id."""
    return scores(index, spec).join(index.docs, "doc_id").select(*RESULT).orderBy(F.desc("score"), "doc_id")


def top(index: Index, spec: QuerySpec, k: int = SNIPPETS, before: str = "", after: str = "") -> DataFrame:
    """The best ``k`` with their rank and snippet.  Only these rows meet documents' metadata and texts."""
    best = scores(index, spec).orderBy(F.desc("score"), "doc_id").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    found = F.broadcast(ranked).join(index.docs, "doc_id")
    if index.content is None:
        return found.select("rank", *RESULT, F.lit("").alias("snippet")).orderBy("rank")
    found = found.join(index.content, "doc_id", "left")
    return found.select("rank", *RESULT, T.snippet(F.col("content"), spec.parsed().terms, before, after).alias("snippet")).orderBy("rank")


def batch_scores(index: Index, matches: DataFrame) -> DataFrame:
    """query_id, doc_id and score for many queries' ``matches`` (query_id, term, df, weight) at once."""
    docs = index.docs.select("doc_id", "file_name", "token_count")
    wanted = index.postings.join(matches.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "freq")
    hits = index.with_totals(wanted.join(docs, "doc_id").join(matches, "term"))
    one = bm25(F.col("freq"), F.col("df"), F.col("n"), F.col("token_count"), F.col("avgdl")) * F.col("weight") * filename_boost(F.col("file_name"), F.col("term"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"))


def _asked(asked: DataFrame, key: str, text: str) -> DataFrame:
    """Each query's terms and how often it has each."""
    terms = asked.select(F.col(key).alias("query_id"), F.explode(T.tokenize(F.col(text))).alias("asked"))
    return terms.groupBy("query_id", "asked").agg(F.count("*").alias("times"))


def _among(asked: DataFrame, theirs: DataFrame, *on: str) -> DataFrame:
    """``asked`` with the vocabulary's rows ``theirs`` that share its key.

    ``theirs`` are many for each term, while Spark judges them by the vocabulary's size on disk; so they are never
    the side that is broadcast.
    """
    few = asked.limit(ASKED + 1).count() <= ASKED
    return (F.broadcast(asked) if few else asked.hint("merge")).join(theirs, list(on))


def batch_keyword(index: Index, asked: DataFrame, key: str = "query_id", text: str = "raw_query") -> DataFrame:
    """Keyword search of many queries at once.  Repeated terms weigh again."""
    terms = _asked(asked, key, text)
    return batch_scores(index, terms.join(index.vocab, terms.asked == index.vocab.term).select("query_id", "term", "df", F.col("times").alias("weight")))


def batch_prefix(index: Index, asked: DataFrame, key: str = "query_id", text: str = "raw_query") -> DataFrame:
    """Prefix search of many queries at once, as an equality: every beginning of each term of the vocabulary is a key."""
    begun = index.vocab.select("term", "df", "term_len", F.explode(F.transform(F.sequence(F.lit(1), "term_len"), lambda n: F.substring("term", F.lit(1), n))).alias("asked"))
    hits = _among(_asked(asked, key, text), begun, "asked")
    weight = F.sum(F.col("times") * F.length("asked") / F.col("term_len"))
    return batch_scores(index, hits.groupBy("query_id", "term").agg(F.first("df").alias("df"), weight.alias("weight")))


def batch_fuzzy(index: Index, asked: DataFrame, key: str = "query_id", text: str = "raw_query") -> DataFrame:
    """Fuzzy search of many queries at once.

    Within two edits, one of three equal parts of a term is in the other one unchanged, moved by two places at most;
    length and such a part are the join's key, and the distance is worked out for what shares one.  Terms of under six
    letters are keyed by length alone.
    """
    vocab = index.vocab.select("term", "df", "term_len")
    ask = _asked(asked, key, text).withColumn("n", F.length("asked"))
    each = ask.select("asked", "n").distinct().select("asked", "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 2), F.col("n") + 2)).alias("term_len"))
    cuts = F.array(F.lit(0), F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3), F.col("n")).cast("array<int>")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.substring("asked", F.get(cuts, k) + 1, F.get(cuts, k + 1) - F.get(cuts, k)))
    own = each.select("asked", "n", "term_len", F.explode(F.when(F.col("n") < 6, F.array(F.lit(""))).otherwise(parts)).alias("part"))
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(6), F.col("term_len") - 2), F.col("term_len") + 2), lambda n: F.array(F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int") - F.floor(n / 3).cast("int"), n - F.floor(2 * n / 3).cast("int")))))
    grams = F.flatten(F.transform(sizes, lambda m: F.when(m <= F.col("term_len"), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("term_len") - m + 1)), lambda i: F.substring("term", i, m))).otherwise(F.array().cast("array<string>"))))
    theirs = vocab.select("term", "df", "term_len", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), grams))).alias("part"))
    near = _among(own, theirs, "term_len", "part").select("asked", "term", "df").distinct().withColumn("d", F.levenshtein("asked", "term", 2)).where("d >= 0")
    weights = F.array(*map(F.lit, FUZZY_WEIGHTS))
    hits = ask.join(near, "asked").groupBy("query_id", "term").agg(F.first("df").alias("df"), F.sum(F.col("times") * F.get(weights, F.col("d"))).alias("weight"))
    return batch_scores(index, hits)


def explain(index: Index, spec: QuerySpec) -> dict:
    """What a query does: its terms and mode, matches before and after filters, the best score, and the plan."""
    every = scores(index, spec.without_filters())
    stays = apply_filters(index.docs, spec.filters).select("doc_id", F.lit(True).alias("stays"))
    found = every.join(stays, "doc_id", "left").agg(F.count("*").alias("all"), F.count_if("stays").alias("n"), F.max(F.when(F.col("stays"), F.col("score"))).alias("best")).first()
    plan = scores(index, spec)._jdf.queryExecution().toString()
    return {"terms": spec.parsed().terms, "mode": spec.mode, "candidates": found["all"], "after_filters": found["n"], "top_score": found["best"], "plan": plan}


def plain(pattern: str) -> str:
    """A pattern for a literal text."""
    return re.escape(pattern)
