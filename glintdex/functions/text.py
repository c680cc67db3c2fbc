"""Text as Column expressions: tokens, file names, sizes, ages, snippets.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that content never indexes.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it its was are be been being have has had do does did will "
    "would could should may might that this these those i you he she we they what which who not no so if as up out about "
    "into than then when where how all each any can just also"
).split()

# File kinds that are read, and folders that are not entered.
EXTENSIONS = (".txt", ".md", ".java", ".json", ".xml", ".yml", ".yaml", ".properties", ".pdf")
IGNORED = (".git", "node_modules", "target", "build", "dist", ".idea")
CONTEXT = 100
#: A character that Java's trim takes off an end.
LOW = r"[\x00-\x20]"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that are no stop words; null and blank give none."""
    return F.filter(_pieces(text), lambda t: ~t.isin(STOP_WORDS))


def tokenize_phrase(text: Column) -> Column:
    """The same with stop words."""
    return _pieces(text)


def tokenize_filename(name: Column) -> Column:
    """Tokens, stop words too, of a file name without what follows its last dot (unless that comes first)."""
    return _pieces(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1"))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty without one or if the only dot comes first."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def parent_dir(path: Column) -> Column:
    """The folder of a path; the path itself if it has none."""
    found = F.regexp_extract(path, r"(?s)^(.*)/[^/]+$", 1)
    return F.when(found == "", path).otherwise(found)


def path_under(path: Column, root: str) -> Column:
    """Whether ``path`` is ``root`` or below it, by whole names."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def ignored_dir(relative: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """Whether any folder of a relative path is ignored or hidden."""
    return F.exists(F.split(relative, "/"), lambda d: d.isin(*ignored) | d.startswith("."))


def human_size(size: Column) -> Column:
    """Tenths are rounded from the exact value, ties to even, as C's printf does; Java's rounds ties up."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, bits in (("KB", 10), ("MB", 20), ("GB", 30)):
        exact = size / float(1 << bits)
        whole = F.floor(exact)
        # What is left has so few bits that ten times it is exact too.
        tenths = whole * 10 + F.rint((exact - whole) * 10).cast("long")
        out = F.when(size >= 1 << bits, F.format_string(f"%.1f {unit}", tenths / 10)).otherwise(out)
    return out


def age_label(modified: Column, now: int) -> Column:
    """How long before ``now`` (both epoch milliseconds): days, hours or minutes."""
    age = F.lit(now) - modified
    out = F.lit("just now")
    for unit, ms in (("m", 60_000), ("h", 3_600_000), ("d", 86_400_000)):
        n = F.floor(age / ms)
        out = F.when(n > 0, F.concat(n.cast("string"), F.lit(f"{unit} ago"))).otherwise(out)
    return out


def shorten(text: Column, most: int) -> Column:
    """The end of a text that is longer than ``most``, after dots."""
    return F.when(F.length(text) > most, F.concat(F.lit("..."), F.right(text, F.lit(max(0, most - 3))))).otherwise(text)


def progress_bar(done: Column, total: Column, width: int = 30) -> Column:
    """A bar of ``width`` characters, filled by the share that is done."""
    full = F.when(total > 0, F.least(F.lit(width), F.floor(done * width / total))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s\x1c-\x1f]")


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are that, else ISO-8859-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def deltas(positions: Column) -> Column:
    """Each position less the one before it."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.element_at(positions, i)))


def undelta(steps: Column) -> Column:
    """The reverse of ``deltas``."""
    start = F.array().cast("array<int>")
    return F.aggregate(steps, start, lambda out, d: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + d)))


def highlight(text: Column, terms: list[str], before: str = "\x1b[1;33m", after: str = "\x1b[0m") -> Column:
    """Marks every term, in one pass, so that no later term can hit a mark."""
    if not terms:
        return text
    longest = "|".join(f"\\Q{t}\\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, F.lit(f"(?i)({longest})"), F.lit(f"{before}$1{after}"))


def snippet(content: Column, terms: list[str], before: str = "", after: str = "") -> Column:
    """What stands around the first occurrence of any term: ``CONTEXT`` characters each way, cut at blanks.

    Terms are looked for as substrings of the lower-case text; of terms found at one place the first one counts.
    """
    if not terms:
        return F.lit("")
    low = F.lower(content)
    places = (F.struct(F.instr(low, t).alias("at"), F.lit(k).alias("k"), F.lit(len(t)).alias("n")) for k, t in enumerate(terms))
    hits = F.filter(F.array(*places), lambda h: h["at"] > 0)
    hit = F.array_min(hits)
    # 0-based: start of the match, and of the window [a, b).
    match, size = hit["at"] - 1, F.length(content)
    a0 = F.greatest(F.lit(0), match - CONTEXT)
    b0 = F.least(size, match + hit["n"] + CONTEXT)
    blank = F.when(a0 > 0, F.call_function("locate", F.lit(" "), content, a0 + 1) - 1).otherwise(F.lit(-1))
    a = F.when((blank > 0) & (blank < match), blank + 1).otherwise(a0)
    head = F.substring(content, F.lit(1), b0 + 1)
    back = F.length(head) - F.instr(F.reverse(head), " ")
    last = F.when(F.instr(head, " ") > 0, back).otherwise(F.lit(-1))
    b = F.when((b0 < size) & (last > match), last).otherwise(b0)
    body = F.regexp_replace(F.translate(F.substring(content, a + 1, b - a), "\r\n", "  "), f"^{LOW}+|{LOW}+$", "")
    if before or after:
        body = highlight(body, terms, before, after)
    whole = F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(b < size, "...").otherwise(""))
    return F.when(is_blank(content) | hit.isNull(), "").otherwise(whole)


def register(spark: SparkSession) -> None:
    """The same expressions as SQL functions, which Catalyst inlines."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    pieces = "regexp_extract_all(lower(coalesce(s, '')), '[a-z0-9]+', 0)"
    for name, args, kind, body in (
        ("glintdex_tokenize", "s STRING", "ARRAY<STRING>", f"filter({pieces}, t -> t NOT IN ({stop}))"),
        ("glintdex_tokenize_phrase", "s STRING", "ARRAY<STRING>", pieces),
        ("glintdex_tokenize_filename", "n STRING", "ARRAY<STRING>", pieces.replace("coalesce(s, '')", r"regexp_replace(coalesce(n, ''), '(?s)^(.+)[.][^.]*$', '$1')")),
        ("glintdex_bm25", "freq DOUBLE, df DOUBLE, n DOUBLE, len DOUBLE, avgdl DOUBLE", "DOUBLE", "ln((n - df + 0.5D) / (df + 0.5D) + 1) * freq * 2.5D / (freq + 1.5D * (0.25D + 0.75D * len / avgdl))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
