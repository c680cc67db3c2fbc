import pytest
from pyspark.sql import functions as F

from glintdex.functions import text as T
from glintdex.plans.spec import QuerySpec, parse, parse_since, parse_size, split_terms


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "terms"),
    [("hello-world_test.file", ["hello", "world", "test", "file"]), ("java11 spring6", ["java11", "spring6"]), ("The AND of", []), (None, []), ("  ", []), ("Étion K", ["tion", "k"])],
)
def test_tokenize(spark, text, terms):
    assert one(spark, text, T.tokenize) == terms
    assert split_terms(text) == terms


@pytest.mark.parametrize(("name", "terms"), [("the-config.yml", ["the", "config"]), ("Makefile", ["makefile"]), (".hidden", ["hidden"]), ("a.b.txt", ["a", "b"])])
def test_tokenize_filename(spark, name, terms):
    assert one(spark, name, T.tokenize_filename) == terms


@pytest.mark.parametrize(("name", "ext"), [("A.TXT", ".txt"), ("x", ""), (".env", ""), (".dot.txt", ".txt"), ("a.", ".")])
def test_extension(spark, name, ext):
    assert one(spark, name, T.extension) == ext


def test_sizes_and_ages(spark):
    assert [one(spark, b, T.human_size, "long") for b in (5, 1024, 1536 << 10, 3 << 30)] == ["5 B", "1.0 KB", "1.5 MB", "3.0 GB"]
    now = 10**12
    assert [one(spark, now - a, lambda c: T.age_label(c, now), "long") for a in (1, 60_000, 7_200_000, 3 * 86_400_000)] == ["just now", "1m ago", "2h ago", "3d ago"]


def test_delta_round_trip(spark):
    row = spark.createDataFrame([([3, 18, 45],), ([],)], "p array<int>").select(T.deltas(F.col("p")).alias("d"), T.undelta(T.deltas(F.col("p"))).alias("u")).collect()
    assert (row[0]["d"], row[0]["u"]) == ([3, 15, 27], [3, 18, 45])
    assert (row[1]["d"], row[1]["u"]) == ([], [])


def test_decode_falls_back(spark):
    made = spark.createDataFrame([(bytearray(b"\xe9\xe0\xfc"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in made.select(T.decode_text(F.col("b"))).collect()] == ["éàü", "é"]


@pytest.mark.parametrize(("path", "under"), [("/a/b", True), ("/a/b/c", True), ("/a/bc", False), ("/a", False)])
def test_path_under(spark, path, under):
    assert one(spark, path, lambda c: T.path_under(c, "/a/b")) is under


def plain_snippet(content, terms):
    hits = [(content.lower().find(t), k) for k, t in enumerate(terms) if t in content.lower()]
    if not hits:
        return ""
    at, k = min(hits)
    a, b = max(0, at - 100), min(len(content), at + len(terms[k]) + 100)
    if a > 0 and 0 < (s := content.find(" ", a)) < at:
        a = s + 1
    if b < len(content) and (e := content.rfind(" ", 0, b + 1)) > at:
        b = e
    return "..." * (a > 0) + content[a:b].replace("\n", " ").replace("\r", " ").strip("".join(map(chr, range(33)))) + "..." * (b < len(content))


def test_snippet_against_plain(spark):
    texts = ["redis", "x " * 200 + "redis\n" + "y " * 200, "no", "a" * 300 + "redis" + "b" * 300, "Redis first spring", "  redis  ", "w " * 60 + "spring" + " z" * 10]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in made.select("i", T.snippet(F.col("t"), ["redis", "spring"]).alias("s")).collect()}
    assert got == {i: plain_snippet(t, ["redis", "spring"]) for i, t in enumerate(texts)}


def test_highlight_is_one_pass(spark):
    assert one(spark, "Redis 1 m", lambda c: T.highlight(c, ["redis", "1", "m"], "\x1b[1;33m", "\x1b[0m")) == "\x1b[1;33mRedis\x1b[0m \x1b[1;33m1\x1b[0m \x1b[1;33mm\x1b[0m"


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT glintdex_tokenize('the Redis-cache') a, glintdex_tokenize_phrase('the Redis') b, glintdex_tokenize_filename('the-x.yml') c, glintdex_bm25(1, 1, 1, 1, 1) d").first()
    assert (row["a"], row["b"], row["c"]) == (["redis", "cache"], ["the", "redis"], ["the", "x"])
    assert row["d"] == pytest.approx(0.287682, abs=1e-6)


@pytest.mark.parametrize(
    ("raw", "terms", "phrase"),
    [('"spring boot"', ["spring", "boot"], True), ('"spring boot', ["spring", "boot"], False), ('"', [], False), ('""', [], False), (None, [], False), ('"the cat"', ["the", "cat"], True), ("the cat", ["cat"], False)],
)
def test_parse(raw, terms, phrase):
    assert (parse(raw).terms, parse(raw).phrase) == (terms, phrase)


def test_modes():
    assert QuerySpec('"a b"', regex=True).mode == "regex"
    assert QuerySpec('"a b"', fuzzy=True).mode == "phrase"
    assert QuerySpec("a", fuzzy=True, prefix=True).mode == "fuzzy"
    assert QuerySpec("a", prefix=True).mode == "prefix"
    assert QuerySpec("a").mode == "keyword"


def test_sizes_and_durations():
    assert [parse_size(x) for x in ("10", "1KB", " 2mb ", "1GB", "", None)] == [10, 1024, 2 << 20, 1 << 30, None, None]
    assert parse_since("2d", 10**12) == 10**12 - 2 * 86_400_000
    assert parse_since("3h", 10**12) == 10**12 - 3 * 3_600_000
    with pytest.warns(UserWarning):
        assert parse_size("1.5MB") is None
    with pytest.warns(UserWarning):
        assert parse_since("soon") is None
