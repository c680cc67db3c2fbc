import os
import time

import pytest

from glintdex import cli
from glintdex.engine import Engine
from glintdex.sources import docfs, settings
from glintdex.sources.storage import Corrupted, Locked, Missing, Store, lock


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    files = {
        "notes.txt": "redis caching notes",
        "guide.md": "spring boot guide",
        "image.png": "x",
        "binary.exe": "x",
        ".dot.txt": "dotted words",
        "_under.txt": "under words",
        "node_modules/lib.txt": "ignored",
        ".hidden/secret.txt": "hidden",
        "sub/deep/nested.java": "class Nested",
        "empty.txt": "",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "latin.txt").write_bytes(b"caf\xe9 cr\xe8me")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "home"))


def found(engine, query, **options):
    return {r["file_name"] for r in engine.search(query, **options).collect()}


def test_listing(spark, tree):
    rows = {r["file_name"]: r["supported"] for r in docfs.listing(spark, str(tree)).collect()}
    assert set(rows) == {"notes.txt", "guide.md", "image.png", "binary.exe", ".dot.txt", "_under.txt", "nested.java", "empty.txt", "latin.txt"}
    assert not rows["image.png"]
    assert rows[".dot.txt"]
    assert docfs.listing(spark, str(tree / ".hidden")).count() == 0
    assert docfs.listing(spark, str(tree / "nowhere")).count() == 0


def test_scan_again_and_again(engine, tree):
    assert engine.count_indexable(str(tree)) == 7
    first = engine.add(str(tree))
    assert (first.indexed, first.updated, first.removed, first.skipped, first.errors) == (6, 0, 0, 2, 1)
    assert found(engine, "redis") == {"notes.txt"}
    assert found(engine, "dotted") == {".dot.txt"}
    assert found(engine, "caf") == {"latin.txt"}
    assert found(engine, "hidden") == set()

    later = time.time() + 100
    (tree / "notes.txt").write_text("docker instead")
    os.utime(tree / "notes.txt", (later, later))
    (tree / "guide.md").unlink()
    (tree / "new.txt").write_text("brand new")
    second = engine.add(str(tree))
    assert (second.indexed, second.updated, second.removed, second.new) == (2, 1, 1, 1)
    assert found(engine, "redis") == set()
    assert found(engine, "docker brand") == {"notes.txt", "new.txt"}
    assert engine.history() and engine.history()[0].endswith("\tdocker brand")

    rows = engine.top("brand").collect()
    assert rows[0]["snippet"] == "brand new"
    assert engine.stats()["overview"].first()["documents"] == 6
    assert engine.remove(str(tree)) == 6
    assert found(engine, "docker") == set()
    engine.reset()
    assert not engine.store.exists()


def test_watch(engine, tree):
    engine.add(str(tree))
    events = []
    options = {"available_now": True, "on_event": lambda what, path: events.append((what, os.path.basename(path)))}
    engine.watch(**options).awaitTermination()
    events.clear()
    (tree / "fresh.txt").write_text("brandnew")
    (tree / "notes.txt").unlink()
    engine.watch(**options).awaitTermination()
    assert set(events) == {("Indexed", "fresh.txt"), ("Removed", "notes.txt")}
    assert found(engine, "brandnew redis") == {"fresh.txt"}


def test_store(spark, engine, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/none")
    assert not store.is_corrupted()
    with pytest.raises(Missing):
        store.load()
    engine.add(str(tree))
    assert not engine.store.is_corrupted()
    name = engine.store.manifest()["name"]
    (tmp_path / "home" / "index" / name / "manifest.json").write_text('{"format": 1, "tables": []}')
    crc = tmp_path / "home" / "index" / name / ".manifest.json.crc"
    crc.unlink(missing_ok=True)
    assert engine.store.is_corrupted()
    with pytest.raises(Corrupted):
        engine.store.load()
    with pytest.raises(Missing):
        engine.search("redis")


def test_lock(tmp_path):
    path = str(tmp_path / "x" / "lock")
    with lock(path), pytest.raises(Locked), lock(path):
        pass
    import socket

    with open(path, "w") as f:
        f.write(f"999999999@{socket.gethostname()}")
    with lock(path):
        pass
    assert not os.path.exists(path)


def test_ids_of_a_large_table(spark, tmp_path):
    """Each row of a stored table gets an id of its own when the result is written, however partitions are coalesced."""
    from pyspark.sql import functions as F

    from glintdex.operators.index import assign_ids

    n = 400_000
    spark.range(n).select(F.concat(F.lit("/x/"), F.xxhash64("id").cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("text "), 5).alias("content")).write.parquet(f"{tmp_path}/paths")
    stored = spark.read.parquet(f"{tmp_path}/paths")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            assign_ids(stored, 5).write.parquet(f"{tmp_path}/{coalesce}")
            got = spark.read.parquet(f"{tmp_path}/{coalesce}")
            row = got.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
            assert (row["n"], row["ids"], row["low"], row["high"]) == (n, n, 5, n + 4)
            assert got.join(stored, "path", "left_anti").isEmpty()
            ordered = got.orderBy("path").select("doc_id").limit(1000).collect()
            assert [r["doc_id"] for r in ordered] == list(range(5, 1005))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_read_errors_are_not_corruption(engine, tree, tmp_path, monkeypatch):
    engine.add(str(tree))
    store = engine.store

    def broken(path):
        raise OSError("the network is down")

    monkeypatch.setattr(store, "_read", broken)
    with pytest.raises(OSError, match="network"):
        engine.index()
    with pytest.raises(OSError, match="network"):
        store.is_corrupted()
    monkeypatch.undo()
    assert engine.store.load().docs.count() == 6


def test_pointers(engine, tree, tmp_path):
    """A new pointer never leaves a moment without one; the last two snapshots stay."""
    for k in range(4):
        (tree / f"more{k}.txt").write_text("further words")
        engine.add(str(tree))
    names = os.listdir(tmp_path / "home" / "index")
    assert sorted(n for n in names if n.startswith("CURRENT-")) == ["CURRENT-3", "CURRENT-4"]
    assert sum(n.startswith("v-") for n in names) == 2
    assert engine.location()["bytes"] > 0


def test_watch_holds_the_lock(engine, tree):
    engine.add(str(tree))
    running = engine.watch()
    try:
        with pytest.raises(Locked):
            engine.add(str(tree))
        with pytest.raises(Locked):
            engine.watch()
    finally:
        running.stop()
    engine.add(str(tree))


def test_setup_and_completion(spark, tmp_path, capsys):
    (tmp_path / "user" / "notes").mkdir(parents=True)
    (tmp_path / "user" / ".hidden").mkdir()
    (tmp_path / "user" / "notes" / "a.txt").write_text("redis words")
    home = ["--home", str(tmp_path / "h")]
    assert cli.main([*home, "setup", "-y", "--quick", "--user-home", str(tmp_path / "user")], spark) == 0
    config = settings.load(str(tmp_path / "h"))
    assert config.watched == [str(tmp_path / "user" / "notes")]
    assert config.max_text_bytes == settings.Config.quick().max_text_bytes
    assert cli.main(["completion"]) == 0
    assert "--min-size" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_settings(tmp_path, spark):
    home = str(tmp_path)
    config = settings.load(home)
    assert (config.max_text_bytes, config.max_pdf_bytes) == (15 << 20, 5 << 20)
    config.add("/a")
    config.add("/a")
    settings.save(home, config)
    assert settings.load(home).watched == ["/a"]
    assert settings.load(home).missing() == ["/a"]
    assert config.is_supported(".TXT") and config.is_ignored("node_modules") and config.remove("/a") and not config.remove("/a")
    for i in range(505):
        settings.remember(home, f"q{i}")
    settings.remember(home, "  ")
    assert settings.history(home, 2) == [x for x in settings.history(home, 600)][:2]
    assert len(settings.history(home, 600)) == 500
    assert settings.history(home, 1)[0].endswith("\tq504")
    assert settings.history_table(spark, home).count() == 500
    settings.clear_history(home)
    assert settings.history(home) == []
    with pytest.raises(ValueError, match="path"):
        settings.expand(" ")


def test_command_line(spark, tree, tmp_path, capsys):
    home = ["--home", str(tmp_path / "h")]
    assert cli.main([*home, "search", "redis"], spark) == 2
    assert cli.main([*home, "add", str(tree / "nowhere")], spark) == 2
    assert cli.main([*home, "add", str(tree)], spark) == 0
    assert cli.main([*home, "search", "redis"], spark) == 0
    assert "notes.txt" in capsys.readouterr().out
    assert cli.main([*home, "search", "nosuchword"], spark) == 1
    assert cli.main([*home, "remove", "/elsewhere"], spark) == 1
    for args in (["stats"], ["history"], ["config"], ["reset", "-y"]):
        assert cli.main([*home, *args], spark) == 0
