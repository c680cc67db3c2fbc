import base64
import gzip
import hashlib

import pyarrow.fs
import pytest

from glintdex.llm import warc

KINDS = "page_id long, url string, html string, file string"


def plain(rows, least=0):
    out = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None]
        ref = max(same, default=None)
        revisit = len(raw) >= least and ref is not None and ref != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", ref if revisit else None))
    return sorted(out, key=str)


def sample():
    rows = [(i, f"https://{'abc'[i % 3]}.example.com/p/{i % 7}?q=ä {i}#frag", f"<p>{i % 11}</p>" if i % 2 else f"é{i}", "x") for i in range(120)]
    return rows + [
        (200, None, None, "x"),
        (201, "not a url", "", "x"),
        (202, " http://user@HOST:80\n/x\ty ", "<p>1</p>", "x"),
        (203, "http://[broken", "z" * 300_000, "x"),
        (None, "http://a/", "<p>1</p>", "x"),
        (119, "https://other.example.com/", "<p>9</p>", "x"),
        (119, "https://other.example.com/", "<p>9</p>", "x"),
    ]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)


def test_against_plain(spark):
    rows = sample()
    got = sorted((tuple(r) for r in warc.digests(spark.createDataFrame(rows, KINDS).repartition(3)).collect()), key=str)
    assert got == plain(rows)


def test_threshold_and_nothing(spark):
    pages = spark.createDataFrame(sample(), KINDS)
    folder, shards = warc.archive(pages, least=9)
    got = sorted((tuple(r) for r in warc.look_up(pages, folder, shards).collect() if r["page_id"] not in (None, 119)), key=str)
    assert got == [r for r in plain(sample(), 9) if r[0] not in (None, 119)]
    assert warc.digests(pages.where("false")).count() == 0


def test_files_are_archives(spark):
    folder, shards = warc.archive(spark.createDataFrame(sample(), KINDS))
    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    raw = b"".join(gzip.decompress(files.open_input_stream(n, compression=None).read()) for n in names)
    assert raw.count(b"WARC/1.1\r\n") == len(sample())
    assert sum(len(files.open_input_stream(f"{base}/{s[2]}.idx", compression=None).read().splitlines()) for s in shards) >= len(sample()) // 7
    reader = warc.Archive(folder, shards)
    assert list(reader.find(warc.capture_key("http://nowhere/", 1))) == []


def test_keys():
    assert warc.capture_key("https://www.Example.com:8080/a?b#c", 5) == f"com,example,www:8080)/a?b {5 + (1 << 63):020d}"
    for url in (" http://user@HOST:80\n/x\ty ", "a b", None, "http://x"):
        assert warc.capture_key(warc.clean_url(url), 1) == warc.capture_key(url, 1)
    assert warc.capture_key("http://a/", 2) < warc.capture_key("http://a/", 10)
