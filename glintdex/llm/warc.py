"""WARC archives with a two-level capture index.

Each page becomes one WARC record, a gzip member of its own.  Of pages with equal payloads, the one with the largest
id is a response; the others are revisits that refer to it.  The capture index sorts keys (the URL with its host
reversed, then the page's id) over all archives.  Its lines lie in gzip blocks of ``BLOCK`` lines, in one shard for
each range of keys; a sparse directory beside each shard has every block's first key and place.  A look-up bisects the
list of shards, then a shard's directory, then the one block that it reads, and reads the record by its byte range.

Files go through pyarrow's file systems into the folder that driver and executors share.  A task names its files
anew at each attempt and hands on the names, and these tables are written, so that what a lost attempt left is never
read.  Only the list of shards (one row for each task of the index) is held by the driver.

Defined results: a null html is an empty payload; a null or odd URL has a key as far as it can be read; a null page_id
comes before all others; rows that repeat the largest page_id of a payload are all responses; repeated rows are records
of their own; payloads of under ``least`` bytes are never revisited; an empty table makes no archives and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintdex.llm.shared import Scratch, narrow

BLOCK = 1000
#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: A payload shared by this many thousandths of all pages or more is joined by broadcast: at most 1,000 of them.
HOT_SHARE = 1000
RECORD_ID = "urn:glintdex:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def clean_url(url: str | None) -> str:
    """On one line and without blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", (url or "").strip())


def capture_key(url: str | None, page_id: int | None) -> str:
    """Host reversed by its labels, then path and query; then the id, so that keys sort as both do."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", clean_url(url))
    m = re.match(r"//([^/?#]*)([^#]*)", rest)
    host, path = (m[1], m[2]) if m else ("", rest.partition("#")[0])
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    surt = ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path or "/")
    return surt + " " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers: tuple[int | None, str | None] | None, date: str) -> bytes:
    """One WARC record.  A revisit's block is its HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD_ID}{refers[0]}>", f"WARC-Refers-To-Target-URI: {clean_url(refers[1])}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of one uncompressed record."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def decide(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """``pages`` (page_id, url, html) with ``ref`` (id and URL of the response), null for a response.

    Most payloads occur once; only those that several pages share are joined.  The few that very many share are
    joined by broadcast and kept out of the shuffled join.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("sum", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    known = own.where(F.col("bytes") >= least).groupBy("sum", "bytes").agg(F.max(F.struct("page_id", "url")).alias("ref"), F.count("*").alias("n"))
    shared = scratch.keep(known.where("n > 1"), "payloads")
    hot_from = max(1000, pages.count() // HOT_SHARE)
    hot, cold = (shared.where(F.col("n") >= hot_from), shared.where(F.col("n") < hot_from))
    out = own.join(F.broadcast(hot.select("sum", "bytes", F.col("ref").alias("hot_ref"))), ["sum", "bytes"], "left")
    out = out.withColumn("at", F.when(F.col("hot_ref").isNull(), F.col("sum")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    out = out.join(cold.select(F.col("sum").alias("at"), "bytes", F.col("ref").alias("cold_ref")), ["at", "bytes"], "left")
    ref = F.coalesce("hot_ref", "cold_ref")
    return out.select("page_id", "url", "html", F.when(~ref.page_id.eqNullSafe(F.col("page_id")), ref).alias("ref"))


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes all pages to archives in ``folder``; returns their captures: key, file, offset, length."""
    decided = decide(narrow(pages, page_id="long", url="string", html="string"), scratch, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        out = name = None
        for batch in batches:
            captures = []
            for page_id, url, html, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                kind, refers = ("revisit", (ref["page_id"], ref["url"])) if ref else ("response", None)
                member = gzip.compress(_record(kind, page_id, url, payload_digest(payload), payload, refers, date), 5, mtime=0)
                if out is None or out.tell() > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                captures.append((capture_key(url, page_id), name, out.tell(), len(member)))
                out.write(member)
            if out is not None:
                out.flush()
            columns = list(zip(*captures, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return scratch.keep(decided.mapInArrow(run, "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, scratch: Scratch) -> list[tuple[str, str, str]]:
    """Writes the shards and their directories; returns (first key, last key, name) of each shard, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, out, directory, held, first, last = uuid.uuid4().hex, None, [], [], None, None

        def flush():
            block = gzip.compress(("\n".join(x for _, x in held) + "\n").encode(), 6, mtime=0)
            directory.append(f"{held[0][0]}\t{out.tell()}\t{len(block)}\n")
            out.write(block)
            held.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = files.open_output_stream(f"{base}/{name}.cdx.gz", compression=None), key
                held.append((key, f"{key} {json.dumps([file, offset, length])}"))
                last = key
                if len(held) == BLOCK:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with files.open_output_stream(f"{base}/{name}.idx") as f:
                f.write("".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (first, last, name)], ["first", "last", "name"])

    dealt = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    shards = scratch.keep(dealt.mapInArrow(run, "first string, last string, name string"), "shards").collect()
    return sorted(((s["first"], s["last"], s["name"]) for s in shards), key=lambda s: (s[0].encode(), s[1].encode()))


class Archive:
    """Reads records by URL and page id through the index."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]):
        self.files, self.base = pyarrow.fs.FileSystem.from_uri(folder)
        self.shards = shards
        self.firsts = [s[0].encode() for s in shards]
        self.lasts = [s[1].encode() for s in shards]
        self.opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directories: OrderedDict[str, tuple[list[bytes], list[tuple[int, int]]]] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], tuple[list[bytes], list[bytes]]] = OrderedDict()
        self.payloads: OrderedDict[str, tuple[int, str]] = OrderedDict()

    @staticmethod
    def _cached(cache: OrderedDict, key, most: int, make):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > most:
                cache.popitem(last=False)
        return cache[key]

    def _range(self, name: str, offset: int, length: int) -> bytes:
        f = self._cached(self.opened, name, 64, lambda: self.files.open_input_file(f"{self.base}/{name}"))
        return f.read_at(length, offset)

    def _directory(self, shard: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        def make():
            with self.files.open_input_stream(f"{self.base}/{shard}.idx", compression=None) as f:
                rows = [x.split(b"\t") for x in f.read().splitlines()]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._cached(self.directories, shard, 16, make)

    def _block(self, shard: str, place: tuple[int, int]) -> tuple[list[bytes], list[bytes]]:
        def make():
            lines = gzip.decompress(self._range(f"{shard}.cdx.gz", *place)).splitlines()
            return [b" ".join(x.split(b" ", 2)[:2]) for x in lines], lines

        return self._cached(self.blocks, (shard, place[0]), 16, make)

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key."""
        want = key.encode()
        s = bisect.bisect_left(self.lasts, want)
        while s < len(self.shards) and self.firsts[s] <= want:
            shard = self.shards[s][2]
            firsts, places = self._directory(shard)
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(firsts) and firsts[b] <= want:
                keys, lines = self._block(shard, places[b])
                for k in range(bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)):
                    yield tuple(json.loads(lines[k].split(b" ", 2)[2]))
                b += 1
            s += 1

    def record(self, capture: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        return parse_record(zlib.decompress(self._range(*capture), 31))

    def _response(self, key: str) -> tuple[int, str]:
        """Length and digest of the full payload that the response with this key holds."""

        def make():
            for capture in self.captures(key):
                fields, block = self.record(capture)
                if fields["warc-type"] == "response":
                    payload = block.partition(CRLF * 2)[2]
                    return len(payload), payload_digest(payload)
            raise ValueError(f"no response for {key}")

        return self._cached(self.payloads, key, 4096, make)

    def find(self, key: str) -> Iterator[tuple[int | None, int, str, str, int | None]]:
        """page_id, bytes and digest of the full payload, type, and the response's page_id, of each record with this key."""
        number = lambda field: int(x) if (x := field.strip("<>").removeprefix(RECORD_ID)) else None
        for capture in self.captures(key):
            fields, block = self.record(capture)
            page_id = number(fields["warc-record-id"])
            if fields["warc-type"] == "response":
                payload = block.partition(CRLF * 2)[2]
                yield page_id, len(payload), payload_digest(payload), "response", None
            else:
                ref = number(fields["warc-refers-to"])
                yield page_id, *self._response(capture_key(fields["warc-refers-to-target-uri"], ref)), "revisit", ref


def look_up(wanted: DataFrame, folder: str, shards: list[tuple[str, str, str]]) -> DataFrame:
    """Every record of the pages in ``wanted`` (page_id, url), read from the archives."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, shards)
        for batch in batches:
            found = [x for key in batch.column(0).to_pylist() for x in archive.find(key)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [x.split()[0] for x in kinds.split(", ")])

    dealt = wanted.select("page_id", "url").mapInArrow(keys, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, kinds)


def archive(pages: DataFrame, least: int = 0) -> tuple[str, list[tuple[str, str, str]]]:
    """Writes archives and index; returns their folder and the list of shards."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    captures = write_archives(pages, folder, scratch, least)
    shards = write_index(captures, folder, scratch)
    scratch.drop("payloads", "captures", "shards")
    return folder, shards


def digests(pages: DataFrame) -> DataFrame:
    """Archives all pages, then looks every page up again."""
    folder, shards = archive(pages)
    return look_up(narrow(pages, page_id="long", url="string"), folder, shards)



#: The same in DuckDB's SQL; each 20 bits of the SHA-1 are four characters of base32.
ORACLE = """
WITH own AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
last AS (SELECT h, max(page_id) AS ref FROM own GROUP BY h)
SELECT page_id, CAST(strlen(own.h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = ref THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> ref THEN ref END AS refers_to
FROM own JOIN last ON own.h = last.h
"""
