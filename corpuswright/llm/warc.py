"""WARC archives and a two-level capture index.

Archives hold one gzip member per record. Each writing task makes its own file in the shared folder and returns a row
per record with the file, offset and length; a task that is run again writes another file, and only the files of the
rows that were committed are ever named. The index is sorted by reversed-host URL key and page_id into parts. A part
is one file: zlib blocks of BLOCK lines, then a sparse directory with the first key of each block, then the
directory's place. Which part holds a key is known from the parts' first keys, at most PARTS of them. A lookup searches
those, reads the part's directory, searches it, reads one block by range, searches that, and reads the record by range.

Defined results: a null html is an empty payload; a null url has an empty key; a null page_id is archived and found
like any other and counts as larger than every other; rows equal in page_id and payload are all response or all
revisit; payloads of any size are passed on a few at a time; an empty table gives no archive and no rows; only
page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

BLOCK = 512  # index lines of a block
PARTS = 4096  # parts of an index at most, whose first keys every lookup task holds
SMALLEST = 100  # bytes from which equal payloads are revisits
TASK = 64 << 20  # compressed bytes of records that a task reads back
HELD = 16 << 20  # bytes of payloads in one batch
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.org/x?y -> org,a)/x?y; scheme, user, port and a leading www. are left out."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip())
    host, slash, path = re.match(r"([^/?#]*)(/?)(.*)", rest, re.S).groups()
    host = host.rpartition("@")[2].partition(":")[0].lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (slash or "/") + path if rest else ""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _line(key: str, page: int | None, rest: list) -> bytes:
    """An index line. JSON keeps any key on one line; its sort key is parsed back, never the raw bytes."""
    return json.dumps([key, page, *rest]).encode()


def _order(key: str, page: int | None) -> tuple[bytes, bool, int]:
    """As Spark orders (surt, page_id with nulls last)."""
    return key.encode("utf-8", "surrogatepass"), page is None, page or 0


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, record_type, refers_to."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # one row per payload that occurs again; its rows may be very many, which Spark splits in the join
    firsts = rows.where(F.col("n_bytes") >= SMALLEST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").select(F.col("digest").alias("_digest"), "first"), "firsts")
    met = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("n_bytes") >= SMALLEST), "left")
    again = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("_digest", "first")


def record(page: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. The payload of a revisit is left out; its length and digest stay in the header."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page is None else page}", f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>", f"X-Refers-To-Page-Id: {refers}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """Headers, and the payload of a response, checked against its digest and length."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    found = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(found["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = found["WARC-Payload-Digest"].removeprefix("sha256:")
    if found["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(found["X-Payload-Length"])):
        raise ValueError(f"payload of {found['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(found["X-Page-Id"]), "url": found["WARC-Target-URI"], "record_type": found["WARC-Type"], "payload": payload,
        "payload_bytes": int(found["X-Payload-Length"]), "payload_digest": digest, "refers_to": number(found.get("X-Refers-To-Page-Id", "")),
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder``; returns (surt, page_id, file, at, length), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            rows = []
            for page, url, payload, digest, n_bytes, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = gzip.compress(record(page, url, payload, n_bytes, digest, kind, refers), 3, mtime=0)
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                rows.append((surt(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["surt", "page_id", "file", "at", "length"])
        if out:
            out.close()

    columns = ("page_id", "url", "payload", "digest", "n_bytes", "record_type", "refers_to")
    rows = _typed(pages).withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
    return written(rows.select(*columns).mapInArrow(run, "surt string, page_id long, file string, at long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, parts: int) -> list[tuple[str, int | None, str]]:
    """Index parts in ``folder``; returns (first key, its page_id, file) of each, in order: at most PARTS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, out, first, at, directory, lines = f"{uuid.uuid4().hex}.cdx", None, None, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            packed = zlib.compress(b"\n".join(lines), 3)
            directory.append([*json.loads(lines[0])[:2], at, len(packed)])
            out.write(packed)
            at, lines = at + len(packed), []

        for batch in batches:
            for key, page, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}", compression=None), (key, page)
                lines.append(_line(key, page, rest))
                if len(lines) == BLOCK:
                    flush()
        if out:
            if lines:
                flush()
            packed = zlib.compress("\n".join(map(json.dumps, directory)).encode(), 3)
            out.write(packed + struct.pack("<QQ", at, len(packed)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], names=["surt", "page_id", "file"])

    order = (F.col("surt"), F.col("page_id").asc_nulls_last())
    ordered = captures.repartitionByRange(min(parts, PARTS), *order).sortWithinPartitions(*order)
    made = written(ordered.select("surt", "page_id", "file", "at", "length").mapInArrow(run, "surt string, page_id long, file string"), "parts").collect()
    return sorted(((r[0], r[1], r[2]) for r in made), key=lambda r: _order(r[0], r[1]))


class Part:
    """A part of the index, read by ranges."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.directory = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]
        self.keys = [_order(x[0], x[1]) for x in self.directory]
        self.block, self.lines, self.orders = -1, [], []

    def find(self, key: str, page: int | None) -> list[tuple[str, int, int]]:
        """(file, at, length) of the captures with this key and page."""
        want, found = _order(key, page), []
        at = max(0, bisect.bisect_left(self.keys, want) - 1)
        while at < len(self.keys) and self.keys[at] <= want:
            if at != self.block:
                _, _, place, length = self.directory[at]
                self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, place)).split(b"\n")]
                self.orders, self.block = [_order(x[0], x[1]) for x in self.lines], at
            lo, hi = bisect.bisect_left(self.orders, want), bisect.bisect_right(self.orders, want)
            found += [tuple(x[2:]) for x in self.lines[lo:hi]]
            at += 1
        return found


def lookup(wanted: DataFrame, parts: list[tuple[str, int | None, str]], index: str, archives: str, tasks: int = 0, payloads: bool = True) -> DataFrame:
    """The records of the wanted (url, page_id), distinct, read through the index by so many tasks (0: as many as the
    session's shuffles have), with or without their payloads."""
    schema = ARROW if payloads else pa.schema([f for f in ARROW if f.name != "payload"])
    out = OUT if payloads else OUT.replace("payload binary, ", "")
    if not parts:
        return wanted.sparkSession.createDataFrame([], out)
    firsts, files = [_order(k, p) for k, p, _ in parts], [f for _, _, f in parts]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = surt(url)
                want = _order(key, page)
                at = max(0, bisect.bisect_left(firsts, want) - 1)  # equal keys may begin in the part before
                while at < len(firsts) and firsts[at] <= want:
                    rows.append((at, key, page))
                    at += 1
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["part", "surt", "page_id"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(index)
        held, part = None, -1
        for batch in batches:
            rows = []
            for at, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    held, part = Part(store, f"{root}/{files[at]}"), at
                rows += held.find(key, page)
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["file", "at", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(archives)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                rows.append(parse(gzip.decompress(source.read_at(length, at))))
                held += len(rows[-1]["payload"])
                if not payloads:
                    del rows[-1]["payload"]
                elif held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    asked = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).distinct()
    placed = asked.mapInArrow(place, "part int, surt string, page_id long")
    dealt = placed.repartition("part", F.pmod(F.xxhash64("surt", "page_id"), F.lit(8))).sortWithinPartitions("part", "surt", F.col("page_id").asc_nulls_last())
    found = dealt.mapInArrow(locate, "file string, at long, length long")
    # ranges of 4 MB of a file go to one task, in order
    by = ("file", F.floor(F.col("at") / (4 << 20)))
    near = (found.repartition(tasks, *by) if tasks else found.repartition(*by)).sortWithinPartitions("file", "at")
    return near.mapInArrow(read, out)


OUT = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Archives and indexes ``pages`` in ``folder``, and reads every capture back through the index."""
    captures = write_archives(pages, f"{folder}/warc")
    n, size = captures.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = write_index(captures, f"{folder}/index", max(1, min(PARTS, -(-n // (16 * BLOCK)))))
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK))  # rows of a few numbers stand for whole records
    return lookup(pages, parts, f"{folder}/index", f"{folder}/warc", tasks, payloads)


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from its archived record."""
    found = round_trip(spark, pages, scratch(spark, "warc"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
