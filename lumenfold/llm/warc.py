"""WARC archives and a two-level capture index.

Writing: each page becomes a gzip member with one WARC/1.1 record, a response, or a revisit of the page with the same
payload and the smallest page_id. Tasks write files of their own names in the shared folder; a table lists the
captures of the tasks that succeeded, so that what a lost executor left behind is never read.

Index: captures are sorted by key (reversed host, path, query, then page_id), and each task compresses its range of
the keys in blocks of LINES lines. The directory keeps the first key of each block with its place. Looking keys up means a
binary search in the directory, one range read of the block, and a binary search within it. The directory (a row for
LINES captures) is broadcast up to DIRECTORY rows. Beyond that, every PAGE-th entry of it is, and the entries of one
page are searched where the keys that fall into it are.

A null html is an empty payload. A null url is archived under an empty target; a null page_id under an empty id: it is never
referred to, and such a record is a response if no page with an id has its payload. Rows that share payload and
smallest page_id are all responses. Payloads of any length are written whole. No pages, no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, written

LINES = 1000
#: Most rows of a directory that is broadcast, and entries to a page of a larger one.
DIRECTORY, PAGE = 200_000, 1000
#: Bytes of an archive after which a task begins another, and of one read.
ARCHIVE, READ = 1 << 30, 8 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, file string, offset long, length long"
ENTRIES = "first string, file string, offset long, length long, part int, number long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: com,example)/path?query, lower-case host, without www, default port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    name = ",".join(reversed(host.split(".")))
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{name}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Index key: SURT without spaces or line ends, then the page's id, in fixed width."""
    word = "".join(c if c > " " else f"%{ord(c):02X}" for c in surt(url))
    return f"{word} " + ("-" if page_id is None else f"{page_id + 2**63:020d}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {key}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record. A revisit holds the HTTP header only, whose Content-Length is the payload's."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    line = lambda s: "".join(c if c >= " " else f"%{ord(c):02X}" for c in s)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, capture_key(url, page_id))), ("WARC-Date", DATE), ("WARC-Target-URI", line(url or "")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, capture_key(refers_url, refers_to))), ("WARC-Refers-To-Target-URI", line(refers_url or "")), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines.decode().split("\r\n")[1:] if x)
    return {k.lower(): v for k, v in pairs}


def parse(data: bytes) -> dict:
    """Columns of RECORDS, and the payload of a response. A response's digest and length are taken anew and checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = _fields(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, said = int(_fields(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    response = h["warc-type"] == "response"
    if response and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"damaged record {h['warc-record-id']}")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said, "record_type": h["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": payload if response else None}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _file_name(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "refers_url")), strict=True):
                    page_id, url, payload, refers_to, refers_url = (x.as_py() for x in r)
                    if out is None or at >= ARCHIVE:
                        if out:
                            out.close()
                        name, at = _file_name(folder, "warc"), 0
                        system, path = _system(name)
                        out = system.open_output_stream(path, compression=None)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(record(page_id, url, payload.encode(), refers_to, refers_url)) + z.flush()
                    out.write(data)
                    rows.append((capture_key(url, page_id), name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return run


def _make_folder(folder: str) -> None:
    system, path = _system(folder)
    system.create_dir(path, recursive=True)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page; the captures: key, file, offset, length."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("hash", F.sha2(F.encode("payload", "UTF-8"), 256))
    keys = written(rows.select("page_id", "url", "hash"), "payload-keys")
    firsts = keys.groupBy("hash").agg(F.min("page_id").alias("refers_to"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("s"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    firsts = written(firsts.select(F.col("hash").alias("h"), "refers_to", F.col("s.url").alias("refers_url")), "payload-firsts")
    revisits = keys.join(firsts, F.col("hash") == F.col("h")).where("page_id is null or page_id > refers_to").select(F.col("page_id").alias("p"), "h", "refers_to", "refers_url").distinct()
    revisits = written(revisits, "revisits")
    joined = rows.join(revisits.hint("shuffle_hash"), (F.col("hash") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    _make_folder(folder)
    return written(joined.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(_writer(folder), CAPTURES), "captures")


def _index_writer(folder: str, lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, number = _file_name(folder, "cdx"), None, 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out, at, number, held
            if out is None:
                system, path = _system(name)
                out = system.open_output_stream(path, compression=None)
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = z.compress("".join(f"{k} {o} {n} {f}\n" for k, f, o, n in held).encode()) + z.flush()
            out.write(data)
            row = [[held[0][0]], [name], [at], [len(data)], [TaskContext.get().partitionId()], [number]]
            at, number, held = at + len(data), number + 1, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["first", "file", "offset", "length", "part", "number"])

        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                    held.append(row)
                    if len(held) == lines:
                        yield flush()
            if held:
                yield flush()
        finally:
            if out:
                out.close()

    return run


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write the key-sorted blocks; the directory: first key, file, offset, length of each block."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _make_folder(folder)
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(_index_writer(folder, lines), ENTRIES), "directory")


def _places(firsts: list[str], key: str) -> range:
    """Entries whose blocks can hold the key; more than one where it fills whole blocks."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def _finder(entries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [e[0] for e in entries.value]
        for batch in batches:
            rows = [(k, *entries.value[p][1:]) for k in batch.column("key").to_pylist() for p in _places(firsts, k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "offset", "length"])

    return run


def _by_page(left, right):
    """Block of each key among the directory entries of one page."""
    entries = sorted(right[["first", "file", "offset", "length"]].itertuples(index=False, name=None))
    firsts = [e[0] for e in entries]
    return pd.DataFrame([(k, *entries[p][1:]) for k in left["key"] for p in _places(firsts, k)], columns=["key", "file", "offset", "length"])


def _block_of(keys: DataFrame, directory: DataFrame, most: int) -> DataFrame:
    """Of each key, the blocks that can hold it."""
    sc = keys.sparkSession.sparkContext
    if directory.count() <= most:
        entries = sc.broadcast(sorted((r.first, r.file, r.offset, r.length) for r in directory.collect()))
        return keys.mapInArrow(_finder(entries), CAPTURES)
    paged = directory.withColumn("page", F.concat_ws("-", "part", F.floor(F.col("number") / PAGE)))
    tops = sc.broadcast(sorted((r["lowest"], r.page, 0, 0) for r in paged.groupBy("page").agg(F.min("first").alias("lowest")).collect()))
    placed = keys.mapInArrow(_finder(tops), CAPTURES).select("key", F.col("file").alias("page"))
    return placed.groupBy("page").cogroup(paged.groupBy("page")).applyInPandas(_by_page, CAPTURES)


def _block_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures of the keys, which come sorted by block: each block is read once."""
    now, keys, lines = None, [], []
    for batch in batches:
        rows = []
        for key, *block in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
            if block != now:
                now = block
                system, path = _system(block[0])
                with system.open_input_file(path) as f:
                    lines = zlib.decompress(f.read_at(block[2], block[1]), 31).decode().split("\n")[:-1]
                keys = [x.rsplit(" ", 3)[0] for x in lines]
            i = bisect_right(keys, key) - 1
            while i >= 0 and keys[i] == key:
                k, offset, length, file = lines[i].rsplit(" ", 3)
                rows.append((k, file, int(offset), int(length)))
                i -= 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "offset", "length"])


def find_captures(keys: DataFrame, directory: DataFrame, most: int = DIRECTORY) -> DataFrame:
    """Captures (key, file, offset, length) of a column `key` of capture keys."""
    blocks = _block_of(keys.select("key").distinct(), directory, most)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(_block_reader, CAPTURES)


def _record_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of captures sorted by place; neighbours come with one read."""
    fields = [x.split(" ")[0] for x in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in RECORDS.split(", ")])
    name, source = None, None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        i, out = 0, []
        while i < len(rows):
            file, start, length = rows[i]
            j, end = i + 1, start + length
            while j < len(rows) and rows[j][0] == file and rows[j][1] <= end + 65536 and rows[j][1] + rows[j][2] - start <= READ:
                end = max(end, rows[j][1] + rows[j][2])
                j += 1
            if file != name:
                if source:
                    source.close()
                system, path = _system(file)
                name, source = file, system.open_input_file(path)
            data = source.read_at(end - start, start)
            for _, o, n in rows[i:j]:
                found = parse(zlib.decompress(data[o - start : o - start + n], 31))
                out.append({k: found[k] for k in fields})
            i = j
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if source:
        source.close()


def read_records(captures: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of captures, by range reads of the archives."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.repartition(n, "file", F.floor(F.col("offset") / READ)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_record_reader, RECORDS)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    captures = write_archives(table(spark, sf_dir, "pages"), f"{folder}/archives")
    directory = build_index(captures, f"{folder}/index")
    found = find_captures(captures.select("key"), directory)
    return read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base 32 of 20 bytes: each 5 hexadecimal digits make 4 letters.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS hex, coalesce(url, '') AS url FROM pages),
g AS (SELECT b, min(page_id) AS low FROM p GROUP BY b),
d AS (SELECT p.page_id, p.url, octet_length(p.b) AS n, g.low,
      array_to_string(list_transform(range(8), lambda i: (
        array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(p.hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), ''))), '') AS digest
      FROM p JOIN g ON p.b = g.b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to, url FROM d
"""
