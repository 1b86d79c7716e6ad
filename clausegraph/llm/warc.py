"""WARC archives with a two-level capture index.

Archives: each task writes the pages that it reads to one file, a gzip member a record. Of records
with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a
response; the others are revisits that name it and hold no payload.

Index: one line a record, keyed by the url with its host reversed. Lines are sorted by key over all
files and cut into compressed blocks of BLOCK_LINES; each index file has a directory beside it with
the first key of each block, and one list has the first key of each index file. A lookup searches
the list, then one directory, both by bisection, and range-reads the blocks that can hold the key;
the lines give the ranges of the records. Reading many keys back goes the same way in tasks: the
keys, in order, find their blocks by bisection of the list and the directories; each block is range-
read once, its lines are bisected for the keys asked of it, and the records are range-read in the
order of their places. A key with many records has many blocks, which meet in different tasks.

The html never shuffles: only (page_id, digest) does. The table of repeated payloads is broadcast if
its counted size is within bounds; else pages join it by shuffle.

Defined cases: a null html is an empty payload; a null url has the key "-" and no target header; a
null page_id stays null and never is what others refer to; rows that repeat a page_id and its
payload are the same capture and all of one type; an empty table writes nothing and reads nothing;
other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, cut, file_system, load, new_folder, slices

BLOCK_LINES, INDEX_ROWS, LEVEL = 3000, 200_000, 4
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, digest string, type string, path string, at long, size long"


def reversed_host_key(url: str | None) -> str:
    """com,example,www)/path?query of http://www.example.com/path?query; white space and control characters are quoted."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + quote(tail, safe="/:?#[]@!$&'()*+,;=%~")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=0 if page_id is None else (1 << 64) | (page_id & ((1 << 64) - 1)))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if not n >> 64:
        return None
    low = n & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record in WARC 1.1; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        *([f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~' + chr(39))}"] if url is not None else []),
        f"WARC-Date: {DATE}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(member: bytes) -> dict:
    """page_id, url, type, refers_to, payload (None for a revisit), payload_bytes, payload_digest of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "refers_to": None, "payload": None, "payload_bytes": length, "payload_digest": named}
    if fields["WARC-Type"] == "revisit":
        return out | {"refers_to": page_of(fields["WARC-Refers-To"])}
    if len(payload) != length or digest_of(payload) != named:
        raise ValueError("a payload does not have its digest")
    return out | {"payload": payload}


class _File:
    """A file under another name until it is complete."""

    def __init__(self, path: str):
        self.fs, self.inner = file_system(path)
        self.temp = f"{self.inner}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes) -> int:
        """Where it was written."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        from pyarrow import fs

        self.out.close()
        if self.fs.get_file_info(self.inner).type != fs.FileType.NotFound:
            self.fs.delete_file(self.inner)  # left by an earlier attempt of this task
        self.fs.move(self.temp, self.inner)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one file a task under folder; returns the index entries (ENTRY)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    named = rows.where(F.octet_length("html") >= least_bytes)
    groups = cut(named.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select(F.col("sha1").alias("_sha1"), "first"))
    if groups.count() * 96 <= BROADCAST_BYTES:
        marked = rows.join(F.broadcast(groups), F.col("sha1") == F.col("_sha1"), "left").select("page_id", "url", "html", "first")
    else:  # by page, so that no group of copies meets in one task
        narrow = named.select("page_id", "sha1").join(groups, F.col("sha1") == F.col("_sha1")).where("page_id <> first").select(F.col("page_id").alias("_page"), F.col("_sha1"), "first").distinct()
        marked = rows.join(narrow, (F.col("page_id") == F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, out = f"{folder}/{TaskContext.get().partitionId():08d}.warc.gz", None
        for batch in slices(batches):
            out = out or _File(path)
            entries = []
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = html.encode("utf-8")
                digest = digest_of(data)
                refers = first if first is not None and first != page_id else None
                member = _member(make_record(page_id, url, data, digest, refers))
                entries.append((reversed_host_key(url), page_id, digest, "response" if refers is None else "revisit", path, out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "digest", "type", "path", "at", "size"])
        if out:
            out.close()

    return cut(marked.mapInArrow(run, ENTRY))


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Writes sorted blocks, a directory a file, and the list of files under folder; returns the blocks: first_key, path, at, size."""
    files = max(1, -(-entries.count() // INDEX_ROWS))
    ordered = entries.repartitionByRange(files, "key", "page_id", "path", "at").sortWithinPartitions("key", "page_id", "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, out, lines, blocks = f"{folder}/{TaskContext.get().partitionId():08d}.cdx.gz", None, [], []

        def flush():
            data = _member("".join(lines).encode())
            blocks.append((lines[0].split(" ", 1)[0], path, out.write(data), len(data)))
            lines.clear()

        for batch in batches:
            for key, page_id, digest, kind, where, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _File(path)
                lines.append(f"{key} {STAMP} {'-' if page_id is None else page_id} {digest} {kind} {at} {size} {where}\n")
                if len(lines) == BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            out.close()
            directory = _File(path.removesuffix(".cdx.gz") + ".dir")
            directory.write("".join(f"{key} {at} {size}\n" for key, _, at, size in blocks).encode())
            directory.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["first_key", "path", "at", "size"])

    blocks = cut(ordered.mapInArrow(run, "first_key string, path string, at long, size long"))
    firsts = blocks.groupBy("path").agg(F.min("first_key").alias("key")).orderBy("path").collect()  # one row a file
    top = _File(f"{folder}/files.list")
    top.write("".join(f"{r['key']} {r['path']}\n" for r in firsts).encode())
    top.close()
    return blocks


def _range(path: str, at: int, size: int) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, at)


def _whole(path: str) -> list[list[str]]:
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        return [line.split(" ") for line in f.read().decode().splitlines()]


def _may_hold(firsts: list[str], key: str) -> range:
    """The entries, by their first keys in order, that can hold the key: a run of equal keys may begin in the entry before."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def lookup(index_folder: str, url: str | None) -> list[dict]:
    """The records of a url, by bisection of the list and a directory and range reads of blocks and records."""
    key, found = reversed_host_key(url), []
    files = _whole(f"{index_folder}/files.list")
    for f in _may_hold([x[0] for x in files], key):
        path = files[f][1]
        directory = _whole(path.removesuffix(".cdx.gz") + ".dir")
        for b in _may_hold([x[0] for x in directory], key):
            lines = zlib.decompress(_range(path, int(directory[b][1]), int(directory[b][2])), 31).decode().splitlines()
            at = bisect.bisect_left(lines, key + " ")
            while at < len(lines) and lines[at].startswith(key + " "):
                _, _, _, _, _, start, size, where = lines[at].split(" ", 7)
                found.append(read_record(_range(where, int(start), int(size))))
                at += 1
    return found


def find_blocks(keys: DataFrame, index_folder: str) -> DataFrame:
    """The blocks that can hold each key of `keys` (column key), by bisection of the list and of directories: key, path, at, size. A task holds the list and one directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, firsts, path = None, [], [], None
        for batch in slices(batches):
            files = files if files is not None else _whole(f"{index_folder}/files.list")
            firsts = firsts or [x[0] for x in files]
            out: tuple[list, ...] = ([], [], [], [])
            for key in batch.column(0).to_pylist():
                for f in _may_hold(firsts, key):
                    if files[f][1] != path:
                        path = files[f][1]
                        directory = _whole(path.removesuffix(".cdx.gz") + ".dir")
                        held = [x[0] for x in directory]
                    for b in _may_hold(held, key):
                        for column, value in zip(out, (key, path, int(directory[b][1]), int(directory[b][2])), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "path", "at", "size"])

    files = max(1, -(-keys.count() // INDEX_ROWS))
    return keys.select("key").repartitionByRange(files, "key").sortWithinPartitions("key").mapInArrow(run, "key string, path string, at long, size long")


def look_up(keys: DataFrame, index_folder: str) -> DataFrame:
    """The places (path, at, size) of the records of the distinct keys of `keys` (column key), through the index's files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lines = None, []
        for batch in slices(batches, 4096):
            out: tuple[list, ...] = ([], [], [])
            for key, *here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != place:
                    place, lines = here, zlib.decompress(_range(*here), 31).decode().splitlines()
                for i in range(bisect.bisect_left(lines, key + " "), len(lines)):
                    if not lines[i].startswith(key + " "):
                        break
                    _, _, _, _, _, at, size, path = lines[i].split(" ", 7)
                    for column, value in zip(out, (path, int(at), int(size)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "at", "size"])

    found = cut(find_blocks(keys, index_folder))
    tasks = max(1, min(found.select("path", "at").distinct().count(), 100_000))
    return found.repartition(tasks, "path", "at").sortWithinPartitions("path", "at", "key").mapInArrow(run, "path string, at long, size long")


def read_archives(lines: DataFrame, files: int, with_payload: bool = False) -> DataFrame:
    """The records at these places, read file by file in their order."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: 5 + with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for batch in slices(batches):
            rows = []
            for where, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != path:
                    if f is not None:
                        f.close()
                    path = where
                    system, inner = file_system(path)
                    f = system.open_input_file(inner)
                r = read_record(f.read_at(size, at))
                rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"], r["payload"])[: 5 + with_payload])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload])
        if f is not None:
            f.close()

    return lines.repartition(max(1, files), "path").sortWithinPartitions("path", "at").mapInArrow(run, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    entries = write_archives(load(spark, sf_dir, "pages"), folder)
    write_index(entries, folder)
    return read_archives(look_up(entries.select("key").distinct(), folder), entries.select("path").distinct().count())
