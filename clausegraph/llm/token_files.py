"""Token ids in files of fixed-width bit packing.

A file holds the documents of one shard in ascending doc_id order. Each id takes the fewest bits
that the vocabulary needs; ids are packed most significant bit first. A block ends after BLOCK_IDS
ids or more, at a document's end, and starts on a whole byte, so any block can be read and unpacked
alone with numpy.

    magic "TIDB1\\n" | blocks | footer | footer length (u64) | magic
    footer: bits u32, blocks u32, documents u64, ids u64,
            per block: byte offset u64, first document u64, first id u64,
            per document: doc_id i64, has an id u8, ids u32

Files are written under another name and moved when complete, so a task that runs twice leaves one
whole file. Readers use pyarrow's file systems on the folder that all machines share.

Defined cases: a null text is empty (the end id alone); a null doc_id comes first and stays null;
documents that repeat a doc_id are written each, ordered by text; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import cut, file_system, load, new_folder, slices
from clausegraph.llm.encode import default_path, encoder

MAGIC, BLOCK_IDS, END_ID, ROWS_A_SHARD, MOST_FILES = b"TIDB1\n", 1 << 16, 2, 8192, 50_000
#: Words that a worker remembers while it writes; it holds little else, so these may take about 260 MB.
WRITER_WORDS = 600_000
HEAD, DOC = struct.Struct("<IIQQ"), np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u4")])


def width(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each.reshape(-1)).tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = each
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


class Writer:
    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self.fs, self.inner = file_system(path)
        self.temp = f"{self.inner}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.ids, self.blocks, self.docs = len(MAGIC), 0, [], []
        self.waiting: list[bytes] = []
        self.waiting_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if not self.waiting:
            self.blocks.append((self.at, len(self.docs), self.ids))
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        self.ids += len(ids) // 4
        if self.waiting_ids >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            data = pack_bits(np.frombuffer(b"".join(self.waiting), "<u4"), self.bits)
            self.out.write(data)
            self.at += len(data)
            self.waiting, self.waiting_ids = [], 0

    def close(self) -> None:
        self._flush()
        foot = HEAD.pack(self.bits, len(self.blocks), len(self.docs), self.ids) + np.asarray(self.blocks, "<u8").tobytes() + np.array(self.docs, DOC).tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.inner).type != fs.FileType.NotFound:
            self.fs.delete_file(self.inner)  # left by an earlier attempt of this task
        self.fs.move(self.temp, self.inner)


class Reader:
    """Reads whole files block by block, or single documents by range reads."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a complete token file")
        (length,) = struct.unpack("<Q", tail[:8])
        foot = self.file.read_at(length, size - 8 - len(MAGIC) - length)
        self.end = size - 8 - len(MAGIC) - length
        self.bits, n_blocks, self.n_docs, self.n_ids = HEAD.unpack(foot[: HEAD.size])
        self.blocks = np.frombuffer(foot, "<u8", 3 * n_blocks, HEAD.size).reshape(n_blocks, 3).astype(np.int64)
        self.docs = np.frombuffer(foot, DOC, self.n_docs, HEAD.size + 24 * n_blocks)
        self.starts = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])

    def _block(self, b: int) -> tuple[int, int]:
        """The documents of block b: first, and one past the last."""
        return int(self.blocks[b, 1]), int(self.blocks[b + 1, 1]) if b + 1 < len(self.blocks) else self.n_docs

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids) in file order."""
        for b in range(len(self.blocks)):
            lo, hi = self._block(b)
            stop = int(self.blocks[b + 1, 0]) if b + 1 < len(self.blocks) else self.end
            n = int(self.starts[hi] - self.starts[lo])
            ids = unpack_bits(self.file.read_at(stop - int(self.blocks[b, 0]), int(self.blocks[b, 0])), self.bits, n)
            for k in range(lo, hi):
                at = int(self.starts[k] - self.starts[lo])
                d = self.docs[k]
                yield (int(d["doc_id"]) if d["known"] else None), int(self.starts[k]), ids[at : at + int(d["n"])]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; reads only its own bytes."""
        b = int(np.searchsorted(self.blocks[:, 1], k, "right")) - 1
        first, n = int(self.starts[k] - self.blocks[b, 2]), int(self.docs["n"][k])
        lo, hi = first * self.bits // 8, -(-(first + n) * self.bits // 8)
        skip = first * self.bits - 8 * lo
        data = self.file.read_at(hi - lo, int(self.blocks[b, 0]) + lo)
        if not skip:
            return unpack_bits(data, self.bits, n)
        each = np.unpackbits(np.frombuffer(data, np.uint8))[skip : skip + n * self.bits]
        return unpack_bits(np.packbits(each).tobytes(), self.bits, n)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, rows_a_shard: int = ROWS_A_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs under folder; returns the shards: shard, path, n_docs, n_ids. The texts shuffle once, by range of doc_id; ids go to the file where they are made."""
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = min(MOST_FILES, max(1, -(-rows.count() // rows_a_shard)))
    spread = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(spread.mapInArrow(_shard_writer(folder, path, end_id), "shard int, path string, n_docs long, n_ids long"))


def _shard_writer(folder: str, path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, end = encoder(path, WRITER_WORDS), np.asarray([end_id], "<u4").tobytes()
        out = None
        for batch in slices(batches):
            if out is None and batch.num_rows:
                out = Writer(f"{folder}/{shard:08d}.tids", width(max(encode.vocab_size(), end_id + 1)))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist()), strict=True):
                out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [out.path], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([out.ids], pa.int64())})

    return run


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for. One task reads one file."""
    spark = shards.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    files = max(1, shards.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Reader(path):
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids), ids if with_ids else None))
                    if len(rows) >= 4096:
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)

    return spark.createDataFrame([], schema) if not shards.take(1) else based.select("path", "base").repartition(files, "path").mapInArrow(run, schema)


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    data = {"doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "n_tokens": pa.array(cols[2], pa.int64()), "ids_crc32": pa.array(cols[3], pa.int64())}
    return pa.RecordBatch.from_pydict(data | ({"ids": pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32()))} if with_ids else {}))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(load(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
