"""Packing documents into windows by best-fit decreasing.

Each document's ids are cut into full windows, which stand alone, and one tail. The tails go into
windows in order of decreasing length; a segment tree over the remaining capacities finds the
tightest open window that still takes a tail, and a new window opens where none does.

Every input partition packs its own documents, so nothing shuffles and a lost task is redone from
its input alone; the cost is at most one ill-filled window a partition. Memory holds one partition's
piece lengths, not its ids. Sequences are numbered partition * 2^33 + number in the partition.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each on its own;
an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausegraph.llm.common import load, slices
from clausegraph.llm.encode import default_path, encoder

WINDOW, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """A segment tree whose leaves are the remaining capacities 0..size and hold the open windows with just that much room."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room >= need: (room, window)."""
        count, i = self.count, need + self.width
        while not count[i]:
            while i & 1:  # up to the first subtree to the right
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf
                return None
        while i < self.width:
            i *= 2
            if not count[i]:
                i += 1
        room = i - self.width
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; lengths of 1..window. Ties keep their order."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need) if need < window else None
        if found is None:
            room, mine, opened = window, opened, opened + 1
        else:
            room, mine = found
        number[i], offset[i] = mine, window - room
        if room > need:
            tree.add(room - need, mine)
    return number, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece (SCHEMA); with_ids adds column ids, the piece's ids as unsigned 32-bit integers."""
    from pyspark.sql import functions as F

    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, window, end_id, with_ids), SCHEMA + ", ids binary" * with_ids)


def _packer(path: str, window: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        encode, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
        doc_ids: list = []
        kept: list[bytes] = []
        starts, lengths, crcs, totals = [], [], [], []
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    if with_ids:
                        kept.append(piece)
        number, offset = best_fit(np.asarray(lengths, np.int64), window)
        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(number + base), pa.array(offset)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
        out = pa.RecordBatch.from_arrays(columns, names)
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    return run


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
