"""Vector code compression: a codebook for each of 8 parts of a vector, fitted exactly by heap Lloyd.

Components become whole numbers, floor(4096 * x), so that every distance, sum and tie is exact. Vectors lie
in blocks of BLOCK_ROWS, rows of a table in the shared folder. Besides the vectors a block holds heaps: for
each part position and entry the parts that the entry owns, keyed by their slack, a lower bound of the
distance to any other entry minus an upper bound of that to their own, when they were last scanned. After a
round the slack of an entry's parts has shrunk by no more than the entry's own move and the largest move of
the others; the sum of these is the entry's drift. So a part whose key (slack plus the drift at its scan) is
above the drift now has kept its entry, alone at the least distance. Only the parts at the top of a heap
whose key is not are popped, scanned against all entries and pushed again. Keys are rounded down and drifts
up by more than the error of their arithmetic, so bounds never decide what whole numbers would not.

A round is one pass over the blocks, which writes them anew with the changes of the entries' sums and counts;
the driver adds these up (Spark sums them first: one number for each entry and component) and moves the
entries. A lost executor repeats its blocks of one round. A round's blocks are deleted once the next are
written; those of the last round stay until the shared folder is cleared.

Defined cases: a vector that is null or has a null or non-finite component is dropped. A vector that has not
the length of the kept vector with the smallest id, or components so large that a squared distance could
leave 64 bits (|x| of 32,768 at 64 components), cannot share the codebooks: its row is returned with null
code and error and takes no part in the rest, as do all if the length isn't a multiple of 8. Null ids come
after all others when the first entries are chosen, repeated ids in the order of their vectors; with fewer
than 16 vectors the codebooks are smaller. Rows that repeat are coded each; null labels are one label; an
error sum beyond 64 bits is the largest long; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.llm.common import cut, file_system, join_hot, load, new_folder, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
#: Bounds give way by this share of what they are made of, which is far beyond the rounding of doubles.
SLIP = 1e-9
MOST = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """The vector's whole numbers, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v (whole numbers, as doubles) of the vectors that are whole and finite."""
    x = F.col(vector_col)
    finite = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return rows.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole(x).alias("v"))


def _fits(v: Column) -> Column:
    """Whether all squared distances to vectors that fit too stay below 2^62."""
    return (F.size(v) % PARTS == 0) & (F.size(v) > 0) & (4 * F.size(v) * F.pow(F.array_max(F.transform(v, F.abs)), F.lit(2)) < float(1 << 62))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the entries of book, as whole numbers."""
    out = np.empty((len(x), len(book)), np.int64)
    for e, entry in enumerate(book):
        gap = x - entry
        np.einsum("ij,ij->i", gap, gap, out=out[:, e])
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first of those that tie, and the part's slack, rounded down."""
    d = distances(x, book)
    best = d.argmin(axis=1)
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, best].astype(float))
    d[rows, best] = MOST
    lower = np.sqrt(d.min(axis=1).astype(float))
    return best, lower - upper - SLIP * (lower + upper)


class Heaps:
    """A block's heaps by part position and entry: arrays of (key, row) in heap order, made lists of pairs only where they change."""

    def __init__(self, entries: int, packed: bytes | None = None):
        self.entries, self.lists = entries, {}
        n = PARTS * entries
        if packed is None:
            self.sizes, self.keys, self.rows = np.zeros(n, np.int32), np.empty(0), np.empty(0, np.uint16)
        else:
            self.sizes = np.frombuffer(packed, np.int32, n)
            total = int(self.sizes.sum())
            self.keys = np.frombuffer(packed, np.float64, total, 4 * n)
            self.rows = np.frombuffer(packed, np.uint16, total, 4 * n + 8 * total)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def opened(self, at: int) -> list[tuple[float, int]]:
        if at not in self.lists:
            a, b = self.starts[at : at + 2]
            self.lists[at] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
        return self.lists[at]

    def pop(self, at: int, drift: float) -> list[int]:
        """The rows whose key isn't above the drift."""
        if at not in self.lists and (not self.sizes[at] or self.keys[self.starts[at]] > drift):
            return []
        heap, out = self.opened(at), []
        while heap and heap[0][0] <= drift:
            out.append(heappop(heap)[1])
        return out

    def push(self, at: int, keys: list[float], rows: list[int]) -> None:
        heap = self.opened(at)
        if heap:
            for pair in zip(keys, rows, strict=True):
                heappush(heap, pair)
        else:
            heap.extend(zip(keys, rows, strict=True))
            heapify(heap)

    def packed(self) -> bytes:
        keys, rows, sizes = [], [], self.sizes.copy()
        for at in range(PARTS * self.entries):
            if at in self.lists:
                heap = self.lists[at]
                sizes[at] = len(heap)
                keys.append(np.fromiter((k for k, _ in heap), np.float64, len(heap)))
                rows.append(np.fromiter((r for _, r in heap), np.uint16, len(heap)))
            else:
                keys.append(self.keys[self.starts[at] : self.starts[at + 1]])
                rows.append(self.rows[self.starts[at] : self.starts[at + 1]])
        return sizes.tobytes() + np.concatenate(keys).tobytes() + np.concatenate(rows).tobytes()

    def owners(self, n: int) -> np.ndarray:
        """The entry of each row and part position."""
        out = np.empty((n, PARTS), np.uint8)
        for at in range(PARTS * self.entries):
            rows = [r for _, r in self.lists[at]] if at in self.lists else self.rows[self.starts[at] : self.starts[at + 1]]
            out[rows, at // self.entries] = at % self.entries
        return out


def settle(x: np.ndarray, heaps: Heaps, books: np.ndarray, drift: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Brings a block's heaps to the codebooks: the changes of the entries' sums and counts, and how many parts were scanned.

    x: rows by parts by components; books: parts by entries by components; drift: parts by entries.
    """
    k = books.shape[1]
    sums, counts, scanned = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), 0
    for part in range(PARTS):
        popped = [(0, list(range(len(x))))] if first else [(e, rows) for e in range(k) if (rows := heaps.pop(part * k + e, drift[part, e]))]
        if not popped:
            continue
        rows = np.concatenate([np.array(r, np.int64) for _, r in popped])
        old = np.repeat([e for e, _ in popped], [len(r) for _, r in popped])
        scanned += len(rows)
        parts = x[rows, part]
        new, slack = scan(parts, books[part])
        keys = slack + drift[part, new]
        for e in np.unique(new).tolist():
            mine = new == e
            heaps.push(part * k + e, keys[mine].tolist(), rows[mine].tolist())
        moved = slice(None) if first else new != old
        np.add.at(sums[part], new[moved], parts[moved])
        np.add.at(counts[part], new[moved], 1)
        if not first:
            np.subtract.at(sums[part], old[moved], parts[moved])
            np.subtract.at(counts[part], old[moved], 1)
    return sums, counts, scanned


def _block(batch: pa.RecordBatch, dims: int) -> tuple[bytes, int]:
    """The whole numbers of a batch's vectors in the fewest bytes that hold them, and how many bytes each takes."""
    v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    size = next(s for s in (2, 4, 8) if np.abs(v).max(initial=0) < 1 << (8 * s - 1))
    return v.astype(f"<i{size}").tobytes(), size


def _parts(packed: bytes, size: int, dims: int) -> np.ndarray:
    return np.frombuffer(packed, f"<i{size}").astype(np.int64).reshape(-1, PARTS, dims // PARTS)


def _delete(path: str) -> None:
    system, inner = file_system(path)
    system.delete_dir(inner)


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of all kept vectors (vec_id, label, code as bytes, error; null where a vector can't share the codebooks), the codebooks, and how many parts each pass scanned."""
    spark = rows.sparkSession
    kept = kept_vectors(rows, id_col, vector_col, label_col)
    seeds = kept.where(_fits(F.col("v"))).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).first()
    dims = seeds["n"] if seeds else 0
    mine = _fits(F.col("v")) & (F.size("v") == dims)
    label = T.StructField("label", kept.schema["label"].dataType)
    null = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("error", "long"))]
    other = kept.where(~mine).select("vec_id", "label", *null)
    if not dims:
        return other, np.zeros((PARTS, 0, 0), np.int64), []
    first = kept.where(mine).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    k, drift = len(first), np.zeros((PARTS, len(first)))
    state = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label.dataType)), *[T.StructField(c, t) for c, t in (("v", T.BinaryType()), ("size", T.IntegerType()), ("heaps", T.BinaryType()), ("sums", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.LongType())), ("scanned", T.LongType()))]])
    kind = pa.list_(pa.int64())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, BLOCK_ROWS):
            if batch.num_rows:
                v, size = _block(batch, dims)
                ids, labels = (pa.ListArray.from_arrays([0, batch.num_rows], batch.column(c)) for c in ("vec_id", "label"))
                yield {"vec_id": ids, "label": labels, "v": v, "size": size, "heaps": None}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield {c: batch.column(c).slice(at, 1) for c in ("vec_id", "label")} | {c: batch.column(c)[at].as_py() for c in ("v", "size", "heaps")}

    def round_of(books: np.ndarray, drift: np.ndarray, start: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (blocks if start else held)(batches):
                heaps = Heaps(k, b["heaps"])
                sums, counts, scanned = settle(_parts(b["v"], b["size"], dims), heaps, books, drift, start)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([b["v"]]), pa.array([b["size"]], pa.int32()), pa.array([heaps.packed()]), pa.array([sums.ravel()], kind), pa.array([counts.ravel()], kind), pa.array([scanned])], state.fieldNames())

        return run

    folder = new_folder(spark, "codes")
    blocks_now, start, totals, members, scans = kept.where(mine), True, np.zeros(books.shape, np.int64), np.zeros((PARTS, k), np.int64), []
    for n in range(rounds):
        path = f"{folder}/{n}"
        blocks_now.mapInArrow(round_of(books, drift, start), state).write.parquet(path)
        blocks_now, start = spark.read.parquet(path), False
        for column, into in (("sums", totals), ("counts", members)):  # one number for each entry and component
            for at, change in blocks_now.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
                into.ravel()[at] += change
        scans.append(blocks_now.agg(F.sum("scanned")).first()[0])
        moved = np.where(members[:, :, None] > 0, totals // np.maximum(members, 1)[:, :, None], books)
        move = np.sqrt(((moved - books) ** 2).sum(axis=2).astype(float))
        others = np.array([[np.delete(m, e).max(initial=0) for e in range(k)] for m in move])
        drift, books = drift + (move + others) * (1 + SLIP), moved
        if n:
            _delete(f"{folder}/{n - 1}")

    coded = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (blocks if start else held)(batches):
            x, heaps = _parts(b["v"], b["size"], dims), Heaps(k, b["heaps"])
            settle(x, heaps, books, drift, start)
            own = heaps.owners(len(x))
            error = ((x - books[np.arange(PARTS), own]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([b["vec_id"].flatten(), b["label"].flatten(), pa.array([c.tobytes() for c in own]), pa.array(error)], coded.fieldNames())

    return blocks_now.mapInArrow(last, coded).unionByName(other), books, scans


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books, _ = compress(load(spark, sf_dir, "embeddings"))
    codes = cut(codes.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.when(total > MOST, MOST).otherwise(total.cast("long")).alias("label_error"))
    labelled = join_hot(codes.select("key", "vec_id", "code", "error"), cut(sums), "key", "n", codes.count())
    return labelled.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """The rounds, unrolled. Distances carry the entry's number in their last digits, so that the least has both."""

    def assign(n: int) -> str:
        return f"a{n} AS MATERIALIZED (SELECT row, p, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {ENTRIES} + e) AS m FROM x JOIN b{n} USING (p) GROUP BY row, p)"

    def move(n: int) -> str:
        floor = "(s - ((s % n + n) % n)) // n"
        return (
            f"s{n} AS (SELECT p, e, i, {floor} AS c FROM (SELECT p, (m % {ENTRIES})::BIGINT AS e, i, sum(v[i]) AS s, count(*)::HUGEINT AS n FROM a{n - 1}, generate_series(1, len(v)) AS g(i) GROUP BY ALL)), "
            f"l{n} AS (SELECT p, e, list(c::BIGINT ORDER BY i) AS c FROM s{n} GROUP BY p, e), "
            f"b{n} AS MATERIALIZED (SELECT p, e, coalesce(l{n}.c, b{n - 1}.c) AS c FROM b{n - 1} LEFT JOIN l{n} USING (p, e))"
        )

    steps = ", ".join([assign(0), *[f"{move(n)}, {assign(n)}" for n in range(1, ROUNDS + 1)]])
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT row, p, w[1 + p * (len(w) // {PARTS}):(p + 1) * (len(w) // {PARTS})] AS v FROM k, generate_series(0, {PARTS - 1}) AS g(p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS e, v AS c FROM x WHERE row <= {ENTRIES}),
{steps},
f AS (SELECT row, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN f USING (row), h
"""


OP11_SQL = _op11_sql()
