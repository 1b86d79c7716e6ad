"""SimHash near-dedup with pigeonring filtering.

Fingerprints: 64 bits over the XXH64 (seed 42) of a text's 3-word shingles, linked where at most 3
bits differ. Exact copies share a fingerprint, so all that follows works on distinct fingerprints.

Candidates. Put the four 16-bit segments of two fingerprints on a ring. If at most 3 bits differ
then, by the pigeonring principle, some segment starts a chain whose cumulative differences stay
within the proportional budgets floor(k * 3 / 4): none in the first segment, at most 1 in the first
two, at most 2 in the first three. So the first segment is equal, one half of the second is equal
(one difference can't touch both), and one third of the third is equal. Each such choice of a
start (4), a half (2) and a third (3) is a key of 29 or 30 bits, and two linked fingerprints share
one of their 24 keys. Rows meet by key; there the chain's budgets prune candidates, and the full
Hamming check comes last.

Hot keys. A histogram over bins of the keys, of which there are enough for BIN_ROWS keys a bin, shows
where many fingerprints meet. The keys of a bin with more than GROUP_ROWS are cut into blocks, and
each pair of blocks is a group of its own, so no group is larger than about GROUP_ROWS at any size of
the table. A group emits a spanning forest of its links, never all pairs.

Components come from alternating large-star and small-star rounds on the forests' edges, with a
checkpoint each round; nothing is collected. Vertices with very many edges meet their minima by
broadcast (there are few of them), so that no hub meets in one task.

Defined cases: a null or empty text has no word and fingerprint zero, linked like any other; rows
with a null doc_id get a component as any other, but never name it unless no other does; repeated
rows are reported each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, HOT_ROWS, cut, join_hot, load, slices

SHINGLE, DISTANCE, SEED = 3, 3, 42
LEAST_BINS, BIN_ROWS, GROUP_ROWS = 1 << 12, 1000, 20_000
#: (shift, bits) of the halves of a segment, and of its thirds.
HALVES, THIRDS = ((8, 8), (0, 8)), ((11, 5), (6, 5), (0, 6))
N_KEYS = 4 * len(HALVES) * len(THIRDS)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # bounds the memory of very long texts
        spans = zip(starts[at : min(n, at + (1 << 15))].tolist(), last[at : min(n, at + (1 << 15))].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, hash: XXH64 of the text, which tells rows apart that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(1)], ["doc_id", "fp", "hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(run, "doc_id long, fp long, hash long")


def chain_keys(fp: F.Column) -> list:
    """The 24 keys of a fingerprint: the choice's number in the top bits, then what it requires to be equal."""
    seg = [F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    out = []
    for start in range(4):
        for h, (hs, hb) in enumerate(HALVES):
            for t, (ts, tb) in enumerate(THIRDS):
                half = F.shiftright(seg[(start + 1) % 4], hs).bitwiseAND(F.lit((1 << hb) - 1))
                third = F.shiftright(seg[(start + 2) % 4], ts).bitwiseAND(F.lit((1 << tb) - 1))
                out.append(F.shiftleft(seg[start], 14).bitwiseOR(F.shiftleft(half, 6)).bitwiseOR(third).bitwiseOR(F.lit((start * 6 + h * 3 + t) << 32)))
    return out


def within_chain(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the differing bits x stay within the chain's budgets from this start (its own segment is equal)."""
    shift = (np.uint64(48) - (np.uint64(16) * ((np.asarray(start, np.uint64) + np.uint64(1)) % np.uint64(4)))).astype(np.uint64)
    second = np.bitwise_count((x >> shift) & np.uint64(0xFFFF))
    shift = (np.uint64(48) - (np.uint64(16) * ((np.asarray(start, np.uint64) + np.uint64(2)) % np.uint64(4)))).astype(np.uint64)
    return (second <= 1) & (second + np.bitwise_count((x >> shift) & np.uint64(0xFFFF)) <= 2)


def _forest(fps: np.ndarray, start: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one group, breadth first: each fingerprint leaves `rest` once."""
    rest = np.unique(fps)
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            x = rest ^ queue.pop()
            near = within_chain(x, start)
            near[near] = np.bitwise_count(x[near]) <= distance
            if near.any():
                met = rest[near]
                rest = rest[~near]
                queue.extend(met)
                yield np.full(len(met), root), met


def _links(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal (key, part), whole runs only."""
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keys)))
    for at, n in zip(first[length > 12].tolist(), length[length > 12].tolist(), strict=True):
        yield from _forest(fps[at : at + n], int(keys[at] >> 32) // 6, distance)
    small = np.repeat((length > 1) & (length <= 12), length)
    keys, fps, run = keys[small], fps[small], np.repeat(np.arange(len(length)), length)[small]
    for gap in range(1, 12):
        if len(fps) <= gap:
            break
        i = np.flatnonzero(run[gap:] == run[:-gap])
        x = fps[i] ^ fps[i + gap]
        ok = within_chain(x, (keys[i] >> 32) // 6) & (x != 0)
        i, x = i[ok], x[ok]
        i = i[np.bitwise_count(x) <= distance]
        yield np.minimum(fps[i], fps[i + gap]), np.maximum(fps[i], fps[i + gap])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) edges whose components are those of all links between the distinct fingerprints of column fp."""
    if distance > DISTANCE:
        raise ValueError("the chain keys are complete up to 3 differing bits")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bins = 1 << max(LEAST_BINS.bit_length() - 1, (distinct.count() * N_KEYS // BIN_ROWS).bit_length())
    bin_of = F.xxhash64("key").bitwiseAND(F.lit(n_bins - 1))
    keyed = distinct.repartition(n, "fp").select("fp", F.explode(F.array(*chain_keys(F.col("fp")))).alias("key")).withColumn("bin", bin_of)
    hot = cut(keyed.groupBy("bin").count().where(F.col("count") > GROUP_ROWS).select(F.col("bin").alias("_bin"), F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("int").alias("blocks")))
    hot = F.broadcast(hot) if hot.count() * 32 <= BROADCAST_BYTES else hot
    spread = keyed.join(hot, F.col("bin") == F.col("_bin"), "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.least(t, mine) * F.col("blocks") + F.greatest(t, mine))
    spread = spread.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    met = spread.repartition(n, "key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(keys, parts, fps):
            for a, b in _links(keys, parts, fps.view(np.uint64), distance):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edge = np.flatnonzero((keys != keys[-1]) | (parts != parts[-1]))
            done = int(edge[-1]) + 1 if len(edge) else 0  # the last run may go on in the next batch
            if done:
                held.append((keys[:done], parts[:done], fps[:done]))
                yield from out(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((keys[done:], parts[done:], fps[done:]))
        if held:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))

    return met.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest vertex of its component.

    Alternating large-star and small-star; minima come from partially aggregated groupings, and each
    round is checkpointed.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None

    def with_least(pairs: DataFrame) -> DataFrame:
        """Adds m, the least b of each a."""
        low = cut(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")))
        largest = low.agg(F.max("_n")).first()[0] or 0
        return join_hot(pairs, low, "a", "_n", pairs.count()) if largest >= HOT_ROWS else pairs.join(low.drop("_n"), "a")

    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = with_least(edges.union(edges.select("b", "a")))
        large = cut(both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _groups(fps: DataFrame, distance: int) -> DataFrame:
    """fp, n and the least row (doc_id, hash) of its component, in which rows without an id come last, for each fingerprint of fps (doc_id, fp, hash)."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    distinct = cut(fps.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")))
    members = cut(components(links(distinct.select("fp"), distance)))
    owned = distinct.join(members.withColumnRenamed("v", "fp"), "fp").select("fp", "root", "first")
    least = cut(owned.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("_n")))
    named = join_hot(owned.select("fp", "root"), least, "root", "_n", owned.count()).select("fp", "least")
    return cut(distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("least")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    table = _groups(fps, distance).select("fp", "n", F.col("least.doc_id").alias("component_id"))
    return join_hot(fps.select("doc_id", "fp"), table, "fp", "n", fps.count())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group one row, that with the smallest id.

    Rows without an id come last. Of rows that repeat the id, the text decides by its hash, and of
    rows that repeat both one stays; rows that are near nothing stay whatever their ids.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    each = join_hot(fps, _groups(fps, DISTANCE), "fp", "n", fps.count())
    each = each.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("hash") == F.col("least.hash")))
    rows = cut(each.groupBy(F.col("doc_id").alias("_gone"), F.col("hash").alias("_gone_hash")).agg(F.max("stays").alias("_stays"), F.count(F.lit(1)).alias("_times")))
    gone, again = rows.where("not _stays or _times > 1"), rows.where("_stays and _times > 1")
    small = lambda t: F.broadcast(t) if t.count() * 32 <= BROADCAST_BYTES else t
    doc = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    met = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash"))
    stay = doc.join(small(gone), met, "left_anti").select("_doc")
    if not again.isEmpty():
        stay = stay.unionByName(doc.join(small(again), met, "left_semi").dropDuplicates(["_id", "_hash"]).select("_doc"))
    return stay.select("_doc.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
