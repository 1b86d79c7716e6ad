"""An inverted-file index of vectors: cells around centres, searched by inner product.

build() fits the centres on a bounded sample (the parameter is documented there), then deals every vector
to its nearest centre and writes two tables: `cells` (one row a cell: centre, radius, parts) and `rows`,
sorted by cell. A cell with more than CELL_ROWS vectors lies in parts, so no cell is too large for a task
however many vectors are alike.

search() sends each query to the cells whose centres it has the largest products with. Queries and vectors
meet by equality of cell, part and block of queries: both sides of such a group are bounded, so neither a
cell that holds a third of all vectors nor one that a third of all queries ask for meets in one task.
Products are exact. With `certain`, a second pass looks into the other cells that could still hold one of
the best: a product with a vector of a cell is at most that with its centre plus the query's length times
the cell's radius. Then the result is that of comparing everything.

Only the centres are broadcast, within CENTRE_BYTES; beyond that there are no more cells but larger ones,
in more parts.

Defined cases: null vectors are in no result, as queries too; repeated ids are told apart only by their
products; fewer vectors than k give fewer rows; an empty table gives an empty result. All vectors have one
length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions.lineage import cut
from clausegraph.operators.retrieval import top_per_query

CELL_ROWS, BLOCK_QUERIES, SAMPLE_A_CELL, CENTRE_BYTES = 8192, 512, 64, 32 << 20
#: Scores are rounded to so many digits; what could tie after rounding stays until then.
DIGITS, TIE = 5, 1.01e-5


@dataclass(frozen=True)
class Index:
    """rows: cell, part, doc, v; cells: cell, parts, radius; centres: a row a cell."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    radii: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def fit_centres(items: DataFrame, cells: int, n: int, a_cell: int = SAMPLE_A_CELL, seed: int = 7) -> np.ndarray:
    """Centres of k-means on about a_cell vectors a cell, chosen by the hash of (doc, v); on all of them where there are no more."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = items
    if n > cells * a_cell:
        sample = items.where(F.pmod(F.xxhash64("doc", "v"), F.lit(1 << 30)) < F.lit((1 << 30) * cells * a_cell // n))
    points = cut(sample.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    fitted = KMeans(k=cells, seed=seed, maxIter=8, initMode="random").fit(points)
    return np.array(fitted.clusterCenters())


def build(items: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", a_cell: int = SAMPLE_A_CELL) -> Index:
    """Writes the index of all vectors below path and opens it. cells: the root of the number of vectors, if not given; a_cell: the sample's size a cell."""
    spark = items.sparkSession
    kept = items.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(vector_col).cast("array<float>").alias("v"))
    n, dims = kept.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    cells = max(1, min(n, cells or math.isqrt(n), CENTRE_BYTES // (8 * max(1, dims or 1))))
    centres = fit_centres(kept, cells, n, a_cell) if n else np.zeros((0, 0))
    sent, kind = spark.sparkContext.broadcast(centres), kept.dtypes[0][1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1), batch.num_rows)
                near = (v @ centres.T - half).argmax(axis=1)
                gap = np.sqrt(((v - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(gap)], ["doc", "v", "cell", "gap"])

    placed = cut(kept.mapInArrow(assign, f"doc {kind}, v array<float>, cell long, gap double"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    known = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(centres)], "cell long, centre array<double>")
    known.join(sizes, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"), F.ceil(F.coalesce("n", F.lit(0)) / CELL_ROWS).cast("int").alias("parts")).write.parquet(f"{path}/cells")
    parts = F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts"))  # bounded with the centres
    dealt = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("doc", "v"), F.col("parts")).cast("int").alias("part"), "doc", "v")
    dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells")
    held = cells.orderBy("cell").collect()  # within CENTRE_BYTES
    return Index(spark.read.parquet(f"{path}/rows"), cells.select("cell", "parts", "radius"), np.array([r["centre"] for r in held]), np.array([r["radius"] for r in held]))


def _asked(index: Index, queries: DataFrame, probes: int, floor: bool) -> DataFrame:
    """qid, q, cell: the `probes` cells of largest product for each of queries (qid, q); with floor (queries have it too), the other cells that may hold a product of floor or more."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radii))
    kind = queries.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = sent.value
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            q = _matrix(batch.column(1), batch.num_rows)
            scores = q @ centres.T
            few = min(probes, len(centres))
            take = np.zeros(scores.shape, bool)
            np.put_along_axis(take, np.argpartition(-scores, few - 1, axis=1)[:, :few], True, axis=1)
            if floor:
                length = np.sqrt((q**2).sum(axis=1))
                most = scores + length[:, None] * radii
                take = ~take & (most * (1 + 1e-9) + TIE >= batch.column(2).to_numpy(zero_copy_only=False)[:, None])
            row, cell = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell)], ["qid", "q", "cell"])

    return queries.mapInArrow(run, f"qid {kind}, q array<float>, cell long")


def _scored(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """qid, doc, score: of each cell, part and block of queries, the k best a query and what ties with them."""
    n = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    met = F.broadcast(cut(index.cells.join(n, "cell").where("parts > 0").select("cell", "parts", "blocks")))  # bounded with the centres
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    items = index.rows.join(met, "cell").select("cell", "part", spread("blocks").alias("block"), "doc", "v")
    queries = asked.join(met, "cell").select("cell", spread("parts").alias("part"), F.pmod(F.xxhash64("qid", "q"), F.col("blocks")).cast("int").alias("block"), "qid", "q")
    keys, kinds = ["cell", "part", "block"], (dict(asked.dtypes)["qid"], dict(index.rows.dtypes)["doc"])
    schema = pa.schema([("qid", queries.limit(0).toArrow().schema.field("qid").type), ("doc", items.limit(0).toArrow().schema.field("doc").type), ("score", pa.float64())])

    def tile(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not items.num_rows or not queries.num_rows:
            return schema.empty_table()
        scores = _matrix(items["v"], items.num_rows) @ _matrix(queries["q"], queries.num_rows).T
        few = min(k, items.num_rows)
        least = np.partition(scores, items.num_rows - few, axis=0)[items.num_rows - few]
        row, q = np.nonzero(scores >= least - TIE)
        return pa.table([queries["qid"].take(pa.array(q)), items["doc"].take(pa.array(row)), pa.array(scores[row, q])], schema=schema)

    return items.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(tile, f"qid {kinds[0]}, doc {kinds[1]}, score double")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, certain: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, doc, score, rank): the k best of the `probes` nearest cells, or, with certain, of all vectors."""
    asked = cut(queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<float>").alias("q")))
    best = lambda rows: top_per_query(rows.withColumn("score", F.round("score", DIGITS)), k)
    found = best(_scored(index, cut(_asked(index, asked, probes, False)), k))
    if not certain:
        return found
    found = cut(found)
    floors = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    low = asked.join(floors, "qid", "left").select("qid", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = best(_scored(index, cut(_asked(index, low, probes, True)), k))
    return top_per_query(found.unionByName(more).drop("rank"), k)


def probes_for(index: Index, queries: DataFrame, k: int = 10, target: float = 0.95, sample: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The fewest probes by which `target` of the exact lists of about `sample` queries is found.

    The sample's lists come from a certain search; each entry counts at the place of its cell among those
    of its query. sample x k rows reach the driver.
    """
    known = queries.where(F.col(vector_col).isNotNull())
    n = known.count()
    some = known if n <= sample else known.where(F.pmod(F.xxhash64(id_col, vector_col), F.lit(1 << 30)) < F.lit((1 << 30) * sample // n))
    exact = search(index, some, k, certain=True, id_col=id_col, vector_col=vector_col)
    held = exact.join(index.rows.select("doc", "cell"), "doc").join(some.select(F.col(id_col).alias("qid"), F.col(vector_col).alias("q")), "qid").select("q", "cell").collect()
    if not held:
        return 1
    scores = np.array([r["q"] for r in held]) @ index.centres.T
    place = (scores > scores[np.arange(len(held)), [r["cell"] for r in held]][:, None]).sum(axis=1)
    return int(np.sort(place)[math.ceil(target * len(held)) - 1]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of a query's exact list (qid, doc) that was found."""
    hit = exact.select("qid", "doc").join(found.select("qid", "doc").withColumn("hit", F.lit(1)), ["qid", "doc"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
