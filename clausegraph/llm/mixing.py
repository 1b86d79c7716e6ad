"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p^a / Z. The exponent a in [0, 1] is bisected so that
no source repeats more than `max_epochs` times (the largest mixing that the limit allows), or so
that the weights reach a target entropy. The budget is the tokens to emit in all; by default it is
the least that emits each document of every source once, so the mixture only repeats and drops nothing.

Budgets are realised by block permutations. A hash of id and text deals a source's documents to
blocks of about BLOCK_TOKENS tokens, or of a LEAST_BLOCKS-th of the source where that is less, so that a
small source is permuted in as fine a grain as a large one. Each epoch is a permutation of the
source's blocks: a hash of source, epoch and block places each of them on [0, 1). Whole epochs give
every document one copy each, and the last, partial epoch takes blocks in its order while the budget
lasts, then documents of the block at the border in the order of their own hash. The border is found
by sums over BANDS bands of places, then over the blocks of one band, so no source is ever ordered
whole. Each copy has a place, (the block's place in its epoch, within epochs, + the epoch) / epochs: rows of all
sources in the order of their places are the mixture, sources interleaved in proportion and the
copies of a document in different epochs. mix(whole=True) lays its rows out in that order: the
range of places is cut into partitions, and each is sorted.

Defined cases: a null source is a source of its own; a null or empty text has no token and follows
its block; a source without tokens gets weight 0 and one epoch; rows that repeat id and text go
together, other rows each on their own, with an id or without; an empty table gives an empty result.
Columns of docs keep their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, cut, load

BANDS, BLOCK_TOKENS, LEAST_BLOCKS, MAX_EPOCHS, SEED, STEPS, PLACES = 1024, 1_000_000, 64, 4.0, 17, 60, 1 << 30


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = STEPS) -> float:
    """The largest a in [low, high] for which holds(a); holds is true up to some a and false beyond. low if it never holds."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent(shares: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent for the (source, tokens) rows of shares.

    Weights flatten as a falls, so small sources repeat more and the entropy rises. For the entropy
    it is the largest a that still reaches the target (0 if none does), for the limit the smallest
    a that keeps to it (1 if none does).
    """
    total, least, most = shares.where("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def sums(a: float) -> tuple[float, float]:
        powered = F.pow(p, F.lit(a))
        return tuple(shares.where("tokens > 0").agg(F.sum(powered), F.sum(powered * F.log(p))).first())

    def entropy(a: float) -> float:
        z, zl = sums(a)
        return math.log(z) - a * zl / z

    if target_entropy is not None:
        return bisect(lambda a: entropy(a) >= target_entropy, steps=30)
    if budget is not None:
        over = lambda a: (least / total) ** a / sums(a)[0] * budget / least > max_epochs
        return bisect(over, steps=30) if over(0.0) else 0.0
    over = lambda a: (most / least) ** (1 - a) > max_epochs
    return bisect(over) if over(0.0) else 0.0


def _hash(*cols: Column | int) -> Column:
    return F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cols])


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df for a broadcast join if its size, counted here, is within bounds; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _in_epoch(source: Column, epoch: Column, block: Column, seed: int) -> Column:
    """The place of a block in an epoch's permutation, of PLACES."""
    return F.pmod(_hash(source, epoch, block, seed), F.lit(PLACES))


def _of(cols: dict[str, str]) -> Column:
    """Null-safe equality of each pair of columns."""
    met = F.lit(True)
    for a, b in cols.items():
        met = met & F.col(a).eqNullSafe(F.col(b))
    return met


def plan(rows: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (_key, _source, _tokens): the sources, their blocks, and the keys taken from blocks at a border."""
    shares = cut(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    a = exponent(shares, max_epochs, target_entropy, budget)
    total, most = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    powered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0)
    z = shares.agg(F.sum(powered)).first()[0] or 1.0
    whole = float(budget) if budget is not None else (most / ((most / total) ** a / z) if total else 0.0)
    sources = shares.withColumn("weight", powered / F.lit(float(z)))
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(whole) / F.col("tokens")).otherwise(F.lit(1.0)))
    sources = sources.withColumn("epochs", F.when(F.abs(F.col("epochs") - F.round("epochs")) < 1e-9, F.round("epochs")).otherwise(F.col("epochs")))
    sources = cut(sources.withColumn("full", F.floor("epochs")).withColumn("rest", F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens"))).withColumn("n_blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS))) + 1))
    placed = place(rows, sources, seed)
    blocks = placed.groupBy("source", "block").agg(F.sum("_tokens").alias("block_tokens"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    blocks = cut(blocks.withColumn("at", _in_epoch(F.col("source"), F.col("full"), F.col("block"), seed)).withColumn("band", (F.col("at") / F.lit(PLACES // BANDS)).cast("int")))
    # The band that the budget's end lies in, then the block.
    before = lambda by, order, tokens: F.coalesce(F.sum(tokens).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = blocks.groupBy(F.col("source").alias("_s"), F.col("band").alias("_b")).agg(F.sum("block_tokens").alias("band_tokens"))
    bands = cut(bands.withColumn("band_before", before("_s", ["_b"], "band_tokens")))  # at most BANDS rows a source
    blocks = blocks.join(_small(bands, 64), _of({"source": "_s", "band": "_b"})).drop("_s", "_b")
    inside = (F.col("band_before") < F.col("rest")) & (F.col("band_before") + F.col("band_tokens") > F.col("rest"))
    left = F.col("rest") - F.col("band_before")
    border = blocks.where(inside).withColumn("left", left - before("source", ["at", "block"], "block_tokens"))
    blocks = cut(blocks.where(~inside).withColumn("left", left).withColumn("taken", F.col("left") >= F.col("band_tokens")).unionByName(border.withColumn("taken", F.col("left") >= F.col("block_tokens"))).withColumn("taken", F.col("taken") & (F.col("left") > 0)).withColumn("border", inside & (F.col("left") > 0) & ~F.col("taken")))
    border = blocks.where("border").select(F.col("source").alias("_bs"), F.col("block").alias("_bb"), "left")
    found = placed.join(_small(border, 64), _of({"source": "_bs", "block": "_bb"}))
    run = Window.partitionBy("_bs", "_bb").orderBy(_hash(F.col("_key"), seed, F.col("full")), "_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = found.withColumn("_sum", F.sum("_tokens").over(run)).where("_sum <= left").select(F.col("source").alias("_ts"), F.col("_key").alias("_tk")).distinct()
    return sources, blocks, cut(taken)


def place(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds to each row its source's plan and its block."""
    joined = rows.join(_small(sources, 96), F.col("_source").eqNullSafe(F.col("source")))
    return joined.withColumn("block", F.pmod(_hash(F.col("_key"), seed), F.col("n_blocks")))


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, weight, epochs, block, copies, places (of its copies, ascending).

    whole=True returns instead the columns of docs, each row as often as it is to be emitted, in the
    order of the places.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).cast("long").alias("_tokens"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if whole else []))
    narrow = cut(base.select("_id", "_key", "_source", "_tokens"))
    sources, blocks, taken = plan(narrow, max_epochs, target_entropy, budget, seed)
    rows = place(base if whole else narrow, sources, seed)
    marks = blocks.select(F.col("source").alias("_ms"), F.col("block").alias("_mb"), "taken", "border")
    rows = rows.join(_small(marks, 64), _of({"source": "_ms", "block": "_mb"}), "left")
    rows = rows.join(_small(taken.withColumn("_in", F.lit(True)), 48), F.col("border") & _of({"source": "_ts", "_key": "_tk"}), "left")
    extra = F.coalesce("taken", F.lit(False)) | F.coalesce("_in", F.lit(False))
    rows = rows.withColumn("copies", (F.col("full") + extra.cast("int")).cast("int"))
    at = lambda e: (F.least(_in_epoch(F.col("source"), e, F.col("block"), seed) / F.lit(float(PLACES)), F.col("epochs") - e) + e) / F.greatest(F.col("epochs"), F.lit(1e-12))
    places = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")), lambda e: at(e - 1))
    rows = rows.withColumn("places", F.when(F.col("copies") > 0, places).otherwise(F.array().cast("array<double>")))
    if not whole:
        return rows.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), "weight", "epochs", "block", "copies", "places")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("_doc", "_key", F.explode("places").alias("_at"))
    laid = laid.withColumn("_part", F.least(F.floor(F.col("_at") * n), F.lit(n - 1)).cast("int"))  # places are even on [0, 1)
    return laid.repartitionById(n, "_part").sortWithinPartitions("_at", "_key").select("_doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))
