"""The graph at rest: tables below a folder, upserts where the last write wins, quarantine, wipes, and embeddings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import fields
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.functions.lineage import cut
from clausegraph.plans.graph import Graph

#: Most bytes of asked ids that are broadcast, and of one id.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 64


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, one a key: the last by `order`."""
    rows = old.unionByName(new, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def checked(rows: DataFrame, valid: F.Column) -> tuple[DataFrame, DataFrame]:
    """(rows that are valid, the others for a quarantine table)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def with_both_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst", key: str = "chunk_id") -> DataFrame:
    """Edges whose two ends exist; the others drop out."""
    return edges.join(sources.select(F.col(key).alias(src)), src, "left_semi").join(targets.select(F.col(key).alias(dst)), dst, "left_semi")


def write(graph: Graph, folder: str) -> None:
    """One Parquet table a label or type; chunks are partitioned by specification, so one can be replaced alone."""
    for f in fields(graph):
        df = getattr(graph, f.name)
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if "spec_id" in df.columns else "static")
        (out.partitionBy("spec_id") if "spec_id" in df.columns else out).parquet(f"{folder}/{f.name}")


def read(spark: SparkSession, folder: str) -> Graph:
    return Graph(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Graph)})


def wipe(spark: SparkSession, folder: str) -> None:
    """Deletes the tables below a folder through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def backfill(rows: DataFrame, made: DataFrame, key: list[str], dry_run: bool = True) -> DataFrame:
    """What a backfill would add (dry_run), or all rows with it: both from one plan, so a dry run counts what a run writes."""
    new = made.join(rows.select(*key), key, "left_anti")
    return new if dry_run else rows.unionByName(new)


def hashed(texts: pd.Series, dim: int) -> np.ndarray:
    """A stand-in encoder: signed hashed words, unit length. A word that texts repeat is hashed once."""
    words = [(t or "").lower().split() for t in texts]
    flat = list(chain.from_iterable(words))
    codes = {w: zlib.crc32(w.encode()) for w in set(flat)}
    h = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    out = np.bincount(row * dim + h % dim, np.where(h >> 31, 1.0, -1.0), len(words) * dim).reshape(len(words), dim)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def encoder(encode: Callable[[pd.Series, int], np.ndarray | list[list[float]]], dim: int, batch: int = 256) -> Callable[[pa.Array], np.ndarray]:
    """A function from an Arrow column of texts to their vectors, a row each, for retrieval.dense; the encoder gets `batch` texts at once."""

    def vectors(texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for at in range(0, len(texts), batch):
            part = texts.slice(at, batch).to_pylist()
            out[at : at + len(part)] = np.asarray(encode(pd.Series(part, dtype=object), dim), np.float32)
        return out

    return vectors


def embed_missing(rows: DataFrame, text_col: str = "content", vector_col: str = "embedding", dim: int = 768, encode: Callable[[pd.Series, int], np.ndarray | list[list[float]]] = hashed, batch: int = 256) -> DataFrame:
    """Fills vector_col where it is null; rows that have a vector never reach the encoder."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            for at in range(0, len(part), batch):
                yield pd.Series([np.asarray(v, np.float32) for v in encode(part.iloc[at : at + batch], dim)])  # a batch's vectors at once, not all of a part's

    done, missing = rows.where(F.col(vector_col).isNotNull()), rows.where(F.col(vector_col).isNull())
    return done.unionByName(missing.withColumn(vector_col, vectors(F.col(text_col))))


def snapshot_tables(gold: DataFrame, tables: DataFrame) -> DataFrame:
    """(qid, chunk_id, table) for gold clauses: their tables, met by specification first (the first three parts of an id) and by clause then."""
    spec = lambda c: F.substring_index(c, "_", 3)
    asked = gold.select("qid", "chunk_id", spec(F.col("chunk_id")).alias("spec_id"))
    return asked.join(tables.select("spec_id", "chunk_id", "table"), ["spec_id", "chunk_id"]).select("qid", "chunk_id", "table")


def append_turns(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with new messages (conv_id, seq, role, text) after the last turn of each; unknown ones begin at 0."""
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    added = new.withColumn("_n", n).join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long").alias("turn"), "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


def without_conversations(conversations: DataFrame, gone: DataFrame) -> DataFrame:
    """Conversations but for those whose conv_id is in gone."""
    return conversations.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def fetch(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the asked ids (a column `key`), with found true, and for each id that has none a row of nulls with found false.

    An id that is asked twice is fetched once; a null id is never found. A set of ids within BROADCAST_BYTES,
    counted first, goes to the rows, so that a few ids do not shuffle the table; the ids of missing ones are their difference.
    """
    asked = cut(ids.select(F.col(key).alias("_asked")).distinct())
    few = asked.count() * ID_BYTES <= BROADCAST_BYTES
    own = [F.col(f"`{c}`") for c in rows.columns]
    found = rows.join(F.broadcast(asked) if few else asked, F.col(f"`{key}`") == F.col("_asked"), "left_semi")
    met = found.select(F.col(f"`{key}`").alias("_had")).distinct()
    missing = asked.join(met, F.col("_asked") == F.col("_had"), "left_anti")
    blank = [F.col("_asked").cast(rows.schema[c].dataType).alias(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return found.select(*own, F.lit(True).alias("found")).unionByName(missing.select(*blank, F.lit(False).alias("found")))
