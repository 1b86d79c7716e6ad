"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes that any operator sends by broadcast; beyond it the operators join by shuffle.
BROADCAST_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster's executors would not see that, so there it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clausegraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_system(path: str):
    """pyarrow's (file system, path in it) of a path; s3a and s3n are its s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder inside the shared one, for files that an operator writes and reads again. Rows read from it are read lazily, so it stays until the shared folder is cleared."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with this share of all rows is hot, if it has HOT_ROWS or more; there are at most as many such keys as its inverse.
HOT_SHARE, HOT_ROWS = 1 / 1000, 5_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of distinct keys on `key`, no key meeting in one task.

    The table's column n (dropped) says how many rows have the key. Rows of the hot keys, which are at
    most 1 / HOT_SHARE, meet theirs by broadcast; only the rest shuffles. how: inner or left.
    """
    names, own = rows.columns, [c for c in table.columns if c not in (key, n)]
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(table.where(F.col(n) >= least).select(F.col(key).alias("_hot_key"), *own))
    rest = table.where(F.col(n) < least).drop(n)
    spread = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    met = spread.where("_hot_key is not null").select(*names, *own)
    return met.unionByName(spread.where("_hot_key is null").select(*names).join(rest, key, how).select(*names, *own))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Texts of ASCII alone take Spark's fast lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches, rows: int = 256):
    """Arrow batches cut small, so that few texts are held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
