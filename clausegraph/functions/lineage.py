"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share; a folder of its own only for a local master, where none is named."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="clausegraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and held where a lost executor doesn't take them."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of df in four tasks a core, by a hash of the key, if they lie in fewer than two a core: a small file, or one of few row groups, is read by few tasks however much work its rows are.

    What makes df runs once more for this, without its columns, so it is meant for tables that are only read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if held >= 2 * cores else df.repartition(4 * cores, key)


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a fresh folder beside the checkpoints, for tables that are written and read again; it stays until that folder is cleared."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
