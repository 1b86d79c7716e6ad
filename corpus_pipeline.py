"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The stages but the
last return the columns of documents; packing returns its pieces. run() writes each stage's rows
below the folder in spark.checkpoint.dir and reads them again, so a lost executor costs one stage.

Defined cases: a text that is null, empty or without a letter has no language, so the first stage
drops it. Later stages, which take any table, count a null text as empty. Of rows that repeat id and
text one passes exact dedup; rows that repeat an id alone, or have none, are documents of their own.
A null source is a source. An empty table gives empty results with the same columns; other columns,
whatever their names, are carried to the mixing stage and not read. Near copies are linked by the
fingerprints' rule (three-word shingles, three bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm import exact_dedup, langid, mixing, packing, simhash
from clausegraph.llm.common import load, new_folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that makes up half of them or more."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget has it, in the order of the copies' places; none is left out."""
    return mixing.mix(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    return packing.pack(docs)


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: SQL can express neither the fitted languages nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
