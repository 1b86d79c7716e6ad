"""Incremental ingestion: a file stream of clause JSON, merged batch by batch into a table partitioned by specification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.sources.documents import DOCUMENT


def clause_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """Clauses of files as they arrive, with the file's time as their version."""
    files = spark.readStream.schema(DOCUMENT).option("multiLine", "true").option("maxFilesPerTrigger", files_a_trigger).json(folder)
    rows = files.select(F.col("metadata.specification_id").alias("spec_id"), F.col("_metadata.file_modification_time").alias("seen"), F.explode("chunks").alias("c"))
    return rows.select("spec_id", "seen", "c.*")


def latest(rows: DataFrame) -> DataFrame:
    """One row a clause: the last seen wins, ties by content."""
    order = Window.partitionBy("spec_id", "chunk_id").orderBy(F.desc("seen"), F.desc("content"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merge(batch: DataFrame, table: str) -> None:
    """Merges clauses (with their version `seen`) into a Parquet table partitioned by specification.

    The stored clauses of the batch's specifications are read and merged by clause, the last seen wins;
    then those partitions alone are replaced. The merged rows are first written beside the table, as a
    path can't be overwritten while it is read. A batch that runs again, after a failure at any point,
    merges the same rows to the same result.
    """
    spark, staged = batch.sparkSession, f"{table.rstrip('/')}.merging"
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    rows = batch
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        stored = spark.read.schema(batch.schema).parquet(table)
        rows = batch.unionByName(stored.join(batch.select("spec_id").distinct(), "spec_id", "left_semi"))
    latest(rows).write.mode("overwrite").parquet(staged)
    spark.read.schema(batch.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("spec_id").parquet(table)


def ingest(stream: DataFrame, table: str, checkpoint: str):
    """Starts the stream into a Parquet table partitioned by specification; later batches add to the specifications of earlier ones."""

    def write(batch: DataFrame, _: int) -> None:
        merge(batch, table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extension beyond the graph: counts and sums of an event stream by window and type, for events at most `late` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
