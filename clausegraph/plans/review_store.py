"""The review store: an append-only log of events, folded into keyed tables.

An event puts some columns of a row, or deletes one. The log is a folder of Parquet batches that are only
ever added; nothing is updated in place, so a job that is repeated or lost leaves the log as it was. A table
is the fold of its events: of each column the last value that was put since the row was last deleted. A
column that a later version of the schema adds has its default in rows that never put it, so old logs need
no migration. Deleting a campaign deletes what belongs to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "batch long, ord long, at long, actor string, entity string, op string, row map<string,string>"
PUT, DELETE = "put", "delete"


@dataclass(frozen=True)
class Table:
    """keys and columns with their types; defaults of columns that may be missing; unique: columns that no two rows share; of: the table whose deletion takes its rows along, met by the key campaign_id."""

    keys: dict[str, str]
    columns: dict[str, str]
    defaults: dict[str, object] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    of: str | None = None


_TEXT = lambda names: dict.fromkeys(names.split(), "string")
# The tables of the store, their keys and their defaults.
TABLES = {
    "campaigns": Table({"id": "long"}, {**_TEXT("name sample_file status"), "seed": "long", "raters_per_q": "int", "all_raters": "int", "requires_campaign_id": "long"}, {"status": "open", "all_raters": 0}, unique=("name",)),
    "questions": Table({"campaign_id": "long", "qid": "string"}, {"pos": "int", **_TEXT("batch question question_class question_subclass question_type spec_series gold_chunk_ids reference_answer judge_gold"), "in_scope": "int"}, {"in_scope": 1}, of="campaigns"),
    "gold_chunks": Table({"campaign_id": "long", "chunk_id": "string"}, {**_TEXT("spec_id section_id section_title content tables_json"), "n_chars": "int"}, of="campaigns"),
    "reviewers": Table({"id": "long"}, {**_TEXT("name role password_hash"), "active": "int"}, {"role": "rater", "active": 1}, unique=("name",)),
    "assignments": Table({"campaign_id": "long", "qid": "string", "reviewer_id": "long"}, {"order_idx": "int"}, of="campaigns"),
    "ratings": Table({"campaign_id": "long", "qid": "string", "reviewer_id": "long"}, {**_TEXT("status c1 c1_note c2 c2_note irrelevant_chunks own_answer c3 verdict comment fix_text"), "t_phase1_s": "double", "t_phase2_s": "double", "revealed_at": "long"}, {"status": "draft"}),
    "adjudications": Table({"campaign_id": "long", "qid": "string"}, _TEXT("decision note decided_by")),
    "events": Table({"id": "long"}, {"ts": "long", **_TEXT("reviewer kind detail")}),
}


def events(rows: DataFrame, entity: str, op: str = PUT, ord_col: str = "ord", at_col: str = "at", actor: str = "") -> DataFrame:
    """Events of one entity from its rows: the columns of the table that rows has, or only its keys for deletions; ord orders them within their batch."""
    table = TABLES[entity]
    names = [c for c in (*table.keys, *(table.columns if op == PUT else ())) if c in rows.columns]
    if missing := set(table.keys) - set(names):
        raise ValueError(f"{entity} has no {', '.join(sorted(missing))}")
    row = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names]))
    at = F.col(at_col).cast("long") if at_col in rows.columns else F.unix_timestamp()
    return rows.select(F.lit(0).cast("long").alias("batch"), F.col(ord_col).cast("long").alias("ord"), at.alias("at"), F.lit(actor).alias("actor"), F.lit(entity).alias("entity"), F.lit(op).alias("op"), row.alias("row"))


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log; none where there is no log yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).parquet(path)


def append(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Adds events as the log's next batch and says its number. One writer at a time."""
    batch = (open_log(spark, path).agg(F.max("batch")).first()[0] or 0) + 1
    new.withColumn("batch", F.lit(batch).cast("long")).select("batch", "ord", "at", "actor", "entity", "op", "row").write.mode("append").parquet(path)
    return batch


def fold(log: DataFrame, entity: str) -> DataFrame:
    """The rows of a table: its keys, its columns, revision (puts after the first), created_at and updated_at.

    Events are ordered by batch and ord; of two of the same order the later time counts. A row of which a key
    is null is none. A rating has no parent: it outlives its campaign.
    """
    table = TABLES[entity]
    place = F.struct("batch", "ord", "at")
    key = lambda k, t: F.col("row")[k].cast(t).alias(k)
    mine = log.where(F.col("entity") == entity).select(*[key(k, t) for k, t in table.keys.items()], place.alias("place"), "at", "op", "row").dropna(subset=list(table.keys))
    gone = mine.where(F.col("op") == DELETE).groupBy(*table.keys).agg(F.max("place").alias("_gone"))
    live = mine.where(F.col("op") == PUT).join(gone, list(table.keys), "left").where("_gone is null or place > _gone")
    if table.of:
        ended = log.where((F.col("entity") == table.of) & (F.col("op") == DELETE)).select(F.col("row")["id"].cast("long").alias("campaign_id"), place.alias("_ended")).groupBy("campaign_id").agg(F.max("_ended").alias("_ended"))
        live = live.join(ended, "campaign_id", "left").where("_ended is null or place > _ended")

    def last(c: str, t: str) -> Column:
        put = F.max_by(F.struct(F.col("row")[c].alias("v")), F.when(F.map_contains_key("row", c), F.col("place")))
        value = F.when(put.isNull(), F.lit(table.defaults.get(c)).cast("string")).otherwise(put["v"])
        return value.cast(t).alias(c)

    return live.groupBy(*table.keys).agg(*[last(c, t) for c, t in table.columns.items()], (F.count(F.lit(1)) - 1).alias("revision"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def conflicts(log: DataFrame, entity: str) -> DataFrame:
    """(column, value, n): values of unique columns that several rows of a table have."""
    rows, out = fold(log, entity), None
    for c in TABLES[entity].unique:
        one = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(c).alias("column"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else log.sparkSession.createDataFrame([], "column string, value string, n long")


def queue(log: DataFrame) -> DataFrame:
    """(campaign_id, reviewer_id, qid, order_idx): each reviewer's next question of each campaign: the first assigned in scope whose rating isn't final."""
    asked = fold(log, "assignments").select("campaign_id", "qid", "reviewer_id", "order_idx")
    scope = fold(log, "questions").where("in_scope = 1").select("campaign_id", "qid")
    final = fold(log, "ratings").where("status = 'final'").select("campaign_id", "qid", "reviewer_id")
    left = asked.join(scope, ["campaign_id", "qid"], "left_semi").join(final, ["campaign_id", "qid", "reviewer_id"], "left_anti")
    first = left.groupBy("campaign_id", "reviewer_id").agg(F.min(F.struct("order_idx", "qid")).alias("f"))
    return first.select("campaign_id", "reviewer_id", "f.qid", "f.order_idx")
