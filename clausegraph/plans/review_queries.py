"""Queries over a review log that is made from the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions.lineage import new_folder
from clausegraph.plans import review_store as S
from clausegraph.plans.registry import query, table

LOG = """
WITH l AS (SELECT l_partkey % 3 + 1 AS campaign_id, 'q' || l_partkey % 40 AS qid, l_suppkey % 9 AS reviewer_id, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS ord, l_orderkey % 5000 AS sec, * FROM lineitem),
edge AS (SELECT max(ord) // 2 AS half FROM l),
puts AS (SELECT l.* FROM l WHERE l_quantity >= 3), dels AS (SELECT campaign_id, qid, reviewer_id, max(ord) AS gone FROM l WHERE l_quantity < 3 GROUP BY ALL),
"""
RATINGS = LOG + """
live AS (SELECT p.* FROM puts p LEFT JOIN dels USING (campaign_id, qid, reviewer_id) WHERE gone IS NULL OR ord > gone)
"""
RATED = "SELECT campaign_id, qid, reviewer_id, arg_max(l_returnflag, ord) FILTER (WHERE l_linenumber % 2 = 1) AS c1, coalesce(arg_max(CASE WHEN l_linestatus = 'O' THEN 'final' ELSE 'draft' END, ord) FILTER (WHERE l_linenumber % 2 = 0), 'draft') AS status, count(*) - 1 AS revision, min(sec) AS created_at, max(sec) AS updated_at FROM live GROUP BY ALL"


def _log(spark, d):
    """Ratings in two partial kinds of puts and deletions; assignments; questions, some out of scope; and the end of one campaign in the middle."""
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_partkey") % 3 + 1).alias("campaign_id"), F.concat(F.lit("q"), (F.col("l_partkey") % 40).cast("string")).alias("qid"), (F.col("l_suppkey") % 9).alias("reviewer_id"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"), (F.col("l_orderkey") % 5000).alias("at"), "l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    puts, odd = rows.where("l_quantity >= 3"), F.col("l_linenumber") % 2 == 1
    half = rows.agg(F.floor(F.max("ord") / 2).alias("ord"))
    log = S.events(puts.where(odd).withColumn("c1", F.col("l_returnflag")), "ratings")
    log = log.unionByName(S.events(puts.where(~odd).withColumn("status", F.when(F.col("l_linestatus") == "O", "final").otherwise("draft")), "ratings"))
    log = log.unionByName(S.events(rows.where("l_quantity < 3"), "ratings", S.DELETE))
    log = log.unionByName(S.events(puts.withColumn("order_idx", F.col("ord") % 100), "assignments"))
    log = log.unionByName(S.events(puts.withColumn("in_scope", (F.col("l_quantity") < 45).cast("int")), "questions"))
    log = log.unionByName(S.events(half.select(F.lit(2).alias("id"), "ord", F.lit(0).alias("at")), "campaigns", S.DELETE))
    folder = new_folder(spark, "review")
    S.append(spark, folder, log)
    return S.open_log(spark, folder)


@query("s15_ratings", RATINGS + RATED)
def ratings(spark, d):
    """The ratings that a log of partial puts and deletions comes to."""
    return S.fold(_log(spark, d), "ratings").select("campaign_id", "qid", "reviewer_id", "c1", "status", "revision", "created_at", "updated_at")


@query(
    "e22_queue",
    RATINGS + f""", rated AS ({RATED}), kept AS (SELECT puts.* FROM puts, edge WHERE campaign_id <> 2 OR ord > half),
asked AS (SELECT campaign_id, qid, reviewer_id, arg_max(ord % 100, ord) AS order_idx FROM kept GROUP BY ALL),
scope AS (SELECT campaign_id, qid FROM kept GROUP BY ALL HAVING arg_max(l_quantity < 45, ord)),
open AS (SELECT a.* FROM asked a SEMI JOIN scope USING (campaign_id, qid) ANTI JOIN (SELECT * FROM rated WHERE status = 'final') f USING (campaign_id, qid, reviewer_id))
SELECT campaign_id, reviewer_id, qid, order_idx::INT AS order_idx FROM open QUALIFY row_number() OVER (PARTITION BY campaign_id, reviewer_id ORDER BY order_idx, qid) = 1""",
)
def next_questions(spark, d):
    """Each reviewer's next question, over the folded tables."""
    return S.queue(_log(spark, d))
