"""Queries over the analogue's procedure layer (see plans.graph), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import procedures as C
from clausegraph.plans.graph import LAYER, VIEWS, order_graph, order_procedures
from clausegraph.plans.registry import query

ORDER = "list_position([" + ", ".join(f"'{r}'" for r in C.GRAPH_ROLES) + "], role)"


def _asked(spark, d):
    """The clauses, and (qid, root) of the procedures that questions are about and of those that they only name."""
    chunks = order_graph(spark, d).chunks
    roots = chunks.select(F.col("spec_id").alias("qid"), F.concat(F.lit("p"), F.col("spec_id").cast("string"), F.lit(".2.1.0")).alias("root")).distinct()
    return chunks, roots, roots.select("qid", F.concat(F.lit("p"), F.col("qid").cast("string"), F.lit(".3")).alias("root"))


@query("j49_graph_closure", VIEWS + LAYER + "SELECT qid, chunk_id, role FROM closed")
def graph_closure(spark, d):
    _, roots, named = _asked(spark, d)
    return C.graph_closure(roots, order_procedures(spark, d), named)


WORTH = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in C.ROLES.items()) + " END::DOUBLE"


@query(
    "j50_closure_assembly",
    VIEWS + LAYER + f""", firsts AS (SELECT qid, chunk_id, arg_min(role, {ORDER}) AS role FROM closed GROUP BY ALL)
SELECT qid, chunk_id, role, {WORTH} AS score, row_number() OVER (PARTITION BY qid ORDER BY {ORDER}, chunk_id) AS position FROM firsts QUALIFY position <= {C.MOST_CLAUSES}""",
)
def closure_assembly(spark, d):
    chunks, roots, named = _asked(spark, d)
    return C.assembled_closure(roots, order_procedures(spark, d), chunks, named)
