"""Queries of batch answering, a mode each, with the SQL of the modes whose branches SQL can express."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausegraph.plans.graph import VIEWS, order_graph
from clausegraph.plans.registry import query, table
from clausegraph.plans.service import Config, answer
from clausegraph.plans.text_queries import BM25


def _documents(spark, d):
    """A graph whose clauses are the documents, and nothing else."""
    g = order_graph(spark, d)
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("spec_id"), F.lit("1").alias("section_id"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("general").alias("chunk_type"))
    return replace(g, chunks=chunks, terms=g.terms.limit(0), mentions=g.mentions.limit(0), refs=g.refs.limit(0), describes=g.describes.limit(0), steps=g.steps.limit(0), involves=g.involves.limit(0), provided=g.provided.limit(0))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query("r40_bm25", BM25 + "SELECT qid, doc, rank, 'bm25' AS via FROM bm")
def sparse(spark, d):
    """The sparse branch alone, not ranked anew."""
    found, _ = answer(_documents(spark, d), _asked(spark, d), Config(mode="bm25", rerank=False, wide=10, rung="entity"))
    return found.select("qid", "doc", "rank", "via")


@query("r40_context", BM25.replace("WITH d", "WITH RECURSIVE d") + """, x AS (SELECT qid, doc, rank, n_chars, least(n_chars, 4000) AS size FROM bm JOIN documents ON doc_id = doc),
fold AS (SELECT qid, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS doc, false AS fits FROM (SELECT DISTINCT qid FROM x) UNION ALL SELECT f.qid, x.rank, CASE WHEN f.used + x.size <= 9000 THEN f.used + x.size ELSE f.used END, x.doc, f.used + x.size <= 9000 FROM fold f JOIN x ON x.qid = f.qid AND x.rank = f.rank + 1)
SELECT qid, doc, fits AS in_context FROM fold WHERE doc IS NOT NULL""")
def in_context(spark, d):
    """Which clauses of an answer fit its context."""
    found, _ = answer(_documents(spark, d), _asked(spark, d), Config(mode="bm25", rerank=False, wide=10, rung="entity", context=9000))
    return found.select("qid", "doc", "in_context")


GRAPHED = VIEWS + """, named(qid, term) AS (VALUES (1, 1), (1, 2), (2, 2)), said AS (SELECT qid, chunk_id AS doc, count(DISTINCT term) AS score FROM named JOIN mentions USING (term) GROUP BY ALL)
SELECT qid, doc, rank, 'graph' AS via FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM said) WHERE rank <= 10"""


@query("r40_graph", GRAPHED)
def graph(spark, d):
    """The graph's branch alone, by the terms that a question names."""
    g = order_graph(spark, d)
    g = replace(g, terms=spark.createDataFrame([(1, "small ring"), (2, "green part")], "term long, full_name string"))
    asked = spark.createDataFrame([(1, "where do a small ring and a green part meet"), (2, "what is a green part"), (3, "nothing named")], "qid int, question string")
    found, _ = answer(g, asked, Config(mode="graph", rerank=False, rung="entity"))
    return found.select("qid", "doc", "rank", "via")


@query("r40_none", "SELECT item_id AS qid, CAST(NULL AS BIGINT) AS doc FROM benchmark WHERE false")
def nothing(spark, d):
    found, _ = answer(_documents(spark, d), _asked(spark, d), Config(mode="none"))
    return found.select("qid", "doc")


def _fused(mode):
    def run(spark, d):
        g = order_graph(spark, d)
        g = replace(g, terms=g.terms.where("term <= 20"))
        asked = spark.createDataFrame([(1, "which order shall be open by its own rules"), (2, "what mentions the parts")], "qid int, question string")
        return answer(g, asked, Config(mode=mode))[0]

    return run


# Dense branches embed by hashed words, which SQL has no function for: tests hold the modes against each other.
for mode in ("dense", "bm25_dense", "fixed", "hybrid"):
    query(f"r40_{mode}")(_fused(mode))
