"""Queries of closures in order, judges against raters, checks of a graph, and fetches by id, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import fusion as X
from clausegraph.operators import retrieval as R
from clausegraph.plans import store
from clausegraph.plans.graph import VIEWS, order_graph
from clausegraph.plans.registry import query, table
from clausegraph.plans.text_queries import BM25, bm25

STOP = ", ".join(f"'{w}'" for w in T.MATCH_STOP)
POOL_WORDS = f"list_filter(regexp_extract_all(lower(coalesce(XX, '')), '[a-z0-9_'']+'), lambda w: w NOT IN ({STOP}))"


@query("r5_closure_order", BM25 + f""", cl AS (SELECT qid, doc, rank, {POOL_WORDS.replace("XX", "text")} AS t FROM bm JOIN documents ON doc_id = doc),
ask AS (SELECT DISTINCT item_id AS qid, unnest({POOL_WORDS.replace("XX", "text")}) AS term FROM benchmark),
ps AS (SELECT qid, count(*) AS n, greatest(avg(len(t)), 1e-9) AS a FROM cl GROUP BY qid),
ptf AS (SELECT qid, doc, len(t) AS dl, term, count(*) AS tf FROM (SELECT qid, doc, t, unnest(t) AS term FROM cl) JOIN ask USING (qid, term) GROUP BY ALL),
pdf AS (SELECT qid, term, count(*) AS df FROM ptf GROUP BY ALL),
sc AS (SELECT qid, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS s FROM ptf JOIN pdf USING (qid, term) JOIN ps USING (qid) GROUP BY ALL),
ev AS (SELECT qid, doc, coalesce(s, 0.0) AS s, min(coalesce(s, 0.0)) OVER (PARTITION BY qid) AS lo, max(coalesce(s, 0.0)) OVER (PARTITION BY qid) AS hi, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY rank, doc) AS pos FROM cl LEFT JOIN sc USING (qid, doc)),
nm AS (SELECT *, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.0 END AS m FROM ev),
fin AS (SELECT *, CASE WHEN n > 1 THEN round(m + 1 - (pos - 1)::DOUBLE / (n - 1), 6) ELSE 0.0 END AS score FROM nm)
SELECT qid, doc, round(m, 6) AS bm, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS place FROM fin""")
def closure_order(spark, d):
    """The ten best documents of each benchmark question as its closure, over whole texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return R.rank_closure(bm25(spark, d).select("qid", "doc", "rank").join(docs, "doc"), asked)


JUDGES = """
WITH jd AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS doc, CASE l_partkey % 4 WHEN 0 THEN 'NOT_RELEVANT' WHEN 1 THEN 'PARTIAL' ELSE 'RELEVANT' END AS label FROM lineitem WHERE l_orderkey % 5 <> 1),
rt AS (SELECT l_orderkey AS qid, l_suppkey AS rater, CASE max(l_linenumber) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS says, list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS irr FROM lineitem GROUP BY ALL),
ch AS (SELECT label, CASE WHEN coalesce(list_contains(irr, doc), false) THEN 'irrelevant' ELSE 'relevant' END AS says FROM jd JOIN rt USING (qid)),
wo AS (SELECT qid, arg_min(label, CASE label WHEN 'NOT_RELEVANT' THEN 0 WHEN 'PARTIAL' THEN 1 ELSE 2 END) AS label FROM jd GROUP BY qid),
cells AS (SELECT 'chunk' AS level, j AS judge, r AS rater FROM (VALUES ('NOT_RELEVANT'), ('PARTIAL'), ('RELEVANT')) a(j), (VALUES ('relevant'), ('irrelevant')) b(r) UNION ALL SELECT 'question', j, r FROM (VALUES ('NOT_RELEVANT'), ('PARTIAL'), ('RELEVANT')) a(j), (VALUES ('full'), ('partial'), ('none')) b(r)),
cn AS (SELECT 'chunk' AS level, label AS judge, says AS rater, count(*) AS n FROM ch GROUP BY ALL UNION ALL SELECT 'question', label, says, count(*) FROM wo JOIN rt USING (qid) GROUP BY ALL)
SELECT level, judge, rater, coalesce(n, 0) AS n FROM cells LEFT JOIN cn USING (level, judge, rater)
"""


@query("e18_judge_levels", JUDGES)
def judge_levels(spark, d):
    """Orders are questions, their parts judged clauses, their suppliers raters who find returned parts irrelevant."""
    li = table(spark, d, "lineitem")
    k = F.col("doc") % 4
    judged = li.where("l_orderkey % 5 <> 1").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc")).distinct().withColumn("label", F.when(k == 0, "NOT_RELEVANT").when(k == 1, "PARTIAL").otherwise("RELEVANT"))
    n = F.max("l_linenumber") % 3
    ratings = li.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("rater")).agg(F.when(n == 0, "full").when(n == 1, "partial").otherwise("none").alias("says"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("irrelevant"))
    return X.judge_confusion(judged, ratings)


EDGES = ("mentions", "describes", "provided", "steps", "involves", "refs")


@query("t16_validate", VIEWS + " ".join(f"{'' if k == 0 else 'UNION ALL'} SELECT 'edge' AS part, '{e}' AS name, count(*) AS n, count(*) > 0 AS holds FROM {e}" for k, e in enumerate(EDGES)) + """
UNION ALL SELECT 'edge', 'denotes', count(*), count(*) > 0 FROM mentions WHERE term < 0
UNION ALL SELECT 'term', t, (SELECT count(*) FROM terms WHERE term::VARCHAR = t), (SELECT count(*) FROM terms WHERE term::VARCHAR = t) > 0 FROM (VALUES ('1'), ('2'), ('AMF')) v(t)
UNION ALL SELECT 'value', '3:Supplier', count(*), coalesce(bool_and(s_suppkey % 2 = 2), false) FROM supplier WHERE s_nationkey = 3""")
def validate(spark, d):
    """The order graph's edges, one kind of which has none, its terms, and a value that does not hold."""
    g = order_graph(spark, d)
    edges = {e: getattr(g, e) for e in EDGES} | {"denotes": g.mentions.where("term < 0")}
    values = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("concept"), F.lit("Supplier").alias("name"), (F.col("s_suppkey") % 2).cast("string").alias("code"))
    return X.validate(edges, g.terms, ["1", "2", "AMF"], values, ("3", "Supplier", "2"))


@query("s23_fetched", "WITH a AS (SELECT DISTINCT l_partkey * 10 AS id FROM lineitem) SELECT id AS o_orderkey, o_custkey, o_orderstatus, o_orderkey IS NOT NULL AS found FROM a LEFT JOIN orders ON o_orderkey = id")
def fetched(spark, d):
    """Orders by ids that the lines name; ids of no order come back as not found."""
    ids = table(spark, d, "lineitem").select((F.col("l_partkey") * 10).alias("o_orderkey"))
    return store.fetch(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ids, "o_orderkey")
