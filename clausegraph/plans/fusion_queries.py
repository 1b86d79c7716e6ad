"""Queries of reordering, multi-hop and label operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegraph.operators import fusion as X
from clausegraph.operators import hierarchy as H
from clausegraph.operators import patterns as P
from clausegraph.operators import review as V
from clausegraph.plans.eval_queries import RATINGS, RUNS, gold, ratings, runs
from clausegraph.plans.graph_queries import SECTIONS, graph
from clausegraph.plans.registry import query, table
from clausegraph.plans.text_queries import BM25, DENSE, bm25, dense

OTHER = ", o AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc) AS rank FROM bm WHERE doc % 2 = 0) "


def _other(spark, d):
    return bm25(spark, d).where("doc % 2 = 0").select("qid", "doc", F.row_number().over(Window.partitionBy("qid").orderBy("doc")).alias("rank"))


@query("r7_title_merge", BM25 + OTHER + ", f AS (SELECT qid, doc, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT qid, doc, rank FROM bm UNION ALL SELECT qid, doc, rank FROM o) GROUP BY ALL) SELECT qid, doc, round(s / max(s) OVER (PARTITION BY qid), 9) AS score FROM f")
def title_merge(spark, d):
    return X.title_merge(bm25(spark, d), _other(spark, d))


@query("r13_protected", BM25 + ", k AS (SELECT qid, doc, score FROM bm WHERE rank <= 3), l AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS n FROM bm WHERE rank > 3 AND doc % 3 = 0) SELECT qid, doc, score, false AS protected FROM k UNION ALL SELECT qid, doc, score, true FROM l WHERE n <= 4")
def protected(spark, d):
    rows = bm25(spark, d)
    return X.protect(rows.where("rank <= 3"), rows, F.col("doc") % 3 == 0)


@query("r22_anchors_first", BM25 + "SELECT qid, doc, position FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc % 4 = 0 DESC, rank) AS position FROM bm) WHERE position <= 6")
def anchors_first(spark, d):
    return X.front(bm25(spark, d), F.col("doc") % 4 == 0, 6).select("qid", "doc", "position")


@query("r21_two_budgets", BM25 + ", n AS (SELECT qid, doc, rank, doc % 3 = 0 AS in_closure, row_number() OVER (PARTITION BY qid, doc % 3 = 0 ORDER BY rank) AS n FROM bm) SELECT qid, doc, in_closure, row_number() OVER (PARTITION BY qid ORDER BY in_closure DESC, rank) AS position FROM n WHERE n <= CASE WHEN in_closure THEN 4 ELSE 3 END")
def two_budgets(spark, d):
    return X.two_budgets(bm25(spark, d), F.col("doc") % 3 == 0, 4, 3).select("qid", "doc", "in_closure", "position")


@query("j45_graded_anchors", BM25 + "SELECT qid, doc, CASE WHEN doc % 2 = 0 AND sum(CASE WHEN doc % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank, doc ROWS UNBOUNDED PRECEDING) <= 2 THEN 'hard' ELSE 'soft' END AS grade FROM bm")
def graded(spark, d):
    return X.graded(bm25(spark, d).withColumnRenamed("rank", "ord"), F.col("doc") % 2 == 0, 2).select("qid", "doc", "grade")


@query("w14_over_maximum", DENSE + "SELECT qid, doc, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM de")
def over_maximum(spark, d):
    return dense(spark, d).select("qid", "doc", F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 6).alias("score"))


@query("j31_merged_patterns", BM25 + ", a AS (SELECT doc, max(score) AS score, 1 AS hops, 0 AS part FROM bm WHERE rank <= 2 GROUP BY doc), b AS (SELECT doc, max(score) AS score, 2 AS hops, 1 AS part FROM bm GROUP BY doc) SELECT doc, score, hops, part FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, score DESC, hops) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1")
def merged(spark, d):
    rows = bm25(spark, d)
    part = lambda df, h: df.groupBy("doc").agg(F.max("score").alias("score")).withColumn("hops", F.lit(h))
    return X.merged(part(rows.where("rank <= 2"), 1), part(rows, 2))


HOP = """, s AS (SELECT DISTINCT chunk_id AS seed FROM mentions WHERE term <= 2),
h1 AS (SELECT seed, dst AS t, src AS a1, dst AS b1 FROM s JOIN refs ON src = seed), h2 AS (SELECT seed, dst AS t, a1, b1, src AS a2, dst AS b2 FROM h1 JOIN refs ON src = t WHERE NOT (src = a1 AND dst = b1)),
h3 AS (SELECT seed, dst AS t FROM h2 JOIN refs ON src = t WHERE NOT (src = a1 AND dst = b1) AND NOT (src = a2 AND dst = b2))
SELECT seed, t AS target, min(hops) AS hops FROM (SELECT seed, t, 1 AS hops FROM h1 UNION ALL SELECT seed, t, 2 FROM h2 UNION ALL SELECT seed, t, 3 FROM h3) WHERE seed <> t GROUP BY seed, t"""
graph("j30_multi_hop", HOP)(lambda g: X.multi_hop(g.mentions.where("term <= 2").select(F.col("chunk_id").alias("seed")).distinct(), g.refs))
graph("j27_cited_from_specs", ", s AS (SELECT chunk_id FROM chunks WHERE spec_id IN (SELECT primary_spec FROM terms WHERE term = 7)) SELECT DISTINCT dst AS chunk_id FROM refs WHERE src IN (SELECT chunk_id FROM s) AND dst IN (SELECT chunk_id FROM chunks)")(
    lambda g: g.refs.join(g.chunks.join(g.terms.where("term = 7").select(F.col("primary_spec").alias("spec_id")), "spec_id", "left_semi").select(F.col("chunk_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("chunk_id")).distinct().join(g.chunks.select("chunk_id"), "chunk_id", "left_semi")
)
graph("j28_chunks_of_cited_specs", ", e AS (SELECT DISTINCT b.spec_id FROM refs r JOIN chunks a ON a.chunk_id = r.src JOIN chunks b ON b.chunk_id = r.dst WHERE r.is_external AND a.spec_id = 3) SELECT chunk_id, spec_id FROM chunks WHERE spec_id IN (SELECT spec_id FROM e) AND spec_id <> 3")(
    lambda g: g.chunks.where("spec_id <> 3").join(
        g.refs.where("is_external").join(g.chunks.where("spec_id = 3").select(F.col("chunk_id").alias("src")), "src", "left_semi").join(g.chunks.select(F.col("chunk_id").alias("dst"), "spec_id"), "dst").select("spec_id").distinct(), "spec_id", "left_semi"
    ).select("chunk_id", "spec_id")
)
graph("j29_same_subject", "SELECT chunk_id, first_value(chunk_id) OVER w AS same_as, count(*) OVER (PARTITION BY spec_id, title) AS n FROM chunks WHERE (spec_id, title) IN (SELECT (spec_id, title) FROM chunks GROUP BY spec_id, title HAVING count(*) > 1 AND bool_or(chunk_type = 'definition')) WINDOW w AS (PARTITION BY spec_id, title ORDER BY chunk_type <> 'definition', chunk_id)")(lambda g: H.same_subject(g.chunks))
graph("j10_name_bridge", "SELECT s.s_suppkey AS op, t.term FROM (SELECT s_suppkey, upper(p_name) AS name FROM supplier JOIN part ON p_partkey = s_suppkey * 3) s JOIN terms t ON lower(s.name) = lower(t.full_name)")(lambda g: P.name_bridge(g.operations.join(g.terms.select((F.col("term") / 3).alias("op"), F.upper("full_name").alias("name")), "op").select("op", "name"), g.terms))
graph("j44_value_anchor", ", v AS (SELECT service, chunk_id, count(DISTINCT CASE WHEN op % 2 = 0 THEN op END) AS hits, count(DISTINCT op) AS n FROM describes JOIN operations USING (op) GROUP BY ALL) SELECT service, chunk_id, hits, n FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY hits DESC, n DESC, chunk_id) AS k FROM v) WHERE k <= 2")(
    lambda g: g.describes.join(g.operations, "op").groupBy("service", "chunk_id").agg(F.countDistinct(F.when(F.col("op") % 2 == 0, F.col("op"))).alias("hits"), F.countDistinct("op").alias("n"))
    .withColumn("k", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("hits"), F.desc("n"), "chunk_id"))).where("k <= 2").select("service", "chunk_id", "hits", "n")
)
graph("j47_closure_citations", SECTIONS + ", t AS (SELECT chunk_id FROM chunks WHERE spec_id = 3 AND (section_id = '2' OR starts_with(section_id, '2.'))) SELECT DISTINCT dst AS chunk_id FROM refs WHERE src IN (SELECT chunk_id FROM t)")(
    lambda g: g.refs.join(g.chunks.where((F.col("spec_id") == 3) & F.col("section_id").rlike(r"^2(\.|$)")).select(F.col("chunk_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("chunk_id")).distinct()
)
graph("p7_levels", "SELECT chunk_id, len(string_split(section_id, '.')) AS level, CASE WHEN contains(section_id, '.') THEN regexp_replace(section_id, '[.][^.]*$', '') END AS parent FROM chunks")(
    lambda g: g.chunks.select("chunk_id", H.T.level(F.col("section_id")).cast("long").alias("level"), H.T.parent_id(F.col("section_id")).alias("parent"))
)


@query("e5_label_schemes", RUNS + ", j AS (SELECT DISTINCT qid, unnest(ranked[1:5]) AS doc FROM runs), jl AS (SELECT qid, doc, CASE doc % 3 WHEN 0 THEN 'RELEVANT' WHEN 1 THEN 'PARTIAL' ELSE 'NOT_RELEVANT' END AS label FROM j), r AS (SELECT coalesce(g.qid, jl.qid) AS qid, coalesce(g.doc, jl.doc) AS doc, g.doc IS NOT NULL AS g, label FROM (SELECT qid, unnest(gold) AS doc FROM gold) g FULL JOIN jl ON g.qid = jl.qid AND g.doc = jl.doc) SELECT qid, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY doc) FILTER (WHERE g), '') AS old, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY doc) FILTER (WHERE label = 'RELEVANT' OR (g AND label IS NULL)), '') AS strict, coalesce(string_agg(doc::VARCHAR, ',' ORDER BY doc) FILTER (WHERE label IN ('RELEVANT', 'PARTIAL') OR (g AND label IS NULL)), '') AS lenient FROM r GROUP BY qid")
def label_schemes(spark, d):
    k = F.col("doc") % 3
    judged = runs(spark, d).select("qid", F.explode(F.slice("ranked", 1, 5)).alias("doc")).distinct().withColumn("label", F.when(k == 0, "RELEVANT").when(k == 1, "PARTIAL").otherwise("NOT_RELEVANT"))
    return X.label_schemes(gold(spark, d), judged).select("qid", *[F.array_join(c, ",").alias(c) for c in ("old", "strict", "lenient")])


@query("e18_confusion", "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY quality")
def confusion(spark, d):
    rows = table(spark, d, "labels").withColumn("j", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return X.confusion(rows, "quality", "j", ["clean", "toxic"])


@query("w11_next_unfinished", "SELECT o_custkey AS reviewer, arg_min(o_orderkey, (o_orderkey % 7, o_orderkey)) AS item FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_custkey")
def next_unfinished(spark, d):
    o = table(spark, d, "orders")
    assigned = o.select(F.col("o_custkey").alias("reviewer"), F.col("o_orderkey").alias("item"), F.struct(F.col("o_orderkey") % 7, "o_orderkey").alias("ord"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item")).distinct().join(assigned, "item")
    return V.next_unfinished(assigned, done)


@query("o8_append_missing", RATINGS + "SELECT item, rater FROM ratings UNION ALL SELECT o_orderkey, 9 FROM orders WHERE o_orderkey NOT IN (SELECT item FROM ratings)")
def append_missing(spark, d):
    have = ratings(spark, d).select("item", F.col("rater").cast("int").alias("rater"))
    return have.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lit(9).alias("rater")).join(have.select("item"), "item", "left_anti"))


@query("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """An extension, no operator of the graph: tumbling windows."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
