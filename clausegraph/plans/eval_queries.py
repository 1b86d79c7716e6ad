"""Evaluation and review queries over analogues made of order lines, with their SQL.

A return flag is a retrieval configuration, a supplier a question, parts by price its ranked list;
discounted parts are gold. Line numbers modulo 3 are raters of orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import evaluation as E
from clausegraph.plans.registry import query, table

RUNS = """WITH r0 AS (SELECT l_returnflag AS config, l_suppkey AS qid, l_partkey AS doc, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
runs AS (SELECT config, qid, list(doc ORDER BY price DESC, doc) AS ranked FROM r0 GROUP BY ALL),
gold AS (SELECT l_suppkey AS qid, list_sort(list(DISTINCT l_partkey)) AS gold FROM lineitem WHERE l_discount >= 0.08 GROUP BY ALL),
scored AS (SELECT config, qid, CASE qid % 3 WHEN 0 THEN 'factoid' WHEN 1 THEN 'procedure' ELSE 'requirement' END AS class, ranked, gold, len(list_intersect(ranked[1:5], gold)) / len(gold)::DOUBLE AS recall5, CASE WHEN len(list_intersect(ranked[1:5], gold)) > 0 THEN 1 ELSE 0 END AS hit5 FROM runs JOIN gold USING (qid))
"""
RATINGS = "WITH ratings AS (SELECT l_orderkey AS item, l_linenumber % 3 AS rater, min(l_returnflag) AS label FROM lineitem GROUP BY ALL), ic AS (SELECT item, label, count(*) AS c FROM ratings GROUP BY ALL), n AS (SELECT *, sum(c) OVER (PARTITION BY item) AS n FROM ic), m AS (SELECT * FROM n WHERE n >= 2) "


def runs(spark, d):
    best = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("config"), F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc")).agg(F.max("l_extendedprice").alias("price"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "doc")))
    return best.groupBy("config", "qid").agg(F.transform(order, lambda x: x["doc"]).alias("ranked"))


def gold(spark, d):
    return table(spark, d, "lineitem").where("l_discount >= 0.08").groupBy(F.col("l_suppkey").alias("qid")).agg(F.array_sort(F.collect_set("l_partkey")).alias("gold"))


def scored(spark, d):
    kind = F.when(F.col("qid") % 3 == 0, "factoid").when(F.col("qid") % 3 == 1, "procedure").otherwise("requirement")
    rows = runs(spark, d).join(gold(spark, d), "qid").withColumn("class", kind)
    return rows.withColumns({"recall5": E.recall_at(F.col("ranked"), F.col("gold"), 5), "hit5": E.hit_at(F.col("ranked"), F.col("gold"), 5)})


def ratings(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 3).alias("rater")).agg(F.min("l_returnflag").alias("label"))


@query("e2_pool", RUNS + "SELECT qid, doc, bool_or(is_gold) AS is_gold, coalesce(string_agg(DISTINCT config, ',' ORDER BY config), '') AS configs FROM (SELECT qid, config, unnest(ranked[1:5]) AS doc, false AS is_gold FROM runs UNION ALL SELECT qid, NULL, unnest(gold), true FROM gold) GROUP BY ALL")
def pool(spark, d):
    return E.pool(runs(spark, d), gold(spark, d))


@query("e3_recall", RUNS + "SELECT config, qid, round(recall5, 9) AS recall5, hit5 FROM scored")
def recall(spark, d):
    return scored(spark, d).select("config", "qid", F.round("recall5", 9).alias("recall5"), "hit5")


@query("e7_by_class", RUNS + "SELECT config, coalesce(class, 'all') AS class, count(*) AS n, round(avg(recall5), 6) AS recall5, round(avg(hit5), 6) AS hit5 FROM scored GROUP BY GROUPING SETS ((config, class), (config))")
def by_class(spark, d):
    return E.by_class(scored(spark, d), "recall5", "hit5")


@query("e4_reciprocal_rank", RUNS + "SELECT config, qid, round(coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(ranked) + 1), lambda i: CASE WHEN list_contains(gold, ranked[i]) THEN i END), lambda x: x IS NOT NULL)), 0), 9)::DOUBLE AS rr FROM scored")
def reciprocal(spark, d):
    return scored(spark, d).select("config", "qid", F.round(E.reciprocal_rank(F.col("ranked"), F.col("gold")), 9).alias("rr"))


@query("e6_new_positives", RUNS + """, pooled AS (SELECT qid, doc, bool_or(g) AS g, list(DISTINCT config) FILTER (WHERE config IS NOT NULL) AS c FROM (SELECT qid, config, unnest(ranked[1:5]) AS doc, false AS g FROM runs UNION ALL SELECT qid, NULL, unnest(gold), true FROM gold) GROUP BY ALL),
judged AS (SELECT qid, doc, CASE doc % 4 WHEN 0 THEN 'RELEVANT' WHEN 1 THEN 'PARTIAL' ELSE 'IRRELEVANT' END AS label, unnest(c) AS config FROM pooled WHERE NOT g)
SELECT config, count(*) FILTER (WHERE label = 'RELEVANT') AS relevant, count(*) FILTER (WHERE label = 'PARTIAL') AS partial FROM judged WHERE label <> 'IRRELEVANT' GROUP BY config""")
def new_positives(spark, d):
    """Documents beyond the gold that a judge calls relevant; a document's number stands for the judge."""
    pooled = E.pool(runs(spark, d), gold(spark, d))
    label = F.when(F.col("doc") % 4 == 0, "RELEVANT").when(F.col("doc") % 4 == 1, "PARTIAL").otherwise("IRRELEVANT")
    return E.new_positives(pooled, pooled.select("qid", "doc", label.alias("label")))


@query("e8_wilson", RUNS + ", p AS (SELECT config, count(*)::DOUBLE AS n, avg(hit5) AS p FROM scored GROUP BY config), c AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS m, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS h FROM p) SELECT config, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM c")
def wilson(spark, d):
    rows = scored(spark, d).groupBy("config").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("hit5").alias("p")).withColumn("w", E.wilson(F.col("p"), F.col("n")))
    return rows.select("config", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


query("e9_percent_agreement", RATINGS + "SELECT count(*) AS items, round(avg(CASE WHEN d = 1 THEN 1 ELSE 0 END), 6) AS agreed FROM (SELECT item, count(DISTINCT label) AS d FROM ratings GROUP BY item HAVING count(*) >= 2)")(lambda spark, d: E.percent_agreement(ratings(spark, d)))
query("e10_fleiss", RATINGS + ", po AS (SELECT avg(p) AS po FROM (SELECT (sum(c * c) - max(n)) / (max(n) * (max(n) - 1)) AS p FROM m GROUP BY item)), pe AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT label, sum(c)::DOUBLE AS c FROM m GROUP BY label)) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM po, pe")(lambda spark, d: E.fleiss(ratings(spark, d)))
query("e13_krippendorff", RATINGS + ", a AS (SELECT sum(c * (n - c) / (n - 1)::DOUBLE) AS d, sum(c)::DOUBLE AS t FROM m), s AS (SELECT sum(c * c) AS s FROM (SELECT label, sum(c)::DOUBLE AS c FROM m GROUP BY label)) SELECT round(1 - (d / t) / ((t * t - s) / (t * (t - 1))), 6) AS alpha FROM a, s")(lambda spark, d: E.krippendorff(ratings(spark, d)))
query("e14_pairwise_cohen", RATINGS + ", j AS (SELECT a.rater AS r1, b.rater AS r2, a.label AS l1, b.label AS l2, count(*)::DOUBLE AS c FROM ratings a JOIN ratings b ON a.item = b.item AND a.rater < b.rater GROUP BY ALL), t AS (SELECT r1, r2, sum(c) AS n, sum(CASE WHEN l1 = l2 THEN c ELSE 0 END) AS s FROM j GROUP BY ALL), x AS (SELECT r1, r2, l1 AS l, sum(c) AS x FROM j GROUP BY ALL), y AS (SELECT r1, r2, l2 AS l, sum(c) AS y FROM j GROUP BY ALL), e AS (SELECT r1, r2, sum(x * y) AS xy FROM x JOIN y USING (r1, r2, l) GROUP BY ALL) SELECT r1, r2, n::BIGINT AS items, round((s / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa, round((k * s / n - 1) / (k - 1), 6) AS pabak FROM t JOIN e USING (r1, r2), (SELECT count(DISTINCT label) AS k FROM ratings)")(lambda spark, d: E.pairwise_cohen(ratings(spark, d)))
query("e12_cohen_labels", "WITH j AS (SELECT quality AS a, toxic AS b FROM labels), p AS (SELECT avg(CASE WHEN a = b THEN 1 ELSE 0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM j) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM p")(
    lambda spark, d: table(spark, d, "labels").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("po"), (F.avg("quality") * F.avg("toxic") + (1 - F.avg("quality")) * (1 - F.avg("toxic"))).alias("pe")).select(F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))
)
query("e19_worst_label", RATINGS + "SELECT item, arg_min(label, CASE label WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS label FROM ratings GROUP BY item")(lambda spark, d: E.worst_label(ratings(spark, d), ["R", "N", "A"]))
query("e20_passes", RATINGS + ", i AS (SELECT item, bool_or(label = 'N') AS a, bool_and(label = 'N') AS b, count(*) FILTER (WHERE label = 'N') AS g, count(*) AS n FROM ratings GROUP BY item) SELECT round(avg(a::INT), 6) AS any_pass, round(avg(b::INT), 6) AS all_pass, round(sum(g) / sum(n), 6) AS rating_pass FROM i")(lambda spark, d: E.passes(ratings(spark, d), "N"))
query("e21_needs_adjudication", RATINGS + "SELECT item FROM ratings GROUP BY item HAVING count(DISTINCT label) > 1 OR NOT bool_and(label = 'N')")(lambda spark, d: E.needs_adjudication(ratings(spark, d), "N"))
query("a11_label_pivot", RATINGS + "SELECT rater, count(*) FILTER (WHERE label = 'A') AS A, count(*) FILTER (WHERE label = 'N') AS N, count(*) FILTER (WHERE label = 'R') AS R FROM ratings GROUP BY rater")(lambda spark, d: ratings(spark, d).groupBy("rater").pivot("label", ["A", "N", "R"]).count().na.fill(0))


BOOTED = RUNS + """, pairs AS (SELECT a.class AS "group", a.qid::VARCHAR AS qid, round(a.recall5 - b.recall5, 6)::DECIMAL(18,6) AS d FROM scored a JOIN scored b ON a.qid = b.qid AND a.config = 'A' AND b.config = 'R'),
whole AS (SELECT "group", count(*) AS n, round(sum(d)::DOUBLE / count(*), 9) AS delta FROM pairs GROUP BY ALL),
w AS (SELECT "group", d, round, h, """ + " + ".join(f"(h >= {t})::INT" for t in E.poisson_steps()) + """ AS w FROM (SELECT "group", d, round, ('0x' || left(md5('20260817|' || qid || '|' || round), 8))::BIGINT AS h FROM pairs SEMI JOIN (FROM whole WHERE n >= 5) USING ("group"), range(500) AS r(round))),
m AS (SELECT "group", round(sum(w * d)::DOUBLE / sum(w), 9) AS m FROM w WHERE w > 0 GROUP BY "group", round),
ends AS (SELECT "group", round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6) AS p FROM m GROUP BY ALL)
SELECT "group", n, delta, low, high, p FROM whole LEFT JOIN ends USING ("group")
"""


@query("e15_hashed_bootstrap", BOOTED)
def hashed_bootstrap(spark, d):
    """Intervals that add up over tasks; groups of five questions or more, 500 rounds."""
    a, b = (scored(spark, d).where(F.col("config") == c).select("qid", "class", F.col("recall5").alias(x)) for c, x in (("A", "a"), ("R", "b")))
    return E.hashed_bootstrap(a.join(b.drop("class"), "qid").withColumn("group", F.col("class")).select("group", "qid", "a", "b"), rounds=500, least=5)


@query("e15_paired_bootstrap")
def bootstrap(spark, d):
    a, b = (scored(spark, d).where(F.col("config") == c).select("qid", "class", F.col("recall5").alias(x)) for c, x in (("A", "a"), ("R", "b")))
    return E.paired_bootstrap(a.join(b.drop("class"), "qid").withColumn("group", F.col("class")).select("group", "qid", "a", "b"))


@query("a3_progress", "SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean_done, max(o_orderdate) AS last FROM orders GROUP BY o_custkey")
def progress(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"), F.round(F.avg(F.when(done, F.col("o_totalprice"))), 4).alias("mean_done"), F.max("o_orderdate").alias("last"))


@query("a9_blocks", "SELECT coalesce(o_orderpriority, 'all') AS class, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def blocks(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderpriority", F.lit("all")).alias("class"), "n", "total")


@query("a10_overlapping_groups", "SELECT g, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([lang, source, lang || '/' || source]) AS g FROM documents) GROUP BY g")
def overlapping(spark, d):
    groups = F.array_distinct(F.array("lang", "source", F.concat_ws("/", "lang", "source")))
    return table(spark, d, "documents").select("doc_id", F.explode(groups).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("a12_positions", "SELECT event_type, v[len(v) // 2 + 1] AS p50, v[least(len(v), (9 * len(v)) // 10 + 1)] AS p90 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def positions(spark, d):
    """The values at half and nine tenths of the sorted list."""
    return E.at_ranks(table(spark, d, "events"), "event_type", "value", {"p50": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 9 / 10))})


@query("a14_facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facets(spark, d):
    pairs = F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")))).alias("p")
    return table(spark, d, "documents").select(pairs).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


@query("a16_facet_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3') AND (contains(lower(text), 'the') OR contains(CAST(doc_id AS VARCHAR), '7')) AND list_has_all([lang || doc_id % 2, 'n' || n_chars % 3, 'd' || doc_id % 2], ['d1', 'n1'])")
def facet_filter(spark, d):
    """Any of the values of a facet, all of the asked tags, and a part of the text or the id."""
    tags = F.array(F.concat("lang", (F.col("doc_id") % 2).cast("string")), F.concat(F.lit("n"), (F.col("n_chars") % 3).cast("string")), F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string")))
    asked = F.forall(F.array(F.lit("d1"), F.lit("n1")), lambda t: F.array_contains(tags, t))
    return table(spark, d, "documents").where(asked & F.col("lang").isin("en", "de") & F.col("source").isin("src1", "src2", "src3") & (F.lower("text").contains("the") | F.col("doc_id").cast("string").contains("7"))).select("doc_id")


@query("s17_inherited_runs", "SELECT o_custkey AS config, o_orderkey AS v FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def inherited(spark, d):
    o = table(spark, d, "orders")
    pick = lambda s, sign: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("config"), (sign * F.col("o_orderkey")).alias("v"))
    return E.inherited(pick("O", 1), pick("F", -1), "config")


SETS = "WITH s AS (SELECT c_nationkey AS folder, o_custkey AS name, list(DISTINCT o_orderpriority) AS items FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) "


@query("s18_subsets", SETS + "SELECT DISTINCT a.folder, a.name FROM s a JOIN s b ON a.folder = b.folder AND a.name <> b.name WHERE len(list_intersect(a.items, b.items)) = len(a.items) AND len(a.items) < len(b.items)")
def subsets(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    sets = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("folder"), F.col("o_custkey").alias("name")).agg(F.collect_set("o_orderpriority").alias("items"))
    return E.subsets(sets)


@query("s23_missing_ids", "SELECT DISTINCT l_partkey * 10 AS id FROM lineitem WHERE l_partkey * 10 NOT IN (SELECT o_orderkey FROM orders)")
def missing_ids(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 10).alias("id")).distinct().join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_anti")


@query("w2_per_group_top", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def per_group_top(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rank", rank).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("o1_union_distinct", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id")).union(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("o4_set_equality", SETS + ", k AS (SELECT folder, name, list_sort(items) AS items FROM s) SELECT folder, name, min(name) OVER (PARTITION BY folder, items) AS same_as, count(*) OVER (PARTITION BY folder, items) AS n FROM k")
def set_equality(spark, d):
    """Equal sets of a folder, by the smallest name that has them, not as pairs."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    sets = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("folder"), F.col("o_custkey").alias("name")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("items"))
    first = sets.groupBy("folder", "items").agg(F.min("name").alias("same_as"), F.count(F.lit(1)).alias("n"))
    return sets.join(first, ["folder", "items"]).select("folder", "name", "same_as", "n")


@query("o6_normalised_ids", "SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id, replace(lang || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '_' END || CAST(n_chars % 30 AS VARCHAR), '.', '_') AS k FROM documents) GROUP BY k")
def normalised_ids(spark, d):
    key = F.concat(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, ".").otherwise("_"), (F.col("n_chars") % 30).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.translate(key, ".", "_").alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"))
