"""Queries of single functions, set operations and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import hierarchy as H
from clausegraph.operators import questions as Q
from clausegraph.operators import retrieval as R
from clausegraph.operators import review as V
from clausegraph.plans.graph import order_graph
from clausegraph.plans.graph_queries import HOPS_BY
from clausegraph.plans.registry import query, table

PARTS = "WITH s AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey)) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey), t AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey)) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) "


def _sets(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_set("l_partkey")).alias(name))
    return part("A", "a").join(part("R", "b"), "k")


@query("o2_intersections", PARTS + "SELECT k, len(list_intersect(a, b)) AS n FROM s JOIN t USING (k)")
def intersections(spark, d):
    return _sets(spark, d).select("k", F.size(F.array_intersect("a", "b")).cast("long").alias("n"))


@query("o3_contained", PARTS + "SELECT k, len(list_intersect(a[1:3], b)) = len(a[1:3]) AS inside FROM s JOIN t USING (k)")
def contained(spark, d):
    return _sets(spark, d).select("k", (F.size(F.array_except(F.slice("a", 1, 3), "b")) == 0).alias("inside"))


@query("o5_differences", PARTS + "SELECT k, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS part FROM s JOIN t USING (k)")
def differences(spark, d):
    return _sets(spark, d).select("k", F.explode(F.array_except("a", "b")).alias("part"))


@query("o7_ordered_distinct", "SELECT l_orderkey, array_to_string(list(l_returnflag ORDER BY f, l_returnflag), ',') AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ordered_distinct(spark, d):
    said = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(said, lambda x: x["l_returnflag"])), ",").alias("flags"))


@query("a13_means_of_valid", "SELECT event_type, count(*) AS n, count(CASE WHEN value > 1 THEN 1 END) AS valid, round(avg(CASE WHEN value > 1 THEN value END), 6) AS mean FROM events GROUP BY event_type")
def means_of_valid(spark, d):
    ok = F.col("value") > 1
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean"))


@query("a5_capped_lists", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:12], ',') AS parts FROM lineitem GROUP BY l_suppkey")
def capped_lists(spark, d):
    few = F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 12)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(few, lambda x: x.cast("string")), ",").alias("parts"))


@query("a6_flattened", "SELECT lang, len(list_distinct(flatten(list([source, lang || source])))) AS n FROM documents GROUP BY lang")
def flattened(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.array("source", F.concat("lang", "source")))))).cast("long").alias("n"))


ORPHANS = """
WITH i AS (SELECT 'ts_' || c_custkey % 40 || '_' || c_custkey % 7 || CASE c_custkey % 4 WHEN 1 THEN '-' || c_custkey % 3 WHEN 2 THEN '-' || c_custkey % 3 || '-' || c_custkey % 5 WHEN 3 THEN '1' ELSE '' END AS id FROM customer),
t AS (SELECT DISTINCT 'ts_' || o_orderkey % 45 || '_' || o_orderkey % 8 || CASE o_orderkey % 5 WHEN 1 THEN '-' || o_custkey % 4 WHEN 2 THEN '-' ELSE '' END AS target FROM orders)
SELECT target FROM t WHERE NOT EXISTS (SELECT 1 FROM i WHERE id = target OR starts_with(id, target || '-'))
"""


@query("a15_orphans", ORPHANS)
def orphans(spark, d):
    """Cited specifications that are not there, where a part of one counts for the whole: prefixes of any length, by equality."""
    s = lambda c: c.cast("string")
    k = F.col("c_custkey")
    tail = F.when(k % 4 == 1, F.concat(F.lit("-"), s(k % 3))).when(k % 4 == 2, F.concat(F.lit("-"), s(k % 3), F.lit("-"), s(k % 5))).when(k % 4 == 3, "1").otherwise("")
    ids = table(spark, d, "customer").select(F.concat(F.lit("ts_"), s(k % 40), F.lit("_"), s(k % 7), tail).alias("id"))
    o = F.col("o_orderkey")
    cited = F.when(o % 5 == 1, F.concat(F.lit("-"), s(F.col("o_custkey") % 4))).when(o % 5 == 2, "-").otherwise("")
    targets = table(spark, d, "orders").select(F.concat(F.lit("ts_"), s(o % 45), F.lit("_"), s(o % 8), cited).alias("target"))
    return H.orphan_targets(targets, ids)


@query("r12_generality", "SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 5 WHEN 0 THEN 1.12 WHEN 1 THEN 0.88 WHEN 2 THEN 0.88 ELSE 1 END, 4) AS score FROM orders")
def generality(spark, d):
    titles = F.array(*map(F.lit, ("General registration with a device", "Registration via another access", "Emergency registration", "Registration, in general", "within viaducts")))
    return table(spark, d, "orders").select("o_orderkey", F.round(Q.generality(F.col("o_totalprice"), F.element_at(titles, (F.col("o_orderkey") % 5 + 1).cast("int"))), 4).alias("score"))


@query("r11_reports", "SELECT o_orderkey, round(o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 0.7 ELSE 1.0 END * CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1.15 ELSE 1.0 END, 6) AS score FROM orders")
def reports(spark, d):
    spec = F.when(F.col("o_custkey") % 2 == 0, "ts_23_700").otherwise("ts_23_501")
    title = F.when(F.col("o_orderkey") % 2 == 0, "Functional entities").otherwise("x")
    return table(spark, d, "orders").select("o_orderkey", F.round(Q.study_and_function(F.col("o_totalprice"), spec, title, F.col("o_orderkey") % 3 == 0), 6).alias("score"))


@query("r17_expanded", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'about ' || p_brand || ' ' || p_name WHEN p_partkey % 3 = 1 THEN 'about ' || p_name || ' ' || p_brand ELSE 'nothing' END AS q FROM part")
def expanded(spark, d):
    k = F.col("p_partkey") % 3
    q = F.when(k == 0, F.concat(F.lit("about "), F.col("p_brand"))).when(k == 1, F.concat(F.lit("about "), F.col("p_name"))).otherwise("nothing")
    return table(spark, d, "part").select("p_partkey", Q.expanded(q, F.col("p_brand"), F.col("p_name")).alias("q"))


@query("r31_spec_ids", "SELECT o_orderkey, 'ts_' || CAST(23 + o_orderkey % 7 AS VARCHAR) || '_' || CAST(501 + o_custkey % 90 AS VARCHAR) AS spec FROM orders")
def spec_ids(spark, d):
    said = F.concat(F.lit("see TS "), (F.col("o_orderkey") % 7 + 23).cast("string"), F.lit("."), (F.col("o_custkey") % 90 + 501).cast("string"), F.lit(" here"))
    return table(spark, d, "orders").select("o_orderkey", T.spec_id(said).alias("spec"))


@query("p23_questions", r"SELECT conv_id, turn, regexp_replace(text || CASE turn % 3 WHEN 0 THEN chr(10) || 'A. one' || chr(10) || 'B. two' WHEN 1 THEN ' A. inline' ELSE chr(10) || '  A) one' || chr(10) || '  B) two' END, '(?s)\n\s*A[.)]\s.*$', '') AS q FROM conversations")
def bare_questions(spark, d):
    """Lettered choices at the end go, in either form, also those that a turn has of its own; a letter inside a line is none."""
    tail = F.when(F.col("turn") % 3 == 0, "\nA. one\nB. two").when(F.col("turn") % 3 == 1, " A. inline").otherwise("\n  A) one\n  B) two")
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_choices(F.concat("text", tail)).alias("q"))


@query("p24_answers", "SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN CASE WHEN contains(text, '</think>') THEN regexp_replace(text, '(?s)^.*?</think>\\s*', '') ELSE '' END WHEN 2 THEN 'so <think>' || text ELSE 'so ' || text END AS a FROM conversations")
def bare_answers(spark, d):
    """A leading think block goes, over several lines, unfinished, or finished inside the turn; one inside the answer stays."""
    k, said = F.col("turn") % 4, F.concat(F.lit("so "), F.col("text"))
    answer = F.when(k == 0, F.concat(F.lit("<think>hm\nhm</think>\n"), said)).when(k == 1, F.concat(F.lit(" <think>never done "), "text")).when(k == 2, F.concat(F.lit("so <think>"), "text")).otherwise(said)
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_thinking(answer).alias("a"))


@query("p20_segments", """WITH t AS (SELECT doc_id, doc_id % 3 AS k, CASE WHEN doc_id % 2 = 0 THEN repeat('long ', 49) || 'long' ELSE 'short head' END AS head, repeat('body ', 49) || 'body' AS body FROM documents),
p AS (SELECT doc_id, doc_id % 2 = 0 AS long, head, CASE k WHEN 0 THEN '1.' || chr(9) || body ELSE body END AS one, CASE k WHEN 0 THEN '2.' || chr(9) || 'end' ELSE 'end' END AS two FROM t)
SELECT doc_id, 0 AS pos, CASE WHEN long THEN head ELSE head || chr(10) || one END AS segment FROM p UNION ALL SELECT doc_id, 1, CASE WHEN long THEN one ELSE two END FROM p UNION ALL SELECT doc_id, 2, two FROM p WHERE long""")
def segments(spark, d):
    """Texts with steps, with blank lines and with lines alone, each with a first part that is long enough or is joined to the next."""
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    head, body = F.when(i % 2 == 0, F.concat(F.repeat(F.lit("long "), 49), F.lit("long"))).otherwise("short head"), F.concat(F.repeat(F.lit("body "), 49), F.lit("body"))
    text = F.when(k == 0, F.concat(head, F.lit("\n1.\t"), body, F.lit("\n2.\tend"))).when(k == 1, F.concat(head, F.lit("\n \n"), body, F.lit("\n\nend "))).otherwise(F.concat_ws("\n", head, body, F.lit("end")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.segments(text)).alias("pos", "segment"))


@query("w4_interleaved", "SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY t, o_custkey, o_orderkey) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS t FROM orders) WHERE t <= 2 ORDER BY t, o_custkey, o_orderkey LIMIT 50")
def interleaved(spark, d):
    """The best of each customer in turn: ranks in groups first, then one small sort of what the limit keeps."""
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    few = table(spark, d, "orders").withColumn("t", turn).where("t <= 2").orderBy("t", "o_custkey", "o_orderkey").limit(50)
    return few.select("o_custkey", "o_orderkey", F.row_number().over(Window.orderBy("t", "o_custkey", "o_orderkey")).alias("position"))


@query("w6_first_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins(spark, d):
    rows = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return R.first_wins(rows, F.col("o_custkey"), "at").select("o_custkey", "o_orderkey")


@query("w7_matching_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderkey) AS position FROM orders")
def matching_first(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", n.alias("position"))


@query("e23_progress", "SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, bool_and(l_linestatus = 'F') AS locked FROM lineitem GROUP BY l_orderkey")
def progress(spark, d):
    done = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"), F.bool_and(done).alias("locked"))


@query("e26_missing_prerequisites", "WITH r AS (SELECT o_custkey AS reviewer, o_orderkey % 5 AS item, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS phase FROM orders) SELECT DISTINCT reviewer, item FROM r WHERE phase = 2 AND NOT EXISTS (SELECT 1 FROM r p WHERE p.reviewer = r.reviewer AND p.item = r.item AND p.phase = 1)")
def missing_prerequisites(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("reviewer"), (F.col("o_orderkey") % 5).alias("item"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("phase"))
    return V.missing_prerequisites(rows)


@query("e27_scope", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def scope(spark, d):
    """What a narrower scope keeps: rows inside it, and rows that are in use."""
    c, used = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.where("c_acctbal > 0").select("c_custkey").unionByName(c.where("not coalesce(c_acctbal > 0, false)").join(used, "c_custkey", "left_semi").select("c_custkey"))


@query("x6_backfill_plan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 1000")
def backfill_plan(spark, d):
    from clausegraph.plans.store import backfill

    return backfill(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("n_chars > 1000").select("doc_id"), ["doc_id"])


@query("j33_fewest_hops", HOPS_BY + "SELECT grp, seed, target, hops, turn FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn, ord, target) AS place FROM (SELECT *, row_number() OVER (PARTITION BY grp, seed ORDER BY hops, target) AS turn FROM firsts)) WHERE place <= 40")
def fewest_hops(spark, d):
    """Many questions at once: each group's seeds take turns, and a target counts for the seed that reaches it by the fewest hops."""
    g = order_graph(spark, d)
    seeds = g.mentions.where("term <= 20").select(F.col("chunk_id").alias("seed")).distinct().withColumn("grp", F.col("seed") % 4)
    return H.hops(seeds.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy("seed"))), g.refs, g.chunks, by="grp")
