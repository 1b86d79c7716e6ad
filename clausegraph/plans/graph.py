"""The property graph as tables, and an analogue of it made from the order tables.

The tables at hand hold no clauses, so queries run the graph operators on orders: an order is a
chunk of its customer's specification with a dotted section id, a part is a term, a supplier is a
service operation, a line is a step. VIEWS has the same tables in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.operators.procedures import Procedures
from clausegraph.plans.registry import table


@dataclass(frozen=True)
class Graph:
    """One DataFrame a node label or edge type.

    chunks(chunk_id, spec_id, section_id, title, content, chunk_type), terms(term, full_name,
    primary_spec), mentions(chunk_id, term), operations(op, service), describes(chunk_id, op),
    provided(op, term), steps(step_id, chunk_id, ord), involves(step_id, term), refs(src, dst,
    is_external, ref_type, confidence).
    """

    chunks: DataFrame
    terms: DataFrame
    mentions: DataFrame
    operations: DataFrame
    describes: DataFrame
    provided: DataFrame
    steps: DataFrame
    involves: DataFrame
    refs: DataFrame


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    o, li, p, s = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "supplier"))
    k = F.col("o_orderkey")
    # Edges are spread by the end on which they mostly join, so that a join or a group by that end does not move them again.
    a, b, c = k % 7 + 1, F.floor(k / 7) % 4, F.floor(k / 28) % 3
    section = F.concat(a.cast("string"), F.when(b > 0, F.concat(F.lit("."), b.cast("string"), F.when(c > 0, F.concat(F.lit("."), c.cast("string"))).otherwise(""))).otherwise(""))
    chunks = o.select(
        k.alias("chunk_id"), (F.col("o_custkey") % 25).alias("spec_id"), section.alias("section_id"), F.concat(F.col("o_orderpriority"), F.lit(" clause "), section).alias("title"),
        F.concat(F.lit("The order "), k.cast("string"), F.when(F.col("o_orderstatus") == "O", F.lit(" shall be open")).otherwise(F.lit(" is closed")), F.repeat(F.lit(" by its own rules"), (k % 9).cast("int"))).alias("content"),
        F.when(k % 4 == 0, "procedure").when(k % 4 == 1, "definition").when(k % 4 == 2, "requirement").otherwise("general").alias("chunk_type"),
    )
    terms = p.select(F.col("p_partkey").alias("term"), F.col("p_name").alias("full_name"), (F.col("p_partkey") % 25).alias("primary_spec"))
    mentions = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("term")).repartition("chunk_id").distinct()
    operations = s.select(F.col("s_suppkey").alias("op"), (F.col("s_nationkey")).alias("service"))
    describes = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("op")).repartition("chunk_id").distinct()
    provided = s.join(p, F.col("p_partkey") % 10 == F.col("s_suppkey") % 10).where(F.col("p_partkey") < 100).select(F.col("s_suppkey").alias("op"), F.col("p_partkey").alias("term"))
    step = F.concat_ws("::", F.col("l_orderkey"), F.col("l_linenumber"))
    steps = li.select(step.alias("step_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    involves = li.select(step.alias("step_id"), F.array(F.col("l_partkey") % 40, F.col("l_suppkey") % 40).alias("both")).repartition("step_id").select("step_id", F.explode("both").alias("term")).distinct()
    refs = li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("dst"), (F.col("l_returnflag") == "R").alias("is_external"), F.when(F.col("l_linenumber") % 2 == 0, "clause").otherwise("table").alias("ref_type"), F.round(F.col("l_discount") * 10, 2).alias("confidence"))
    refs = refs.where("src <> dst").repartition("dst").groupBy("src", "dst").agg(F.max("is_external").alias("is_external"), F.min("ref_type").alias("ref_type"), F.max("confidence").alias("confidence"))
    return Graph(chunks, terms, mentions, operations, describes, provided, steps, involves, refs)


VIEWS = """
WITH chunks0 AS (SELECT *, o_orderkey % 7 + 1 AS a, o_orderkey // 7 % 4 AS b, o_orderkey // 28 % 3 AS c FROM orders),
chunks1 AS (SELECT *, CAST(a AS VARCHAR) || CASE WHEN b > 0 THEN '.' || CAST(b AS VARCHAR) || CASE WHEN c > 0 THEN '.' || CAST(c AS VARCHAR) ELSE '' END ELSE '' END AS section_id FROM chunks0),
chunks AS (SELECT o_orderkey AS chunk_id, o_custkey % 25 AS spec_id, section_id, o_orderpriority || ' clause ' || section_id AS title,
  'The order ' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderstatus = 'O' THEN ' shall be open' ELSE ' is closed' END || repeat(' by its own rules', o_orderkey % 9) AS content,
  CASE o_orderkey % 4 WHEN 0 THEN 'procedure' WHEN 1 THEN 'definition' WHEN 2 THEN 'requirement' ELSE 'general' END AS chunk_type FROM chunks1),
terms AS (SELECT p_partkey AS term, p_name AS full_name, p_partkey % 25 AS primary_spec FROM part),
mentions AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS term FROM lineitem),
operations AS (SELECT s_suppkey AS op, s_nationkey AS service FROM supplier),
describes AS (SELECT DISTINCT l_orderkey AS chunk_id, l_suppkey AS op FROM lineitem),
provided AS (SELECT s_suppkey AS op, p_partkey AS term FROM supplier JOIN part ON p_partkey % 10 = s_suppkey % 10 WHERE p_partkey < 100),
steps AS (SELECT CAST(l_orderkey AS VARCHAR) || '::' || CAST(l_linenumber AS VARCHAR) AS step_id, l_orderkey AS chunk_id, l_linenumber AS ord FROM lineitem),
involves AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '::' || CAST(l_linenumber AS VARCHAR) AS step_id, unnest([l_partkey % 40, l_suppkey % 40]) AS term FROM lineitem),
refs AS (SELECT src, dst, bool_or(ext) AS is_external, min(kind) AS ref_type, max(c) AS confidence FROM (SELECT l_orderkey AS src, l_partkey * 8 + l_linenumber AS dst, l_returnflag = 'R' AS ext, CASE WHEN l_linenumber % 2 = 0 THEN 'clause' ELSE 'table' END AS kind, round(l_discount * 10, 2) AS c FROM lineitem) WHERE src <> dst GROUP BY src, dst)
"""


def order_procedures(spark: SparkSession, sf_dir: str) -> Procedures:
    """The procedure layer of the analogue: a section of a specification is a procedure, and what its orders are in is what it has."""
    g = order_graph(spark, sf_dir)
    proc = F.concat(F.lit("p"), F.col("spec_id").cast("string"), F.lit("."), F.col("section_id"))
    placed = g.chunks.select("chunk_id", "chunk_type", proc.alias("proc"))
    at = placed.select("chunk_id", "proc")
    ours = placed.select("proc").distinct()
    # Edges lie by dst, so they meet their ends there first; the kinds of a pair are bits of one column, so that both tables of links come from one shuffle.
    links = g.refs.where("confidence >= 0.9").join(at.select(F.col("chunk_id").alias("dst"), F.col("proc").alias("other")), "dst").join(at.withColumnRenamed("chunk_id", "src"), "src").where("proc <> other")
    bit = F.when(F.col("ref_type") == "clause", 1).when(F.col("ref_type") == "table", F.when(F.col("is_external"), 2).otherwise(4))
    linked = links.groupBy("proc", "other").agg(F.bit_or(bit).alias("bits"))
    kinds = F.filter(F.array(F.when(F.col("bits").bitwiseAND(2) > 0, "stage3"), F.when(F.col("bits").bitwiseAND(4) > 0, "stage2")), F.isnotnull)
    return Procedures(
        procedures=ours,
        sub_of=ours.where(F.size(F.split("proc", r"\.")) > 2).select(F.concat(F.lit("x"), F.col("proc")).alias("proc"), F.regexp_replace("proc", r"\.[^.]*$", "").alias("parent")).unionByName(ours.select(F.concat(F.lit("xx"), F.col("proc")).alias("proc"), F.concat(F.lit("x"), F.col("proc")).alias("parent"))),
        clauses=placed.select("proc", "chunk_id", F.when(F.col("chunk_type") == "procedure", "main").otherwise("part").alias("role")).unionByName(placed.where("chunk_id % 3 = 0").select(F.concat(F.lit("x"), F.col("proc")).alias("proc"), "chunk_id", F.lit("part").alias("role"))),
        uses=g.describes.join(at, "chunk_id").where("chunk_id % 5 = 0").select("proc", "op").distinct(),
        op_defs=g.describes.where("chunk_id % 97 = 0").select("op", "chunk_id"),
        invokes=linked.where(F.col("bits").bitwiseAND(1) > 0).select("proc", F.col("other").alias("invoked")),
        same=linked.select("proc", "other", F.explode(kinds).alias("kind")),
        messages=g.mentions.join(at, "chunk_id").where("term % 20 = 0").select("proc", F.col("term").alias("message")).distinct(),
        message_defs=g.mentions.where("chunk_id % 83 = 0").select(F.col("term").alias("message"), "chunk_id"),
    )


LAYER = """
, placed AS (SELECT chunk_id, chunk_type, 'p' || spec_id || '.' || section_id AS proc FROM chunks),
procs AS (SELECT DISTINCT proc FROM placed),
links AS (SELECT a.proc, b.proc AS other, ref_type, is_external, confidence FROM refs JOIN placed a ON a.chunk_id = src JOIN placed b ON b.chunk_id = dst WHERE a.proc <> b.proc),
sub_of AS (SELECT 'x' || proc AS proc, regexp_replace(proc, '\\.[^.]*$', '') AS parent FROM procs WHERE len(string_split(proc, '.')) > 2 UNION ALL SELECT 'xx' || proc, 'x' || proc FROM procs),
clauses AS (SELECT proc, chunk_id, CASE WHEN chunk_type = 'procedure' THEN 'main' ELSE 'part' END AS role FROM placed UNION ALL SELECT 'x' || proc, chunk_id, 'part' FROM placed WHERE chunk_id % 3 = 0),
uses AS (SELECT DISTINCT proc, op FROM describes JOIN placed USING (chunk_id) WHERE chunk_id % 5 = 0),
op_defs AS (SELECT op, chunk_id FROM describes WHERE chunk_id % 97 = 0),
invokes AS (SELECT DISTINCT proc, other AS invoked FROM links WHERE ref_type = 'clause' AND confidence >= 0.9),
same AS (SELECT DISTINCT proc, other FROM links WHERE ref_type = 'table' AND confidence >= 0.9 AND is_external),
messages AS (SELECT DISTINCT proc, term AS message FROM mentions JOIN placed USING (chunk_id) WHERE term % 20 = 0),
message_defs AS (SELECT term AS message, chunk_id FROM mentions WHERE chunk_id % 83 = 0),
roots AS (SELECT DISTINCT spec_id AS qid, 'p' || spec_id || '.2.1' AS root, 'p' || spec_id || '.3' AS named FROM chunks),
zero AS (SELECT DISTINCT qid, proc FROM roots JOIN procs ON proc = root OR starts_with(proc, root || '.')),
one AS (SELECT qid, s.proc FROM zero z JOIN sub_of s ON s.parent = z.proc),
two AS (SELECT qid, s.proc FROM one z JOIN sub_of s ON s.parent = z.proc),
ours AS (FROM zero UNION FROM one UNION FROM two),
twins AS (SELECT qid, other FROM ours JOIN same USING (proc) UNION SELECT qid, same.proc FROM ours JOIN same ON other = ours.proc),
closed AS (
  SELECT qid, chunk_id, 'main' AS role FROM ours JOIN clauses USING (proc)
  UNION SELECT qid, chunk_id, 'op_def' FROM ours JOIN uses USING (proc) JOIN op_defs USING (op)
  UNION SELECT qid, chunk_id, 'named' FROM roots JOIN clauses c ON (c.proc = named OR starts_with(c.proc, named || '.')) AND c.role = 'main'
  UNION SELECT qid, chunk_id, 'invoked' FROM ours JOIN invokes USING (proc) JOIN clauses c ON c.proc = invoked AND c.role = 'main'
  UNION SELECT qid, chunk_id, 'stage3' FROM twins JOIN clauses c ON c.proc = other AND c.role = 'main'
  UNION SELECT qid, chunk_id, 'msg_def' FROM ours JOIN messages USING (proc) JOIN message_defs USING (message))
"""
