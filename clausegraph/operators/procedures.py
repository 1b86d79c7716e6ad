"""The procedure layer as tables, and the clauses that belong to a procedure by it.

Procedures have dotted ids; edges are tables of pairs. A root names a procedure and all below it by id.
Every expansion is a join on equality: ids meet roots by their exploded prefixes, and a path of up to `most`
edges is grown from its frontier, one join a step, with what was reached before left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T

# Roles of a procedure's clauses in the order in which they are put together, their worth, and the most clauses of a closure.
GRAPH_ROLES = ("main", "op_def", "named", "invoked", "stage3", "msg_def")
TEXT_ROLES = ("main", "op_def", "named", "ref", "named_in_text", "cited_spec")
ROLES = {"main": 1.0, "op_def": 0.8, "named": 0.7, "ref": 0.6, "invoked": 0.65, "stage3": 0.6, "msg_def": 0.55, "named_in_text": 0.65, "cited_spec": 0.55}
MOST_CLAUSES, SUB_STEPS = 60, 2


@dataclass(frozen=True)
class Procedures:
    """procedures(proc), sub_of(proc, parent), clauses(proc, chunk_id, role), uses(proc, op), op_defs(op,
    chunk_id), invokes(proc, invoked), same(proc, other, kind), messages(proc, message), message_defs(message,
    chunk_id)."""

    procedures: DataFrame
    sub_of: DataFrame
    clauses: DataFrame
    uses: DataFrame
    op_defs: DataFrame
    invokes: DataFrame
    same: DataFrame
    messages: DataFrame
    message_defs: DataFrame


def base(root: Column) -> Column:
    """A root without its last .0, which stands for the text between a heading and its first part."""
    return F.regexp_replace(root, r"\.0$", "")


def at_or_below(roots: DataFrame, procedures: DataFrame) -> DataFrame:
    """(qid, proc): procedures whose id is a root's (qid, root) or begins with it and a dot."""
    own = procedures.select("proc", F.explode(F.concat(T.prefixes(F.col("proc")), F.array("proc"))).alias("root"))
    return roots.select("qid", base(F.col("root")).alias("root")).distinct().join(own, "root").select("qid", "proc").distinct()


def expand(starts: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(qid, proc, steps): what starts (qid, proc) reach against the direction of edges (proc, parent) in 0 to `most` steps, with the fewest."""
    reached = frontier = starts.select("qid", "proc").distinct().withColumn("steps", F.lit(0))
    for n in range(1, most + 1):
        further = frontier.select("qid", F.col("proc").alias("parent")).join(edges.select("proc", "parent"), "parent").select("qid", "proc").distinct()
        frontier = further.join(reached.select("qid", "proc"), ["qid", "proc"], "left_anti").withColumn("steps", F.lit(n))
        reached = reached.unionByName(frontier)
    return reached


def _places(layer: Procedures) -> DataFrame:
    """(chunk_id, place): a row a clause; its place is the sorted set of the procedures that it is in, each after 1 if it is a main clause there, else 0."""
    link = F.concat(F.when(F.col("role") == "main", "1").otherwise("0"), F.col("proc"))
    return layer.clauses.groupBy("chunk_id").agg(F.sort_array(F.collect_set(link)).alias("place"))


def _branches(roots: DataFrame, layer: Procedures, named: DataFrame | None, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(place, qid, role) of the places that questions want for their procedures, and (qid, chunk_id, role) of definitions; rows of both are distinct."""
    # Steps don't count here, so no step is held against those before it: with expand() the plan had each start eight times, not three.
    ours = further = at_or_below(roots, layer.procedures)
    for _ in range(SUB_STEPS):
        further = further.select("qid", F.col("proc").alias("parent")).join(layer.sub_of.select("proc", "parent"), "parent").select("qid", "proc").distinct()
        ours = ours.unionByName(further)
    ours = ours.distinct()
    stage3 = layer.same.where("kind = 'stage3'").select("proc", "other")
    reached = {
        "main": ours,
        "invoked": ours.join(layer.invokes, "proc").select("qid", F.col("invoked").alias("proc")),
        "stage3": ours.join(stage3.unionByName(stage3.select(F.col("other").alias("proc"), F.col("proc").alias("other"))), "proc").select("qid", F.col("other").alias("proc")),
    }
    if named is not None:
        reached["named"] = at_or_below(named, layer.procedures)
    wanted = _by_role(reached, "proc")
    link = places.select("place").distinct().select("place", F.explode("place").alias("link"))
    links = link.select("place", F.expr("substring(link, 2)").alias("proc"), F.col("link").startswith("1").alias("leads"))
    at_places = links.join(wanted, "proc").where("leads or role = 'main'").select("place", "qid", "role").distinct()
    defined = {
        "op_def": ours.join(layer.uses, "proc").select("qid", "op").distinct().join(layer.op_defs, "op"),
        "msg_def": ours.join(layer.messages, "proc").select("qid", "message").distinct().join(layer.message_defs, "message"),
    }
    return at_places, _by_role(defined, "chunk_id")


def _by_role(branches: dict[str, DataFrame], name: str) -> DataFrame:
    out = None
    for role, rows in branches.items():
        one = rows.select("qid", name).distinct().withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    return out


def graph_closure(roots: DataFrame, layer: Procedures, named: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, role): the clauses of a procedure by the layer, a row for each role that a clause has.

    The procedures at or below a root (qid, root), and their sub-procedures of up to two steps, give their own
    clauses (main), the definitions of the operations and messages that they use (op_def, msg_def), and the
    main clauses of the procedures that they invoke (invoked) and of their stage-3 counterparts, whichever way
    the edge points (stage3). Roots that a question only names (qid, root) give their own main clauses (named).

    Many clauses share a place, and questions meet the few places, so that each row is made once: a distinct of
    the rows themselves would hold a question's share of all clauses in a task.
    """
    places = _places(layer)
    at_places, defined = _branches(roots, layer, named, places)
    return places.join(at_places, "place").select("qid", "chunk_id", "role").unionByName(defined.select("qid", "chunk_id", "role"))


def assembled_closure(roots: DataFrame, layer: Procedures, chunks: DataFrame, named: DataFrame | None = None, order: tuple[str, ...] = GRAPH_ROLES, most: int = MOST_CLAUSES) -> DataFrame:
    """assemble() of graph_closure(), from the first `most` clauses with content of each place.

    Clauses of a place have its roles in common, so a later one comes after `most` others for every question
    that wants the place. The definitions go whole.
    """
    places = _places(layer)
    at_places, defined = _branches(roots, layer, named, places)
    turn = F.row_number().over(Window.partitionBy("place").orderBy("chunk_id"))
    first = places.join(_said(chunks), "chunk_id", "left_semi").withColumn("turn", turn).where(F.col("turn") <= most)
    rows = first.join(at_places, "place").select("qid", "chunk_id", "role").unionByName(defined.select("qid", "chunk_id", "role"))
    return assemble(rows, chunks, order, most)


def _said(chunks: DataFrame) -> DataFrame:
    """(chunk_id): clauses with content."""
    return (chunks.where(~F.coalesce("content", F.lit("")).rlike(r"^\s*$")) if "content" in chunks.columns else chunks).select("chunk_id")


def assemble(rows: DataFrame, chunks: DataFrame, order: tuple[str, ...] = GRAPH_ROLES, most: int = MOST_CLAUSES) -> DataFrame:
    """(qid, chunk_id, role, score, position): clauses with content, each in the first of its roles, in the order of roles and ids, `most` a question."""
    turn = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    first = rows.where(F.col("role").isin(*order)).groupBy("qid", "chunk_id").agg(F.min(turn).alias("turn")).join(_said(chunks), "chunk_id", "left_semi")
    role = F.element_at(F.array(*[F.lit(r) for r in order]), F.col("turn").cast("int"))
    worth = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "chunk_id"))).where(F.col("position") <= most)
    return placed.select("qid", "chunk_id", role.alias("role"), worth[role].alias("score"), "position")
