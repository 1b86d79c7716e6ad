"""Many questions answered by an agent each, in rounds that all take together.

In a round every open question's policy names a tool and its argument; the calls of a round are one table,
dealt to the tools, and each tool answers all of its calls by one join. So the number of jobs grows with the
rounds, not with the questions. Policies run in tasks, in batches of questions, and must not rely on what an
earlier call of theirs left behind. The state between rounds is a checkpointed table.

A planning phase may come first: a planner looks for titles, terms and specifications of the graph and ends
with the gaps to fill, which the policy is then told.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.lineage import cut
from clausegraph.operators import phrases
from clausegraph.operators import retrieval as R
from clausegraph.plans.graph import Graph

# Rounds of planning and of search, clauses that end a search, rows of a tool, answers without a tool that end a question.
PLAN_ROUNDS, ROUNDS, MOST, A_CALL, TITLES, BAD = 5, 5, 30, 10, 20, 2
#: The argument of each tool.
TOOLS = {"title_search": "phrase", "term_search": "term", "spec_search": "spec", "expand": "chunk_id", "inspect": "chunk_id", "vector_search": "text", "query": "sql"}
LOOKS = {"search_titles": "phrase", "search_terms": "phrase", "search_specs": "phrase"}


def _first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """(qid, chunk_id, ord): the first n a question."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("ord") <= n).select("qid", "chunk_id", "ord")


def _bordered(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text between word borders, whatever its signs and case."""
    quoted = F.regexp_replace(phrase, r"([^A-Za-z0-9\s])", r"\\$1")
    return F.rlike(text, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))


class Tools:
    """Each tool takes calls (qid, arg) and gives (qid, chunk_id, ord)."""

    def __init__(self, graph: Graph, encode: Callable | None = None, views: list[str] | None = None):
        self.graph, self.encode, self.views, self._items = graph, encode, views, None

    def title_search(self, calls: DataFrame) -> DataFrame:
        titles = self.graph.chunks.select("chunk_id", "title")
        asked = calls.select("qid", "arg", F.lower("arg").alias("phrase")).where("phrase <> ''")
        met = phrases.contained(asked, titles).join(asked, "phrase").join(titles, "chunk_id").where(_bordered(F.col("title"), F.col("arg")))
        return _first(met, TITLES, "chunk_id")

    def term_search(self, calls: DataFrame) -> DataFrame:
        said = self.graph.mentions.select("chunk_id", F.col("term").cast("string").alias("arg")).distinct()
        return _first(calls.join(said, "arg"), A_CALL, "chunk_id")

    def spec_search(self, calls: DataFrame) -> DataFrame:
        return _first(calls.join(self.graph.chunks.select("chunk_id", F.col("spec_id").cast("string").alias("arg")), "arg"), A_CALL, "chunk_id")

    def expand(self, calls: DataFrame) -> DataFrame:
        return _first(calls.join(self.graph.refs.select(F.col("src").cast("string").alias("arg"), F.col("dst").alias("chunk_id")), "arg"), A_CALL, "chunk_id")

    def inspect(self, calls: DataFrame) -> DataFrame:
        return _first(calls.join(self.graph.chunks.select("chunk_id", F.col("chunk_id").cast("string").alias("arg")), "arg"), A_CALL, "chunk_id")

    def vector_search(self, calls: DataFrame) -> DataFrame:
        from clausegraph.plans.service import _unit_vectors
        from clausegraph.plans.store import hashed

        encode = self.encode or hashed
        if self._items is None:
            self._items = cut(_unit_vectors(self.graph.chunks, "chunk_id", "content", encode).select(F.col("chunk_id").alias("id"), "embedding"))
        found = R.dense(self._items, _unit_vectors(calls, "qid", "arg", encode).withColumnRenamed("qid", "id"), A_CALL, "id")
        return found.select("qid", F.col("doc").alias("chunk_id"), F.col("rank").alias("ord"))

    def query(self, calls: DataFrame) -> DataFrame | None:
        """Guarded queries: as many parts of one job as there are different texts; those that don't read, or give no chunk_id, give nothing."""
        from clausegraph.plans.service import MOST_ROWS, Rejected, guard, recovered

        spark, out = calls.sparkSession, None
        for (text,) in calls.select("arg").distinct().collect():
            try:
                rows = recovered(spark.sql(guard(spark, text, self.views)).limit(MOST_ROWS), ["chunk_id"])
            except Exception as e:
                if isinstance(e, Rejected) or "AnalysisException" in type(e).__name__:
                    continue
                raise
            if "chunk_id" in rows.columns:
                one = rows.select(F.lit(text).alias("arg"), F.col("chunk_id").cast(dict(self.graph.chunks.dtypes)["chunk_id"]).alias("chunk_id"))
                out = one if out is None else out.unionByName(one)
        return None if out is None else _first(calls.join(out.distinct(), "arg"), MOST, "chunk_id")


def _decisions(state: DataFrame, ask: Callable[[str, list, list], dict], seen: str) -> DataFrame:
    """qid, tool, args (JSON): what the policy or planner says for each open question."""
    kind = dict(state.dtypes)["qid"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [ask(q, json.loads(s), list(p)) or {} for q, s, p in zip(frame["question"], frame["seen"], frame["plan"], strict=True)]
            yield pd.DataFrame({"qid": frame["qid"], "tool": [str(a.get("tool")) for a in said], "args": [json.dumps(a.get("args") or {}) for a in said]})

    return state.where("not done").select("qid", "question", F.to_json(seen).alias("seen"), "plan").mapInPandas(run, f"qid {kind}, tool string, args string")


def _calls(said: DataFrame, tools: dict[str, str]) -> DataFrame:
    """qid, tool, arg: the calls of known tools; any other but finish is named unknown."""
    arg = F.coalesce(*[F.when(F.col("tool") == t, F.get_json_object("args", f"$.{a}")) for t, a in tools.items()], F.lit(""))
    tool = F.when(F.col("tool").isin(*tools, "finish"), F.col("tool")).otherwise("unknown")
    return said.select("qid", tool.alias("tool"), arg.alias("arg"), "args")


def plan_gaps(graph: Graph, questions: DataFrame, planner: Callable[[str, list], dict], rounds: int = PLAN_ROUNDS, late: Callable[[], bool] = lambda: False) -> DataFrame:
    """(qid, question, plan): the gaps with which the planner finishes, or none.

    planner(question, notes) names a look (search_titles, search_terms, search_specs, with a phrase) or finishes
    with gaps; notes are what the looks before found: {look, phrase, names}, up to ten names each.
    """
    names = {
        "search_titles": graph.chunks.select(F.col("title").alias("name")),
        "search_terms": graph.terms.select(F.col("full_name").alias("name")),
        "search_specs": graph.chunks.select(F.col("spec_id").cast("string").alias("name")),
    }
    note = "array<struct<look:string,phrase:string,names:array<string>>>"
    state = questions.select("qid", "question", F.array().cast("array<string>").alias("plan"), F.array().cast(note).alias("notes"), F.lit(0).alias("bad"), F.lit(False).alias("done"))
    for _ in range(rounds):
        if late() or state.where("not done").isEmpty():
            break
        said = cut(_calls(_decisions(state, lambda q, seen, plan: planner(q, seen), "notes"), LOOKS))
        found = None
        for look in [r["tool"] for r in said.select("tool").distinct().collect() if r["tool"] in LOOKS]:
            asked = said.where(F.col("tool") == look).select("qid", F.lower("arg").alias("phrase")).where("phrase <> ''")
            known = names[look].where("name is not null").distinct().withColumn("chunk_id", F.col("name")).withColumnRenamed("name", "title")
            met = asked.join(phrases.contained(asked, known), "phrase").distinct()
            met = met.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where(F.col("n") <= A_CALL)
            one = met.groupBy("qid").agg(F.array_sort(F.collect_list("chunk_id")).alias("names"))
            found = one if found is None else found.unionByName(one)
        joined = state.join(said, "qid", "left")
        joined = joined.join(found, "qid", "left") if found is not None else joined.withColumn("names", F.lit(None).cast("array<string>"))
        more = F.array(F.struct(F.col("tool").alias("look"), F.col("arg").alias("phrase"), F.coalesce("names", F.array().cast("array<string>")).alias("names")))
        ended = F.col("tool") == "finish"
        bad = F.col("bad") + F.coalesce((F.col("tool") == "unknown").cast("int"), F.lit(0))
        state = cut(joined.select("qid", "question", F.when(ended, F.coalesce(F.from_json(F.get_json_object("args", "$.gaps"), "array<string>"), F.col("plan"))).otherwise(F.col("plan")).alias("plan"), F.when(F.col("tool").isin(*LOOKS), F.concat("notes", more)).otherwise(F.col("notes")).alias("notes"), bad.alias("bad"), (F.col("done") | F.coalesce(ended, F.lit(False)) | (bad >= BAD)).alias("done")))
    return state.select("qid", "question", "plan")


def search(graph: Graph, questions: DataFrame, policy: Callable, rounds: int = ROUNDS, most: int = MOST, planner: Callable | None = None, seconds: float | None = None, encode: Callable | None = None, views: list[str] | None = None, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, DataFrame]:
    """(found, log) for questions (qid, question) of distinct qids: found has qid, chunk_id, via, place; log has qid, round, tool, arg.

    policy(question, found), or policy(question, found, plan) where there is a planner, names a tool of TOOLS
    with its argument, or finishes; found is a list of {chunk_id, via}. A question ends when its policy
    finishes, has `most` clauses, or has named no tool twice; all end after `rounds` or, at the end of a
    round, once `seconds` have passed since the start, planning included.
    """
    began = clock()
    late = lambda: seconds is not None and clock() - began >= seconds
    kind, qkind = dict(graph.chunks.dtypes)["chunk_id"], dict(questions.dtypes)["qid"]
    start = plan_gaps(graph, questions, planner, late=late) if planner else questions.select("qid", "question", F.array().cast("array<string>").alias("plan"))
    state = start.select("qid", "question", "plan", F.array().cast(f"array<struct<chunk_id:{kind},via:string>>").alias("found"), F.lit(0).alias("bad"), F.lit(False).alias("done"))
    ask = policy if planner else lambda q, found, plan: policy(q, found)
    tools, log = Tools(graph, encode, views), questions.sparkSession.createDataFrame([], f"qid {qkind}, round int, tool string, arg string")
    for n in range(1, rounds + 1):
        if late() or state.where("not done").isEmpty():
            break
        said = cut(_calls(_decisions(state, ask, "found"), TOOLS))
        log = log.unionByName(said.select("qid", F.lit(n).alias("round"), "tool", "arg"))
        rows = None
        for tool in sorted(r["tool"] for r in said.select("tool").distinct().collect()):
            if tool in TOOLS and (one := getattr(tools, tool)(said.where(F.col("tool") == tool).select("qid", "arg"))) is not None:
                one = one.select("qid", F.col("chunk_id").cast(kind).alias("chunk_id"), "ord", F.lit(tool).alias("via"))
                rows = one if rows is None else rows.unionByName(one)
        joined = state.join(said.select("qid", "tool"), "qid", "left")
        if rows is not None:
            listed = rows.where("chunk_id is not null").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "via"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["via"].alias("via"))).alias("more"))
            joined = joined.join(listed, "qid", "left")
        else:
            joined = joined.withColumn("more", F.lit(None).cast(f"array<struct<chunk_id:{kind},via:string>>"))
        have = F.transform("found", lambda x: x["chunk_id"])
        new = F.filter(F.coalesce("more", F.array().cast(f"array<struct<chunk_id:{kind},via:string>>")), lambda x: ~F.array_contains(have, x["chunk_id"]))
        found = F.slice(F.concat("found", F.array_distinct(new)), 1, most)
        bad = F.col("bad") + F.coalesce((F.col("tool") == "unknown").cast("int"), F.lit(0))
        ended = F.col("done") | F.coalesce(F.col("tool") == "finish", F.lit(False)) | (bad >= BAD) | (F.size(found) >= most)
        state = cut(joined.select("qid", "question", "plan", found.alias("found"), bad.alias("bad"), ended.alias("done")))
    return state.select("qid", F.posexplode("found").alias("place", "x")).select("qid", "x.chunk_id", "x.via", (F.col("place") + 1).alias("place")), log
