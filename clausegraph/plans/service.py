"""The query service: read-only SQL, schema, batch answering, the retrieval agent, configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions.lineage import cut, spread
from clausegraph.operators import hierarchy as H
from clausegraph.operators import patterns as P
from clausegraph.operators import questions as Q
from clausegraph.operators import retrieval as R
from clausegraph.plans.graph import Graph
from clausegraph.sources.clients import first_json as first_object  # noqa: F401  part of the service

#: Most bytes of candidates that are broadcast to meet their clauses, and of one of them.
BROADCAST_BYTES, POOL_ROW_BYTES = 32 << 20, 256
# Bounds of ad-hoc queries, modes, rungs of the ablation ladder, widths.
MOST_ROWS = 1000
MODES = ("fixed", "hybrid", "dense", "bm25", "bm25_dense", "graph", "react_agent", "none")
VECTOR_DIM = 768
OPERATION_NAME = r"\bN[a-z][a-z0-9]*_[A-Z][A-Za-z0-9]*_[A-Z][A-Za-z0-9]*\b"
LADDER = ("entity", "relation", "hierarchy", "xref", "provenance")
QUERY_ROOTS = frozenset(("Project", "UnresolvedWith", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Filter", "UnresolvedHaving", "SubqueryAlias", "UnresolvedInlineTable", "Intersect", "Except", "WithCTE", "Offset"))
WRITING_NODES = frozenset(("InsertIntoStatement", "InsertIntoDir", "ScriptTransformation"))
#: Plan and expression nodes that read something other than a named view: names made at run time, files, earlier states.
FOREIGN_NODES = frozenset(("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "RelationTimeTravel", "UnresolvedPathBasedTable", "UnresolvedFunctionName"))
WRITING_CLASS = "org.apache.spark.sql.catalyst.plans.logical."
#: Functions that a query may call: Spark's own of these groups, which are pure, and a few without one. The group misc_funcs, which calls the JVM and tells about the session, is left out.
CALLED_GROUPS = frozenset(f"{g}_funcs" for g in "agg array bitwise collection conditional conversion datetime hash json lambda map math predicate string struct window generator".split())
CALLED_BESIDES = frozenset(("explode", "posexplode", "inline", "stack"))
#: The table functions that may be called.
CALLED_TABLES = frozenset(("range",))


class Rejected(ValueError):
    """A query that is not a plain read."""


def clean(text: str) -> str:
    """Query text without fences and the prose before its first SELECT or WITH."""
    fenced = re.search(r"```(?:\w+)?\s*(.*?)```", text, re.DOTALL)
    body = (fenced.group(1) if fenced else text).strip().rstrip(";").strip()
    start = re.search(r"(?im)^\s*(select|with)\b", body)
    return body[start.start() :].strip() if start else body


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan):
    """A parsed plan's nodes: children, the bodies of WITH, and the plans of subqueries in expressions."""
    yield plan
    for part in (*_each(plan.children()), *_each(plan.innerChildren()), *_each(plan.subqueries())):
        if hasattr(part, "children"):
            yield from _nodes(part)


def _inner(expression):
    yield expression
    for child in _each(expression.children()):
        yield from _inner(child)


def _is_called(catalog, jvm, name: str) -> bool:
    """Whether a function of this name is Spark's own, of a group that may be called, and not hidden by one of the session's."""
    identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    if catalog.isTemporaryFunction(identifier) or not catalog.isRegisteredFunction(identifier):
        return False
    info = catalog.lookupFunctionInfo(identifier)
    return info.getClassName().startswith("org.apache.spark.sql.catalyst.expressions.") and (info.getGroup() in CALLED_GROUPS or name in CALLED_BESIDES)


def plan_faults(spark: SparkSession, text: str, views: frozenset[str]) -> list[str]:
    """What makes a parsed text more than a read of the views; the one place that uses Spark's parser.

    The root must be a query, no node a command, an insertion or a script; every relation
    a view of the list or a name that a WITH of the text gives (and no table has); every function, table
    functions too, one that may be called. Names come from the parsed nodes, so how a text is spelled doesn't matter.
    """
    from py4j.java_gateway import is_instance_of

    state, jvm = spark._jsparkSession.sessionState(), spark._jvm
    plan = state.sqlParser().parsePlan(text)
    root = plan.getClass().getSimpleName()
    faults, made, relations = [] if root in QUERY_ROOTS else [f"{root} is not a query"], set(), []
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if name in WRITING_NODES | FOREIGN_NODES or any(is_instance_of(spark._sc._gateway, node, WRITING_CLASS + c) for c in ("Command", "ParsedStatement")):
            faults.append(f"{name} is not a query")
        if name == "UnresolvedWith":
            made.update(pair._1().lower() for pair in _each(node.cteRelations()))
        if name == "UnresolvedTableValuedFunction" and ".".join(_each(node.name())).lower() not in CALLED_TABLES:
            faults.append(f"{'.'.join(_each(node.name()))} may not be called")
        if name == "UnresolvedRelation":
            relations.append(list(_each(node.multipartIdentifier())))
        for expression in _each(node.expressions()):
            for e in _inner(expression):
                kind = e.getClass().getSimpleName()
                if kind in FOREIGN_NODES:
                    faults.append(f"{kind} is not a query")
                called = list(_each(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().unquotedString()] if kind == "UnresolvedGenerator" else None
                if called is not None and (len(called) > 1 or not _is_called(state.catalog(), jvm, called[0].lower())):
                    faults.append(f"{'.'.join(called)} may not be called")
    for parts in relations:
        name = parts[0].lower()
        if len(parts) > 1 or name not in views and (name not in made or spark.catalog.tableExists(name)):
            faults.append(f"{'.'.join(parts)} is not one of the views")
    return faults


def guard(spark: SparkSession, text: str, views: Iterable[str] | None = None) -> str:
    """The cleaned text, if all of its parsed plan does no more than read the views (by default all temporary views of the session): words such as SET inside names or strings don't matter."""
    text = clean(text)
    if not text:
        raise Rejected("empty query")
    if views is None:
        views = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    try:
        faults = plan_faults(spark, text, frozenset(v.lower() for v in views))
    except Exception as e:
        raise Rejected(str(e).splitlines()[0]) from e
    if faults:
        raise Rejected(faults[0])
    return text


def run_readonly(spark: SparkSession, text: str, args: dict | None = None, limit: int = 200, views: Iterable[str] | None = None) -> tuple[list[dict], bool]:
    """Rows as plain values, and whether there were more than the limit (1 to 1000)."""
    limit = max(1, min(MOST_ROWS, limit))
    rows = spark.sql(guard(spark, text, views), args or {}).limit(limit + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
    return [json.loads(r["j"]) for r in rows[:limit]], len(rows) > limit


def register(graph: Graph) -> None:
    """The graph's tables as views for run_readonly."""
    for name in ("chunks", "terms", "mentions", "operations", "describes", "provided", "steps", "involves", "refs"):
        getattr(graph, name).createOrReplaceTempView(name)


def describe(graph: Graph) -> DataFrame:
    """(label, column, type, n) of every table of the graph."""
    counts = P.edge_counts(graph)
    out = None
    for name in ("chunks", "terms", "mentions", "operations", "describes", "provided", "steps", "involves", "refs"):
        df = getattr(graph, name)
        one = df.sparkSession.createDataFrame([(name, c, t) for c, t in df.dtypes], "label string, column string, type string")
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(counts), "label")  # one row a label


class Schema:
    """The graph's schema for prompts and pages: collected at first use and kept until invalidate(), without what is hidden.

    A hidden label goes with all its columns; a hidden column goes wherever it stands.
    """

    def __init__(self, graph: Graph, hidden_labels: Iterable[str] = (), hidden_columns: Iterable[str] = ()):
        self.graph, self.hidden_labels, self.hidden_columns = graph, tuple(hidden_labels), tuple(hidden_columns)
        self.invalidate()

    def invalidate(self) -> None:
        self._rows: list[dict] | None = None

    def frame(self) -> DataFrame:
        """(label, column, type, n) of what is shown."""
        return describe(self.graph).where(~F.col("label").isin(*self.hidden_labels) & ~F.col("column").isin(*self.hidden_columns))

    def as_rows(self) -> list[dict]:
        """label, n and the columns with their types, by label: a row a table."""
        if self._rows is None:
            grouped = self.frame().groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("column", "type"))).alias("columns")).orderBy("label")
            self._rows = [r.asDict(recursive=True) for r in grouped.collect()]
        return self._rows

    def as_text(self) -> str:
        """A line a table: its name, its rows, its columns with their types."""
        return "\n".join(f"{r['label']} ({r['n']} rows): " + ", ".join(f"{c['column']} {c['type']}" for c in r["columns"]) for r in self.as_rows())


@dataclass(frozen=True)
class Config:
    """A retrieval's switches."""

    mode: str = "fixed"
    k: int = 10
    wide: int = 40
    rung: str = "provenance"
    rerank: bool = True
    step_evidence: bool = False
    closure: bool = False
    context: int = 20_000
    a_chunk: int = 4_000
    model: str | None = None
    context_length: int | None = None

    def has(self, rung: str) -> bool:
        return LADDER.index(rung) <= LADDER.index(self.rung)


#: Options by the start of a model's name; a request's context length comes before the profile's, then 16384.
PROFILES = {"qwen": {"context_length": 32_768}, "llama": {"context_length": 8_192}, "deepseek": {"context_length": 65_536}}


def context_length(config: Config) -> int:
    profile = next((p for k, p in PROFILES.items() if (config.model or "").lower().startswith(k)), {})
    return config.context_length or profile.get("context_length") or 16_384


def overlap_logit(question: F.Column, content: F.Column) -> F.Column:
    """A stand-in for a pair scorer: a logit from the share of the question's words that a clause has."""
    from clausegraph.functions import text as T

    asked = F.array_distinct(T.tokens(question))
    share = F.size(F.array_intersect(asked, F.array_distinct(T.tokens(content)))) / F.greatest(F.size(asked), F.lit(1))
    return share * 8 - 3


def _unit_vectors(rows: DataFrame, id_col: str, text_col: str, encode: Callable) -> DataFrame:
    from clausegraph.plans.store import embed_missing

    return embed_missing(rows.select(id_col, text_col, F.lit(None).cast("array<float>").alias("embedding")), text_col, "embedding", VECTOR_DIM, encode)


def _dense_branch(chunks: DataFrame, questions: DataFrame, wide: int, encode: Callable) -> DataFrame:
    """(qid, doc, score, rank) by the vectors of contents, which are made where they are scored, in tasks of all cores."""
    from clausegraph.plans.store import encoder

    asked = _unit_vectors(questions, "qid", "question", encode).withColumnRenamed("qid", "id")
    items = spread(chunks.select(F.col("chunk_id").alias("id"), "content"), "id")
    return R.dense(items, asked, wide, "id", encode=encoder(encode, VECTOR_DIM), text_col="content")


def _graph_branch(graph: Graph, terms: DataFrame, config: Config) -> DataFrame:
    """(qid, doc, score, step_hits) by the layers that the rung has: entity counts named terms; relation adds operations of the named providers and steps in which two of them meet."""
    said = terms.join(graph.mentions.select(F.col("term").cast("string").alias("term"), F.col("chunk_id").alias("doc")), "term").groupBy("qid", "doc").agg(F.countDistinct("term").cast("double").alias("score"))
    if not config.has("relation"):
        return said.withColumn("step_hits", F.lit(None).cast("int"))
    provided = graph.provided.select("op", F.col("term").cast("string").alias("term"))
    via = terms.join(provided, "term").join(graph.describes.select("op", F.col("chunk_id").alias("doc")), "op").groupBy("qid", "doc").agg(F.countDistinct("op").cast("double").alias("score"))
    involved = graph.involves.select("step_id", F.col("term").cast("string").alias("term"))
    met = terms.join(involved, "term").groupBy("qid", "step_id").agg(F.countDistinct("term").cast("int").alias("n")).where("n >= 2")
    acting = met.join(graph.steps.select("step_id", F.col("chunk_id").alias("doc")), "step_id").groupBy("qid", "doc").agg(F.max("n").alias("step_hits"))
    counted = said.unionByName(via).groupBy("qid", "doc").agg(F.sum("score").alias("score"))
    return counted.join(acting, ["qid", "doc"], "full").withColumn("score", F.coalesce("score", F.col("step_hits").cast("double")))


def answer(graph: Graph, questions: DataFrame, config: Config | None = None, scorer: Callable | None = None, encode: Callable | None = None, policy: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked clauses for many questions (qid, question) in one plan: (candidates, trace).

    candidates: qid, doc, rank, score, section_id, title, via, in_context; trace: qid, seq, stage, payload.

    Modes: none has no candidates; bm25 and dense have one branch, bm25_dense both by rank fusion; graph
    has the graph's branch alone; fixed fuses dense and graph (weighted by the graph's scores) and ranks
    anew, hybrid does so without ranking anew; react_agent lets `policy` choose tools, for all
    questions in common rounds (plans.agents). Rungs: relation adds operations and steps to the graph's branch, hierarchy siblings of
    the best clauses, xref what these cite, provenance the kind of a clause's specification. The switch
    closure puts the clauses of the procedure that a question names first; step_evidence adds their
    steps to the trace. in_context says which clauses fit a context of `context` characters, at most
    `a_chunk` of each.
    """
    config, scorer = config or Config(), scorer or overlap_logit
    if config.mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if config.mode == "react_agent" and policy is None:
        raise ValueError("react_agent needs a policy")
    if encode is None:
        from clausegraph.plans.store import hashed as encode
    chunks, wide = graph.chunks, config.wide
    key = dict(chunks.dtypes)["chunk_id"]
    nothing = questions.select("qid", F.lit(None).cast(key).alias("doc"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("via")).limit(0)
    terms = cut(Q.named_terms(questions, graph.terms.select(F.col("term").cast("string").alias("term"), "full_name")))
    branches, steps = [], None
    uses_graph = config.mode in ("fixed", "hybrid", "graph")
    if config.mode in ("bm25", "bm25_dense"):
        found = R.normalised(R.bm25(spread(chunks.select("chunk_id", "content"), "chunk_id"), questions, wide, "chunk_id", "content", "qid", "question"))
        branches.append(found.select("qid", "doc", "rank", F.lit(1.0).alias("weight"), F.lit("bm25").alias("via")))
    if config.mode in ("dense", "bm25_dense", "fixed", "hybrid"):
        found = _dense_branch(chunks, questions, wide, encode)
        branches.append(found.select("qid", "doc", "rank", F.lit(1.0).alias("weight"), F.lit("dense").alias("via")))
    if uses_graph:
        found = cut(_graph_branch(graph, terms, config))
        steps = found.where("step_hits is not null").select("qid", "doc", "step_hits")
        best = R.top_per_query(R.normalised(found), wide)
        branches.append(best.join(R.branch_weight(best, questions), "qid").select("qid", "doc", "rank", "weight", F.lit("graph").alias("via")))
    if config.mode == "react_agent":
        from clausegraph.plans.agents import search

        found, _ = search(graph, questions, policy, encode=encode)
        branches.append(found.select("qid", F.col("chunk_id").alias("doc"), F.col("place").alias("rank"), F.lit(1.0).alias("weight"), "via"))
    lists = nothing
    for branch in branches:
        lists = lists.unionByName(branch)
    lists = cut(lists)
    fused = R.rrf(lists, wide * max(1, len(branches))).select("qid", "doc", "score", "rank")
    via = lists.groupBy("qid", "doc").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))
    pool = fused.join(via, ["qid", "doc"]).select("qid", "doc", "score", "via", *[F.lit(False).alias(c) for c in ("chain", "lead")])
    extra = []
    top = fused.where("rank <= 5").select("qid", F.col("doc").alias("seed"), F.col("rank").alias("ord"))
    if uses_graph and config.has("hierarchy"):
        seeds = top.where("ord <= 2")
        near = H.siblings(seeds.select(F.col("seed").alias("chunk_id")).distinct(), chunks).where("rank <= 3")
        extra.append(seeds.join(near, "seed").select("qid", F.col("chunk_id").alias("doc"), F.lit("sibling").alias("via"), F.lit(False).alias("chain"), F.lit(False).alias("lead")))
    if uses_graph and config.has("xref"):
        reached = H.hops(top, graph.refs, chunks, by="qid")
        extra.append(reached.select("qid", F.col("target").alias("doc"), F.lit("hop").alias("via"), F.lit(True).alias("chain"), F.lit(False).alias("lead")))
    if config.closure:
        heads = chunks.join(H.parents(chunks).select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "spec_id", "title", F.lit(1).alias("size"))
        roots = Q.root_headings(questions, heads)
        led = Q.closure(roots, chunks, graph.refs, graph.describes.withColumn("op", F.col("op").cast("string")), texts=True, questions=questions)
        extra.append(led.select("qid", F.col("chunk_id").alias("doc"), F.concat(F.lit("closure:"), "role").alias("via"), F.lit(False).alias("chain"), F.lit(True).alias("lead")))
    for more in extra:
        pool = pool.unionByName(more.withColumn("score", F.lit(0.0)))
    pool = cut(pool.groupBy("qid", "doc").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("via", ","))))), ",").alias("via"), F.max("chain").alias("chain"), F.max("lead").alias("lead")))
    pool = pool.join(steps, ["qid", "doc"], "left") if steps is not None else pool.withColumn("step_hits", F.lit(None).cast("int"))
    few = pool.count() * POOL_ROW_BYTES <= BROADCAST_BYTES
    told = cut((F.broadcast(pool) if few else pool).join(chunks.select(F.col("chunk_id").alias("doc"), "section_id", "title", "spec_id", "chunk_type", "content"), "doc").join(questions, "qid"))
    q, t = F.lower("question"), F.lower(F.coalesce("title", F.lit("")))
    high = F.max("score").over(P.Window.partitionBy("qid"))
    upstream = F.coalesce(F.try_divide(F.col("score"), high), F.lit(0.0))
    if config.has("provenance"):
        upstream = Q.study_and_function(upstream, F.col("spec_id").cast("string"), F.col("title"), Q.intent(F.col("question")).isin("definition", "network_function"))
    ops = F.regexp_extract_all("question", F.lit(OPERATION_NAME), 0)
    named = {"anchor": (F.length(t) > 0) & q.contains(t), "op_prefix": F.exists(ops, lambda o: F.contains(t, F.lower(o)))}
    told = told.withColumns(named).withColumn("upstream", F.round(upstream, 6))
    if config.rerank and config.mode != "hybrid":
        bias = Q.bias(F.col("question"), F.col("title"), F.col("spec_id").cast("string"), F.col("chunk_type"), F.col("step_hits").isNotNull(), F.col("step_hits"), F.col("op_prefix"), F.col("anchor"), F.col("chain"))
        scored = told.select("qid", "doc", F.round(scorer(F.col("question"), F.col("content")), 6).alias("logit"), "upstream", bias.alias("bias"), (F.col("step_hits").isNotNull() | F.col("chain") | F.col("lead")).alias("protected"))
        ranked = R.rerank(scored, wide * 4)
    else:
        ranked = R.top_per_query(told.select("qid", "doc", F.col("upstream").alias("score")), wide * 4)
    final = ranked.drop("rank").join(told.select("qid", "doc", "lead", "via", "section_id", "title", F.length("content").cast("long").alias("size")), ["qid", "doc"])
    turn = F.row_number().over(P.Window.partitionBy("qid").orderBy(F.desc("lead"), F.desc("score"), "doc"))
    final = cut(final.withColumn("rank", turn).where(F.col("rank") <= config.k))
    fits = R.context(final.select("qid", "doc", "rank", "size"), config.context, config.a_chunk).select("qid", "doc", F.lit(True).alias("fits"))
    out = final.join(fits, ["qid", "doc"], "left").select("qid", "doc", "rank", "score", "section_id", "title", "via", F.coalesce("fits", F.lit(False)).alias("in_context"))
    stages = [("intent", questions.select("qid", Q.intent(F.col("question")).alias("p"))), ("terms", terms.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("p")))]
    stages += [(f"retrieval_{name}", lists.where(F.col("via") == name).groupBy("qid").agg(F.count(F.lit(1)).cast("string").alias("p"))) for name in ("bm25", "dense", "graph")]
    if config.step_evidence:
        involved = terms.join(graph.involves.select("step_id", F.col("term").cast("string").alias("term")), "term").select("qid", "step_id").distinct()
        shown = involved.join(graph.steps, "step_id").join(final.select("qid", F.col("doc").alias("chunk_id")), ["qid", "chunk_id"])
        stages.append(("step_evidence", shown.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("step_id")), ",").alias("p"))))
    stages.append(("sources", out.groupBy("qid").agg(F.count(F.lit(1)).cast("string").alias("p"))))
    trace = None
    for seq, (stage, df) in enumerate(stages):
        one = df.select("qid", F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), F.col("p").alias("payload"))
        trace = one if trace is None else trace.unionByName(one)
    return out, trace


@dataclass
class Agent:
    """A bounded loop over parameterised tools: a policy sees the question and what was found, and names the next tool.

    It stops when the policy finishes, after `steps` calls, with `most` clauses, or after two answers that name no tool.
    """

    graph: Graph
    policy: Callable[[str, list[dict]], dict]
    steps: int = 5
    most: int = 30
    found: list[dict] = field(default_factory=list)
    log: list[str] = field(default_factory=list)

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        g = self.graph
        return {
            "title_search": lambda phrase: P.title_phrases(g.chunks, [phrase]).select("chunk_id"),
            "term_search": lambda term: P.mention_counts(g, [term]).select("chunk_id"),
            "spec_search": lambda spec: g.chunks.where(F.col("spec_id") == spec).select("chunk_id").orderBy("chunk_id").limit(10),
            "expand": lambda chunk_id: g.refs.where(F.col("src") == chunk_id).select(F.col("dst").alias("chunk_id")).orderBy("chunk_id").limit(10),
            "inspect": lambda chunk_id: g.chunks.where(F.col("chunk_id") == chunk_id).select("chunk_id"),
        }

    def run(self, question: str) -> list[dict]:
        tools, bad = self.tools(), 0
        for _ in range(self.steps):
            asked = self.policy(question, self.found)
            if asked.get("tool") == "finish" or len(self.found) >= self.most:
                break
            if asked.get("tool") not in tools:
                bad += 1
                if bad == 2:
                    break
                continue
            self.log.append(asked["tool"])
            known = {f["chunk_id"] for f in self.found}
            rows = tools[asked["tool"]](**asked.get("args", {})).limit(self.most).collect()
            self.found += [{"chunk_id": r["chunk_id"], "via": asked["tool"]} for r in rows if r["chunk_id"] not in known][: self.most - len(self.found)]
        return self.found


def ladder(config: Config) -> list[Config]:
    return [replace(config, rung=r) for r in LADDER]


def corpus_shape(graph: Graph) -> DataFrame:
    """(kind, name, n): how many clauses a specification and a type have, and how many rows a label."""
    by = lambda kind, c: graph.chunks.groupBy(F.col(c).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by("spec", "spec_id").unionByName(by("type", "chunk_type")).unionByName(P.edge_counts(graph).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n"))


def recovered(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df with columns named as wanted, where a query called them otherwise: c.chunk_id, CHUNK_ID or `chunk id` for chunk_id. The first that fits is taken; a name that is there stays."""
    plain = lambda c: re.sub(r"[^a-z0-9]+", "_", c.rsplit(".", 1)[-1].lower()).strip("_")
    names = list(df.columns)
    for want in wanted:
        if want not in names:
            at = next((i for i, n in enumerate(names) if n not in wanted and plain(n) == want.lower()), None)
            if at is not None:
                names[at] = want
    return df.toDF(*names)
