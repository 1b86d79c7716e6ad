"""Graph patterns: who mentions, describes and steps through what. Ids travel alone; content joins after top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.plans.graph import Graph


def document_frequency(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"))


def band(mentions: DataFrame, terms: DataFrame, low: int = 5, high: int = 5000) -> DataFrame:
    """Mentions of known terms whose document frequency lies in the band, with it."""
    df = document_frequency(mentions.join(terms.select("term"), "term", "left_semi")).where(F.col("df").between(low, high))
    return mentions.join(df, "term").select("chunk_id", "term", "df")


def co_occurrence(mentions: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, weight) for terms a < b in one chunk at least `least` times.

    Pairs grow with the square of a chunk's terms, and a chunk has ten key terms at most. A chunk's distinct
    terms meet in its own row, so its pairs are distinct too and weights are plain counts.
    """
    bags = mentions.where("chunk_id is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    firsts = bags.select(F.posexplode("terms").alias("at", "a"), "terms").select("a", F.slice("terms", F.col("at") + 2, F.size("terms")).alias("after"))
    pairs = firsts.select("a", F.explode("after").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def top(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def one_term(g: Graph, term: int, types: list[str], k: int = 20) -> DataFrame:
    """Chunks of the term's primary specification and of these types, or with its name in the title; scored by mention and type. Two equality paths, united."""
    t = g.terms.where(F.col("term") == term)
    by_spec = g.chunks.where(F.col("chunk_type").isin(types)).join(t.select(F.col("primary_spec").alias("spec_id")), "spec_id")
    by_title = g.chunks.join(F.broadcast(t.select("full_name").limit(1)), F.col("title").contains(F.col("full_name"))).select(g.chunks.columns)
    found = by_spec.select(g.chunks.columns).unionByName(by_title).dropDuplicates(["chunk_id"])
    said = g.mentions.where(F.col("term") == term).select("chunk_id", F.lit(1).alias("said"))
    scored = found.join(said, "chunk_id", "left").withColumn("score", F.when(F.col("said").isNotNull() & F.col("chunk_type").isin(types), 1.0).when(F.col("said").isNotNull(), 0.8).otherwise(0.5))
    return top(scored.select("chunk_id", "spec_id", "section_id", "score"), k, F.desc("score"), "chunk_id")


def many_terms(g: Graph, asked: list[int], k: int = 20) -> DataFrame:
    """Chunks of the terms' specifications, one row for each asked term that they mention (or one without): repeated rows count towards the limit."""
    specs = g.terms.where(F.col("term").isin(asked)).select(F.col("primary_spec").alias("spec_id")).distinct()
    said = g.mentions.where(F.col("term").isin(asked))
    rows = g.chunks.join(specs, "spec_id", "left_semi").join(said, "chunk_id", "left")
    return top(rows.select("chunk_id", "term", F.when(F.col("term").isNotNull(), 1.0).otherwise(0.5).alias("score")), k, F.desc("score"), "chunk_id", "term")


def same_step(g: Graph, asked: list[int]) -> DataFrame:
    """Relational division: chunks with steps that involve all asked terms; the score is the number of such steps."""
    full = g.involves.where(F.col("term").isin(asked)).groupBy("step_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(set(asked)))
    return g.steps.join(full, "step_id").groupBy("chunk_id").agg(F.countDistinct("step_id").alias("score"))


def term_paths(g: Graph, asked: list[int]) -> DataFrame:
    """(chunk_id, term, via): asked terms that a chunk mentions, or whose operation it describes."""
    said = g.mentions.where(F.col("term").isin(asked)).select("chunk_id", "term", F.lit("mention").alias("via"))
    by_op = g.describes.join(g.provided.where(F.col("term").isin(asked)), "op").select("chunk_id", "term", F.lit("operation").alias("via"))
    return said.unionByName(by_op).distinct()


def all_terms_any_way(g: Graph, asked: list[int]) -> DataFrame:
    """Chunks that reach every asked term by mention or operation and describe some operation; the score counts terms reached by operation, and may be 0."""
    paths = term_paths(g, asked).groupBy("chunk_id").agg(F.countDistinct("term").alias("n"), F.countDistinct(F.when(F.col("via") == "operation", F.col("term"))).alias("score"))
    return paths.where(F.col("n") == len(set(asked))).join(g.describes.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "score")


def steps_and_operations(g: Graph, asked: list[int], k: int = 20) -> DataFrame:
    """Either division with one score: 100 a full step, 50 if all terms come by operation, 2 a mention, 1 an operation, 1 a term in steps; four sort keys."""
    n = len(set(asked))
    step = g.steps.join(g.involves.where(F.col("term").isin(asked)), "step_id").groupBy("chunk_id", "step_id").agg(F.countDistinct("term").alias("m"), F.collect_set("term").alias("ts"))
    step = step.groupBy("chunk_id").agg(F.sum((F.col("m") == n).cast("long")).alias("full_steps"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).cast("long").alias("step_actors"))
    path = term_paths(g, asked).groupBy("chunk_id").agg(F.countDistinct(F.when(F.col("via") == "mention", F.col("term"))).alias("said"), F.countDistinct(F.when(F.col("via") == "operation", F.col("term"))).alias("by_op"))
    both = step.join(path, "chunk_id", "full").na.fill(0)
    both = both.where((F.col("full_steps") > 0) | (F.col("by_op") == n))
    score = 100 * F.col("full_steps") + F.when(F.col("by_op") == n, 50).otherwise(0) + 2 * F.col("said") + F.col("by_op") + F.col("step_actors")
    rows = both.withColumn("score", score.cast("long")).select("chunk_id", "full_steps", "said", "by_op", "score")
    return top(rows, k, F.desc("score"), F.desc("full_steps"), F.desc("said"), "chunk_id")


def title_phrases(chunks: DataFrame, phrases: list[str], k: int = 20) -> DataFrame:
    """Chunks whose title has one of the phrases between word borders; a constant score, ties by id."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.col("title").rlike(rf"(?i)(^|[^A-Za-z0-9_])\Q{p}\E([^A-Za-z0-9_]|$)")
    return top(chunks.where(hit).select("chunk_id", "title", F.lit(1.0).alias("score")), k, "chunk_id")


def cited_with(g: Graph, spec: int) -> DataFrame:
    """Both ends of the external citations out of a specification; union distinct, ordered as a whole."""
    mine = g.chunks.where(F.col("spec_id") == spec).select(F.col("chunk_id").alias("src"))
    edges = g.refs.where("is_external").join(mine, "src", "left_semi").join(g.chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    return edges.select(F.col("src").alias("chunk_id")).union(edges.select("dst")).distinct()


def mention_counts(g: Graph, asked: list[int], k: int = 10) -> DataFrame:
    hits = g.mentions.where(F.col("term").isin(asked)).groupBy("chunk_id").agg(F.countDistinct("term").alias("hits"))
    return top(hits, k, F.desc("hits"), "chunk_id")


def step_actors(g: Graph, asked: list[int], least: int = 2) -> DataFrame:
    """Chunks with a step where at least `least` asked terms meet, and the most that do."""
    met = g.steps.join(g.involves.where(F.col("term").isin(asked)), "step_id").groupBy("chunk_id", "step_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") >= least)
    return met.groupBy("chunk_id").agg(F.max("n").alias("n_step_actor_hits"))


def step_evidence(g: Graph, asked: list[int], least_steps: int = 4) -> DataFrame:
    """Steps that involve an asked term, and their neighbours; only of chunks with `least_steps` or more of which these are a strict part."""
    hit = g.involves.where(F.col("term").isin(asked)).select("step_id").distinct().withColumn("hit", F.lit(1))
    near = Window.partitionBy("chunk_id").orderBy("ord").rowsBetween(-1, 1)
    whole = Window.partitionBy("chunk_id")
    rows = g.steps.join(hit, "step_id", "left").withColumn("near", F.coalesce(F.max("hit").over(near), F.lit(0)))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("kept", F.sum("near").over(whole))
    return rows.where((F.col("n") >= least_steps) & (F.col("kept") < F.col("n")) & (F.col("near") == 1)).select("chunk_id", "step_id", "ord")


def next_steps(steps: DataFrame) -> DataFrame:
    following = F.lead("step_id").over(Window.partitionBy("chunk_id").orderBy("ord"))
    return steps.withColumn("next", following).where("next is not null").select(F.col("step_id").alias("src"), F.col("next").alias("dst"))


# From this size on a clause holds an operation because it holds half of a specification; the hard anchors of a question.
OVERSIZED, MOST_ANCHORS = 40_000, 3


def per_operation(g: Graph, k: int = 2) -> DataFrame:
    """(op, chunk_id, title_score, matched, rank): for each operation the k clauses that define it best.

    A title with the operation's name counts 2, one with the last part of the name (of four characters
    or more) 1; then come clauses that describe more of the operations, then the shorter, then by id.
    """
    name, title = F.lower(F.col("op").cast("string")), F.lower(F.coalesce("title", F.lit("")))
    last = F.substring_index(name, "_", -1)
    score = F.when(F.contains(title, name), 2).when((F.length(last) >= 4) & F.contains(title, last), 1).otherwise(0)
    matched = g.describes.groupBy("chunk_id").agg(F.countDistinct("op").alias("matched"))
    rows = g.describes.join(matched, "chunk_id").join(g.chunks.select("chunk_id", "title", F.length("content").alias("size")), "chunk_id").withColumn("title_score", score)
    rank = F.row_number().over(Window.partitionBy("op").orderBy(F.desc("title_score"), F.desc("matched"), "size", "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("op", "chunk_id", "title_score", "matched", "rank")


def all_operations(g: Graph, asked: list[int], k: int = MOST_ANCHORS) -> DataFrame:
    """Clauses that describe two or more asked operations: most first; then those that are not oversized, no study, shorter; then by id."""
    n = g.describes.where(F.col("op").isin(asked)).groupBy("chunk_id").agg(F.countDistinct("op").alias("matched")).where("matched >= 2")
    rows = n.join(g.chunks.select("chunk_id", "spec_id", F.length("content").alias("size")), "chunk_id")
    study = F.coalesce(F.regexp_extract(F.col("spec_id").cast("string"), r"^[^_]*_[^_]*_(\d{3})", 1).try_cast("int") >= 700, F.lit(False))
    return top(rows, k, F.desc("matched"), F.col("size") > OVERSIZED, study, "size", "chunk_id").drop("spec_id")


def service_operations(g: Graph, service: str) -> DataFrame:
    """(chunk_id, n_ops): clauses by how many operations of a service they describe; an operation is a service's if its name starts with the service's."""
    ops = g.describes.where(F.startswith(F.col("op").cast("string"), F.lit(service)))
    return ops.groupBy("chunk_id").agg(F.countDistinct("op").alias("n_ops"))


# Fixed value: into how many keys the terms of one name are spread.
NAME_SPREAD = 32


def name_bridge(named: DataFrame, terms: DataFrame) -> DataFrame:
    """(op, term): operations (op, name) whose name is a term's full name, in any case of letters.

    Few names may be shared by many, so that small tables make many pairs: a name's terms are spread over
    NAME_SPREAD keys, which each operation meets, and no pair moves.
    """
    tasks = 4 * named.sparkSession.sparkContext.defaultParallelism
    ops = named.select("op", F.lower("name").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(NAME_SPREAD - 1))).alias("part"))
    spread = terms.select("term", F.lower("full_name").alias("n"), F.pmod(F.xxhash64("term"), F.lit(NAME_SPREAD)).cast("int").alias("part"))
    return ops.repartition(tasks, "n", "part").join(spread.repartition(tasks, "n", "part"), ["n", "part"]).select("op", "term")


def unused_terms(g: Graph) -> DataFrame:
    return g.terms.join(g.mentions, "term", "left_anti").select("term", "full_name")


def typed_terms(g: Graph) -> DataFrame:
    """Every term, of type 'network function' where an operation is provided by it."""
    by = g.provided.select("term").distinct().withColumn("is_provider", F.lit(True))
    return g.terms.join(by, "term", "left").select("term", F.when(F.col("is_provider"), "network function").alias("semantic_type"))


def citation_keys(refs: DataFrame) -> DataFrame:
    """Surrogate keys: ten hex digits of the MD5 of source, target and type."""
    return refs.select("src", "dst", F.substring(F.md5(F.concat_ws("_", F.col("src"), F.col("dst"), F.col("ref_type")).cast("binary")), 1, 10).alias("ref_uid"))


# Fixed value: the least confidence of an external citation.
EXTERNAL_CONFIDENCE = 0.7


def known_targets(g: Graph) -> DataFrame:
    """External clause citations of enough confidence whose target is loaded; the others drop out."""
    return g.refs.where(F.col("is_external") & (F.col("ref_type") == "clause") & (F.col("confidence") >= EXTERNAL_CONFIDENCE)).join(g.chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def missing_targets(g: Graph) -> DataFrame:
    return g.refs.join(g.chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_anti").select("dst").distinct()


def edge_counts(g: Graph) -> DataFrame:
    out = None
    for name in ("chunks", "terms", "mentions", "operations", "describes", "provided", "steps", "involves", "refs"):
        one = getattr(g, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# The text forms of a clause's edges, in their order, and which kinds are capped.
EDGE_FORMS = ("  {value}", "  {value}", "  {chunk} DESCRIBES_MESSAGE {value}", "  Parameter[{value}] DEFINED_IN_TABLE {chunk}", "  {chunk} MENTIONS {value}", "  {spec} REFERENCES_SPEC {value}")
CAPPED_KINDS, NO_EDGES = (1, 3, 4), "  (no graph relations)"


def neighbourhood(g: Graph, asked: DataFrame, messages: DataFrame, parameters: DataFrame, most: int = 12) -> DataFrame:
    """(chunk_id, n, block): the edges of each asked clause (chunk_id) as a text under its specification and title.

    Six kinds, in this order: operations with who provides them, steps with whom they involve, messages
    (chunk_id, message), parameters (parameter, chunk_id), mentions on one line, and cited specifications.
    Steps, parameters and mentions are cut to the first `most`; n counts the edges shown. Values are distinct
    and in text order. A clause without edges says so; one that is not among the chunks is left out.

    Each kind moves to its clauses once, as ids: an operation and a step carry their terms as one list, and
    texts are written where a clause's kinds meet.
    """
    asked = asked.select("chunk_id").distinct()
    text = lambda c: F.col(c).cast("string")
    cited = g.refs.where("is_external").join(g.chunks.select(F.col("chunk_id").alias("dst"), "spec_id"), "dst").withColumnRenamed("src", "chunk_id")

    def linked(rows: DataFrame, ends: DataFrame, key: str) -> DataFrame:
        """(chunk_id, value) of rows (chunk_id, key), where value is the key and the list of its terms."""
        lists = ends.groupBy(key).agg(F.collect_set("term").alias("terms"))
        return rows.join(lists, key).select("chunk_id", F.struct(text(key).alias("key"), "terms").alias("value"))

    def spelled(values: Column, word: str) -> Column:
        return F.flatten(F.transform(values, lambda v: F.transform(v["terms"], lambda t: F.concat(v["key"], F.lit(f" {word} "), t.cast("string")))))

    strings = lambda values: F.transform(values, lambda v: v.cast("string"))
    kinds = (
        (linked(g.describes, g.provided, "op"), lambda v: spelled(v, "PROVIDED_BY")), (linked(g.steps, g.involves, "step_id"), lambda v: spelled(v, "INVOLVES")),
        (messages.select("chunk_id", F.col("message").alias("value")), strings), (parameters.select("chunk_id", F.col("parameter").alias("value")), strings),
        (g.mentions.select("chunk_id", F.col("term").alias("value")), strings), (cited.select("chunk_id", F.col("spec_id").alias("value")), strings),
    )
    rows = asked.join(g.chunks.select("chunk_id", text("spec_id").alias("spec"), "title"), "chunk_id").distinct()
    for kind, (edges, written) in enumerate(kinds):
        own = edges.join(asked, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.collect_set("value").alias("values"))
        ordered = F.array_sort(F.array_distinct(written(F.col("values"))))
        rows = rows.join(own.select("chunk_id", (F.slice(ordered, 1, most) if kind in CAPPED_KINDS else ordered).alias(f"v{kind}")), "chunk_id", "left")

    def line(kind: int) -> Column:
        values, (before, after) = F.col(f"v{kind}"), EDGE_FORMS[kind].split("{value}")
        filled = lambda part: F.replace(F.replace(F.lit(part), F.lit("{chunk}"), text("chunk_id")), F.lit("{spec}"), F.col("spec"))
        each = F.concat(filled(before), F.array_join(values, ", "), filled(after)) if kind == 4 else F.array_join(F.transform(values, lambda v: F.concat(filled(before), v, filled(after))), "\n")
        return F.when(F.size(values) > 0, each)

    n = sum((F.greatest(F.coalesce(F.size(f"v{k}"), F.lit(0)), F.lit(0)) for k in range(len(kinds))), F.lit(0)).cast("long")
    body = F.coalesce(F.nullif(F.concat_ws("\n", *[line(k) for k in range(len(kinds))]), F.lit("")), F.lit(NO_EDGES))
    return rows.select("chunk_id", n.alias("n"), F.concat(F.lit("["), F.col("spec"), F.lit(" §"), F.coalesce("title", F.lit("")), F.lit("]\n"), body).alias("block"))
