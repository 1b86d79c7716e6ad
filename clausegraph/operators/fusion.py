"""Reordering and extending ranked lists: title merges, protected clauses, anchors, multi-hop, concepts, tables in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T


def title_merge(rows: DataFrame, titled: DataFrame, k: int = 60) -> DataFrame:
    """(qid, doc, score): two ranked lists (qid, doc, rank) fused by reciprocal ranks, then over the best of the question, which becomes 1."""
    both = rows.select("qid", "doc", "rank").unionByName(titled.select("qid", "doc", "rank"))
    fused = both.groupBy("qid", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"))
    return fused.select("qid", "doc", F.round(F.col("s") / F.max("s").over(Window.partitionBy("qid")), 9).alias("score"))


def protect(kept: DataFrame, before: DataFrame, is_procedure: Column, most: int = 4) -> DataFrame:
    """Kept rows (qid, doc, score), and up to `most` a question of those before that were dropped although their title names a procedure, best first."""
    lost = before.join(kept.select("qid", "doc"), ["qid", "doc"], "left_anti").where(is_procedure)
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    back = lost.withColumn("n", n).where(F.col("n") <= most).select("qid", "doc", "score", F.lit(True).alias("protected"))
    return kept.select("qid", "doc", "score", F.lit(False).alias("protected")).unionByName(back)


def front(rows: DataFrame, flag: Column, k: int) -> DataFrame:
    """Rows (qid, doc, rank) with those that have the flag first, both parts in their order, cut to k."""
    order = Window.partitionBy("qid").orderBy(F.coalesce(flag, F.lit(False)).cast("int").desc(), "rank")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def two_budgets(rows: DataFrame, is_closure: Column, closure_k: int = 20, rest_k: int = 10) -> DataFrame:
    """The closure's rows, up to their budget, lead; the rest follows up to its own."""
    flagged = rows.withColumn("in_closure", F.coalesce(is_closure, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("qid", "in_closure").orderBy("rank"))
    kept = flagged.withColumn("n", n).where(F.col("n") <= F.when(F.col("in_closure"), closure_k).otherwise(rest_k))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("in_closure").cast("int").desc(), "rank"))).drop("n")


def graded(rows: DataFrame, hard: Column, most: int = 5) -> DataFrame:
    """Anchors (qid, doc, ord) with grade: the first `most` a question that qualify are hard, all others soft."""
    flagged = rows.withColumn("is_hard", F.coalesce(hard, F.lit(False)))
    so_far = F.sum(F.col("is_hard").cast("int")).over(Window.partitionBy("qid").orderBy("ord", "doc").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("grade", F.when(F.col("is_hard") & (so_far <= most), "hard").otherwise("soft")).drop("is_hard")


def multi_hop(seeds: DataFrame, refs: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, target, hops) within that many citations, no citation twice in a path, the fewest hops kept; `hops` joins, unrolled."""
    if hops > 3:
        raise ValueError("up to three hops")
    edges = refs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(">", "src", "dst").alias("e"))
    path = seeds.select("seed").join(edges, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("target"), F.array("e").alias("used"))
    out = path.select("seed", "target", F.lit(1).alias("hops"))
    for n in range(2, hops + 1):
        path = path.join(edges, F.col("target") == F.col("a")).where(~F.array_contains("used", F.col("e"))).select("seed", F.col("b").alias("target"), F.concat("used", F.array("e")).alias("used"))
        out = out.unionByName(path.select("seed", "target", F.lit(n).alias("hops")))
    return out.where("seed <> target").groupBy("seed", "target").agg(F.min("hops").alias("hops"))


def merged(*parts: DataFrame) -> DataFrame:
    """Candidates (doc, score, hops) of several patterns: each document once, from the first part that has it, by score and hops."""
    rows = None
    for k, p in enumerate(parts):
        one = p.select("doc", "score", "hops", F.lit(k).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    first = Window.partitionBy("doc").orderBy("part", F.desc("score"), "hops")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc", "score", "hops", "part")


def shortlist(questions: DataFrame, headings: DataFrame, k: int = 40) -> DataFrame:
    """(qid, chunk_id, score): headings (chunk_id, title, path) by the idf of asked words in the title, half of that in the path's, less 0.3 of the title's other words.

    With a spec_id in both, a question asks its own specification (qid, question, spec_id) alone, and words are
    weighed over that specification's headings; without, all headings are of one. A heading that shares no
    word, neither itself nor by its path, is none. Ties go to the larger subtree (size), then the larger id.
    """
    words = lambda c: F.array_distinct(F.transform(T.tokens(F.coalesce(c, F.lit(""))), T.stem))
    own_spec = "spec_id" in questions.columns and "spec_id" in headings.columns
    spec = (F.col("spec_id") if own_spec else F.lit(0)).alias("spec")
    size = (F.col("size") if "size" in headings.columns else F.lit(0)).alias("size")
    heads = headings.select(spec, "chunk_id", words(F.col("title")).alias("t"), words(F.col("path")).alias("p"), size)
    own = heads.select("spec", "chunk_id", F.explode("t").alias("w"))
    above = heads.select("spec", "chunk_id", F.explode(F.array_except("p", "t")).alias("w"))
    n = heads.groupBy("spec").agg(F.count(F.lit(1)).alias("n"))
    asked = questions.select("qid", spec, F.explode(words(F.col("question"))).alias("w"))
    known = own.select("spec", "w").unionByName(above.select("spec", "w")).distinct().join(own.groupBy("spec", "w").agg(F.count(F.lit(1)).alias("df")), ["spec", "w"], "left")
    idf = known.join(n, "spec").select("spec", "w", F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))
    total = own.join(idf, ["spec", "w"]).groupBy("chunk_id").agg(F.sum("idf").alias("all"))
    met = lambda rows, name: rows.join(asked, ["spec", "w"]).join(idf, ["spec", "w"]).groupBy("qid", "chunk_id").agg(F.sum("idf").alias(name))
    mine = F.coalesce("own", F.lit(0.0))
    score = F.round(mine + 0.5 * F.coalesce("up", F.lit(0.0)) - 0.3 * (F.coalesce("all", F.lit(0.0)) - mine), 6)
    rows = met(own, "own").join(met(above, "up"), ["qid", "chunk_id"], "full").join(total, "chunk_id", "left").join(heads.select("chunk_id", "size"), "chunk_id").select("qid", "chunk_id", score.alias("score"), "size")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("size"), F.desc("chunk_id")))
    return rows.withColumn("n", best).where(F.col("n") <= k).select("qid", "chunk_id", "score")


def camel_words(name: Column) -> Column:
    """smContextStatus -> sm context status."""
    return F.lower(F.array_join(F.split(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-]"), " "))


def concepts_named(questions: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """(qid, name): concepts that a question names as they are, by their parts, or in the plural; the three longest."""
    forms = concepts.select("name", F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.lower("name"), camel_words(F.col("name"))), lambda f: F.array(f, F.concat(f, F.lit("s"))))))).alias("s"))
    words = questions.select("qid", F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9]+(?:[-_][a-z0-9]+)*"), 0).alias("w")).where(F.size("w") > 0)
    runs = words.select("qid", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.array_join(F.slice("w", i, n), " "))))).alias("s")).distinct()
    found = runs.join(forms, "s").select("qid", "name").distinct()
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("name")), "name"))
    return found.withColumn("n", n).where(F.col("n") <= k).select("qid", "name")


def locate_table(content: Column, headers: Column, rows: Column) -> Column:
    """struct(found, n_rows, truncated): how much of a table stands in a text, without regard to white space: the whole, or its longest run of complete first rows."""
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    text = flat(content)
    prefix = lambda n: flat(F.concat(F.array_join(headers, ""), F.array_join(F.flatten(F.slice(rows, F.lit(1), n)), "")))
    fits = F.filter(F.sequence(F.size(rows), F.lit(0), F.lit(-1)), lambda n: (prefix(n) != "") & F.contains(text, prefix(n)))
    n = F.try_element_at(fits, F.lit(1))
    return F.struct(n.isNotNull().alias("found"), F.coalesce(n, F.lit(0)).alias("n_rows"), F.coalesce(n < F.size(rows), F.lit(False)).alias("truncated"))


def sanity(terms: DataFrame, required: list[str]) -> DataFrame:
    """Required terms that are missing."""
    want = terms.sparkSession.createDataFrame([(r,) for r in required], "term string")
    return want.join(terms.select("term"), "term", "left_anti")


def label_schemes(gold: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, old, strict, lenient): authored gold; with what is judged RELEVANT; and with PARTIAL too. Gold judged NOT_RELEVANT leaves the latter two."""
    g = gold.select("qid", F.explode("gold").alias("doc"), F.lit(True).alias("g"))
    rows = g.join(judged.select("qid", "doc", "label"), ["qid", "doc"], "full")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("doc"))))
    is_gold = F.coalesce("g", F.lit(False))
    good = F.coalesce(F.col("label") == "RELEVANT", is_gold & F.col("label").isNull(), F.lit(False)) | (is_gold & F.col("label").isNull())
    some = good | F.coalesce(F.col("label") == "PARTIAL", F.lit(False))
    return rows.groupBy("qid").agg(pick(is_gold).alias("old"), pick(good).alias("strict"), pick(some).alias("lenient"))


def confusion(rows: DataFrame, truth: str, judged: str, labels: list[str]) -> DataFrame:
    """One row a true label, one column a judged label."""
    return rows.groupBy(truth).pivot(judged, labels).agg(F.count(F.lit(1))).na.fill(0)


# A judge's labels from the worst, and what a rater says of a question and of a clause.
JUDGED, SAID, OF_CLAUSE = ("NOT_RELEVANT", "PARTIAL", "RELEVANT"), ("full", "partial", "none"), ("relevant", "irrelevant")


def judge_confusion(judged: DataFrame, ratings: DataFrame) -> DataFrame:
    """(level, judge, rater, n): a judge's labels (qid, doc, label) against raters' (qid, rater, says, irrelevant), every cell, also of 0.

    At the level of clauses each rater meets each judged clause of the question: irrelevant if it is in the
    rater's list (null: none), else relevant. At the level of questions the judge's label is the worst of its clauses';
    a label or a word of a rater that is not among the fixed ones is left out, and so are questions that were not judged.
    Lists are exploded and meet by equality; clauses and ratings are counted by question, so pairs are never made.
    """
    known = judged.where(F.col("label").isin(*JUDGED)).select("qid", "doc", "label")
    raters = ratings.groupBy("qid").agg(F.count(F.lit(1)).alias("raters"))
    against = ratings.select("qid", "rater", F.explode(F.array_distinct("irrelevant")).alias("doc")).groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("no"))
    clauses = known.join(raters, "qid").join(against, ["qid", "doc"], "left").withColumn("no", F.coalesce("no", F.lit(0)))
    sums = clauses.groupBy("label").agg(F.sum(F.col("raters") - F.col("no")).alias("relevant"), F.sum("no").alias("irrelevant"))
    chunk = sums.select(F.lit("chunk").alias("level"), F.col("label").alias("judge"), F.explode(F.array(*[F.struct(F.lit(c).alias("rater"), F.col(c).alias("n")) for c in OF_CLAUSE])).alias("x")).select("level", "judge", "x.rater", "x.n")
    worst = known.groupBy("qid").agg(F.min(sum((F.when(F.col("label") == x, k).otherwise(0) for k, x in enumerate(JUDGED)), F.lit(0))).alias("at"))
    asked = ratings.where(F.col("says").isin(*SAID)).join(worst, "qid")
    label = F.element_at(F.array(*[F.lit(x) for x in JUDGED]), F.col("at") + 1)
    question = asked.groupBy(label.alias("judge"), F.col("says").alias("rater")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("question").alias("level"), "judge", "rater", "n")
    cells = [(level, j, r) for level, names in (("chunk", OF_CLAUSE), ("question", SAID)) for j in JUDGED for r in names]
    grid = judged.sparkSession.createDataFrame(cells, "level string, judge string, rater string")
    return grid.join(chunk.unionByName(question), ["level", "judge", "rater"], "left").select("level", "judge", "rater", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def validate(edges: dict[str, DataFrame], terms: DataFrame, required: list[str], values: DataFrame, wanted: tuple[str, str, str]) -> DataFrame:
    """(part, name, n, holds): a row for every kind of edge, also without edges, for every required term, and for the wanted value.

    terms(term); values(concept, name, code); wanted is a (concept, name, code) that must be there. holds is n > 0;
    for the value, that the code is the wanted one wherever the concept has the name.
    """
    spark = terms.sparkSession
    out = None
    for name, df in edges.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    want = spark.createDataFrame([(r,) for r in required], "term string")
    met = want.join(terms.select(F.col("term").cast("string").alias("term")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = want.join(met, "term", "left").select(F.lit("term").alias("part"), F.col("term").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    out = (found if out is None else out.unionByName(found)).withColumn("holds", F.col("n") > 0)
    concept, name, code = wanted
    value = values.where((F.col("concept") == concept) & (F.col("name") == name)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col("code").cast("string") == code, F.lit(False))), F.lit(False)).alias("holds"))
    return out.unionByName(value.select(F.lit("value").alias("part"), F.lit(f"{concept}:{name}").alias("name"), "n", "holds"))
