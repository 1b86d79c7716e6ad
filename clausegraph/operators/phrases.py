"""Phrases of questions that name the head of a clause tree, by an inverted index of title n-grams.

A phrase may stand anywhere in a title, also inside words, so the index is of grams of GRAM characters of
titles that have a space in them, and of the shorter phrases' own lengths. Each phrase asks for the rarest of its grams alone and
is then compared with the titles that have it; so a frequent gram ("procedure") is read only by phrases
that consist of nothing rarer. Only titles that may head a tree are in the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.lineage import cut, spread
from clausegraph.operators import hierarchy as H

# Words that no phrase begins or ends with, titles that name no subject, lengths of phrases in words and their number, and the bounds of a tree.
PHRASE_STOP = ("the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "at", "is", "are", "what", "which", "does", "do", "how", "we", "our", "it", "that", "this", "with", "from", "by", "as", "when", "must", "shall")
TREE_GENERIC = ("general", "description", "introduction", "scope", "overview", "definitions", "abbreviations", "requirements", "general requirements", "security", "charging", "activation", "deactivation", "registration", "invocation", "interrogation", "provision", "normal operation", "procedures", "security requirements", "high level requirements", "general aspects")
PHRASE_WORD = r"[A-Za-z0-9][A-Za-z0-9/_-]*"
LENGTHS, MOST_PHRASES = (6, 5, 4, 3, 2), 40
LEAST_CHILDREN, MOST_PARENTS, MOST_ROWS = 3, 4, 3
GRAM = 5
#: Most grams of titles that are broadcast, of GRAM characters at most.
MOST_GRAMS = 500_000


def phrases(question: Column) -> Column:
    """The phrases of a question, the longest first, from left to right: runs of two to six words that neither begin nor end with a stop word and are no generic title; the first 40."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(PHRASE_WORD), 0)
    cut_up = F.struct(words.alias("w"), F.transform(words, lambda w: ~w.isin(*PHRASE_STOP)).alias("ends"))
    return F.transform(F.array(cut_up), _phrases)[0]  # variables here: the words are cut and looked up once, not for each run


def _phrases(cut_up: Column) -> Column:
    words, ends = cut_up["w"], cut_up["ends"]

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(starts, lambda i: F.element_at(ends, i) & F.element_at(ends, i + n - 1))
        return F.transform(kept, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.slice(F.filter(F.concat(*[runs(n) for n in LENGTHS]), lambda p: ~p.isin(*TREE_GENERIC)), 1, MOST_PHRASES)


def heads(chunks: DataFrame, least: int = LEAST_CHILDREN) -> DataFrame:
    """(chunk_id, spec_id, title, n_kids): clauses with at least that many children, by the nearest section above, whose text says 'shall'."""
    saying = chunks.where(F.contains(F.lower("content"), F.lit("shall"))).select(F.col("chunk_id").alias("child"))
    kids = H.nearest_ancestors(chunks).join(saying, "child").groupBy(F.col("parent").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_kids")).where(F.col("n_kids") >= least)
    return chunks.select("chunk_id", "spec_id", "title").join(kids, "chunk_id")


def _grams(text: Column, size: Column) -> Column:
    """The distinct grams of a text of one size; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def contained(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(phrase, chunk_id): the lower-cased titles (chunk_id, title) in which each phrase of asked (phrase) stands."""
    own = asked.select("phrase").distinct().withColumn("size", F.least(F.length("phrase"), F.lit(GRAM)))
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # one to GRAM
    named = titles.select("chunk_id", F.lower("title").alias("t"))
    index = named.select("chunk_id", "t", F.explode(F.concat(F.array().cast("array<string>"), *[_grams(F.col("t"), F.lit(s)) for s in sizes])).alias("gram"))
    wanted = own.select("phrase", F.explode(_grams(F.col("phrase"), F.col("size"))).alias("gram"))
    held = index.join(wanted.select("gram").distinct(), "gram", "left_semi")
    times = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(times, "gram", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0").select("phrase", F.col("r.gram").alias("gram"))
    return rarest.join(held, "gram").where(F.contains("t", F.col("phrase"))).select("phrase", "chunk_id")


def likely(said: DataFrame, titles: DataFrame) -> DataFrame:
    """(phrase): the distinct phrases of said (phrase) whose first and last grams both stand in some title (chunk_id, title).

    For many phrases and few titles: others drop out where they are made, as the titles' grams go to the phrases if they are counted few.
    """
    size, text = F.least(F.length("phrase"), F.lit(GRAM)), F.lower("title")
    there = cut(titles.select(F.explode(F.concat(*[_grams(text, F.lit(s)) for s in range(1, GRAM + 1)])).alias("gram")).distinct())
    grams = F.broadcast(there) if there.count() <= MOST_GRAMS else there
    first, last = F.substring(F.col("phrase"), F.lit(1), size), F.substring(F.col("phrase"), F.length("phrase") - size + 1, size)
    begun = said.select("phrase", last.alias("last"), first.alias("gram")).join(grams, "gram", "left_semi")
    return begun.select("phrase", F.col("last").alias("gram")).join(grams, "gram", "left_semi").select("phrase").distinct()


def tree_phrases(questions: DataFrame, chunks: DataFrame, specs: DataFrame | None = None, most_parents: int = MOST_PARENTS) -> DataFrame:
    """(qid, phrase, chunk_id, spec_id, title, n_kids): for each question the clause tree that it names, if any.

    A phrase counts if at most four heads have it, of the question's specifications (specs: qid, spec_id)
    where it has any. Of a question's three rows with the most children the longest phrase leads, then the
    most children, then the id. Heads are counted for each phrase, and for each phrase and specification,
    before they meet questions: what has too many of them for any question meets none.
    """
    roots = cut(heads(chunks))
    asked = spread(questions, "qid")
    every = F.lit(None).cast(dict(roots.dtypes)["spec_id"])
    pins = F.array(every)
    if specs is not None:
        asked = asked.join(specs.groupBy("qid").agg(F.collect_set(F.col("spec_id").cast(dict(roots.dtypes)["spec_id"])).alias("_pins")), "qid", "left")
        pins = F.coalesce("_pins", pins)
    said = asked.select("qid", pins.alias("_pins"), F.explode(F.array_distinct(phrases(F.col("question")))).alias("phrase"))
    found = cut(contained(cut(likely(said, roots)), roots).join(roots, "chunk_id"))
    few = lambda rows, *keys: rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("n") <= most_parents).drop("n")
    kept = few(found, "phrase").withColumn("pin", every)
    if specs is not None:
        kept = kept.unionByName(few(found.where("spec_id is not null"), "phrase", "spec_id").withColumn("pin", F.col("spec_id")))
    met = said.select("qid", "phrase", F.explode("_pins").alias("own")).withColumnRenamed("phrase", "says")
    rows = met.join(kept, (F.col("says") == F.col("phrase")) & F.col("own").eqNullSafe(F.col("pin"))).drop("says", "own", "pin")
    rows = few(rows, "qid", "phrase")
    richest = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n_kids"), F.desc(F.length("phrase")), "phrase", "chunk_id"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("phrase")), F.desc("n_kids"), "phrase", "chunk_id"))
    top = rows.withColumn("k", richest).where(F.col("k") <= MOST_ROWS)
    return top.withColumn("k", best).where("k = 1").select("qid", "phrase", "chunk_id", "spec_id", "title", "n_kids")
