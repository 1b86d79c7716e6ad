"""Concepts that questions name: many names, written as schemas write them, found in prose.

A name's forms (as it is, its parts as words, its abbreviation spelled out) are cut into words, with and
without a plural s; so are the questions, into all runs of as many words as forms have. Runs meet forms by
equality, whatever the number of names, and what met is confirmed by the form's own pattern, so that signs
inside a name count and words that only share letters don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words that are no concept by themselves, the suffixes of names in capitals, the abbreviation that is spelled out, and the bounds of names and forms.
COMMON = ("cause", "operation", "status", "type", "event", "service", "name", "action", "result", "state", "mode", "direction", "priority", "category", "format", "method", "level", "class", "unit", "period", "condition", "indication", "notification", "report", "request", "response", "trigger", "reason", "source", "target", "value", "message", "parameter", "identity")
CAPITALS = r"^([A-Z]{2,})(TYPE|CODE|NAME|ID)$"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SPELLED = ("ie", "information element")
LEAST_NAME, LEAST_SPLIT, MOST_CONCEPTS = 3, 6, 3


def distinctive(name: Column) -> Column:
    """Whether a name may be looked for in prose: three characters or more, no common word, no single word that only begins with a capital."""
    return (F.length(name) >= LEAST_NAME) & ~F.lower(name).isin(*COMMON) & ~name.rlike("^[A-Z][a-z]+$")


def parts(name: Column) -> Column:
    """The words of a name: by its capitals, or in capitals alone by its suffix."""
    split = F.split(name, CAMEL)
    return F.when(F.size(split) > 1, split).when(name.rlike(CAPITALS), F.array(F.regexp_extract(name, CAPITALS, 1), F.regexp_extract(name, CAPITALS, 2))).otherwise(split)


def forms(name: Column) -> Column:
    """The forms of a name: arrays of words that stand in this order with white space between; the name itself is one word."""
    words = parts(name)
    spelled = F.transform(words, lambda w: F.when(F.lower(w) == SPELLED[0], SPELLED[1]).otherwise(w))
    several = F.when((F.size(words) >= 2) & (F.length(name) >= LEAST_SPLIT), F.array_distinct(F.array(words, spelled))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(F.array(F.array(name)), several)


def pattern(form: Column) -> Column:
    """The pattern of a form: its words quoted, white space between, a plural s, no letter or digit beside it."""
    quoted = F.transform(form, lambda w: F.regexp_replace(w, r"([^A-Za-z0-9\s])", r"\\$1"))
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.array_join(quoted, r"\s+"), F.lit("s?(?![A-Za-z0-9])"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def concepts_in(questions: DataFrame, concepts: DataFrame, most: int | None = MOST_CONCEPTS) -> DataFrame:
    """(qid, name, place): concepts (name) that questions (qid, question) name, the longest first, then by name; the first `most`.

    Case, white space between words and a plural s don't count. A name without a letter a-z or a digit is
    never found.
    """
    known = concepts.select("name").where(distinctive(F.col("name"))).distinct().select("name", F.explode(forms(F.col("name"))).alias("form"))
    said = F.array_join("form", " ")
    keyed = known.select("name", pattern(F.col("form")).alias("pattern"), F.explode(F.array(_words(said), _words(F.concat(said, F.lit("s"))))).alias("w")).where(F.size("w") > 0)
    keyed = keyed.select("name", "pattern", F.size("w").alias("n"), F.array_join("w", " ").alias("run")).distinct()
    lengths = [r["n"] for r in keyed.select("n").distinct().collect()]  # as many as names have different numbers of words
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    asked = questions.select("qid", "question", _words(F.col("question")).alias("w"))
    spread = asked.select("qid", "question", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(n) for n in sorted(lengths)]))).alias("run"))
    met = spread.join(keyed.drop("n"), "run").where(F.rlike("question", F.col("pattern"))).select("qid", "name").distinct()
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("name")), "name")))
    return placed if most is None else placed.where(F.col("place") <= most)
