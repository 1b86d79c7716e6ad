"""Clause texts cut to segments: tables located in a text, and contexts packed from the segments that matter."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as T

TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
SEGMENTS = "array<struct<kind:string,start:int,stop:int,text:string,headers:array<string>,rows:array<array<string>>,truncated:boolean>>"
# What stands for text that was left out, and between the clauses of a context.
ELLIPSIS, GAP, RULE = "…", "\n[…]\n", "\n\n---\n\n"


def squeeze(text: str) -> str:
    return "".join(text.split())


class Places:
    """A text without its white space, and where its characters stand in the text: by the words' starts in both, not by a list of characters."""

    def __init__(self, text: str):
        words, at = text.split(), 0
        self.starts = []
        for w in words:
            at = text.index(w, at)
            self.starts.append(at)
            at += len(w)
        self.flat = "".join(words)
        self.flat_starts = [0, *accumulate(map(len, words))][: len(words)]

    def of(self, i: int) -> int:
        """The place in the text of the i-th character that isn't white space."""
        w = bisect_right(self.flat_starts, i) - 1
        return self.starts[w] + i - self.flat_starts[w]


def table_place(flat: str, after: int, headers: list[str], rows: list[list[str]]) -> tuple[int, int, int] | None:
    """Start, length and complete rows of a table in a text without white space: the whole table, else its head and as many first rows as stand there, one at least."""
    pieces = [squeeze("".join(c or "" for c in line)) for line in (headers, *rows)]
    whole = "".join(pieces)
    if not whole:
        return None
    at = flat.find(whole, after)
    if at >= 0:
        return at, len(whole), len(rows)
    least = "".join(pieces[:2])
    if not rows or not least or (at := flat.find(least, after)) < 0:
        return None
    size, n = len(least), 1
    for piece in pieces[2:]:
        if not flat.startswith(piece, at + size):
            break
        size, n = size + len(piece), n + 1
    return at, size, n


def located(text: str, tables: list[dict]) -> Iterator[dict]:
    """The segments of a text: its tables where they stand, one after the other, and the text between."""
    places, after, done = Places(text), 0, 0
    said = lambda a, b: {"kind": "text", "start": a, "stop": b, "text": text[a:b], "headers": None, "rows": None, "truncated": False}
    for table in tables:
        headers, rows = list(table["headers"] if table["headers"] is not None else []), [list(r) if r is not None else [] for r in (table["rows"] if table["rows"] is not None else [])]
        found = table_place(places.flat, after, headers, rows)
        if found is None:
            continue
        at, size, n = found
        start, stop = places.of(at), places.of(at + size - 1) + 1
        if start > done:
            yield said(done, start)
        yield {"kind": "table", "start": start, "stop": stop, "text": None, "headers": headers, "rows": rows[:n], "truncated": n < len(rows)}
        after, done = at + size, stop
    if done < len(text) or len(tables) == 0:
        yield said(done, len(text))


def _segments(texts: pd.Series, tables: pd.Series) -> pd.Series:
    return pd.Series([list(located(x or "", t if t is not None else [])) for x, t in zip(texts, tables, strict=True)], dtype=object)


def table_segments(content: Column, tables: Column) -> Column:
    """The segments of a clause, by its tables in their order, with places (from 0, stop exclusive): kind text or table.

    White space counts nowhere. A table that is cut off in the text is `truncated` to the rows that are
    complete; one of which not even the head and a row stand there has no segment. A null text is empty; a
    clause without tables is one text, if empty too; null cells are empty.
    """
    return F.pandas_udf(_segments, SEGMENTS)(content, tables.cast(TABLES))


def fit(content: Column, scored: Column, budget: int) -> Column:
    """At most about `budget` characters of a content: the whole if it fits, else the segments of scored (array of struct(score, text)) by their scores, those that still fit, in the order of the text.

    Ties go to the earlier segment. Of a single segment, or if none fits, the beginning of the best.
    """
    start_of = lambda c: F.concat(F.regexp_replace(F.substring(c, 1, budget), r"\s+$", ""), F.lit(ELLIPSIS))
    order = F.array_sort(F.transform(scored, lambda x, i: F.struct((-x["score"]).cast("double").alias("s"), i.alias("i"), (F.length(x["text"]) + 1).alias("n"))))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    take = lambda a, x: F.when(a["used"] + x["n"] <= budget, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["i"])).alias("kept"))).otherwise(a)
    kept = F.aggregate(order, none, take, lambda a: a["kept"])
    joined = F.array_join(F.transform(F.filter(scored, lambda x, i: F.array_contains(kept, i)), lambda x: x["text"]), GAP)
    best = F.element_at(scored, F.element_at(order, 1)["i"] + 1)["text"]
    return F.when(F.length(content) <= budget, content).when(F.size(scored) < 2, start_of(content)).when(F.size(kept) == 0, start_of(best)).otherwise(joined)


def scored_segments(question: Column, content: Column, score: Callable[[Column, Column], Column]) -> Column:
    """array of struct(score, text) of a content's segments."""
    return F.transform(T.segments(content), lambda s: F.struct(score(question, s).cast("double").alias("score"), s.alias("text")))


def packed(rows: DataFrame, score: Callable[[Column, Column], Column], total: int = 20_000, a_chunk: int = 4_000, provenance: bool = True) -> DataFrame:
    """(qid, context, used): the clauses of each question in one text, and which they are.

    rows: qid, question, doc, rank, spec_id, section_id, content, and evidence if a clause has a text of its
    own that stands for its content as it is. A clause gives at most a_chunk characters, chosen by its
    segments' scores for the question; one that would exceed the total is skipped, and later ones may still
    fit. With provenance each begins with its specification and section.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    cut = fit(content, F.col("_scored"), a_chunk)
    own = F.coalesce(F.nullif(F.col("evidence"), F.lit("")), cut) if "evidence" in rows.columns else cut
    head = F.concat(F.lit("["), F.coalesce(F.col("spec_id").cast("string"), F.lit("?")), F.lit(" §"), F.coalesce(F.col("section_id").cast("string"), F.lit("?")), F.lit("]\n"))
    scored = F.when(F.length(content) > a_chunk, scored_segments(F.col("question"), content, score))
    blocks = rows.withColumn("_scored", scored).select("qid", F.struct("rank", "doc", (F.concat(head, own) if provenance else own).alias("block")).alias("x"))
    kinds = dict(rows.dtypes)
    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("blocks"), F.array().cast(f"array<{kinds['doc']}>").alias("used"))

    def add(a: Column, x: Column) -> Column:
        size = a["size"] + F.length(x["block"])
        return F.when(size <= total, F.struct(size.alias("size"), F.concat(a["blocks"], F.array(x["block"])).alias("blocks"), F.concat(a["used"], F.array(x["doc"])).alias("used"))).otherwise(a)

    folded = blocks.groupBy("qid").agg(F.aggregate(F.array_sort(F.collect_list("x")), start, add).alias("a"))
    return folded.select("qid", F.array_join("a.blocks", RULE).alias("context"), F.col("a.used").alias("used"))
