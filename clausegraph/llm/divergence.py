r"""Source divergence audit: how far the sources of a language use its words differently.

Plain relational work. Matches of the term pattern (texts split by all that stands between them) are exploded and counted by language, source and term,
together with the documents that hold them; a language keeps the terms of at least LEAST_DOCS of its
documents. Each group of a language and a source is crossed with the kept terms of its language, so that
zeros are there, and each row gets its smoothed share p of 10^9. The shares meet themselves by language
and term, and the differences are summed for each pair of sources (`pair`); and each group's terms that it
uses more than its language are ranked by the difference (`term`). All arithmetic is of whole numbers.

Scale. Counting has partial sums before the shuffle, so a language or source with a third of all rows is no
hot key. The table of groups is broadcast within BROADCAST_BYTES when it meets the terms; beyond that terms
are dealt to SALTS parts of their language, so that no language meets in one task. The shares are written
once; a (language, term) has one row for each source. The pairs asked for are every two sources of a
language, so their number is the contract's; each two are summed once and mirrored. Ranks beyond the most
that `term` reports are cut off in each task before the shuffle, as Spark does for a limit on a row number.

Defined cases: null text, lang and source count as ''; a text without a term still makes its group occur; a
language without a kept term has pairs of value 0 and no term rows; a language of one source has no pair;
repeated rows count each; ties rank by the item's UTF-8 bytes; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, ascii_lower, cut, load

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between terms: splitting by it gives the same matches, and empty pieces, in less time.
BETWEEN = TERM.replace("^", "")
LEAST_DOCS, MOST_TERMS, SHARE, WEIGHT = 30, 50, 1_000_000_000, 5
GROUP_BYTES, TERM_BYTES, SALTS = 200, 120, 64


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it)."""
    named = docs.select(*_named(docs), F.split(ascii_lower(F.col("text")), BETWEEN).alias("terms"))
    twice = named.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    each = twice.select("lang", "source", "kind", F.explode("terms").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("kind")).alias("n"), F.sum("kind").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * kept)), in decimals."""
    top = (F.lit(SHARE).cast("decimal(10,0)") * (n + WEIGHT).cast("decimal(20,0)")).alias("top")
    return F.call_function("div", top, (total + WEIGHT * kept).cast("decimal(20,0)")) + 1


def dense(groups: DataFrame, kept: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """groups (lang, source, ...) crossed with the kept terms (lang, term, ...) of their language."""
    if groups.count() * GROUP_BYTES <= most_bytes:
        return kept.join(F.broadcast(groups), "lang")
    dealt = kept.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["lang", "_salt"]).drop("_salt")


def shares(groups: DataFrame, counts: DataFrame, least_docs: int = LEAST_DOCS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each group (lang, source) and each kept term of its language, by term_counts' rows: lang, term, source, n, p and the language's q."""
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least_docs).drop("docs"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    own = kept.select("lang", "term")
    own = F.broadcast(own) if kept.count() * TERM_BYTES <= most_bytes else own
    found = cut(counts.drop("docs").join(own, ["lang", "term"], "left_semi"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = cut(groups.join(of_lang, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))))
    full = dense(sized, kept, most_bytes).join(found, ["lang", "term", "source"], "left")
    n = F.coalesce("n", F.lit(0))
    return cut(full.select("lang", "term", "source", n.alias("n"), share(n, F.col("total"), F.col("kept")).alias("p"), share(F.col("whole"), F.col("lang_total"), F.col("kept")).alias("q")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    groups = cut(docs.select(*_named(docs)).distinct())
    p = shares(groups, cut(term_counts(docs)), least_docs, most_bytes)
    other = p.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    sums = cut(p.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("r"))).alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    terms = p.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = [part.withColumn("rank", rank).select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for name, part in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1].where(F.col("rank") <= most_terms))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS kept, sum(whole) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + {SHARE}::HUGEINT * (coalesce(c.n, 0) + {WEIGHT}) // (n.total + {WEIGHT} * v.kept)::HUGEINT AS p,
         1 + {SHARE}::HUGEINT * (whole + {WEIGHT}) // (v.total + {WEIGHT} * v.kept)::HUGEINT AS q
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (FROM pair UNION ALL FROM term)
QUALIFY part = 'pair' OR rank <= {MOST_TERMS}
"""
