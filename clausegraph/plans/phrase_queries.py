"""Queries of phrases and concepts that questions name, over the analogue of clauses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import concepts as X
from clausegraph.operators import phrases as P
from clausegraph.plans.graph import VIEWS, order_graph
from clausegraph.plans.registry import query, table

STOP = ", ".join(f"'{w}'" for w in P.PHRASE_STOP)
GENERIC = ", ".join(f"'{w}'" for w in P.TREE_GENERIC)
#: Titles of the analogue's clauses that tell subjects apart, and questions that name some of them.
TITLED = "SELECT chunk_id, spec_id, section_id, content, p_name || ' control of Area-' || chunk_id % 61 || '/' || spec_id AS title FROM chunks JOIN part ON p_partkey = chunk_id % (SELECT count(*) FROM part)"
ASKED = "SELECT p_partkey AS qid, 'How must the ' || p_name || ' Control of area-' || p_partkey % 61 || '/' || p_partkey % 25 || ' be set up for a normal operation, and what does it do in general aspects?' AS question, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 25 END AS spec FROM part"
SAID = f"""
, titled AS ({TITLED}), asked AS ({ASKED}),
words AS (SELECT qid, regexp_extract_all(lower(question), '{P.PHRASE_WORD}') AS w FROM asked),
runs AS (SELECT qid, n, i, w[i:i + n - 1] AS g FROM words, unnest([6, 5, 4, 3, 2]) AS s(n), generate_series(1, len(w) - n + 1) AS t(i)),
said AS (SELECT qid, n, i, array_to_string(g, ' ') AS phrase FROM runs WHERE g[1] NOT IN ({STOP}) AND g[-1] NOT IN ({STOP}) AND array_to_string(g, ' ') NOT IN ({GENERIC})
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, i) <= {P.MOST_PHRASES})
"""
HEADS = f"""
, sections AS (SELECT spec_id, section_id, max(chunk_id) AS chunk_id FROM chunks GROUP BY ALL),
near AS (SELECT s.chunk_id AS child, arg_max(p.chunk_id, length(p.section_id)) AS parent FROM sections s JOIN sections p ON s.spec_id = p.spec_id AND starts_with(s.section_id, p.section_id || '.') GROUP BY ALL),
heads AS (SELECT parent AS chunk_id, count(*) AS n_kids FROM near JOIN chunks c ON c.chunk_id = child WHERE contains(lower(content), 'shall') GROUP BY parent HAVING count(*) >= {P.LEAST_CHILDREN})
"""


def _titled(spark, d):
    parts = table(spark, d, "part")
    n = parts.count()
    chunks = order_graph(spark, d).chunks.drop("title")
    named = chunks.join(parts.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("chunk_id") % n)
    title = F.concat("p_name", F.lit(" control of Area-"), (F.col("chunk_id") % 61).cast("string"), F.lit("/"), F.col("spec_id").cast("string"))
    return named.withColumn("title", title).select("chunk_id", "spec_id", "section_id", "content", "title")


def _asked(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("How must the "), "p_name", F.lit(" Control of area-"), (k % 61).cast("string"), F.lit("/"), (k % 25).cast("string"), F.lit(" be set up for a normal operation, and what does it do in general aspects?"))
    return table(spark, d, "part").select(k.alias("qid"), text.alias("question"), F.when(k % 3 == 0, k % 25).alias("spec"))


@query("j25_phrases", VIEWS + SAID + "SELECT DISTINCT qid, phrase FROM said")
def phrases(spark, d):
    """The phrases of questions about parts."""
    return _asked(spark, d).select("qid", F.explode(F.array_distinct(P.phrases(F.col("question")))).alias("phrase"))


@query(
    "j25_phrase_trees",
    VIEWS + SAID + HEADS + f""", met AS (SELECT DISTINCT said.qid, phrase, t.chunk_id, t.spec_id, title, n_kids FROM said JOIN asked USING (qid) JOIN titled t ON contains(lower(title), phrase) AND (spec IS NULL OR spec = t.spec_id) JOIN heads USING (chunk_id)),
few AS (SELECT * FROM met QUALIFY count(*) OVER (PARTITION BY qid, phrase) <= {P.MOST_PARENTS}),
top AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n_kids DESC, length(phrase) DESC, phrase, chunk_id) <= {P.MOST_ROWS})
SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(phrase) DESC, n_kids DESC, phrase, chunk_id) = 1""",
)
def phrase_trees(spark, d):
    """The clause trees that questions about parts name; a third of them pin a specification."""
    asked = _asked(spark, d)
    return P.tree_phrases(asked, _titled(spark, d), asked.where("spec is not null").select("qid", F.col("spec").alias("spec_id")))


COMMON = ", ".join(f"'{w}'" for w in X.COMMON)
CONCEPTS = f"""
WITH w AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
named AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] WHEN 1 THEN p_name WHEN 2 THEN upper(a[1]) || a[2:] || 'IeType' WHEN 3 THEN upper(a) || 'TYPE' WHEN 4 THEN upper(b[1]) || b[2:] WHEN 5 THEN b || '-' || p_partkey % 9 ELSE 'status' END AS name FROM w),
asked AS (SELECT p_partkey AS qid, 'Which ' || CASE p_partkey % 5 WHEN 0 THEN p_name || 's and ' || b || '-' || p_partkey % 9 WHEN 1 THEN a || '  information element types of ' || upper(a) || 'TYPE' WHEN 2 THEN a || ' types with ' || b || '-' || p_partkey % 9 || '9' WHEN 3 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] || ', ' || a || ' IE type' ELSE a || 's ' || b || ' ' || p_partkey % 9 END || ' have a status, ' || b || '?' AS question FROM w),
spaced AS (SELECT DISTINCT name, CASE WHEN regexp_matches(name, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]') THEN regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') ELSE regexp_replace(name, '{X.CAPITALS}', '\\1 \\2') END AS words FROM named WHERE length(name) >= 3 AND lower(name) NOT IN ({COMMON}) AND NOT regexp_full_match(name, '[A-Z][a-z]+')),
forms AS (SELECT name, name AS form FROM spaced UNION SELECT name, regexp_replace(words, ' ', '\\\\s+', 'g') FROM spaced WHERE words <> name AND length(name) >= 6 UNION SELECT name, regexp_replace(regexp_replace(words, '\\bIe\\b', 'information element', 'g'), ' ', '\\\\s+', 'g') FROM spaced WHERE words <> name AND length(name) >= 6),
met AS (SELECT DISTINCT qid, name FROM asked JOIN forms ON regexp_matches(question, '(?i)(^|[^A-Za-z0-9])' || form || 's?($|[^A-Za-z0-9])'))
SELECT qid, name, place FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY length(name) DESC, name))::INT AS place FROM met) WHERE place <= {X.MOST_CONCEPTS}
"""


@query("r33_concepts", CONCEPTS)
def concepts(spark, d):
    """Concepts named as schemas write them, in questions that write some of them as words."""
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(k, "p_name", F.substring_index("p_name", " ", 1).alias("a"), F.element_at(F.split("p_name", " "), 2).alias("b"))
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.expr(f"substring({c}, 2)"))
    camel, digit = F.concat(capital("a"), capital("b")), (k % 9).cast("string")
    name = F.when(k % 7 == 0, camel).when(k % 7 == 1, F.col("p_name")).when(k % 7 == 2, F.concat(capital("a"), F.lit("IeType"))).when(k % 7 == 3, F.concat(F.upper("a"), F.lit("TYPE"))).when(k % 7 == 4, capital("b")).when(k % 7 == 5, F.concat("b", F.lit("-"), digit)).otherwise("status")
    said = F.when(k % 5 == 0, F.concat("p_name", F.lit("s and "), "b", F.lit("-"), digit)).when(k % 5 == 1, F.concat("a", F.lit("  information element types of "), F.upper("a"), F.lit("TYPE"))).when(k % 5 == 2, F.concat("a", F.lit(" types with "), "b", F.lit("-"), digit, F.lit("9"))).when(k % 5 == 3, F.concat(camel, F.lit(", "), "a", F.lit(" IE type"))).otherwise(F.concat("a", F.lit("s "), "b", F.lit(" "), digit))
    question = F.concat(F.lit("Which "), said, F.lit(" have a status, "), "b", F.lit("?"))
    return X.concepts_in(w.select(k.alias("qid"), question.alias("question")), w.select(name.alias("name")))
