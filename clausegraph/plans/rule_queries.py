"""Queries of rule cascades, with SQL made from the same word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import extract as X
from clausegraph.operators import questions as Q
from clausegraph.plans.registry import query, table


def _count(words: tuple[str, ...], *names: str) -> str:
    return "(" + " + ".join("(" + " OR ".join(f"contains({n}, '{w}')" for n in names) + ")::INT" for w in words) + ")"


def _any(words: tuple[str, ...], *names: str) -> str:
    return "(" + " OR ".join(f"contains({n}, '{w}')" for w in words for n in names) + ")"


# Titles that an order stands for, so that every rule has its rows.
TITLES = ("General", "Registration procedure", "Impacts on services and interfaces", "Overview of the architecture", "Abbreviations", "Paging policy", "Terminology", "A survey of trends", "Theorem and proof", "x")
QUESTIONS = ("What is a slice", "How does the AMF register", "How to compare x versus y", "Which clause of TS 23.501", "How do the nodes interact over the interface", "hello", "What are the steps of the process", "registration of a device")
TITLE_SQL = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
QUESTION_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUESTIONS)) + " END"
SPEC_SQL = "CASE o_custkey % 4 WHEN 0 THEN 'ts_23_501' WHEN 1 THEN 'ts_23_700-x' WHEN 2 THEN 'other' ELSE 'ts_38_331' END"
KIND_SQL = "CASE o_orderkey % 7 WHEN 0 THEN 'definition' ELSE 'general' END"


def _pick(values: tuple[str, ...], column: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _orders(spark, d):
    spec = F.element_at(F.array(*map(F.lit, ("ts_23_501", "ts_23_700-x", "other", "ts_38_331"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", _pick(TITLES, "o_orderkey").alias("title"), _pick(QUESTIONS, "o_orderkey").alias("q"), spec.alias("spec"), F.when(F.col("o_orderkey") % 7 == 0, "definition").otherwise("general").alias("kind"), F.concat(F.lit("the "), F.lower("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, " message timer").otherwise(" text")).alias("content"))


@query("t6_subjects", f"""WITH o AS (SELECT o_orderkey, {KIND_SQL} AS kind, lower({TITLE_SQL}) AS title, {SPEC_SQL} AS spec, 'the ' || lower(o_orderpriority) || CASE WHEN o_orderkey % 3 = 0 THEN ' message timer' ELSE ' text' END AS content FROM orders),
s AS (SELECT *, {_count(X.SPECIFICATION_WORDS, "title", "content")} AS sp, {_count(X.OVERVIEW_WORDS, "title")} AS ov, {_count(X.PUBLICATION_WORDS, "content")} AS re FROM o)
SELECT o_orderkey, CASE WHEN kind = 'definition' THEN 'Lexicon' WHEN {_any(X.LEXICON_WORDS, "title")} THEN 'Lexicon' WHEN sp >= 2 OR {_any(("procedure", "ie ", "message"), "title")} THEN 'Standards specifications' WHEN ov >= 1 THEN 'Standards overview' WHEN re >= 2 THEN 'Research publications'
 WHEN {_any(X.SURVEY_WORDS, "title", "content")} THEN 'Research overview' WHEN starts_with(spec, 'ts_') THEN 'Standards specifications' ELSE 'Research overview' END AS name,
 round(CASE WHEN kind = 'definition' THEN 0.95 WHEN {_any(X.LEXICON_WORDS, "title")} THEN 0.9 WHEN sp >= 2 OR {_any(("procedure", "ie ", "message"), "title")} THEN least(0.95, 0.7 + sp * 0.05) WHEN ov >= 1 THEN 0.7 + ov * 0.1 WHEN re >= 2 THEN least(0.9, 0.6 + re * 0.1) WHEN {_any(X.SURVEY_WORDS, "title", "content")} THEN 0.7 WHEN starts_with(spec, 'ts_') THEN 0.6 ELSE 0.5 END, 6)::DOUBLE AS confidence FROM s""")
def subjects(spark, d):
    return _orders(spark, d).select("o_orderkey", X.subject(F.col("kind"), F.col("title"), F.col("content"), F.col("spec")).alias("s")).select("o_orderkey", "s.name", "s.confidence")


def _intent_sql() -> str:
    b = lambda p: p.replace("'", "''")
    counts = {k: "(" + " + ".join(f"regexp_matches(q, '{b(p)}')::INT" for p in ps) + ")" for k, ps in Q.INTENTS.items()}
    names = "|".join(Q.FUNCTION_NAMES)
    cases = " ".join(f"WHEN {n} = most THEN '{k}'" for k, n in counts.items())
    return f"WITH o AS (SELECT o_orderkey, lower({QUESTION_SQL}) AS q FROM orders), c AS (SELECT *, greatest({', '.join(counts.values())}) AS most FROM o), i AS (SELECT o_orderkey, CASE WHEN regexp_matches(q, '\\b({names})\\b') THEN 'network_function' WHEN most = 0 THEN 'general' {cases} END AS intent FROM c)"


@query("r26_intents", _intent_sql() + " SELECT o_orderkey, intent FROM i")
def intents(spark, d):
    return _orders(spark, d).select("o_orderkey", Q.intent(F.col("q")).alias("intent"))


KIND_OF = "CASE " + " ".join(f"WHEN intent IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in Q.KINDS.items()) + " ELSE 'WHAT_DEF' END"


@query("r32_patterns", _intent_sql() + f""", k AS (SELECT o_orderkey, {KIND_OF} AS wh, o_orderkey % 3 AS n, o_orderkey % 5 = 0 AS spec, CASE WHEN o_orderkey % 11 = 0 THEN 'm' END AS msg, CASE WHEN o_orderkey % 13 = 0 THEN 'p' END AS par, CASE WHEN o_orderkey % 2 = 0 THEN 'N2' END AS face FROM i)
SELECT o_orderkey, CASE WHEN msg IS NOT NULL THEN 'M' WHEN par IS NOT NULL THEN 'P' WHEN wh = 'WHERE_LOC' AND spec THEN 'E' WHEN wh = 'WHERE_LOC' AND face IS NOT NULL THEN 'B'
 WHEN n >= 2 THEN CASE WHEN wh IN ('HOW_PROC', 'WHO_ENTITY') THEN 'FG' ELSE 'A2' END WHEN n = 1 THEN CASE WHEN wh = 'WHAT_DEF' THEN 'FUNC' ELSE 'A1' END WHEN wh IN ('WHAT_DEF', 'HOW_PROC', 'WHY_COND') AND face IS NOT NULL THEN 'B' ELSE 'C' END AS pattern FROM k""")
def patterns(spark, d):
    k = F.col("o_orderkey")
    return intents(spark, d).select("o_orderkey", Q.pattern(Q.kind(F.col("intent")), k % 3, k % 5 == 0, F.when(k % 11 == 0, "m"), F.when(k % 13 == 0, "p"), F.when(k % 2 == 0, "N2")).alias("pattern"))


BIAS_SQL = f"""WITH o AS (SELECT o_orderkey, lower({QUESTION_SQL}) AS q, lower({TITLE_SQL}) AS t, {SPEC_SQL} AS spec, {KIND_SQL} AS kind, o_orderkey % 4 = 0 AS st, o_orderkey % 6 AS hits, o_orderkey % 9 = 0 AS op, o_orderkey % 12 = 0 AS an, o_orderkey % 5 = 0 AS ch FROM orders),
f AS (SELECT *, ({" OR ".join(f"(contains(q, '{p}') AND contains(t, '{p}'))" for p in Q.PROCEDURES)}) AS own, {_any(Q.PROCEDURES, "q")} AS asked, ({" OR ".join(f"(NOT contains(q, '{p}') AND contains(t, '{p}'))" for p in Q.PROCEDURES)}) AS other FROM o)
SELECT o_orderkey, round(greatest(-1, least(1, CASE WHEN spec = 'ts_23_700-x' AND NOT {_any(Q.STUDY_WORDS, "q")} THEN -0.6 ELSE 0 END + CASE WHEN contains(t, 'impacts on services') THEN -0.7 ELSE 0 END + CASE WHEN st THEN 0.7 + least(0.36, greatest(0, hits - 1) * 0.12) ELSE 0 END + CASE WHEN op THEN 0.4 ELSE 0 END + CASE WHEN an THEN 0.7 ELSE 0 END + CASE WHEN ch THEN 0.5 ELSE 0 END
 + CASE WHEN own THEN 0.5 WHEN asked AND other AND NOT ch THEN -0.3 ELSE 0 END + CASE WHEN NOT st AND NOT op AND (kind = 'definition' OR t IN ({", ".join(repr(x) for x in Q.GENERAL_TITLES)})) AND NOT own THEN -0.25 ELSE 0 END)), 6)::DOUBLE AS bias FROM f"""


@query("r19_bias", BIAS_SQL)
def bias(spark, d):
    k = F.col("o_orderkey")
    b = Q.bias(F.col("q"), F.col("title"), F.col("spec"), F.col("kind"), k % 4 == 0, (k % 6).cast("int"), k % 9 == 0, k % 12 == 0, k % 5 == 0)
    return _orders(spark, d).select("o_orderkey", F.round(b, 6).alias("bias"))


@query("p2_annexes", "SELECT page_id, chr((65 + page_id % 26)::INT) AS id, CASE WHEN page_id % 3 = 1 THEN 'Annex ' || chr((65 + page_id % 26)::INT) ELSE split_part(url, '/', 3) END AS title FROM pages WHERE page_id % 3 < 2")
def annexes(spark, d):
    letter = F.chr(F.col("page_id") % 26 + 65)
    k, host = F.col("page_id") % 3, F.split_part("url", F.lit("/"), F.lit(3))
    line = F.when(k == 0, F.concat(F.lit("Annex "), letter, F.lit(" (normative): "), host)).when(k == 1, F.concat(F.lit("Annex "), letter, F.lit(":"))).otherwise(F.concat(F.lit("Annex "), letter, F.lit(": "), host, F.lit("\t12")))
    return table(spark, d, "pages").select("page_id", T.annex(line).alias("a")).where("a is not null").select("page_id", "a.id", "a.title")


@query("t2_valid_abbreviations", "SELECT p_partkey, a, length(a) >= 2 AND regexp_matches(a, '^[A-Z0-9]') AND length(regexp_replace(a, '[^A-Z0-9/-]', '', 'g')) >= length(a) * 0.6 AS valid FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(left(p_name, 3)) WHEN 1 THEN left(p_name, 4) WHEN 2 THEN p_brand WHEN 3 THEN upper(left(p_name, 1)) || left(p_brand, 5) ELSE upper(left(p_name, 1)) END AS a FROM part)")
def valid_abbreviations(spark, d):
    k = F.col("p_partkey") % 5
    a = F.when(k == 0, F.upper(F.substring("p_name", 1, 3))).when(k == 1, F.substring("p_name", 1, 4)).when(k == 2, F.col("p_brand")).when(k == 3, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_brand", 1, 5))).otherwise(F.upper(F.substring("p_name", 1, 1)))
    return table(spark, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", "a", X.valid_abbreviation(F.col("a")).alias("valid"))


STEPS = "WITH c AS (SELECT l_orderkey AS chunk_id, list(l_linenumber ORDER BY l_linenumber) AS ls, count(*) AS n FROM lineitem GROUP BY l_orderkey) "


@query("t13_steps", STEPS + "SELECT CAST(chunk_id AS VARCHAR) || '::' || CAST(unnest(ls) AS VARCHAR) AS step_id FROM c WHERE n >= 3 AND (chunk_id % 2 = 0 OR (chunk_id % 3 = 0 AND ls[1] IN (0, 1) AND list_sum(list_transform(range(1, len(ls)), lambda i: (ls[i + 1] IN (ls[i], ls[i] + 1))::INT)) >= 0.7 * (len(ls) - 1)))")
def steps(spark, d):
    """An order's lines, numbered as steps; even orders are typed procedures, and every third says that a flow follows."""
    said = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit(".\t"), F.col("l_returnflag")).alias("s"))))
    chunks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("chunk_id")).agg(F.array_join(F.transform(said, lambda x: x["s"]), "\n").alias("content"))
    k = F.col("chunk_id").cast("long")
    chunks = chunks.select("chunk_id", F.when(k % 3 == 0, "Call flow").otherwise("x").alias("title"), "content", F.when(k % 2 == 0, "procedure").otherwise("general").alias("chunk_type"))
    return X.steps(chunks).select("step_id")


@query("r37_abstentions", "SELECT conv_id, turn, contains(lower(text), 'the') AND NOT regexp_matches(text, '\\[[0-9]+\\]') AND turn % 2 = 1 OR turn % 3 = 0 AS abstains FROM conversations")
def abstentions(spark, d):
    said = F.when((F.col("turn") % 2 == 1) & F.lower("text").contains("the"), F.concat(F.col("text"), F.lit(" Context does not cover"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", Q.abstains(F.col("turn") % 3, said).alias("abstains"))


@query("t5_merged_terms", """WITH r AS (SELECT p_brand AS term, p_type AS full_name, p_partkey AS seq, p_size FROM part), s AS (SELECT *, p_size % 4 = 0 AS fine FROM r)
SELECT term, count(*) AS n, count(DISTINCT p_size % 4) AS specs FROM s GROUP BY term""")
def merged_terms(spark, d):
    """Terms merged from all parts; the fold itself is held against plain Python in the tests."""
    spec = F.element_at(F.array(*map(F.lit, ("ts_23_501", "ts_1", "ts_29_510", "ts_2"))), (F.col("p_size") % 4 + 1).cast("int"))
    found = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("term"), F.col("p_type").alias("full_name"), spec.alias("spec_id"), F.lit("abbreviation").alias("term_type"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return X.merge_terms(found).join(counts, "term").select("term", "n", F.size("source_specs").cast("long").alias("specs"))
