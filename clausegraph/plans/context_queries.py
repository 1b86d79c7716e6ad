"""Queries of located segments and packed contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import contexts as C
from clausegraph.plans.registry import query, table
from clausegraph.plans.text_queries import BM25, WORDS, bm25

TABLE_SQL = """
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, 'Part ' || p_partkey || ' has:' || chr(10) AS intro, 'Name' || chr(9) || 'Size  of it' || chr(10) || p_name || chr(9) || 'a b' AS one, chr(10) || p_name || ' too' || chr(9) || '10 mm' AS two, p_name FROM part),
s AS (
  SELECT *, 0 AS pos, 'text' AS kind, 0 AS start, length(intro) - CASE WHEN k = 2 THEN 1 ELSE 0 END AS stop, 0 AS n FROM t WHERE k <> 3
  UNION ALL SELECT *, 1, 'table', length(intro), length(intro || one || two), 2 FROM t WHERE k = 0
  UNION ALL SELECT *, 2, 'text', length(intro || one || two), length(intro || one || two) + 5, 0 FROM t WHERE k = 0
  UNION ALL SELECT *, 1, 'table', length(intro), length(intro || one), 1 FROM t WHERE k = 1
  UNION ALL SELECT *, 2, 'text', length(intro || one), length(intro || one) + 3, 0 FROM t WHERE k = 1
  UNION ALL SELECT *, 0, 'table', 0, length(one || two), 2 FROM t WHERE k = 3
  UNION ALL SELECT *, 1, 'text', length(one || two), length(one || two) + 1, 0 FROM t WHERE k = 3
  UNION ALL SELECT *, 2, 'table', length(one || two) + 1, 2 * length(one || two) + 1, 2 FROM t WHERE k = 3),
c AS (SELECT *, CASE k WHEN 0 THEN intro || one || two || chr(10) || 'end.' WHEN 1 THEN intro || one || left(two, 3) WHEN 2 THEN rtrim(intro, chr(10)) ELSE one || two || ' ' || one || two END AS content FROM s)
SELECT p_partkey, pos::INT AS pos, kind, start::INT AS start, stop::INT AS stop, CASE WHEN kind = 'text' THEN content[start + 1:stop] END AS text,
       CASE WHEN kind = 'table' THEN 'Name|Size  of it' END AS headers, CASE n WHEN 1 THEN p_name || '|a b' WHEN 2 THEN p_name || '|a b|' || p_name || ' too|10 mm' END AS cells, n = 1 AS truncated
FROM c
"""


@query("p22_table_segments", TABLE_SQL)
def table_segments(spark, d):
    """Tables whole, cut off, missing, and twice in a text, with white space of its own."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    intro = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(" has:\n"))
    one, two = F.concat(F.lit("Name\tSize  of it\n"), name, F.lit("\ta b")), F.concat(F.lit("\n"), name, F.lit(" too\t10 mm"))
    content = F.when(k == 0, F.concat(intro, one, two, F.lit("\nend."))).when(k == 1, F.concat(intro, one, F.substring(two, 1, 3))).when(k == 2, F.regexp_replace(intro, r"\n$", "")).otherwise(F.concat(one, two, F.lit(" "), one, two))
    whole = F.struct(F.array(F.lit("Name"), F.lit("Size  of it")).alias("headers"), F.array(F.array(name, F.lit("a b")), F.array(F.concat(name, F.lit(" too")), F.lit("10 mm"))).alias("rows"))
    found = table(spark, d, "part").select("p_partkey", F.posexplode(C.table_segments(content, F.when(k == 3, F.array(whole, whole)).otherwise(F.array(whole)))).alias("pos", "s"))
    return found.select("p_partkey", "pos", "s.kind", "s.start", "s.stop", "s.text", F.array_join("s.headers", "|").alias("headers"), F.array_join(F.flatten("s.rows"), "|").alias("cells"), "s.truncated")


#: Characters of a clause and of a context in r35_packed.
A_CHUNK, TOTAL = 600, 2500
PACKED_SQL = BM25.replace(", p AS", ", q0 AS (SELECT item_id AS qid, list_distinct(" + WORDS + ") AS qt FROM benchmark), p AS", 1) + f"""
, x AS (SELECT bm.qid, doc, rank, '[' || coalesce(source, '?') || ' §' || coalesce(lang, '?') || ']' || chr(10) AS head, text FROM bm JOIN documents ON doc_id = doc),
g0 AS (SELECT doc, any_value(text) AS text FROM x WHERE length(text) > {A_CHUNK} GROUP BY doc),
g1 AS (SELECT doc, list_filter(list_transform(CASE WHEN regexp_matches(text, '\\n\\s*\\n') THEN string_split_regex(text, '\\n\\s*\\n') ELSE string_split(text, chr(10)) END, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS raw FROM g0),
g2 AS (SELECT doc, list_reduce(list_transform(raw, lambda s: [s]), lambda a, s: CASE WHEN length(a[-1]) < 200 THEN list_concat(a[:len(a) - 1], [a[-1] || chr(10) || s[1]]) ELSE list_concat(a, s) END) AS segs FROM g1),
g3 AS (SELECT doc, len(segs) AS n_segs, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM g2),
g4 AS (SELECT x.qid, x.doc, n_segs, i, seg, len(list_filter(qt, lambda t: list_contains(regexp_extract_all(lower(seg), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*'), t))) AS score FROM x JOIN g3 USING (doc) JOIN q0 USING (qid)),
g5 AS (SELECT qid, doc, any_value(n_segs) AS n_segs, list({{'i': i::BIGINT, 'n': length(seg)::BIGINT + 1}} ORDER BY score DESC, i) AS o, list(seg ORDER BY i) AS segs FROM g4 GROUP BY ALL),
g6 AS (SELECT *, list_reduce(o, lambda a, b: CASE WHEN a.used + b.n <= {A_CHUNK} THEN {{'used': a.used + b.n, 'kept': list_append(a.kept, b.i)}} ELSE a END, {{'used': 0::BIGINT, 'kept': []::BIGINT[]}}).kept AS kept FROM g5),
g7 AS (SELECT qid, doc, CASE WHEN n_segs < 2 THEN NULL WHEN len(kept) = 0 THEN regexp_replace(left(segs[o[1].i], {A_CHUNK}), '\\s+$', '') || '…' ELSE array_to_string(list_transform(list_sort(kept), lambda k: segs[k]), chr(10) || '[…]' || chr(10)) END AS fitted FROM g6),
f AS (SELECT qid, doc, rank, head || CASE WHEN length(text) <= {A_CHUNK} THEN text ELSE coalesce(fitted, regexp_replace(left(text, {A_CHUNK}), '\\s+$', '') || '…') END AS block FROM x LEFT JOIN g7 USING (qid, doc)),
r AS (SELECT qid, list_reduce(list({{'doc': doc, 'block': block}} ORDER BY rank, doc), lambda a, b: CASE WHEN a.size + length(b.block) <= {TOTAL} THEN {{'size': a.size + length(b.block), 'used': list_append(a.used, b.doc), 'blocks': list_append(a.blocks, b.block)}} ELSE a END, {{'size': 0::BIGINT, 'used': []::BIGINT[], 'blocks': []::VARCHAR[]}}) AS a FROM f GROUP BY qid)
SELECT qid, array_to_string(a.blocks, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context, array_to_string(a.used, ',') AS used FROM r
"""


@query("r35_packed", PACKED_SQL)
def packed_contexts(spark, d):
    """Contexts of the best documents by words, each cut by the words that its segments share with the question."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("spec_id"), F.col("lang").alias("section_id"), F.col("text").alias("content"))
    rows = bm25(spark, d).select("qid", "doc", "rank").join(docs, "doc").join(asked, "qid")
    shared = lambda q, s: F.size(F.array_intersect(T.tokens(q), T.tokens(s)))
    return C.packed(rows, shared, TOTAL, A_CHUNK).select("qid", "context", F.array_join("used", ",").alias("used"))
