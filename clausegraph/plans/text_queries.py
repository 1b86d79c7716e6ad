"""Queries over documents, embeddings, pages and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.functions.lineage import new_folder
from clausegraph.operators import extract as X
from clausegraph.operators import retrieval as R
from clausegraph.operators import vector_index as V
from clausegraph.plans import store
from clausegraph.plans.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*')"
BM25 = f"""
WITH d AS (SELECT doc_id AS doc, {WORDS} AS t FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest({WORDS}) AS term FROM benchmark),
w AS (SELECT q.qid, p.doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / a)) AS w FROM q JOIN p USING (term) JOIN df USING (term) JOIN d USING (doc), s),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (SELECT qid, doc, round(sum(w), 6) AS score FROM w GROUP BY ALL)) WHERE rank <= 10)
"""
DENSE = """
WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT qid, vec_id AS doc, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM x) WHERE rank <= 10)
"""


@query("r3_bm25", BM25 + "SELECT qid, doc, score, rank FROM bm")
def bm25(spark, d):
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark")).select("qid", "doc", "score", "rank")


@query("r1_dense", DENSE + "SELECT qid, doc, score, rank FROM de")
def dense(spark, d):
    items = table(spark, d, "embeddings")
    return R.dense(items, items.where("vec_id % 50 = 0")).select("qid", "doc", "score", "rank")


def _index(spark, d):
    items = table(spark, d, "embeddings")
    return items, V.build(items, new_folder(spark, "vectors"))


@query("r1_index", DENSE + "SELECT qid, doc, score, rank FROM de")
def vector_index(spark, d):
    """The exact lists by the inverted-file index: the nearest cells, then all that could hold more."""
    items, index = _index(spark, d)
    return V.search(index, items.where("vec_id % 50 = 0"), certain=True).select("qid", "doc", "score", "rank")


@query("r1_index_probed")
def vector_index_probed(spark, d):
    """The lists of the nearest cells alone, as many as find 95 % for a sample of the queries; tests hold their recall against the exact ones."""
    items, index = _index(spark, d)
    asked = items.where("vec_id % 50 = 0")
    return V.search(index, asked, probes=V.probes_for(index, asked)).select("qid", "doc", "score", "rank")


TITLE_WORDS = "list_filter(regexp_extract_all(lower(left(text, 60)), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.TITLE_STOP) + "))"


@query("r4_title_bm25", BM25.replace(f"{WORDS} AS t FROM documents", f"{TITLE_WORDS} AS t FROM documents") + "SELECT qid, doc, score, rank FROM bm")
def title_bm25(spark, d):
    stop = r"(?<![A-Za-z0-9_])(" + "|".join(T.TITLE_STOP) + r")(?![A-Za-z0-9_])"
    titled = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower(F.substring("text", 1, 60)), stop, " ").alias("text"))
    return R.bm25(titled, table(spark, d, "benchmark")).select("qid", "doc", "score", "rank")


FUSED = BM25 + ", k AS (SELECT doc, item_id AS qid FROM (SELECT doc_id AS doc FROM documents), benchmark WHERE false), o AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY doc DESC) AS rank FROM bm), f AS (SELECT qid, doc, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT qid, doc, rank, 1.0 AS w FROM bm UNION ALL SELECT qid, doc, rank, 0.6 FROM o) GROUP BY ALL) "


@query("r6_rrf", FUSED + "SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 5")
def rrf(spark, d):
    first = bm25(spark, d)
    second = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc")))).withColumn("weight", F.lit(0.6))
    return R.rrf(first.withColumn("weight", F.lit(1.0)).unionByName(second), 5).select("qid", "doc", "score", "rank")


@query("r8_branch_weight", DENSE + "SELECT qid, CASE WHEN min(score) = max(score) THEN 0.5 WHEN max(score) >= 0.92 THEN 1.4 ELSE 0.6 END::DOUBLE AS weight FROM de GROUP BY qid")
def branch_weight(spark, d):
    return R.branch_weight(dense(spark, d))


@query("r9_confident", DENSE + "SELECT qid, doc, score FROM de WHERE score >= 0.75")
def confident(spark, d):
    return dense(spark, d).where("score >= 0.75").select("qid", "doc", "score")


@query("r10_normalised", BM25 + "SELECT qid, doc, round(score / max(score) OVER (PARTITION BY qid) * 0.99, 9) AS score FROM bm")
def normalised(spark, d):
    return R.normalised(bm25(spark, d), only_above_one=False, factor=0.99).select("qid", "doc", "score")


LOGITS = BM25 + ", l AS (SELECT qid, doc, score / 4 - 2 AS logit, round(score / max(score) OVER (PARTITION BY qid), 6) AS upstream, (CASE WHEN doc % 3 = 0 THEN 0.7 ELSE 0 END + CASE WHEN doc % 4 = 0 THEN -0.6 ELSE 0 END)::DOUBLE AS bias, doc % 7 = 0 AS protected FROM bm), pp AS (SELECT *, protected OR CASE WHEN upstream >= 1 THEN logit >= -2 ELSE logit >= 0 END AS passes, round(0.6 / (1 + exp(-logit)) + 0.3 * upstream + CASE WHEN upstream >= 1 THEN 0.15 ELSE 0 END + 0.5 * bias, 9) AS score FROM l), t AS (SELECT *, sum(passes::INT) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid, passes, logit >= -2 ORDER BY score DESC, doc) AS turn FROM pp) "


def _logits(spark, d):
    rows = bm25(spark, d)
    up = F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 6)
    rows = rows.select("qid", "doc", (F.col("score") / 4 - 2).alias("logit"), up.alias("upstream"), (F.col("doc") % 3 == 0).alias("x"), (F.col("doc") % 4 == 0).alias("y"), (F.col("doc") % 7 == 0).alias("protected"))
    return rows.withColumn("bias", R.feature_bias({"x": 0.7, "y": -0.6}))


@query("r14_rerank", LOGITS + "SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM t WHERE passes OR (logit >= -2 AND turn <= 3 - n)) WHERE rank <= 10")
def reranked(spark, d):
    return R.rerank(_logits(spark, d)).select("qid", "doc", "score", "rank")


@query("r15_blend", LOGITS + "SELECT qid, doc, score FROM pp")
def blended(spark, d):
    return _logits(spark, d).select("qid", "doc", F.round(R.blend(F.col("logit"), F.col("upstream"), F.col("bias")), 9).alias("score"))


@query("r20_round_robin", BM25 + ", g AS (SELECT qid // 3 AS q, qid AS gap, doc, rank FROM bm), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY rank, gap) AS n FROM g) WHERE n = 1) SELECT q AS qid, gap, doc, position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, gap) AS position FROM f) WHERE position <= 10")
def robin(spark, d):
    rows = bm25(spark, d).select(F.floor(F.col("qid") / 3).alias("qid"), F.col("qid").alias("gap"), "doc", "rank")
    return R.round_robin(rows, 10)


@query("r20_backfill", BM25 + ", g AS (SELECT qid // 3 AS q, qid AS gap, doc, rank FROM bm WHERE rank <= 2), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY rank, gap) AS n FROM g) WHERE n = 1), t AS (SELECT q, gap, doc, row_number() OVER (PARTITION BY q ORDER BY rank, gap) AS position FROM f), l AS (SELECT q, max(position) AS last FROM t GROUP BY q), o AS (SELECT qid // 3 AS q, doc, min(rank) AS rank FROM bm GROUP BY ALL), m AS (SELECT o.q, o.doc, row_number() OVER (PARTITION BY o.q ORDER BY o.rank, o.doc) AS after FROM o ANTI JOIN t ON o.q = t.q AND o.doc = t.doc) SELECT q AS qid, gap, doc, position FROM t UNION ALL SELECT q, NULL, doc, after + last FROM m JOIN l USING (q) WHERE after + last <= 10")
def backfilled(spark, d):
    rows = bm25(spark, d).select(F.floor(F.col("qid") / 3).alias("qid"), F.col("qid").alias("gap"), "doc", "rank")
    return R.round_robin(rows.where("rank <= 2"), 10, rows.groupBy("qid", "doc").agg(F.min("rank").alias("rank")))


@query("r35_context", BM25.replace("WITH d", "WITH RECURSIVE d") + """, x AS (SELECT qid, doc, rank, least(n_chars, 4000) AS size FROM bm JOIN documents ON doc_id = doc),
fold AS (SELECT qid, 0::BIGINT AS rank, 0::BIGINT AS used, NULL::BIGINT AS doc, 0::BIGINT AS size, false AS fits FROM (SELECT DISTINCT qid FROM x)
UNION ALL SELECT f.qid, x.rank, CASE WHEN f.used + x.size <= 9000 THEN f.used + x.size ELSE f.used END, x.doc, x.size, f.used + x.size <= 9000 FROM fold f JOIN x ON x.qid = f.qid AND x.rank = f.rank + 1)
SELECT qid, doc, rank::INT AS rank, size FROM fold WHERE fits""")
def packed(spark, d):
    rows = bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("size")), "doc")
    return R.context(rows, 9000)


@query("r36_sources", BM25 + "SELECT DISTINCT doc, source FROM bm JOIN documents ON doc_id = doc")
def sources(spark, d):
    return table(spark, d, "documents").join(bm25(spark, d).select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "source")


@query("p13_content_type", """SELECT doc_id, CASE WHEN regexp_matches(t, 'definition|overview|general|scope') THEN 'definition' WHEN contains(t, 'abbreviation') THEN 'abbreviation'
 WHEN regexp_matches(t, 'procedure|flow|process|registration|handover') THEN 'procedure' WHEN regexp_matches(t, 'parameter|identifier|ie|element') THEN 'parameter' WHEN regexp_matches(t, 'reference|normative') THEN 'reference'
 WHEN contains(left(lower(text), 500), 'shall') THEN 'requirement' WHEN regexp_matches(t, 'interface|api|service') THEN 'interface' ELSE 'general' END AS chunk_type FROM (SELECT doc_id, text, lower(left(text, 40)) AS t FROM documents)""")
def content_types(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_type(F.substring("text", 1, 40), F.col("text")).alias("chunk_type"))


@query("p1_headings", r"""SELECT page_id, regexp_extract(line, '^(\d+(?:\.\d+)*)\s+(.+)$', 1) AS id, trim(regexp_extract(line, '^(\d+(?:\.\d+)*)\s+(.+)$', 2)) AS title FROM (SELECT page_id, CAST(page_id % 9 + 1 AS VARCHAR) || '.' || CAST(page_id % 4 AS VARCHAR) || ' ' || split_part(url, '/', 3) AS line FROM pages)""")
def headings(spark, d):
    line = F.concat((F.col("page_id") % 9 + 1).cast("string"), F.lit("."), (F.col("page_id") % 4).cast("string"), F.lit(" "), F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, d, "pages").select("page_id", T.heading(line).alias("h")).select("page_id", "h.id", "h.title")


@query("p9_split", """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, length(text) AS n FROM documents),
f AS (SELECT doc_id, 1 AS i, 1 AS part, length(ls[1]) + 1 AS size FROM l WHERE n > 2000
UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN f.size + length(l.ls[f.i + 1]) + 1 > 2000 THEN part + 1 ELSE part END, CASE WHEN f.size + length(l.ls[f.i + 1]) + 1 > 2000 THEN length(l.ls[f.i + 1]) + 1 ELSE f.size + length(l.ls[f.i + 1]) + 1 END FROM f JOIN l USING (doc_id) WHERE f.i < len(l.ls))
SELECT doc_id, part, max(size) - 1 AS chars, string_agg(ls[i], chr(10) ORDER BY i) AS content FROM f JOIN l USING (doc_id) GROUP BY doc_id, part UNION ALL SELECT doc_id, 1, n, text FROM l JOIN documents USING (doc_id) WHERE n <= 2000""")
def split(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"), 2000)).alias("part", "content"))
    return parts.select("doc_id", (F.col("part") + 1).alias("part"), F.length("content").cast("long").alias("chars"), "content")


@query("p21_preview", "SELECT doc_id, CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS preview FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("r2_passage", "SELECT doc_id, CASE WHEN starts_with(text, title) THEN text ELSE title || chr(10) || text END AS passage FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE source END AS title FROM documents)")
def passages(spark, d):
    rows = table(spark, d, "documents").withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.col("source")))
    return rows.select("doc_id", T.passage(F.col("title"), F.col("text")).alias("passage"))


@query("s3_main_body", r"""SELECT doc_id, NOT regexp_matches(lower(n), 'cover|annex|history|amendment') AND NOT contains(lower(n), '-rm.') AND NOT starts_with(n, '._') AND (regexp_matches(lower(n), 'main[-_ ]?body') OR regexp_matches(n, '(?i)^\d{5}(-\d+)*-[a-z]{0,2}\d{1,3}(-cl)?(_s[\w\-.]+)?\.docx$')) AS main
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(23000 + n_chars % 900 AS VARCHAR) || '-i80.docx' WHEN 1 THEN 'cover.docx' WHEN 2 THEN '38101-1-ib1_s07.docx' WHEN 3 THEN '._23501-i80.docx' WHEN 4 THEN '23501-rm.docx' ELSE 'x_main_body.docx' END AS n FROM documents)""")
def main_bodies(spark, d):
    k = F.col("doc_id") % 6
    name = F.when(k == 0, F.concat((F.col("n_chars") % 900 + 23000).cast("string"), F.lit("-i80.docx"))).when(k == 1, "cover.docx").when(k == 2, "38101-1-ib1_s07.docx").when(k == 3, "._23501-i80.docx").when(k == 4, "23501-rm.docx").otherwise("x_main_body.docx")
    return table(spark, d, "documents").select("doc_id", T.is_main_body(name).alias("main"))


@query("s9_merge_parts", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM (SELECT doc_id, source, 0 AS seq FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT doc_id, 'late', 1 FROM documents)) WHERE n = 1")
def merge_parts(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.where("n_chars % 2 = 0").select("doc_id", "source", F.lit(0).alias("seq")).unionByName(docs.select("doc_id", F.lit("late").alias("source"), F.lit(1).alias("seq")))
    return R.first_wins(rows, F.col("doc_id"), "seq").select("doc_id", "source")


@query("s14_conversations", "SELECT conv_id, count(*) AS messages, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 80) AS title, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversations(spark, d):
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.substring(first, 1, 80).alias("title"), F.max("turn").alias("last_turn"))


@query("s14_appended", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'more' FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 2 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'done' FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 2 = 0 GROUP BY conv_id")
def appended(spark, d):
    """A question and its answer behind every other conversation, and every fifth deleted."""
    rows = table(spark, d, "conversations")
    said = F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.lit("more").alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.lit("done").alias("text"))))
    new = rows.where("conv_id % 2 = 0").select("conv_id").distinct().select("conv_id", said.alias("m")).select("conv_id", "m.*")
    return store.without_conversations(store.append_turns(rows, new), rows.where("conv_id % 5 = 0"))


@query("s16_export", "SELECT l.doc_id, quality, toxic, lang || ';' || source AS tags FROM labels l LEFT JOIN documents USING (doc_id)")
def export(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left").select("doc_id", "quality", "toxic", F.array_join(F.array("lang", "source"), ";").alias("tags"))


@query("x3_transcripts", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark, d):
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("transcript"))


DEFINITION_LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
x AS (SELECT doc_id, pos, trim(regexp_replace(CASE WHEN contains(line, ':') THEN line ELSE regexp_replace(line, '^([^\s:]+) ', '\1: ') END, '^\s+|\s+$', '', 'g')) AS line FROM l),
p AS (SELECT doc_id, pos, trim(split_part(line, ':', 1)) AS term, trim(substr(line, strpos(line, ':') + 1)) AS definition FROM x WHERE contains(line, ':') AND NOT starts_with(lower(line), 'for the purposes')
AND NOT contains(left(lower(line), 50), 'apply') AND NOT contains(lower(line), 'tr 21.905') AND NOT contains(lower(line), 'ts 23.501'))
SELECT doc_id, pos, term, definition FROM p WHERE length(term) BETWEEN 2 AND 100 AND length(definition) > 10 AND regexp_matches(term, '\p{{L}}') AND NOT (starts_with(term, '[') AND ends_with(term, ']')) AND NOT regexp_matches(term, '{X.JUNK_HEAD}')
"""


@query("t3_definition_lines", DEFINITION_LINES)
def definition_lines(spark, d):
    """The definition extractor over all lines of every document; a line without a colon is read as if one stood after its first word."""
    content = F.regexp_replace("text", r"(?md)^([^\s:]+) (?=[^:\n]*$)", "$1: ")
    chunks = table(spark, d, "documents").select(F.lit("").alias("spec_id"), F.col("doc_id").alias("chunk_id"), content.alias("content"))
    return X.definitions(chunks).select(F.col("chunk_id").alias("doc_id"), "pos", "term", F.col("full_name").alias("definition"))


@query("w9_event_neighbours", "SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events) WHERE near = 1")
def event_neighbours(spark, d):
    near = F.max((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 1))
    return table(spark, d, "events").withColumn("near", near).where("near = 1").select("event_id", "user_id")


@query("w13_minmax", "SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def minmax(spark, d):
    ends = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return table(spark, d, "events").join(ends, "event_type").select("event_id", F.round(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), 6).alias("scaled"))


@query("w12_natural_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 20, CASE WHEN n_chars % 3 = 0 THEN 'a' ELSE '' END, doc_id) AS position FROM documents")
def natural_order(spark, d):
    """Keys such as 4a stand after 4 and before 5."""
    key = F.concat((F.col("n_chars") % 20).cast("string"), F.when(F.col("n_chars") % 3 == 0, "a").otherwise(""))
    rows = table(spark, d, "documents").withColumn("key", key)
    order = Window.partitionBy("source").orderBy(F.regexp_extract("key", r"^(\d+)", 1).cast("int"), F.regexp_extract("key", r"([a-z]*)$", 1), "doc_id")
    return rows.select("doc_id", F.row_number().over(order).alias("position"))
