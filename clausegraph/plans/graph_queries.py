"""Queries over the order analogue of the graph (see plans.graph), with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausegraph.operators import hierarchy as H
from clausegraph.operators import patterns as P
from clausegraph.plans.graph import VIEWS, order_graph
from clausegraph.plans.registry import query

# The asked ids are parameters of the queries, as a user would name them.
TERMS, PAIR, OPS, SPEC = [1, 2, 3], [5, 7], [1, 2, 3], 3


def graph(name: str, sql: str | None):
    """Registers f(graph) under name; sql goes on from VIEWS."""

    def register(f):
        query(name, VIEWS + sql if sql is not None else None)(lambda spark, sf_dir: f(order_graph(spark, sf_dir)))
        return f

    return register


SECTIONS = """, sections AS (SELECT spec_id, section_id, max(chunk_id) AS chunk_id FROM chunks GROUP BY ALL),
anc AS (SELECT s.chunk_id, s.spec_id, s.section_id, p.section_id AS ancestor, p.chunk_id AS parent FROM sections s JOIN sections p ON s.spec_id = p.spec_id AND starts_with(s.section_id, p.section_id || '.'))
"""

query("j1_contains", "SELECT c_custkey AS doc, o_orderkey AS chunk_id FROM customer JOIN orders ON c_custkey = o_custkey")(
    lambda spark, d: spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("doc"), F.col("o_orderkey").alias("chunk_id"))
)
graph("j2_edges_with_both_ends", "SELECT src, dst FROM refs WHERE dst IN (SELECT chunk_id FROM chunks)")(lambda g: g.refs.join(g.chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select("src", "dst"))
graph("j3_citation_keys", "SELECT src, dst, substr(md5(CAST(src AS VARCHAR) || '_' || CAST(dst AS VARCHAR) || '_' || ref_type), 1, 10) AS ref_uid FROM refs")(lambda g: P.citation_keys(g.refs))


@graph("j4_resolve_citations", SECTIONS + """, cited AS (SELECT chunk_id AS src, spec_id, CASE chunk_id % 5 WHEN 0 THEN '3' WHEN 1 THEN '2.1' WHEN 2 THEN '4.9-2' WHEN 3 THEN '5.2-1' ELSE '6.3.2' END AS cited FROM chunks WHERE chunk_id % 3 = 0),
below AS (SELECT spec_id, ancestor0 AS cited, chunk_id AS dst, down FROM (SELECT s.spec_id, s.chunk_id, array_to_string(string_split(s.section_id, '.')[1:k], '.') AS ancestor0, len(string_split(s.section_id, '.')) - k AS down FROM sections s, unnest(range(1, len(string_split(s.section_id, '.')))) AS t(k))),
sz AS (SELECT spec_id, cited, count(*) AS n FROM below GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY spec_id, cited ORDER BY dst) AS r FROM below b JOIN sz USING (spec_id, cited) WHERE n <= 12 OR down = 1) WHERE r <= 12),
missing AS (SELECT * FROM cited c WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.spec_id = c.spec_id AND s.section_id = c.cited))
SELECT c.src, s.chunk_id AS dst, 1 AS tier FROM cited c JOIN sections s ON s.spec_id = c.spec_id AND s.section_id = c.cited WHERE c.src <> s.chunk_id
UNION SELECT m.src, h.dst, 2 FROM missing m JOIN chosen h USING (spec_id, cited) WHERE m.src <> h.dst
UNION SELECT m.src, s.chunk_id, 3 FROM missing m JOIN sections s ON s.spec_id = m.spec_id AND s.section_id = regexp_replace(m.cited, '-[0-9]+$', '') WHERE regexp_matches(m.cited, '-[0-9]+$') AND m.src <> s.chunk_id AND NOT EXISTS (SELECT 1 FROM below b WHERE b.spec_id = m.spec_id AND b.cited = m.cited)""")
def _(g):
    k = F.col("chunk_id") % 5
    cited = F.when(k == 0, "3").when(k == 1, "2.1").when(k == 2, "4.9-2").when(k == 3, "5.2-1").otherwise("6.3.2")
    return H.resolve(g.chunks.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("src"), "spec_id", cited.alias("cited")), g.chunks)


graph("j5_known_targets", "SELECT src, dst FROM refs WHERE is_external AND ref_type = 'clause' AND confidence >= 0.7 AND dst IN (SELECT chunk_id FROM chunks)")(P.known_targets)
graph("j6_parents", SECTIONS + "SELECT DISTINCT spec_id, ancestor AS section_id, parent AS chunk_id FROM anc")(lambda g: H.parents(g.chunks))
graph("j6_leaves", SECTIONS + "SELECT spec_id, section_id, chunk_id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM anc a WHERE a.parent = s.chunk_id)")(lambda g: H.leaves(g.chunks))
graph("j7_nearest_ancestors", SECTIONS + "SELECT chunk_id AS child, arg_max(parent, length(ancestor)) AS parent FROM anc GROUP BY chunk_id")(lambda g: H.nearest_ancestors(g.chunks))
graph("p8_heading_paths", SECTIONS + "SELECT c.chunk_id, coalesce(string_agg(t.title, ' > ' ORDER BY length(s.section_id)), '') AS path FROM chunks c LEFT JOIN sections s ON s.spec_id = c.spec_id AND starts_with(c.section_id, s.section_id || '.') LEFT JOIN chunks t ON t.chunk_id = s.chunk_id GROUP BY c.chunk_id")(lambda g: H.heading_paths(g.chunks))
graph("j8_co_occurrence", "SELECT a.term AS a, b.term AS b, count(DISTINCT a.chunk_id) AS weight FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.term < b.term GROUP BY ALL HAVING count(DISTINCT a.chunk_id) >= 2")(lambda g: P.co_occurrence(g.mentions, 2))
graph("j9_mention_band", ", df AS (SELECT term, count(DISTINCT chunk_id) AS df FROM mentions JOIN terms USING (term) GROUP BY term HAVING count(DISTINCT chunk_id) BETWEEN 5 AND 5000) SELECT chunk_id, term, df FROM mentions JOIN df USING (term)")(lambda g: P.band(g.mentions, g.terms))
graph("j11_typed_terms", "SELECT term, CASE WHEN term IN (SELECT term FROM provided) THEN 'network function' END AS semantic_type FROM terms")(P.typed_terms)
ONE = ", t AS (SELECT * FROM terms WHERE term = 7), f AS (SELECT DISTINCT c.* FROM chunks c, t WHERE (c.spec_id = t.primary_spec AND c.chunk_type IN ('procedure', 'definition')) OR contains(c.title, t.full_name)) "
graph("j12_one_term", ONE + "SELECT f.chunk_id, spec_id, section_id, CASE WHEN m.term IS NOT NULL AND chunk_type IN ('procedure', 'definition') THEN 1.0 WHEN m.term IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM f LEFT JOIN mentions m ON m.chunk_id = f.chunk_id AND m.term = 7 ORDER BY score DESC, f.chunk_id LIMIT 20")(lambda g: P.one_term(g, 7, ["procedure", "definition"]))
graph("j13_term_in_spec", "SELECT chunk_id, term, CASE WHEN chunk_type = 'procedure' THEN 1.0 ELSE 0.7 END::DOUBLE AS score FROM mentions JOIN chunks USING (chunk_id) WHERE spec_id = 3 AND chunk_type IN ('procedure', 'requirement')")(
    lambda g: g.mentions.join(g.chunks.where((F.col("spec_id") == SPEC) & F.col("chunk_type").isin("procedure", "requirement")), "chunk_id").select("chunk_id", "term", F.when(F.col("chunk_type") == "procedure", 1.0).otherwise(0.7).alias("score"))
)
graph("j14_many_terms", "SELECT c.chunk_id, coalesce(m.term, -1) AS term, CASE WHEN m.term IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM chunks c LEFT JOIN mentions m ON m.chunk_id = c.chunk_id AND m.term IN (1, 2, 3) WHERE spec_id IN (SELECT primary_spec FROM terms WHERE term IN (1, 2, 3)) ORDER BY score DESC, c.chunk_id, 2 LIMIT 20")(lambda g: P.many_terms(g, TERMS).withColumn("term", F.coalesce("term", F.lit(-1).cast("long"))))
graph("j15_same_step", "SELECT chunk_id, count(DISTINCT step_id) AS score FROM steps JOIN (SELECT step_id FROM involves WHERE term IN (5, 7) GROUP BY step_id HAVING count(DISTINCT term) = 2) USING (step_id) GROUP BY chunk_id")(lambda g: P.same_step(g, PAIR))
PATHS = ", paths AS (SELECT DISTINCT * FROM (SELECT chunk_id, term, 'mention' AS via FROM mentions WHERE term IN (1, 11) UNION ALL SELECT chunk_id, term, 'operation' FROM describes JOIN provided USING (op) WHERE term IN (1, 11))), byc AS (SELECT chunk_id, count(DISTINCT term) AS n, count(DISTINCT CASE WHEN via = 'operation' THEN term END) AS by_op, count(DISTINCT CASE WHEN via = 'mention' THEN term END) AS said FROM paths GROUP BY chunk_id) "
graph("j16_all_terms_any_way", PATHS + "SELECT chunk_id, by_op AS score FROM byc WHERE n = 2 AND chunk_id IN (SELECT chunk_id FROM describes)")(lambda g: P.all_terms_any_way(g, [1, 11]))
graph("j17_steps_and_operations", PATHS + """, st AS (SELECT chunk_id, step_id, term FROM steps JOIN involves USING (step_id) WHERE term IN (1, 11)),
fs AS (SELECT chunk_id, count(*) AS full_steps FROM (SELECT chunk_id, step_id FROM st GROUP BY ALL HAVING count(DISTINCT term) = 2) GROUP BY chunk_id),
ac AS (SELECT chunk_id, count(DISTINCT term) AS actors FROM st GROUP BY chunk_id),
j AS (SELECT coalesce(ac.chunk_id, byc.chunk_id) AS chunk_id, coalesce(full_steps, 0) AS full_steps, coalesce(said, 0) AS said, coalesce(by_op, 0) AS by_op, coalesce(actors, 0) AS actors FROM ac FULL JOIN byc ON ac.chunk_id = byc.chunk_id LEFT JOIN fs ON fs.chunk_id = ac.chunk_id)
SELECT chunk_id, full_steps, said, by_op, 100 * full_steps + CASE WHEN by_op = 2 THEN 50 ELSE 0 END + 2 * said + by_op + actors AS score FROM j WHERE full_steps > 0 OR by_op = 2 ORDER BY score DESC, full_steps DESC, said DESC, chunk_id LIMIT 20""")(lambda g: P.steps_and_operations(g, [1, 11]))
graph("j18_title_phrase", "SELECT chunk_id, title, 1.0::DOUBLE AS score FROM chunks WHERE regexp_matches(title, '(^|[^A-Za-z0-9_])URGENT([^A-Za-z0-9_]|$)') ORDER BY chunk_id LIMIT 20")(lambda g: P.title_phrases(g.chunks, ["urgent"]))
graph("j19_two_phrases", "SELECT chunk_id, title, 1.0::DOUBLE AS score FROM chunks WHERE contains(title, 'LOW clause 3') AND regexp_matches(title, 'clause 3([^A-Za-z0-9_]|$)') OR contains(title, 'HIGH') ORDER BY chunk_id LIMIT 20")(lambda g: P.title_phrases(g.chunks, ["low clause 3", "high"]))
graph("j20_chunks_of_operation", "SELECT chunk_id FROM describes WHERE op = 1")(lambda g: g.describes.where("op = 1").select("chunk_id"))
graph("j21_chunks_of_terms", "SELECT DISTINCT chunk_id FROM mentions JOIN terms USING (term) WHERE full_name LIKE '%ring%'")(lambda g: g.mentions.join(g.terms.where("full_name like '%ring%'"), "term", "left_semi").select("chunk_id").distinct())
graph("j22_cited_with", ", e AS (SELECT src, dst FROM refs WHERE is_external AND src IN (SELECT chunk_id FROM chunks WHERE spec_id = 3) AND dst IN (SELECT chunk_id FROM chunks)) SELECT src AS chunk_id FROM e UNION SELECT dst FROM e")(lambda g: P.cited_with(g, SPEC))
graph("j23_nothing", "SELECT chunk_id, title FROM chunks WHERE false")(lambda g: g.chunks.where(F.lit(False)).select("chunk_id", "title"))
graph("j24_values_of_service", "SELECT service, term, count(DISTINCT op) AS n_ops FROM operations JOIN provided USING (op) GROUP BY ALL")(lambda g: g.operations.join(g.provided, "op").groupBy("service", "term").agg(F.countDistinct("op").alias("n_ops")))
graph("j25_parents_with_requirements", SECTIONS + ", c AS (SELECT a.parent, count(*) AS n FROM anc a JOIN chunks k ON k.chunk_id = a.chunk_id WHERE contains(k.content, 'shall') GROUP BY a.parent HAVING count(*) >= 3) SELECT parent AS chunk_id, n FROM c")(
    lambda g: H.ancestors(H.distinct_sections(g.chunks)).join(g.chunks.where(F.col("content").contains("shall")).select("chunk_id"), "chunk_id", "left_semi")
    .join(H.distinct_sections(g.chunks).select("spec_id", F.col("section_id").alias("ancestor"), F.col("chunk_id").alias("parent")), ["spec_id", "ancestor"])
    .groupBy(F.col("parent").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
)
graph("j26_mention_counts", "SELECT chunk_id, count(DISTINCT term) AS hits FROM mentions WHERE term IN (1, 2, 3) GROUP BY chunk_id ORDER BY hits DESC, chunk_id LIMIT 10")(lambda g: P.mention_counts(g, TERMS))
HOPS = """, seeds AS (SELECT chunk_id AS seed, row_number() OVER (ORDER BY chunk_id) AS ord FROM (SELECT DISTINCT chunk_id FROM mentions WHERE term <= 5 ORDER BY chunk_id LIMIT 12)),
one AS (SELECT seed, ord, dst AS target FROM seeds JOIN refs ON src = seed),
allh AS (SELECT seed, ord, target, 1 AS hops FROM one UNION ALL SELECT seed, ord, dst, 2 FROM one JOIN refs ON src = target WHERE NOT (seed = target AND target = dst)),
best0 AS (SELECT seed, ord, target, min(hops) AS hops FROM allh JOIN chunks s ON s.chunk_id = seed JOIN chunks t ON t.chunk_id = target WHERE s.spec_id <> t.spec_id AND length(t.content) >= 100 GROUP BY ALL),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, target) AS n FROM best0) WHERE n <= 50),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hops, n, ord) AS f FROM lim) WHERE f = 1)
"""
HOPS_BY = VIEWS + """, seeds AS (SELECT chunk_id AS seed, chunk_id % 4 AS grp, row_number() OVER (PARTITION BY chunk_id % 4 ORDER BY chunk_id) AS ord FROM (SELECT DISTINCT chunk_id FROM mentions WHERE term <= 20)),
one AS (SELECT grp, seed, ord, dst AS target FROM seeds JOIN refs ON src = seed),
allh AS (SELECT grp, seed, ord, target, 1 AS hops FROM one UNION ALL SELECT grp, seed, ord, dst, 2 FROM one JOIN refs ON src = target WHERE NOT (seed = target AND target = dst)),
best0 AS (SELECT grp, seed, ord, target, min(hops) AS hops FROM allh JOIN chunks s ON s.chunk_id = seed JOIN chunks t ON t.chunk_id = target WHERE s.spec_id <> t.spec_id AND length(t.content) >= 100 GROUP BY ALL),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, seed ORDER BY hops, target) AS n FROM best0) WHERE n <= 50),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, target ORDER BY hops, n, ord) AS f FROM lim) WHERE f = 1)
"""
graph("j32_reference_hop", HOPS + "SELECT seed, target, hops, turn FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, target) AS turn FROM firsts) ORDER BY turn, ord LIMIT 40")(
    lambda g: H.hops(g.mentions.where("term <= 5").select("chunk_id").distinct().orderBy("chunk_id").limit(12).select(F.col("chunk_id").alias("seed"), F.row_number().over(P.Window.orderBy("chunk_id")).alias("ord")), g.refs, g.chunks)
)
UP = """, pl AS (SELECT *, regexp_replace(section_id, '[.][^.]*$', '') AS up, len(string_split(section_id, '.')) AS deep FROM chunks WHERE contains(section_id, '.')) """
graph("j34_siblings", SECTIONS + UP + """, seeds AS (SELECT DISTINCT chunk_id FROM mentions WHERE term <= 3),
pe AS (SELECT chunk_id AS child, arg_max(parent, length(ancestor)) AS parent FROM anc GROUP BY chunk_id),
near AS (SELECT a.child AS seed, b.child AS chunk_id, 'edge' AS source FROM pe a JOIN pe b USING (parent) JOIN chunks c ON c.chunk_id = b.child WHERE contains(lower(c.content), 'shall')
UNION ALL SELECT s.chunk_id, o.chunk_id, 'prefix' FROM pl s JOIN pl o ON s.spec_id = o.spec_id AND s.up = o.up AND s.deep = o.deep),
best AS (SELECT seed, chunk_id, min(source) AS source FROM near WHERE seed <> chunk_id AND seed IN (SELECT chunk_id FROM seeds) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY source, chunk_id) AS rank FROM best) WHERE rank <= 10""")(lambda g: H.siblings(g.mentions.where("term <= 3").select("chunk_id").distinct(), g.chunks))
graph("j35_step_actors", "SELECT chunk_id, max(n) AS n_step_actor_hits FROM (SELECT chunk_id, step_id, count(DISTINCT term) AS n FROM steps JOIN involves USING (step_id) WHERE term IN (1, 2, 3, 5, 7) GROUP BY ALL HAVING count(DISTINCT term) >= 2) GROUP BY chunk_id")(lambda g: P.step_actors(g, [1, 2, 3, 5, 7]))
graph("j36_step_evidence", ", h AS (SELECT s.*, max(CASE WHEN i.step_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.chunk_id ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM steps s LEFT JOIN (SELECT DISTINCT step_id FROM involves WHERE term IN (5, 7)) i USING (step_id)), k AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n, sum(near) OVER (PARTITION BY chunk_id) AS kept FROM h) SELECT chunk_id, step_id, ord FROM k WHERE n >= 4 AND kept < n AND near = 1")(lambda g: P.step_evidence(g, PAIR))
graph("j37_neighbourhood", """, e AS (SELECT chunk_id, 0 AS kind, op || ' PROVIDED_BY ' || term AS v FROM describes JOIN provided USING (op)
UNION SELECT chunk_id, 1, step_id || ' INVOLVES ' || term FROM steps JOIN involves USING (step_id)
UNION SELECT chunk_id, 2, 'm' || term FROM mentions WHERE term % 20 = 0
UNION SELECT chunk_id, 3, 'p' || term FROM mentions WHERE term % 3 = 0
UNION SELECT chunk_id, 4, term::VARCHAR FROM mentions
UNION SELECT src, 5, spec_id::VARCHAR FROM refs JOIN chunks ON chunk_id = dst WHERE is_external),
r AS (SELECT * FROM e QUALIFY kind IN (0, 2, 5) OR row_number() OVER (PARTITION BY chunk_id, kind ORDER BY v) <= 12),
l AS (SELECT chunk_id, kind, CASE kind WHEN 4 THEN '  ' || chunk_id || ' MENTIONS ' || string_agg(v, ', ' ORDER BY v) ELSE string_agg(CASE kind WHEN 2 THEN '  ' || chunk_id || ' DESCRIBES_MESSAGE ' || v WHEN 3 THEN '  Parameter[' || v || '] DEFINED_IN_TABLE ' || chunk_id WHEN 5 THEN '  ' || spec_id || ' REFERENCES_SPEC ' || v ELSE '  ' || v END, chr(10) ORDER BY v) END AS line, count(*) AS n FROM r JOIN chunks USING (chunk_id) GROUP BY chunk_id, kind, spec_id)
SELECT chunk_id, coalesce(sum(n), 0)::BIGINT AS n, '[' || spec_id || ' §' || title || ']' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY kind), '  (no graph relations)') AS block FROM chunks LEFT JOIN l USING (chunk_id) GROUP BY chunk_id, spec_id, title""")(
    lambda g: P.neighbourhood(g, g.chunks.select("chunk_id"), g.mentions.where("term % 20 = 0").select("chunk_id", F.concat(F.lit("m"), "term").alias("message")), g.mentions.where("term % 3 = 0").select(F.concat(F.lit("p"), "term").alias("parameter"), "chunk_id"))
)
graph("j38_titles_in_specs", "SELECT chunk_id, title FROM chunks WHERE title IN ('5-LOW clause 3', '2-HIGH clause 2.1') AND spec_id IN (1, 2, 3) ORDER BY chunk_id LIMIT 3")(lambda g: P.top(g.chunks.where(F.col("title").isin("5-LOW clause 3", "2-HIGH clause 2.1") & F.col("spec_id").isin(1, 2, 3)).select("chunk_id", "title"), 3, "chunk_id"))
graph("j39_quoted_phrase", "SELECT chunk_id, title FROM chunks WHERE contains(title, 'clause 4') ORDER BY length(title), chunk_id LIMIT 5")(lambda g: P.top(g.chunks.where(F.col("title").contains("clause 4")).select("chunk_id", "title"), 5, F.length("title"), "chunk_id"))
graph("j40_cited_clause", "SELECT chunk_id, section_id, CASE WHEN section_id = '3.2' THEN 0 ELSE 1 END AS child FROM chunks WHERE spec_id = 3 AND (section_id = '3.2' OR starts_with(section_id, '3.2.'))")(lambda g: g.chunks.where((F.col("spec_id") == SPEC) & ((F.col("section_id") == "3.2") | F.col("section_id").startswith("3.2."))).select("chunk_id", "section_id", F.when(F.col("section_id") == "3.2", 0).otherwise(1).alias("child")))
graph("j41_per_operation", ", m AS (SELECT chunk_id, count(DISTINCT op) AS matched FROM describes GROUP BY chunk_id) SELECT op, chunk_id, title_score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY title_score DESC, matched DESC, size, chunk_id) AS rank FROM (SELECT op, chunk_id, matched, length(content) AS size, CASE WHEN contains(lower(title), CAST(op AS VARCHAR)) THEN 2 ELSE 0 END AS title_score FROM describes JOIN m USING (chunk_id) JOIN chunks USING (chunk_id))) WHERE rank <= 2")(P.per_operation)
graph("j42_all_operations", "SELECT chunk_id, matched, length(content) AS size FROM (SELECT chunk_id, count(DISTINCT op) AS matched FROM describes WHERE op IN (1, 2, 3) GROUP BY chunk_id HAVING count(DISTINCT op) >= 2) JOIN chunks USING (chunk_id) ORDER BY matched DESC, size, chunk_id LIMIT 3")(lambda g: P.all_operations(g, OPS).withColumn("size", F.col("size").cast("long")))
graph("j43_service_operations", "SELECT chunk_id, count(DISTINCT op) AS n_ops FROM describes WHERE starts_with(CAST(op AS VARCHAR), '1') GROUP BY chunk_id")(lambda g: P.service_operations(g, "1"))
graph("j46_subtree", "SELECT chunk_id, section_id FROM chunks WHERE spec_id = 3 AND (section_id = '2' OR starts_with(section_id, '2.') OR starts_with(section_id, '2p'))")(lambda g: g.chunks.where((F.col("spec_id") == SPEC) & F.col("section_id").rlike(r"^2([.p]|$)")).select("chunk_id", "section_id"))
graph("j51_unknown_targets", "SELECT DISTINCT dst FROM refs WHERE dst NOT IN (SELECT chunk_id FROM chunks)")(P.missing_targets)
graph("j51_unused_terms", "SELECT term, full_name FROM terms WHERE term NOT IN (SELECT term FROM mentions JOIN chunks USING (chunk_id) WHERE spec_id = 3)")(lambda g: P.unused_terms(replace(g, mentions=g.mentions.join(g.chunks.where(F.col("spec_id") == SPEC), "chunk_id", "left_semi"))))
graph("a1_chunk_types", "SELECT chunk_type, count(*) AS n FROM chunks GROUP BY chunk_type")(lambda g: g.chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n")))
graph("a2_distinct_counts", "SELECT spec_id, count(DISTINCT section_id) AS sections, count(DISTINCT term) AS terms FROM chunks JOIN mentions USING (chunk_id) GROUP BY spec_id")(lambda g: g.chunks.join(g.mentions, "chunk_id").groupBy("spec_id").agg(F.countDistinct("section_id").alias("sections"), F.countDistinct("term").alias("terms")))
graph("a7_document_frequency", "SELECT term, count(DISTINCT chunk_id) AS df FROM mentions GROUP BY term")(lambda g: P.document_frequency(g.mentions))
graph("t17_edge_counts", "SELECT 'chunks' AS label, count(*) AS n FROM chunks " + " ".join(f"UNION ALL SELECT '{x}', count(*) FROM {x}" for x in ("terms", "mentions", "operations", "describes", "provided", "steps", "involves", "refs")))(P.edge_counts)
graph("w10_next_steps", "SELECT src, dst FROM (SELECT step_id AS src, lead(step_id) OVER (PARTITION BY chunk_id ORDER BY ord) AS dst FROM steps) WHERE dst IS NOT NULL")(lambda g: P.next_steps(g.steps))
graph("o9_most_specific", SECTIONS + "SELECT spec_id, section_id, chunk_id FROM sections s WHERE NOT EXISTS (SELECT 1 FROM sections x WHERE x.spec_id = s.spec_id AND starts_with(x.section_id, s.section_id || '.'))")(lambda g: H.leaves(g.chunks))
