"""Steps whose cost must grow with their input: the same results as plain versions, and plans without what grew faster."""

import random

from pyspark.sql import functions as F

from clausegraph.operators import extract, phrases, questions, retrieval
from tests.test_core import brute_merge


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_terms_of_many_rows(spark):
    """terms of many rows, against the plain fold; an array of all citations of a term took hours at this size of term."""
    rng = random.Random(5)
    for names, specs in (("xyz", ["ts_1", "ts_23_501", "ts_23_502", "ts_38_331"]), ("pqrstuv", ["ts_23_501", "ts_29_502", "ts_23_509"]), ("x", ["ts_9"])):
        rows = [(i, rng.choice("ABC"), rng.choice(names), rng.choice(specs), "abbreviation") for i in range(600)]
        found = extract.merge_terms(spark.createDataFrame(rows, "seq int, term string, full_name string, spec_id string, term_type string")).collect()
        assert {r["term"]: (r["full_name"], r["primary_spec"], r["source_specs"]) for r in found} == brute_merge(rows)
    wide = spark.range(40000).select(F.col("id").alias("seq"), F.lit("A").alias("term"), (F.col("id") % 7).cast("string").alias("full_name"), F.lit("ts_23_501").alias("spec_id"), F.lit("t").alias("term_type"))
    assert extract.merge_terms(wide).first()["full_name"] == "0"


def test_resolved_terms_in_one_array(spark):
    """a question's terms are settled in its own row; windows over all questions held gigabytes in a task."""
    asked = spark.createDataFrame([(1, "How does the Access function meet the UPF"), (2, "UPF and PDUSET and UPF"), (3, "nothing"), (4, "the access function of functions, session function")], "qid int, question string")
    index = spark.createDataFrame([("AMF", "access function"), ("SMF", "session function"), ("FX", "function"), ("UPF", "plane function"), ("PDUSET", "set of units")], "term string, full_name string")
    found = questions.resolved_terms(asked, index)
    assert "Window" not in plan(found)
    assert sorted((r["qid"], r["term"], r["place"], r["is_primary"]) for r in found.collect()) == [(1, "AMF", 14, True), (2, "PDUSET", 1, True), (2, "UPF", 0, False), (4, "AMF", 5, True), (4, "SMF", 34, False)]


def test_names_in_text_moves_no_pairs(spark):
    """headings that share a title, and one of two titles; the pairs themselves are neither grouped nor shuffled."""
    flows = spark.createDataFrame([(1, "Uses the small red ring here and the small red ring."), (2, "a large blue bolt, the small red ring")], "flow int, text string")
    heads = spark.createDataFrame([(i, "Small red ring") for i in range(50)] + [(90, "large blue bolt"), (90, "small red ring"), (91, "red ring"), (91, "red ring")], "chunk_id int, title string")
    found = questions.names_in_text(flows, heads)
    assert sorted(map(tuple, found.collect())) == sorted([(f, i) for f in (1, 2) for i in range(50)] + [(1, 90), (2, 90)])
    assert not plan(found).startswith("Aggregate") and "Generate explode(ids" in plan(found)


def test_phrases_cut_a_question_once(spark):
    """the pattern of words stands once in the expression, not within each run."""
    df = spark.createDataFrame([("How is the Big ring control of area-1 set",)], "q string").select(phrases.phrases(F.col("q")).alias("p"))
    assert plan(df).count("regexp_extract_all") <= 2
    assert df.first()["p"][0] == "big ring control of area-1 set"


def test_bm25_moves_no_postings(spark):
    """Documents are scored where they are read; texts of many batches, queries and documents without terms, none at all."""
    import math

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 12))) for _ in range(2500)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a bb a"), (2, "h zz"), (3, "zz"), (4, None)], "item_id long, text string")
    found = retrieval.bm25(docs, asked, 5)
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
    bags = [(t or "").split() for t in texts]
    mean, df = sum(map(len, bags)) / len(bags), lambda w: sum(w in b for b in bags)
    want = []
    for q, words in ((1, "a bb"), (2, "h zz")):
        idf = {w: math.log(1 + (len(bags) - df(w) + 0.5) / (df(w) + 0.5)) for w in words.split()}
        scores = {i: round(sum(idf[w] * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in idf), 6) for i, b in enumerate(bags) if set(idf) & set(b)}
        want += [(q, i, s, n) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    assert sorted((r["qid"], r["doc"], r["score"], r["rank"]) for r in found.collect()) == sorted(want)
    assert retrieval.bm25(docs.limit(0), asked).count() == 0 and retrieval.bm25(docs, asked.limit(0)).count() == 0


def test_page_headings_as_their_sql(spark, tmp_path):
    """references that the SQL leaves, the first of several headings, pages without any."""
    import duckdb

    from clausegraph.plans import registered

    pages = ["<h1>a &quot;b&quot; &amp;&amp</h1><p>x</p>", "<h1>one &lt;</h1><h1>two</h1>", "<p>none</p>", None, "<h1>&amp;lt; &#65;</h1>"]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registered()[1]["s5_page_headings"]).fetchall()
    found = registered()[0]["s5_page_headings"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["title"], r["n"]) for r in found) == sorted(want)


def test_vectors_leave_the_encoder_in_batches(spark):
    """A task holds the vectors of one small batch, not those of a part as Python's numbers."""
    import inspect

    from clausegraph.plans import store

    rows = spark.range(700).select(F.col("id").cast("string").alias("content"), F.lit(None).cast("array<float>").alias("embedding")).coalesce(1)
    found = store.embed_missing(rows, dim=16, batch=64).collect()
    assert len(found) == 700 and all(len(r["embedding"]) == 16 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in found)
    assert "found +=" not in inspect.getsource(store.embed_missing)


def test_dense_branch_encodes_where_it_scores(spark):
    """contents that lie in one task are encoded in many, and vectors never leave them; the same rows as by vectors made first."""
    from clausegraph.operators import retrieval as R
    from clausegraph.plans import service, store

    words = "order open rule closed part clause shall own".split()
    texts = [" ".join(random.Random(i).choices(words, k=i % 9)) + f" {i % 40}" for i in range(3000)] + [None, ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").coalesce(1)
    asked = spark.createDataFrame([(1, "which order shall be open"), (2, "a part of its own clause 7"), (3, None)], "qid long, question string")
    found = service._dense_branch(chunks, asked, 12, store.hashed)
    assert "RepartitionByExpression" in plan(found) and "ArrowEvalPython" not in plan(found)
    vectors = [service._unit_vectors(df, key, text, store.hashed).withColumnRenamed(key, "id") for df, key, text in ((chunks, "chunk_id", "content"), (asked, "qid", "question"))]
    want = R.dense(*vectors, 12, "id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 36


def test_hashed_is_as_by_single_words():
    """words hashed once a batch, against a loop over all of them."""
    import zlib

    import numpy as np
    import pandas as pd

    from clausegraph.plans import store

    texts = ["Open open \u00dcber rule", None, "", "  a\u00a0b\tc ", "open"]
    want = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            want[i, h % 16] += 1 if h >> 31 else -1
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    found = store.hashed(pd.Series(texts, dtype=object), 16)
    assert isinstance(found, np.ndarray) and (found == want / np.where(norms == 0, 1, norms)).all()
    assert store.hashed(pd.Series([], dtype=object), 16).shape == (0, 16)


def test_phrase_trees_count_heads_before_questions(spark):
    """phrases that no title can have drop out unshuffled, and heads are counted for a phrase before they meet questions; pinned and free questions, several pins, a pin that is null."""
    k = F.col("id").cast("int")
    heads = spark.range(24).select(k.alias("n"), F.concat(F.lit("s"), k % 4).alias("spec_id"), k.cast("string").alias("section_id"), F.concat(F.when(k < 6, "Ring control ").when(k < 10, "Bolt control ").otherwise("Other subject "), k.cast("string")).alias("title"))
    rows = heads.select((F.col("n") * 10).alias("chunk_id"), "spec_id", "section_id", "title", F.lit("x").alias("content"))
    kids = heads.crossJoin(spark.range(1, 4)).select((F.col("n") * 10 + F.col("id")).cast("int").alias("chunk_id"), "spec_id", F.concat("section_id", F.lit("."), F.col("id").cast("string")).alias("section_id"), F.lit("kid").alias("title"), F.lit("It shall").alias("content"))
    asked = spark.createDataFrame([(1, "the ring control of it"), (2, "a ring control"), (3, "bolt control"), (4, "ring control"), (5, "ring control"), (6, "nothing here"), (7, "ring control 5 of it"), (8, None)], "qid int, question string")
    pins = spark.createDataFrame([(2, "s1"), (2, "s1"), (4, "s0"), (4, "s1"), (4, "s2"), (4, None), (5, None)], "qid int, spec_id string")
    found = phrases.tree_phrases(asked, rows.unionByName(kids), pins)
    # six heads have "ring control" (two of s0, two of s1, one of s2 and s3): too many for 1 and, of three pins, for 4; four heads have "bolt control"
    assert sorted((r["qid"], r["phrase"], r["chunk_id"], r["spec_id"], r["n_kids"]) for r in found.collect()) == [(2, "ring control", 10, "s1", 3), (3, "bolt control", 60, "s2", 3), (7, "ring control 5", 50, "s1", 3)]
    assert sorted(r["phrase"] for r in phrases.likely(asked.select(F.explode(F.array_distinct(phrases.phrases(F.col("question")))).alias("phrase")), heads).collect()) == ["bolt control", "control 5", "ring control", "ring control 5"]


def test_names_in_text_moves_few_headings_by_broadcast(spark, monkeypatch):
    """blocks of few headings go to the runs, which move once; the same pairs where blocks move."""
    flows = spark.range(60).select("id", F.concat(F.lit("uses the small red ring here and item "), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "flow")
    heads = spark.range(90).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, "Small red ring").otherwise(F.concat(F.lit("and item "), F.col("id").cast("string"))).alias("title"))
    found = questions.names_in_text(flows, heads)
    assert "explode(sequence" not in plan(found) and "xxhash64(flow" not in plan(found)
    monkeypatch.setattr(questions, "BROADCAST_BYTES", 0)
    moved = questions.names_in_text(flows, heads)
    assert "xxhash64(flow" in plan(moved)
    want = [(f, h) for f in range(60) for h in range(90) if h % 3 == 0 or h == f]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, moved.collect())) == want


def test_neighbourhood_moves_edges_once(spark):
    """the edges of a clause meet without a window and as ids; a clause that stands twice among the chunks is still one."""
    from dataclasses import replace

    from clausegraph.operators import patterns
    from clausegraph.plans.graph import order_graph

    g = order_graph(spark, "/root/testdata/sf0.001")
    none = g.mentions.limit(0)
    messages, parameters = none.select("chunk_id", F.col("term").alias("message")), none.select("chunk_id", F.col("term").alias("parameter"))
    one = g.chunks.where("chunk_id = 7")
    found = patterns.neighbourhood(replace(g, chunks=g.chunks.unionByName(one)), one.select("chunk_id"), messages, parameters)
    assert "Window" not in plan(found)
    again = patterns.neighbourhood(g, one.select("chunk_id"), messages, parameters)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in again.collect()] and found.first()["n"] > 0


def test_words_are_met_once(monkeypatch):
    """op5_token_files: known words are looked up alone, new ones learned on the way; other texts go whole, as the library has them."""
    from clausegraph.llm import encode

    e = encode.Encoder(encode.default_path())
    odd = ["a", "a  b", "a\tb", " a", "a ", "\na", "a\n", "a\n\nb", "a\n b", "x <|endoftext|> y", "ab,.;! c?!", "...\n...", "a b c", "a \x1c b", "it's!\n'tis", "Ñandú\nñandú, ñ.", "word word,\nword word"]
    assert e.encode([None, "", *odd]) == [b"", b"", *e._raw(odd)]
    learned = []
    e.words.learn = lambda word: learned.append(word) or b""
    e.encode(["word word,\nword", "a c?!"])
    assert learned == []


def test_bootstrap_spreads_few_rows(spark):
    """e15: questions are spread before each becomes a row a round; one task had them all. Every weight follows from its hash."""
    import hashlib

    from clausegraph.operators import evaluation

    rows = [("g", str(i), (i * 7 % 11) / 10, (i * 5 % 13) / 10) for i in range(40)]
    pairs = spark.createDataFrame(rows, "group string, qid string, a double, b double")
    found = evaluation.hashed_bootstrap(pairs, rounds=60, seed=3)
    assert "RepartitionByExpression" in plan(found) and "conv(" not in plan(found)
    means = []
    for r in range(60):
        hs = [(int(hashlib.md5(f"3|{q}|{r}".encode()).hexdigest()[:8], 16), round(a - b, 6)) for _, q, a, b in rows]
        ws = [(sum(h >= t for t in evaluation.poisson_steps()), d) for h, d in hs]
        means.append(round(sum(w * d for w, d in ws) / sum(w for w, _ in ws), 9))
    one = found.first()
    assert one["p"] == round(min(1.0, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 60), 6)
    assert min(means) <= one["low"] <= one["high"] <= max(means)


def test_citations_are_tried_where_they_start():
    """p16 to p18: a pattern is tried at its words alone, and finds what a search of the whole text finds."""
    import random

    rng = random.Random(4)
    parts = ["3GPP", "  ", "\n", "TS", "tr", "ATS", "29.500", "23.501x", "23.501", "clause", "Clauses", "sub", "sub-", "Section", "clauſe", "sectıon", "İ", "Annex", "annex", "B.1", "4.1", "5-1", "Table", "figure", "of", "and", ",", "-", "x", "é"]
    tried = 0
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(20))
        specs, places, whole = extract._starts(text)
        patterns = [extract.SPEC_MENTION, *(p for _, p in extract.CITATIONS), *extract.WHOLE_SPEC]
        for pattern, starts in zip(patterns, [specs, *places, *whole], strict=True):
            assert [m.span() for m in extract._found(pattern, text, starts)] == [m.span() for m in pattern.finditer(text)]
            tried += len(starts or ())
    assert 0 < tried < 3000 * 9 * 10
    assert extract._starts("no such words here " * 50) == ([], [[]] * 5, [[]] * 3)


def test_co_occurrence_without_a_distinct_of_pairs(spark):
    """a chunk's terms meet in its own row; a map of all (pair, chunk) took the memory of a task."""
    from clausegraph.operators import patterns

    rows = [(c, t) for c, ts in {1: "abca", 2: "ab", 3: "cba", 4: "d", 5: ""}.items() for t in ts] + [(6, None), (6, "a"), (None, "a"), (None, "b")]
    found = patterns.co_occurrence(spark.createDataFrame(rows, "chunk_id int, term string"), 2)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 3), ("a", "c", 2), ("b", "c", 2)]
    assert "Join" not in plan(found) and "distinct" not in plan(found)


def test_name_bridge_spreads_a_shared_name(spark):
    """F8: one name of many terms and operations is met in many tasks, each pair once."""
    from clausegraph.operators import patterns

    named = spark.range(20).select(F.col("id").alias("op"), F.lit("Ring").alias("name")).union(spark.createDataFrame([(99, None)], "op long, name string"))
    terms = spark.range(300).select(F.col("id").alias("term"), F.lit("rING").alias("full_name"))
    found = patterns.name_bridge(named, terms).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 4
    assert found.count() == found.select("op", "term").distinct().count() == 6000


def tangled_layer(spark, seed):
    """A procedure layer with clauses in several procedures, repeated rows and nulls, its roots and named roots, and the closure by sets."""
    from clausegraph.operators import procedures as C

    rng = random.Random(seed)
    procs = [f"{a}{b}" for a in ("1", "10", "2", "3") for b in ("", ".1", ".1.2", ".2")]
    pick = lambda n, *of: [tuple(rng.choice(o) for o in of) for _ in range(n)]
    chunks, ops = range(60), range(8)
    clauses = pick(150, [*procs, None], [*chunks, None], ["main", "part", None])
    t = dict(
        procedures=[(p,) for p in procs], sub_of=pick(6, procs, procs), clauses=clauses + clauses[:20], uses=pick(25, procs, ops), op_defs=pick(12, ops, chunks),
        invokes=pick(10, procs, procs), same=pick(12, procs, procs, ["stage3", "stage2"]), messages=pick(20, procs, ops), message_defs=pick(9, ops, chunks),
    )
    types = dict(procedures="proc string", sub_of="proc string, parent string", clauses="proc string, chunk_id int, role string", uses="proc string, op int", op_defs="op int, chunk_id int")
    types |= dict(invokes="proc string, invoked string", same="proc string, other string, kind string", messages="proc string, message int", message_defs="message int, chunk_id int")
    layer = C.Procedures(**{k: spark.createDataFrame(v, types[k]) for k, v in t.items()})
    roots, named = [(1, "1.0"), (2, "2.1"), (2, "2"), (3, "none")], [(1, "3"), (2, "2"), (4, "10.1")]
    below = lambda asked, q: {p for i, r in asked if i == q for p in procs if f"{p}.".startswith(r.removesuffix(".0") + ".")}
    want = set()
    for q in (1, 2, 3, 4):
        ours = below(roots, q)
        for _ in range(2):
            ours = ours | {p for p, up in t["sub_of"] if up in ours}
        leads = {"named": below(named, q), "invoked": {b for a, b in t["invokes"] if a in ours}}
        leads["stage3"] = {y for a, b, kind in t["same"] if kind == "stage3" for x, y in ((a, b), (b, a)) if x in ours}
        want |= {(q, c, "main") for p, c, _ in clauses if p in ours} | {(q, c, role) for role, of in leads.items() for p, c, r in clauses if p in of and r == "main"}
        for role, used, defined in (("op_def", "uses", "op_defs"), ("msg_def", "messages", "message_defs")):
            want |= {(q, c, role) for p, o in t[used] if p in ours for o2, c in t[defined] if o2 == o}
    asked = [spark.createDataFrame(x, "qid int, root string") for x in (roots, named)]
    return layer, *asked, want


def test_closure_meets_places_not_clauses(spark):
    """questions meet the places of clauses; a distinct of all rows of all clauses took the memory of a task."""
    from clausegraph.operators import procedures as C

    for seed in (1, 2):
        layer, roots, named, want = tangled_layer(spark, seed)
        found = C.graph_closure(roots, layer, named)
        assert plan(found).startswith("Union")
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert {r["role"] for r in found.collect()} == set(C.GRAPH_ROLES)


def test_assembly_takes_the_first_clauses_of_places(spark):
    """the first clauses with content of each place are enough; a group and a sort of all rows took the memory of a task."""
    from clausegraph.operators import procedures as C

    layer, roots, named, want = tangled_layer(spark, 3)
    blank = {3, 11, 12, 40}
    chunks = spark.createDataFrame([(c, " \n" if c in blank else "x") for c in range(58)] + [(5, "x"), (None, "x")], "chunk_id int, content string")
    for most in (1, 4, 60):
        rows = set()
        for q in (1, 2, 3, 4):
            firsts = {}
            for c, role in {(c, r) for i, c, r in want if i == q and c is not None and c < 58 and c not in blank}:
                firsts[c] = min(firsts.get(c, 9), C.GRAPH_ROLES.index(role))
            rows |= {(q, c, C.GRAPH_ROLES[t], C.ROLES[C.GRAPH_ROLES[t]], n) for n, (t, c) in enumerate(sorted((t, c) for c, t in firsts.items())[:most], 1)}
        found = C.assembled_closure(roots, layer, chunks, named, most=most)
        assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert "windowspecdefinition(place" in plan(found)
