"""Closures in order, siblings, neighbourhoods, scope warnings, judges against raters, checks of a graph, fetches by id."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import fusion, hierarchy, patterns, questions, retrieval
from clausegraph.plans import store
from clausegraph.plans.graph import Graph

CHUNK = "chunk_id string, spec_id string, section_id string, title string, content string, chunk_type string"


def brute_order(question, docs):
    """(doc, place) of docs (doc, rank, text), written once more from the docstring."""
    cut = lambda t: [w for w in re.findall(r"[a-z0-9_']+", (t or "").lower()) if w not in T.MATCH_STOP]
    docs = sorted(docs, key=lambda d: d[1])
    words, asked, n = [cut(d[2]) for d in docs], set(cut(question)), len(docs)
    if n < 2:
        return [d[0] for d in docs]
    mean = sum(map(len, words)) / n or 1
    df = Counter(w for ws in words for w in set(ws))
    bm = []
    for ws in words:
        tf = Counter(ws)
        bm.append(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in asked if w in tf))
    low, high = min(bm), max(bm)
    score = [(b - low) / (high - low) + 1 - i / (n - 1) if high > low else 1 - i / (n - 1) for i, b in enumerate(bm)]
    return [docs[i][0] for i in sorted(range(n), key=lambda i: (-round(score[i], 6), i))]


def test_closures_by_brute_force(spark):
    texts = ["the AMF sends a reject to the UE", "registration reject cause values", None, "", "paging of idle UE's, paging again", "registration registration registration", "what is this"]
    asked = {1: "why does the AMF send a registration reject", 2: "paging", 3: "words of no text", 4: "reject", 5: None}
    pools = {1: range(7), 2: range(7), 3: range(4), 4: [1], 5: [0, 1, 5]}
    rows = [(q, d, 10 * k + 3, texts[d]) for q, ds in pools.items() for k, d in enumerate(ds)]
    found = retrieval.rank_closure(spark.createDataFrame(rows, "qid int, doc int, rank int, text string"), spark.createDataFrame(list(asked.items()), "qid int, question string"))
    by = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["qid"], r["place"])):
        by[r["qid"]].append(r["doc"])
    assert by == {q: brute_order(asked[q] or "", [(d, rank, t) for p, d, rank, t in rows if p == q]) for q in pools}
    assert retrieval.rank_closure(spark.createDataFrame([], "qid int, doc int, rank int, text string"), spark.createDataFrame([], "qid int, question string")).count() == 0


def test_siblings_by_edge_then_prefix(spark):
    says = {"5.1": "it SHALL", "5.2": "may", "5.3": "shall", "5.4": None, "5.4.1": "shall", "6.1": "shall", "6.2": "may"}
    rows = [(s, "a", s, "t", c, "general") for s, c in says.items()] + [("5", "a", "5", "t", "x", "general"), ("b5.9", "b", "5.9", "t", "shall", "general")]
    near = lambda seeds, **k: [(r["seed"], r["chunk_id"], r["source"]) for r in hierarchy.siblings(spark.createDataFrame([(s,) for s in seeds], "chunk_id string"), spark.createDataFrame(rows, CHUNK), **k).orderBy("seed", "rank").collect()]
    assert near(["5.1"]) == [("5.1", "5.3", "edge"), ("5.1", "5.2", "prefix"), ("5.1", "5.4", "prefix")]
    assert near(["6.1", "5.4.1", "5"]) == [("6.1", "6.2", "prefix")]  # section 6 is not there: no edge
    assert near(["5.2", "5.2"], most=2) == [("5.2", "5.1", "edge"), ("5.2", "5.3", "edge")] and near([]) == []


def test_many_children_of_one_parent(spark):
    rows = [(f"c{k:05}", "a", f"1.{k}", "t", "shall" if k % 3 == 0 else "may", "general") for k in range(1, 3001)] + [("c0", "a", "1", "t", "x", "general")]
    chunks = spark.createDataFrame(rows, CHUNK)
    found = hierarchy.siblings(chunks.select("chunk_id"), chunks).groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "edge").alias("edges"), F.max("rank").alias("last")).collect()
    assert len(found) == 3000 and all((r["n"], r["edges"], r["last"]) == (10, 10, 10) for r in found)


def test_neighbourhood_forms(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    g = Graph(
        chunks=df([("a", "s1", "1", "Head", "", "general"), ("b", "s2", "1", None, "", "general")], CHUNK), terms=df([("T",)], "term string"), mentions=df([("a", f"T{k:02}") for k in range(14)], "chunk_id string, term string"),
        operations=df([("O", "x")], "op string, service string"), describes=df([("a", "O")], "chunk_id string, op string"), provided=df([("O", "AMF"), ("O", "SMF")], "op string, term string"),
        steps=df([("a::1", "a", 1)], "step_id string, chunk_id string, ord int"), involves=df([("a::1", "AMF")], "step_id string, term string"), refs=df([("a", "b", True, "clause", 1.0), ("b", "a", False, "clause", 1.0)], "src string, dst string, is_external boolean, ref_type string, confidence double"),
    )
    found = patterns.neighbourhood(g, df([("a",), ("b",), ("a",), ("z",)], "chunk_id string"), df([("a", "M")], "chunk_id string, message string"), df([("P", "a"), ("P", "a")], "parameter string, chunk_id string"))
    mentions = ", ".join(f"T{k:02}" for k in range(12))
    a = f"[s1 §Head]\n  O PROVIDED_BY AMF\n  O PROVIDED_BY SMF\n  a::1 INVOLVES AMF\n  a DESCRIBES_MESSAGE M\n  Parameter[P] DEFINED_IN_TABLE a\n  a MENTIONS {mentions}\n  s1 REFERENCES_SPEC s2"
    assert {tuple(r) for r in found.collect()} == {("a", 18, a), ("b", 0, "[s2 §]\n  (no graph relations)")}


def test_scope_warnings(spark):
    q = "Is Nabc_D_E over the 'N99' reference point or N2 reference-point (AMF) (XYZ) (QQ) of 6G at a monthly price?"
    asked = spark.createDataFrame([(1, q), (2, None), (3, "NABC_D and N2 alone")], "qid int, question string")
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    found = lambda **k: [tuple(r) for r in questions.scope_warnings(asked, one("term", "AMF"), one("op", "Nudm_SDM_Get"), **k).orderBy("qid", "rank").collect()]
    assert found(titles=one("title", "The n2 point", "N990", None), most=9) == [(1, w, k + 1) for k, w in enumerate(["out of scope: 6g", "out of scope: monthly price", "unknown operation Nabc_D_E", "unknown reference point N99", "unknown abbreviation XYZ", "unknown abbreviation QQ"])]
    assert [w for _, w, _ in found(resolved=spark.createDataFrame([(1, "XYZ"), (3, "QQ")], "qid int, term string"))] == ["out of scope: 6g", "out of scope: monthly price", "unknown operation Nabc_D_E", "unknown abbreviation QQ"]


def test_judges_against_raters(spark):
    judged = {(1, "a"): "RELEVANT", (1, "b"): "PARTIAL", (2, "a"): "RELEVANT", (3, "c"): "NOT_RELEVANT", (4, "x"): "odd"}
    ratings = [(1, "r", "full", ["b", "b"]), (1, "s", "partial", None), (2, "r", "full", ["z"]), (3, "r", "none", ["c"]), (4, "r", "full", []), (9, "r", "full", ["a"]), (2, "t", None, [])]
    want = Counter()
    for q, _, says, no in ratings:
        labels = [v for (p, _), v in judged.items() if p == q and v in fusion.JUDGED]
        if labels and says:
            want["question", min(labels, key=fusion.JUDGED.index), says] += 1
        for (p, d), v in judged.items():
            if p == q and v in fusion.JUDGED:
                want["chunk", v, "irrelevant" if d in (no or []) else "relevant"] += 1
    rows = lambda j, r: fusion.judge_confusion(spark.createDataFrame(j, "qid int, doc string, label string"), spark.createDataFrame(r, "qid int, rater string, says string, irrelevant array<string>")).collect()
    found = rows([(q, d, v) for (q, d), v in judged.items()], ratings)
    assert len(found) == 15 and {k[:3]: k[3] for k in map(tuple, found) if k[3]} == dict(want)
    assert [r["n"] for r in rows([], [])] == [0] * 15


def test_checks_of_a_graph(spark):
    terms = spark.createDataFrame([("AMF",), ("AMF",)], "term string")
    values = lambda *rows: spark.createDataFrame(rows, "concept string, name string, code string")
    check = lambda v: {(r["part"], r["name"]): (r["n"], r["holds"]) for r in fusion.validate({"full": terms, "bare": terms.where("false")}, terms, ["AMF", "SMF"], v, ("SST", "URLLC", "2")).collect()}
    base = {("edge", "full"): (2, True), ("edge", "bare"): (0, False), ("term", "AMF"): (2, True), ("term", "SMF"): (0, False)}
    for rows, want in (([("SST", "URLLC", "2")], (1, True)), ([("SST", "URLLC", "3")], (1, False)), ([("SST", "URLLC", None)], (1, False)), ([("QCI", "URLLC", "2")], (0, False))):
        assert check(values(*rows)) == base | {("value", "SST:URLLC"): want}


def test_fetch(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, v string")
    ids = spark.createDataFrame([(1,), (1,), (7,), (None,)], "id long")
    for most in (store.BROADCAST_BYTES, 0):
        monkeypatch.setattr(store, "BROADCAST_BYTES", most)
        assert Counter(map(tuple, store.fetch(rows, ids, "id").collect())) == Counter([(1, "a", True), (1, "b", True), (7, None, False), (None, None, False)])
    assert store.fetch(rows, ids.where("false"), "id").count() == 0
