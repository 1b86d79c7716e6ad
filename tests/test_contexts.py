"""Located segments, packed contexts, clause-tree phrases."""

import random
import re

from pyspark.sql import functions as F

from clausegraph.operators import contexts as C
from clausegraph.operators import phrases as P


def test_places_are_those_of_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab \n\tü😀 ", k=rng.randrange(40)))
        places = C.Places(text)
        assert places.flat == re.sub(r"\s", "", text)
        assert [text[places.of(i)] for i in range(len(places.flat))] == list(places.flat)
        assert sorted({places.of(i) for i in range(len(places.flat))}) == [i for i, c in enumerate(text) if not c.isspace()]


def test_segments_rebuild_the_text():
    rng = random.Random(2)
    cell = lambda: "".join(rng.choices("xyz ", k=rng.randrange(4)))
    for _ in range(300):
        tables = [{"headers": [cell() for _ in range(2)], "rows": [[cell() for _ in range(2)] for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(3))]
        text = "".join(rng.choice([cell(), " ", "\n", *["\n".join("\t".join(r) for r in (t["headers"], *t["rows"])) for t in tables]]) for _ in range(8))
        found = list(C.located(text, tables))
        assert "".join(text[s["start"] : s["stop"]] for s in found) == text
        assert all(a["stop"] == b["start"] for a, b in zip(found, found[1:], strict=False))
        for s in found:
            if s["kind"] == "table":
                assert C.squeeze(text[s["start"] : s["stop"]]) == C.squeeze("".join(s["headers"]) + "".join("".join(r) for r in s["rows"]))


def test_segments_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", []), (3, "a b", [(None, None)]), (4, "H 1 2", [(["H"], [["1", None], ["2", "3"]])]), (5, "H", [(["H"], None)])]
    df = spark.createDataFrame(rows, f"id int, c string, t {C.TABLES}")
    found = {r["id"]: [(s["kind"], s["start"], s["stop"], s["truncated"]) for s in r["s"]] for r in df.select("id", C.table_segments(F.col("c"), F.col("t")).alias("s")).collect()}
    assert found == {1: [("text", 0, 0, False)], 2: [("text", 0, 0, False)], 3: [("text", 0, 3, False)], 4: [("table", 0, 3, True), ("text", 3, 5, False)], 5: [("table", 0, 1, False)]}


def test_fit_keeps_what_matters(spark):
    parts = ["alpha " * 40, "beta " * 50, "gamma " * 40, "delta " * 45]
    text = "\n\n".join(p.strip() for p in parts)
    rows = [(1, 1, 1, "beta delta", text), (1, 2, 2, "beta delta", "short"), (1, 3, 3, "beta delta", "one " * 300), (1, 4, 4, "beta delta", None), (2, 1, 1, "x", "q" * 900)]
    df = spark.createDataFrame(rows, "qid int, doc int, rank int, question string, content string").withColumns({"spec_id": F.lit("ts_1"), "section_id": F.lit("4.2")})
    score = lambda q, s: F.size(F.array_intersect(F.split(q, " "), F.split(s, " ")))
    found = {r["qid"]: r for r in C.packed(df, score, total=700, a_chunk=520).collect()}
    first = f"[ts_1 §4.2]\n{parts[1].strip()}{C.GAP}{parts[3].strip()}"
    assert found[1]["context"] == C.RULE.join([first, "[ts_1 §4.2]\nshort", "[ts_1 §4.2]\n"]) and found[1]["used"] == [1, 2, 4]
    assert found[2]["context"] == "[ts_1 §4.2]\n" + "q" * 520 + "…"
    own = C.packed(df.where("qid = 2").withColumn("evidence", F.lit("step 3")), score, provenance=False).collect()
    assert [(r["context"], r["used"]) for r in own] == [("step 3", [1])]


def test_phrases_and_trees(spark):
    asked = spark.createDataFrame([(1, "What is the Localised service area of a network?"), (2, None), (3, "the of"), (4, "service area")], "qid int, question string")
    said = {r["qid"]: r["p"] for r in asked.select("qid", P.phrases(F.col("question")).alias("p")).collect()}
    assert said[1][:4] == ["localised service area of a network", "service area of a network", "area of a network", "localised service area"] and said[2] == said[3] == [] and said[4] == ["service area"]
    rows = []
    for n, (title, kids) in enumerate([("Localised service areas", 3), ("Service area x", 4), ("My service-area", 5), ("Service area few", 2)]):
        rows += [(f"{n}", "s", f"{n + 1}", title, "x")] + [(f"{n}.{k}", "s", f"{n + 1}.{k}", "t", "it SHALL be") for k in range(kids)]
    chunks = spark.createDataFrame(rows, "chunk_id string, spec_id string, section_id string, title string, content string")
    trees = {r["qid"]: (r["phrase"], r["chunk_id"], r["n_kids"]) for r in P.tree_phrases(asked, chunks).collect()}
    assert trees == {1: ("localised service area", "0", 3), 4: ("service area", "1", 4)}
    assert P.tree_phrases(asked, chunks, most_parents=1).where("qid = 4").count() == 0
    assert P.tree_phrases(asked, chunks, specs=spark.createDataFrame([(4, "other")], "qid int, spec_id string")).where("qid = 4").count() == 0


def test_contained_is_a_substring_search(spark):
    rng = random.Random(3)
    titles = [(i, "".join(rng.choices("abC ", k=rng.randrange(12)))) for i in range(80)]
    asked = ["".join(rng.choices("abc ", k=rng.randrange(1, 8))) for _ in range(60)]
    found = P.contained(spark.createDataFrame([(a,) for a in asked], "phrase string"), spark.createDataFrame(titles, "chunk_id int, title string"))
    assert {tuple(r) for r in found.collect()} == {(a, i) for a in asked for i, t in titles if a in t.lower()}


def test_concepts_against_a_search_of_every_form(spark):
    from clausegraph.operators import concepts as X

    names = ["PositioningMethod", "EPS QCI", "QCI", "IETYPE", "NgapIeType", "Cause", "Enumerated", "SST", "5G-GUTI", "a+b", "ab", "status", "smContextStatus", "C++"]
    texts = ["Which positioning   methods and PositioningMethods?", "the EPS QCIs, not xQCI", "qci_1 and ie types", "ngap information element types of IE TYPE", "cause because enumerated sst.", "5g guti or 5G-GUTIs", "a+b aab A+Bs", "SM context\nstatus", "c++ c++s", None, ""]
    want = {
        0: ["PositioningMethod"], 1: ["EPS QCI", "QCI"], 2: ["IETYPE", "QCI"], 3: ["NgapIeType", "IETYPE"], 4: ["SST"],
        5: ["5G-GUTI"], 6: ["a+b"], 7: ["smContextStatus"], 8: ["C++"],
    }
    asked = spark.createDataFrame(list(enumerate(texts)), "qid int, question string")
    found = {}
    for r in X.concepts_in(asked, spark.createDataFrame([(n,) for n in names * 2], "name string"), most=None).orderBy("qid", "place").collect():
        found.setdefault(r["qid"], []).append(r["name"])
    assert found == want
    assert X.concepts_in(asked, spark.createDataFrame([], "name string")).count() == 0
