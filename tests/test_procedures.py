"""The procedure layer: expansion, the five branches, and how roles are put together."""

from clausegraph.operators import procedures as C
from clausegraph.operators import questions as Q


def layer(spark):
    f = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    return C.Procedures(
        procedures=f([("a.1",), ("a.1.2",), ("a.10",), ("b",), ("s1",), ("s2",), ("s3",), ("n.1",)], "proc"),
        sub_of=f([("s1", "a.1"), ("s2", "s1"), ("s3", "s2"), ("a.1", "s2")], "proc parent"),
        clauses=f([("a.1", "c1", "main"), ("a.1.2", "c2", "part"), ("a.10", "c10", "main"), ("s1", "c3", "part"), ("s2", "c4", "main"), ("s3", "c5", "main"), ("b", "c6", "main"), ("b", "c7", "part"), ("n.1", "c8", "main"), ("n.1", "c9", "part")], "proc chunk_id role"),
        uses=f([("s2", "op"), ("s3", "far")], "proc op"),
        op_defs=f([("op", "d1"), ("op", "c1"), ("far", "d2")], "op chunk_id"),
        invokes=f([("s1", "b"), ("b", "a.10")], "proc invoked"),
        same=f([("b", "a.1", "stage3"), ("a.1", "a.10", "stage2")], "proc other kind"),
        messages=f([("a.1.2", "m")], "proc message"),
        message_defs=f([("m", "e1"), ("m2", "e2")], "message chunk_id"),
    )


def test_graph_closure(spark):
    root = spark.createDataFrame([(1, "a.1.0"), (2, "none")], "qid int, root string")
    named = spark.createDataFrame([(1, "n")], "qid int, root string")
    rows = {(r["qid"], r["chunk_id"], r["role"]) for r in C.graph_closure(root, layer(spark), named).collect()}
    main = {(1, c, "main") for c in ("c1", "c2", "c3", "c4")}  # a.10 isn't below a.1, s3 is three steps away
    assert rows == main | {(1, "d1", "op_def"), (1, "c1", "op_def"), (1, "c6", "invoked"), (1, "c6", "stage3"), (1, "e1", "msg_def"), (1, "c8", "named")}


def test_expansion_ends_in_rings(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b"), ("d", "a"), ("d", "c")], "proc string, parent string")
    found = C.expand(spark.createDataFrame([(1, "a"), (1, "a")], "qid int, proc string"), edges, 3)
    assert sorted((r["proc"], r["steps"]) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]


def test_assembly_takes_the_first_role_and_the_first_clauses(spark):
    rows = spark.createDataFrame([(1, "a", "msg_def"), (1, "a", "invoked"), (1, "b", "main"), (1, "c", "named"), (1, "empty", "main"), (1, "z", "unknown"), (2, "c", "stage3")], "qid int, chunk_id string, role string")
    chunks = spark.createDataFrame([(c, "x") for c in "abcz"] + [("empty", " \n")], "chunk_id string, content string")
    found = C.assemble(rows, chunks, most=2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "b", "main", 1.0, 1), (1, "c", "named", 0.7, 2), (2, "c", "stage3", 0.6, 1)]
    assert [r["role"] for r in C.assemble(rows.where("chunk_id = 'a'"), chunks).collect()] == ["invoked"]


def test_roles_by_texts(spark):
    chunks = spark.createDataFrame(
        [("m", "s", "2", "Flow", "It performs the policy association establishment procedure and more."), ("k", "s", "5", "Policy association establishment procedure", "x"), ("r", "t", "1", "Other", "x"), ("q", "t", "2", "Charging data reset", "x"), ("u", "v", "1", "Charging data reset", "x"), ("n", "s", "7", "Named", "x"), ("nn", "s", "7.1", "Below", "x")],
        "chunk_id string, spec_id string, section_id string, title string, content string",
    )
    roots, named = (spark.createDataFrame([(1, c)], "qid int, chunk_id string") for c in "mn")
    refs = spark.createDataFrame([("m", "r")], "src string, dst string")
    asked = spark.createDataFrame([(1, "how is charging data reset in the flow")], "qid int, question string")
    rows = Q.closure(roots, chunks, refs, named=named, texts=True, questions=asked).collect()
    assert {(r["chunk_id"], r["role"]) for r in rows} == {("m", "main"), ("n", "named"), ("nn", "named"), ("r", "ref"), ("k", "named_in_text"), ("q", "cited_spec")}


def test_orphans_and_shortlists(spark):
    from clausegraph.operators import fusion, hierarchy

    targets = spark.createDataFrame([(t,) for t in ("a", "a-1", "a-1-2", "a-", "b", "b1", "c", "c")], "target string")
    ids = spark.createDataFrame([("a-1-2-3",), ("b1-7",), ("d",)], "id string")
    assert {r["target"] for r in hierarchy.orphan_targets(targets, ids).collect()} == {"a-", "b", "c"}
    heads = spark.createDataFrame([("x1", 1, "paging area", "", 1), ("x2", 1, "paging area", "", 5), ("x3", 1, "other", "paging", 1), ("x4", 1, "void", "none", 1), ("y", 2, "paging", "", 1)], "chunk_id string, spec_id int, title string, path string, size int")
    asked = spark.createDataFrame([(7, "paging", 1), (8, "paging", 2), (9, "paging", 3)], "qid int, question string, spec_id int")
    rows = fusion.shortlist(asked, heads).orderBy("qid", "score").collect()
    assert {(r["qid"], r["chunk_id"]) for r in rows} == {(7, "x1"), (7, "x2"), (7, "x3"), (8, "y")}
    assert fusion.shortlist(asked, heads, k=1).where("qid = 7").first()["chunk_id"] == "x2"
