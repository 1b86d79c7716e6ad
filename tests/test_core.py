"""Text, ingestion, extraction, question, service and review operators on small hand-made cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import chunking, evaluation, extract, questions, retrieval, review
from clausegraph.plans import service
from clausegraph.plans.graph import order_graph
from clausegraph.sources import documents
from clausegraph.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_headings(spark):
    h = lambda s: (r := one(spark, T.heading(F.col("s")), s=s)) and (r["id"], r["title"])
    assert h("5.2.1 Registration") == ("5.2.1", "Registration")
    assert h("5.8a\tKeys") == ("5.8a", "Keys") and h("A.1\tAnnex part") == ("A.1", "Annex part")
    assert h("5G system") is None and h("plain") is None
    a = lambda s: (r := one(spark, T.annex(F.col("s")), s=s)) and (r["id"], r["title"])
    assert a("Annex A (normative):\tKeys") == ("A", "Keys") and a("Annex B:") == ("B", "Annex B")
    assert a("Annex A (normative):\tKeys\t12") is None and a("Annex A contains") is None
    assert one(spark, T.is_change_history(F.col("s")), s=" Change  history ") is True


def test_ids(spark):
    assert one(spark, T.prefixes(F.col("s")), s="5.2.1") == ["5", "5.2"] and one(spark, T.prefixes(F.col("s")), s="5") == []
    assert one(spark, T.parent_id(F.col("s")), s="5.2.1") == "5.2" and one(spark, T.parent_id(F.col("s")), s="5") is None
    assert one(spark, T.spec_id(F.col("s")), s="see TS 23.501") == "ts_23_501"
    assert one(spark, T.series(F.col("s")), s="/a/23_series/x.docx") == "23" and one(spark, T.series(F.col("s")), s="/a/38101-1.docx") == "38"
    for name, want in (("23501-i80.docx", True), ("31121-i40_s01-s03_5.docx", True), ("23501-rm.docx", False), ("._23501-i80.docx", False), ("38101_cover.docx", False), ("notes.docx", False)):
        assert one(spark, T.is_main_body(F.col("s")), s=name) is want


@pytest.mark.parametrize(("title", "content", "want"), [("General", "", "definition"), ("Call flow", "", "procedure"), ("Policies", "", "parameter"), ("X", "It shall be", "requirement"), ("N2 API", "", "interface"), ("X", "y", "general"), ("Normative text", "", "reference")])
def test_content_type(spark, title, content, want):
    assert one(spark, T.content_type(F.col("t"), F.col("c")), t=title, c=content) == want


def test_complexity_against_python(spark):
    import re

    text = "The AMF and SMF (see clause 5 and table 6, TS 23.501) shall. " * 7
    tech = sum(len(re.findall(p, text)) for p in T.TECHNICAL)
    assert one(spark, T.complexity(F.col("s")), s=text) == round(min(1, len(text.split()) / 1000 * 0.5 + tech / 50 * 0.5), 3)


def test_rounding_is_python_s(spark):
    import random

    rng = random.Random(1)
    xs = [k / 2000 for k in range(2001)] + [k / 1000 * 0.5 + j / 50 * 0.5 for k in range(0, 900, 7) for j in range(12)] + [rng.random() for _ in range(500)]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.rounded(F.col("x"), 3).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 3) for r in found)


def brute_split(content, limit):
    if len(content) <= limit:
        return [content]
    out, held, size = [], [], 0
    for line in content.split("\n"):
        if held and size + len(line) + 1 > limit:
            out.append("\n".join(held))
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    return [*out, "\n".join(held)]


def test_split_and_segments(spark):
    for content in ("a\nb", "aaaa\nbbbb\ncc\n" + "d" * 30 + "\ne\n\nf", "\n" * 20, "x" * 50):
        assert one(spark, T.split_lines(F.col("s"), 10), s=content) == brute_split(content, 10)
    assert one(spark, T.segments(F.col("s"), 1), s="intro\n1.\tone\n2.\ttwo") == ["intro", "1.\tone", "2.\ttwo"]
    assert one(spark, T.segments(F.col("s"), 1), s="a\n\nb") == ["a", "b"]
    assert one(spark, T.segments(F.col("s"), 200), s="a\nb\nc") == ["a\nb\nc"]
    assert one(spark, T.preview(F.col("s"), 5), s="ab\ncdefg") == "ab cd..."
    assert one(spark, T.without_choices(F.col("s")), s="What?\nA. x\nB. y") == "What?"
    assert one(spark, T.without_thinking(F.col("s")), s="<think>hm</think> yes") == "yes"
    assert one(spark, T.tokens(F.col("s")), s="Nudm_SDM_Get is-A b2") == ["nudm_sdm_get", "is", "a", "b2"]
    assert one(spark, T.stem(F.col("s")), s="registrations") == "registr" and one(spark, T.stem(F.col("s")), s="bed") == "bed"


def docx(*paragraphs, table=None):
    def p(style, said):
        runs = "<w:tab/>".join(f"<w:t>{x}</w:t>" for x in said.split("\t"))
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r>{runs}</w:r></w:p>'

    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p('Normal', c)}</w:tc>" for c in r) + "</w:tr>" for r in table or [])
    body = "".join(p(s, t) for s, t in paragraphs) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_to_chunks_and_back(spark, tmp_path):
    data = docx(("Normal", "3GPP TS 23.501 V18.9.0"), ("Heading1", "1\tScope"), ("Normal", "The AMF shall."), ("Heading1", "2\tTop"), ("Heading2", "2.1\tRegistration procedure"), ("Normal", "See clause 1 and TS 29.500 clause 4.2."), ("Heading2", "2.1\tAgain"), ("Normal", "more"), ("Normal", "Annex A (normative):\tKeys"), ("Normal", "key text"), ("Heading1", "Annex Z: Change history"), ("Normal", "gone"), table=[["x", "y"]])
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("deep/23501-i90.docx", data)
        z.writestr("deep/23501_cover.docx", data)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(outer.getvalue())
    (tmp_path / "in/bad.zip").write_bytes(b"not a zip")
    files = documents.zip_members(spark, f"file://{tmp_path}/in")
    elements = documents.docx_elements(files)
    about = documents.metadata(elements)
    assert tuple(about.select("spec_id", "version", "release").first()) == ("ts_23_501", "18.9.0", "Rel-18")
    rows = chunking.chunks(chunking.sections(elements), about)
    got = {r["chunk_id"]: r for r in rows.collect()}
    assert set(got) == {"ts_23_501_1", "ts_23_501_2.1", "ts_23_501_2.1~2", "ts_23_501_A"}
    reg = got["ts_23_501_2.1"]
    assert reg["section_path"] == ["Top"] and reg["section_path_ids"] == ["2"] and reg["chunk_type"] == "procedure"
    assert [x["ref_id"] for x in reg["cross_references"]["external"] if x["ref_type"] == "clause"] == ["1", "4.2"]
    assert got["ts_23_501_1"]["content_metadata"]["key_terms"] == ["AMF"]
    assert chunking.violations(rows).count() == 0
    documents.write_documents(rows, f"file://{tmp_path}/json")
    back = documents.read_documents(spark, f"file://{tmp_path}/json")
    assert {r["chunk_id"]: r["content"] for r in back.collect()} == {k: v["content"] for k, v in got.items()}
    query = ingest.ingest(ingest.clause_stream(spark, f"file://{tmp_path}/json"), f"{tmp_path}/table", f"{tmp_path}/cp")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 4


def test_html_elements(spark):
    page = "<h1>1 Scope</h1><script>x='</p>'</script><p>a<br>b<table><tr><th>H<td>I<tr><td>1<td>2</table><h2>1.1 More</h2><p>c"
    rows = documents.html_elements(spark.createDataFrame([("p", page)], "path string, content string")).orderBy("pos").collect()
    assert [(r["tag"], r["text"]) for r in rows if r["tag"] != "table"] == [("h1", "1 Scope"), ("p", "a\nb"), ("h2", "1.1 More"), ("p", "c")]


def test_violations(spark):
    schema = "chunk_id string, spec_id string, section_id string, content string, cross_references " + documents.REFERENCE + ", content_metadata struct<word_count: int>, section_path array<string>, section_path_ids array<string>"
    ref = {"internal": [], "external": [{"target_spec": "ts_23_501", "ref_type": "spec", "ref_id": "", "confidence": 0.8}, {"target_spec": "bad", "ref_type": "spec", "ref_id": "", "confidence": 0.8}]}
    rows = [("x_1", "ts_23_501", "?", " ", ref, (1,), ["a"], []), ("x_1", "bad", "1", "a b", ref, (2,), [], [])]
    found = {r["check"] for r in chunking.violations(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"spec_id format", "section_id format", "empty content", "chunk prefix", "unique ids", "target format", "self reference", "path shape", "word count"}


def test_citations():
    near = "See TS 29.500 clause 5.2, " + "x" * 120 + " clause 6.1.4.1a. clauses 4.16.4, 4.16.5 and A.2; Annex B.1; table 5-1."
    found = extract.cite(near, "ts_23_501")
    assert {"ref_type": "clause", "ref_id": "6.1.4.1a"} in found["internal"] and {"ref_type": "table", "ref_id": "5-1"} in found["internal"]
    assert [r["ref_id"] for r in found["internal"] if r["ref_type"] == "clause"] == ["6.1.4.1a", "B.1", "4.16.4", "4.16.5", "A.2"]
    assert {(r["target_spec"], r["ref_type"], r["ref_id"], r["confidence"]) for r in found["external"]} == {("ts_29_500", "clause", "5.2", 0.9), ("ts_29_500", "spec", "", 0.8)}
    assert extract.cite("TS 23.501 clause 5", "ts_23_501") == {"internal": [{"ref_type": "clause", "ref_id": "5"}], "external": []}
    assert extract.cite("requirements 5.2.2.10", "ts_1")["external"] == [] and extract.cite(None, None) == {"internal": [], "external": []}


CH = "chunk_id string, spec_id string, title string, content string, chunk_type string"


def test_terms(spark):
    rows = [("c1", "ts_23_501", "", "For the purposes of\nAMF\tAccess and Mobility Function\nSMF  Session Function\nab\tno", ""), ("c2", "ts_1", "", "PDU session: a connection of a kind\n\"key\": something long enough\nshort: x", "")]
    chunks = spark.createDataFrame(rows, CH)
    assert {(r["term"], r["full_name"]) for r in extract.abbreviations(chunks).collect()} == {("AMF", "Access and Mobility Function"), ("SMF", "Session Function")}
    assert {(r["term"], r["full_name"]) for r in extract.definitions(chunks).collect()} == {("PDU session", "a connection of a kind")}


def brute_merge(rows):
    out = {}
    for _, term, name, spec, _kind in sorted(rows):
        fine = spec.startswith(extract.PREFERRED)
        if term not in out:
            out[term] = {"name": name, "spec": spec, "specs": [spec], "cites": [(name, fine)]}
            continue
        e = out[term]
        e["specs"] += [spec] * (spec not in e["specs"])
        e["cites"].append((name, fine))
        was = e["spec"].startswith(extract.PREFERRED)
        new, old = (sum(f for n, f in e["cites"] if n == x) for x in (name, e["name"]))
        if (fine and not was) or (fine and was and name != e["name"] and (new > old or (new == old and spec < e["spec"]))):
            e["name"], e["spec"] = name, spec
    return {k: (e["name"], e["spec"], e["specs"]) for k, e in out.items()}


def test_merge_terms(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice("AB"), rng.choice("xyz"), rng.choice(["ts_1", "ts_2", "ts_23_501", "ts_23_502", "ts_38_331"]), "abbreviation") for i in range(40)]
    found = extract.merge_terms(spark.createDataFrame(rows, "seq int, term string, full_name string, spec_id string, term_type string")).collect()
    assert {r["term"]: (r["full_name"], r["primary_spec"], r["source_specs"]) for r in found} == brute_merge(rows)


def test_subjects(spark):
    s = lambda t, n, c, i="ts_23_501": tuple(one(spark, extract.subject(F.col("t"), F.col("n"), F.col("c"), F.col("i")), t=t, n=n, c=c, i=i))
    assert s("definition", "", "") == ("Lexicon", 0.95) and s("", "Terminology", "") == ("Lexicon", 0.9)
    assert s("", "x", "the timer and the message") == ("Standards specifications", 0.8)
    assert s("", "Overview of architecture", "") == ("Standards overview", pytest.approx(0.9))
    assert s("", "x", "a theorem and its proof") == ("Research publications", pytest.approx(0.8))
    assert s("", "x", "a survey") == ("Research overview", 0.7) and s("", "x", "y") == ("Standards specifications", 0.6) and s("", "x", "y", "z") == ("Research overview", 0.5)


def test_operations_messages_steps(spark):
    flow = "Figure 1 illustrates the procedure\n1.\tAMF asks\n2.\tSMF answers\n3.\tend"
    rows = [("c1", "s", "Flow", flow, "general"), ("c2", "s", "x", "1.\ta\n2.\tb\n3.\tc", "procedure"), ("c3", "s", "x", "1.\ta\n2.\tb\n3.\tc", "general"), ("c4", "s", "the procedure", "1\ta\n2\tb\n3\tc", "general"), ("c5", "s", "call flow", "5.\ta\n6.\tb\n7.\tc", "general"), ("c6", "s", "x", "Nudm_SDM_Get and Nxyz_A_B REGISTRATION REQUEST", "general"), ("c7", "s", "x", "REGISTRATION\nREQUEST and ATTACH REQUEST", "general"), ("c8", "s", "x", "a REGISTRATION REQUEST", "general")]
    chunks = spark.createDataFrame(rows, CH)
    assert {r["chunk_id"]: r["pattern"] for r in extract.with_flow(chunks).where("pattern is not null").collect()} == {"c1": 1, "c2": 1, "c4": 2}
    steps = extract.steps(chunks)
    assert {(r["step_id"], r["text"]) for r in steps.where("chunk_id = 'c1'").collect()} == {("c1::1", "AMF asks"), ("c1::2", "SMF answers"), ("c1::3", "end")}
    mentions = spark.createDataFrame([("c1", "AMF"), ("c1", "SM")], "chunk_id string, term string")
    assert [tuple(r) for r in extract.step_terms(steps, mentions).collect()] == [("c1::1", "AMF")]
    terms = spark.createDataFrame([("UDM",)], "term string")
    assert [(r["op"], r["service"]) for r in extract.service_operations(chunks, terms).collect()] == [("Nudm_SDM_Get", "SDM")]
    assert {(r["message"], r["df"]) for r in extract.messages(chunks).collect()} == {("REGISTRATION REQUEST", 3)}


TB = CH + ", tables array<" + documents.TABLE + ">"


def test_tables(spark):
    t = lambda h, *r: {"headers": h, "rows": [list(x) for x in r]}
    rows = [
        ("c1", "ts_23_501", "Standardised SST values", "", "", [t(["Slice/Service type", "SST value", "Characteristics"], ("eMBB", "1", "enhanced mobile broadband"), ("URLLC", "2", "low latency traffic"), ("NOTE", "NOTE 1", "a note that goes"))]),
        ("c2", "ts_29_500", "Enumeration: SmStatus", "", "", [t(["Enumeration value", "Description"], ('"ACTIVE(1)"', "on"), ("GROUP",))]),
        ("c3", "ts_23_501", "x", "", "", [t(["5QIValue", "Resource Type", "Priority", "Priority"], ("1", "GBR", "20", "21"))]),
        ("c4", "ts_23_501", "Examples", "", "", [t(["A value", "Description"], ("1", "one two three"))]),
        ("c5", "ts_36_521", "x", "", "", [t(["A value", "Description"], ("1", "one two three"))]),
        ("c6", "ts_23_501", "x", "", "", [t(["A value", "1.5", "{2}"], ("1", "2", "3"))]),
        ("c7", "ts_23_501", "x", "", "", [t(["IE/Group name", "Presence", "Semantics description"], ("Cause", "M", "why it was"), ("NOTE 2", "", "gone"), ("short",))]),
    ]
    chunks = spark.createDataFrame(rows, TB)
    found = {(r["concept"], r["kind"], r["name"], r["code"]) for r in extract.values(chunks).collect()}
    assert found == {("SST", "value_set", "eMBB", "1"), ("SST", "value_set", "URLLC", "2"), ("SmStatus", "enumeration", "ACTIVE", "ACTIVE"), ("5QI", "attribute_map", "5QI 1", "1")}
    attrs = extract.values(chunks).where("concept = '5QI'").first()["attrs"]
    assert attrs == {"Resource Type": "GBR", "Priority": "20", "Priority (2)": "21"}
    assert {(r["param_id"], r["name"]) for r in extract.parameters(chunks).where("chunk_id = 'c7'").collect()} == {("c7::0::0", "Cause")}


def test_questions(spark):
    i = lambda q: one(spark, questions.intent(F.col("q")), q=q)
    assert i("What does the AMF do") == "network_function" and i("what is a slice") == "definition" and i("hello") == "general" and i("difference between x and y") == "comparison"
    assert one(spark, questions.kind(F.col("k")), k="procedure") == "HOW_PROC" and one(spark, questions.kind(F.col("k")), k="comparison") == "WHAT_DEF"
    p = lambda wh, n, spec=False, m=None, par=None, face=None: one(spark, questions.pattern(F.col("wh"), F.col("n"), F.col("s"), F.col("m"), F.col("p"), F.col("i")), wh=wh, n=n, s=spec, m=m, p=par, i=face)
    assert [p("WHAT_DEF", 2), p("WHAT_DEF", 1), p("WHAT_DEF", 0, face="N2"), p("WHAT_DEF", 0)] == ["A2", "FUNC", "B", "C"]
    assert [p("HOW_PROC", 2), p("WHERE_LOC", 1, True), p("WHERE_LOC", 0, face="N2"), p("WHO_ENTITY", 3), p("WHY_COND", 1), p("HOW_PROC", 2, m="X"), p("HOW_PROC", 2, par="Y")] == ["FG", "E", "B", "FG", "A1", "M", "P"]
    terms = spark.createDataFrame([("AMF", "access function"), ("AF", "application function"), ("SF", "access")], "term string, full_name string")
    asked = spark.createDataFrame([(1, "How does the access function meet the AF?"), (2, "nothing here")], "qid int, question string")
    assert {(r["qid"], r["term"]) for r in questions.named_terms(asked, terms).collect()} == {(1, "AMF"), (1, "AF")}
    assert one(spark, questions.specs_named(F.col("q")), q="TS 23.501 and TR 38.101-1, ts 23.501") == ["ts_23_501", "ts_38_101-1"]
    ops = spark.createDataFrame([("Nudm_SDM_Get",)], "op string")
    warned = questions.scope_warnings(spark.createDataFrame([(1, "Nudm_SDM_Get Nabc_D_E (AMF) (XYZ)")], "qid int, question string"), terms, ops)
    assert {r["warning"] for r in warned.collect()} == {"unknown operation Nabc_D_E", "unknown abbreviation XYZ"}


@pytest.mark.parametrize(("question", "title", "spec", "kind", "flags", "want"), [
    ("registration of a UE", "Registration", "ts_23_502", "procedure", {}, 0.5),
    ("registration of a UE", "Paging", "ts_23_502", "procedure", {}, -0.3),
    ("registration of a UE", "Paging", "ts_23_502", "procedure", {"chain": True}, 0.5),
    ("what", "Impacts on services and x", "ts_23_700", "general", {}, -1.0),
    ("key issue of what", "x", "ts_23_700", "general", {}, 0.0),
    ("what", "General", "ts_23_502", "general", {}, -0.25),
    ("what", "General", "ts_23_502", "general", {"step_all": True, "hits": 3}, 0.94),
    ("what", "x", "ts_23_502", "general", {"anchor": True, "op": True}, 1.0),
])
def test_bias(spark, question, title, spec, kind, flags, want):
    c = questions.bias(*map(F.col, ("q", "t", "s", "k", "sa", "h", "op", "an", "ch")))
    assert one(spark, c, q=question, t=title, s=spec, k=kind, sa=flags.get("step_all", False), h=flags.get("hits", 1), op=flags.get("op", False), an=flags.get("anchor", False), ch=flags.get("chain", False)) == pytest.approx(want)


def test_root_headings(spark):
    heads = spark.createDataFrame([("ab", "ts_23_502", "5GS to EPS handover using N26 interface", 3), ("ba", "ts_23_502", "EPS to 5GS handover over N26", 9), ("an", "ts_23_502", "AN Release", 2), ("other", "ts_23_501", "AN Release", 99), ("whole", "ts_23_502", "UE configuration update", 1), ("general", "ts_23_502", "Paging", 5)], "chunk_id string, spec_id string, title string, size int")
    asked = ["What happens in the 5GS to EPS handover via N26 procedure of TS 23.502?", "and the EPS to 5GS handover over N26 interface in TS 23.502", "the AN releases of TS 23.502", "In AN release, as TS 23.502 says, what follows from the UE configuration updates", "AN release", "one two three four five six seven eight nine ten eleven twelve paging in TS 23.502", "paging in TS 23.502", "TS 23.502 and then the UE configuration update"]
    frame = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    assert {r["qid"]: r["chunk_id"] for r in questions.root_headings(frame, heads).collect()} == {0: "ab", 1: "ba", 2: "an", 3: "an", 5: "general", 6: "general", 7: "whole"}


def test_guard_walks_the_whole_plan(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    for bad in (
        "WITH t AS (SELECT 1 AS a) INSERT INTO foo SELECT * FROM t",
        "FROM numbers INSERT INTO foo SELECT id INSERT INTO bar SELECT id",
        "SELECT * FROM (SELECT TRANSFORM (id) USING 'cat' AS (x) FROM numbers)",
        "WITH t AS (SELECT TRANSFORM (id) USING 'cat' AS (x) FROM numbers) SELECT * FROM t",
        "SELECT (SELECT max(x) FROM (SELECT TRANSFORM (id) USING 'cat' AS (x) FROM numbers)) AS m",
        "SELECT reflect('java.lang.System', 'exit', 0)",
        "CACHE TABLE numbers",
        "WITH t AS (SELECT 1) DELETE FROM foo",
    ):
        with pytest.raises(service.Rejected):
            service.guard(spark, bad)
    fine = "WITH t AS (SELECT id, id % 2 AS k FROM numbers) SELECT k, count(*) AS n FROM t WHERE id IN (SELECT id FROM numbers) GROUP BY k HAVING count(*) > 0 ORDER BY k LIMIT 3"
    assert service.run_readonly(spark, fine)[0] == [{"k": 0, "n": 2}, {"k": 1, "n": 1}]


def test_guard(spark):
    assert service.guard(spark, "```sql\nSELECT 1 AS a;\n```") == "SELECT 1 AS a"
    assert service.guard(spark, "Here it is:\nWITH x AS (SELECT 'NG SETUP, RESET' AS s) SELECT * FROM x")
    for bad in ("DROP TABLE x", "INSERT INTO x SELECT 1", "", "CREATE VIEW v AS SELECT 1", "SET a = 1", "nonsense"):
        with pytest.raises(service.Rejected):
            service.guard(spark, bad)
    rows, more = service.run_readonly(spark, "SELECT id FROM range(5) WHERE id > :low", {"low": 1}, limit=2)
    assert rows == [{"id": 2}, {"id": 3}] and more
    assert service.first_object('x {bad} {"a": {"b": 1}} y') == {"a": {"b": 1}} and service.first_object("none") is None


def test_answer_and_agent(spark, sf):
    g = order_graph(spark, sf)
    asked = spark.createDataFrame([(1, "what is the order 17 that shall be open"), (2, "how does small ring work")], "qid int, question string")
    found, trace = service.answer(g, asked)
    rows = found.collect()
    assert rows and all(r["rank"] <= 10 for r in rows) and {r["stage"] for r in trace.collect()} >= {"intent", "sources"}
    script = iter([{"tool": "nope"}, {"tool": "spec_search", "args": {"spec": 3}}, {"tool": "title_search", "args": {"phrase": "urgent"}}, {"tool": "finish"}])
    agent = service.Agent(g, lambda q, f: next(script))
    assert agent.run("x") and agent.log == ["spec_search", "title_search"]
    assert service.describe(g).count() > 20
    assert service.context_length(service.Config(model="qwen3")) == 32_768 and len(service.ladder(service.Config())) == 5


def test_every_mode_answers_in_its_own_way(spark, sf):
    g = order_graph(spark, sf)
    g = service.replace(g, chunks=g.chunks.where("chunk_id < 300"))
    asked = spark.createDataFrame([(1, "which order shall be open for small ring by its own rules"), (2, "what is a green part"), (3, "none of these")], "qid int, question string")
    parts = spark.createDataFrame([(1, "small ring"), (2, "green part")], "term long, full_name string")
    g = service.replace(g, terms=parts)
    found, via = {}, {}
    for mode in service.MODES:
        policy = (lambda q, f: {"tool": "spec_search", "args": {"spec": 3}} if not f else {"tool": "finish"}) if mode == "react_agent" else None
        rows, trace = service.answer(g, asked, service.Config(mode=mode, k=5, wide=20, rung="entity"), policy=policy)
        found[mode] = sorted((r["qid"], r["rank"], r["doc"]) for r in rows.collect())
        via[mode] = {v for r in rows.collect() for v in r["via"].split(",")}
        stages = {r["stage"] for r in trace.collect()}
        assert stages >= {"intent"} and ("sources" in stages) == (mode != "none")
    assert found["none"] == [] and via["bm25"] == {"bm25"} and via["dense"] == {"dense"} and via["graph"] == {"graph"} and via["react_agent"] == {"spec_search"}
    assert via["bm25_dense"] == {"bm25", "dense"} and via["fixed"] <= {"dense", "graph"} and "graph" in via["hybrid"]
    assert len({tuple(x) for x in found.values()}) >= 7
    with pytest.raises(ValueError):
        service.answer(g, asked, service.Config(mode="react_agent"))
    full, trace = service.answer(g, asked, service.Config(mode="graph", k=30, step_evidence=True, context=200, a_chunk=90))
    rows = full.collect()
    assert {v for r in rows for v in r["via"].split(",")} >= {"graph"} and "step_evidence" in {r["stage"] for r in trace.collect()}
    for q in {r["qid"] for r in rows}:
        assert 0 < sum(r["in_context"] for r in rows if r["qid"] == q) <= 200 // 20


def test_closure_leads(spark, sf):
    g = order_graph(spark, sf)
    chunks = spark.createDataFrame([("a", "ts_23_502", "2", "AN Release", "x", "procedure"), ("b", "ts_23_502", "2.1", "Parts", "y", "procedure"), ("c", "ts_23_502", "3", "Else", "an release words", "general")], "chunk_id string, spec_id string, section_id string, title string, content string, chunk_type string")
    text = lambda df, *c: df.limit(0).withColumns({x: F.lit(None).cast("string") for x in c})
    g = service.replace(g, chunks=chunks, mentions=text(g.mentions, "chunk_id"), describes=text(g.describes, "chunk_id"), steps=text(g.steps, "chunk_id"), refs=text(g.refs, "src", "dst"))
    asked = spark.createDataFrame([(1, "the AN release of TS 23.502")], "qid int, question string")
    led = [(r["doc"], r["rank"]) for r in service.answer(g, asked, service.Config(mode="bm25", closure=True, k=3))[0].collect()]
    assert sorted(led, key=lambda x: x[1])[:2] in ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)])
    plain = {r["doc"] for r in service.answer(g, asked, service.Config(mode="bm25", k=3))[0].collect()}
    assert "b" not in plain


def test_dense_in_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {tuple(r) for r in retrieval.dense(rows, rows.where("vec_id % 5 = 0"), 3).select("qid", "doc", "rank").collect()}
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 4000)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    assert {tuple(r) for r in retrieval.dense(rows, rows.where("vec_id % 5 = 0"), 3).select("qid", "doc", "rank").collect()} == want and len(want) == 300
    assert retrieval.dense(rows, rows.limit(0)).count() == 0


def test_later_batches_add_to_a_specification(spark, tmp_path):
    one = lambda name, *chunks: (tmp_path / "in" / name).write_text(json.dumps({"metadata": {"specification_id": "ts_23_501"}, "chunks": [{"chunk_id": c, "section_id": c, "section_title": "t", "content": x} for c, x in chunks]}))
    (tmp_path / "in").mkdir()
    table = f"{tmp_path}/table"
    one("1.json", ("a", "first"), ("b", "first"))
    for files in (1, 2):
        if files == 2:
            one("2.json", ("b", "second"), ("c", "second"))
        for _ in range(2):
            ingest.ingest(ingest.clause_stream(spark, f"{tmp_path}/in"), table, f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r["chunk_id"], r["content"]) for r in spark.read.parquet(table).collect()} == {("a", "first"), ("b", "second"), ("c", "second")}
    batch = spark.read.parquet(table)
    kept = spark.createDataFrame(batch.collect(), batch.schema)
    ingest.merge(kept, table)  # a batch that runs again
    assert spark.read.parquet(table).count() == 3


def test_agreement_of_no_or_equal_labels(spark):
    schema = "item int, rater string, label string"
    same = spark.createDataFrame([(i, r, "A") for i in range(4) for r in "xy"], schema)
    assert evaluation.krippendorff(same).first()[0] == 1.0 and evaluation.fleiss(same).first()[0] == 1.0
    assert [tuple(r) for r in evaluation.pairwise_cohen(same).select("kappa", "pabak").collect()] == [(1.0, None)]
    none = same.limit(0)
    assert evaluation.krippendorff(none).first()[0] is None and evaluation.fleiss(none).first()[0] is None
    three = spark.createDataFrame([(1, "x", "A"), (1, "y", "A"), (2, "x", "B"), (2, "y", "C")], schema)
    assert evaluation.pairwise_cohen(three).first()["pabak"] == pytest.approx((3 * 0.5 - 1) / 2)


def test_subsets_and_ranks_by_brute_force(spark):
    import random

    rng = random.Random(2)
    sets = [(f, n, sorted(rng.sample("abcdef", rng.randint(0, 4)))) for f in "xy" for n in range(40)]
    want = {(f, n) for f, n, a in sets if any(f == g and set(a) < set(b) for g, _, b in sets)}
    found = evaluation.subsets(spark.createDataFrame(sets, "folder string, name int, items array<string>"))
    assert {tuple(r) for r in found.collect()} == want
    values = {"a": [rng.randint(0, 50) / 7 for _ in range(501)], "b": [3.0] * 5, "c": [1.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: (r["mid"], r["last"]) for r in evaluation.at_ranks(rows, "k", "v", {"mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).collect()}
    assert got == {k: (sorted(v)[len(v) // 2], max(v)) for k, v in values.items()}


def test_review(spark):
    pairs = review.assign(list(range(10)), ["a", "b", "c"], 2, 7, {0: ["a"]})
    load = {r: sum(x == r for _, x in pairs) for r in "abc"}
    assert len(pairs) == 20 and len(set(pairs)) == 20 and max(load.values()) - min(load.values()) <= 1 and (0, "a") in pairs
    qs = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(50)], "qid int, class string")
    few = review.stratified(qs, 5, 1)
    more = {r["qid"] for r in review.stratified(qs, 9, 1, few).collect()}
    assert {r["qid"] for r in few.collect()} <= more and len(more) == 18
    todo = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "reviewer string, item int, ord int")
    rated = spark.createDataFrame([("a", 1)], "reviewer string, item int")
    assert {tuple(r) for r in review.next_unfinished(todo, rated).collect()} == {("a", 2), ("b", 1)}
    schema = "reviewer string, item int, phase int, label string"
    old = spark.createDataFrame([("a", 1, 1, "x")], schema)
    new = spark.createDataFrame([("a", 1, 1, "y"), ("a", 1, 2, "z"), ("b", 1, 2, "no")], schema)
    assert {tuple(r) for r in review.upsert(old, new).collect()} == {("a", 1, 1, "y"), ("a", 1, 2, "z")}


def test_agreement_bounds(spark):
    rows = [(i, r, "A") for i in range(10) for r in "xyz"]
    perfect = spark.createDataFrame(rows + [(99, "x", "B"), (99, "y", "B")], "item int, rater string, label string")
    assert evaluation.fleiss(perfect).first()[0] == 1.0 and evaluation.krippendorff(perfect).first()[0] == 1.0
    assert {r["kappa"] for r in evaluation.pairwise_cohen(perfect).collect()} == {1.0}


def test_bootstrap(spark):
    rows = [("g", i, 1.0 + (i % 3), 0.5) for i in range(40)] + [("few", 1, 1.0, 0.0)]
    found = {r["group"]: r for r in evaluation.paired_bootstrap(spark.createDataFrame(rows, "group string, qid int, a double, b double"), 200).collect()}
    assert found["g"]["low"] > 0 and found["g"]["p"] < 0.05 and found["few"]["low"] is None
    assert one(spark, evaluation.verdict(F.col("a"), F.col("b")), a=0.1, b=0.2) == "positive"


def test_hashed_bootstrap(spark):
    """Weights follow the Poisson law, intervals are near those of drawing, and the order of rows doesn't matter."""
    steps = [0, *evaluation.poisson_steps(), 1 << 32]
    shares = [(b - a) / (1 << 32) for a, b in zip(steps, steps[1:], strict=False)]
    assert abs(sum(k * s for k, s in enumerate(shares)) - 1) < 1e-8
    rows = [("g", i, 1.0 + (i * 7 % 11) / 5, 0.9 + (i * 5 % 7) / 3) for i in range(200)] + [("few", 1, 1.0, 0.0), ("few", 2, None, 0.0)]
    made = spark.createDataFrame(rows, "group string, qid int, a double, b double")
    mine, drawn = ({r["group"]: r for r in f(df, 800).collect()} for f, df in ((evaluation.hashed_bootstrap, made.repartition(5)), (evaluation.paired_bootstrap, made.where("group = 'g'"))))
    assert mine == {r["group"]: r for r in evaluation.hashed_bootstrap(made, 800).collect()}
    assert abs(mine["g"]["low"] - drawn["g"]["low"]) < 0.03 and abs(mine["g"]["high"] - drawn["g"]["high"]) < 0.03 and abs(mine["g"]["p"] - drawn["g"]["p"]) < 0.06
    assert mine["few"]["n"] == 1 and mine["few"]["low"] is None and mine["g"]["n"] == 200


def test_rrf_formula(spark):
    rows = spark.createDataFrame([(1, 5, 1, 1.0), (1, 6, 2, 1.0), (1, 6, 1, 0.5)], "qid int, doc int, rank int, weight double")
    found = {r["doc"]: r["score"] for r in retrieval.rrf(rows).collect()}
    assert found == {5: round(1 / 61, 9), 6: round(1 / 62 + 0.5 / 61, 9)}


def test_registry_is_complete():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 90
    json.dumps(sorted(E.queries()))


def test_clients():
    from clausegraph.sources import clients as C

    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise C.Failed(503)
        return "ok"

    assert C.retrying(call, sleep=slept.append) == "ok" and len(slept) == 2 and slept[1] > slept[0]
    with pytest.raises(C.Failed):
        C.retrying(lambda: (_ for _ in ()).throw(C.Failed(400)))
    said = "<think>why not</think>\nbecause <b>"
    for size in (1, 3, 100):
        assert C.collect(C.split_thinking(said[i : i + size] for i in range(0, len(said), size))) == {"thinking": "why not", "answer": "because <b>"}
    assert C.collect(C.split_thinking(["<th", "en"])) == {"answer": "<then"}
    assert "".join(C.capped(["abc", "def"], chars=4)) == "abcd"
    router = C.Router({"": C.offline, "x": lambda m, p: "x"})
    assert router("xy", "") == "x" and "AMF" in router("m", C.prompt("what does AMF do", [("t", "The AMF moves. Other.")]))


def test_model_backed_choices():
    from clausegraph.sources import clients as C

    rules = lambda q: "general"
    assert C.classify(lambda p: 'Sure: {"intent": "definition", "terms": [" AMF ", ""]}', "q", ["definition"], rules) == {"intent": "definition", "terms": ["AMF"], "by": "model"}
    for bad in ("nothing", '{"intent": "other", "terms": []}', '{"intent": "definition", "terms": [1]}', '{"intent": "definition"}'):
        assert C.classify(lambda p, bad=bad: bad, "q", ["definition"], rules) == {"intent": "general", "terms": [], "by": "rules"}

    def failing(prompt):
        raise C.Failed(503)

    assert C.classify(failing, "q", ["definition"], rules)["by"] == "rules" and C.asks_whole_flow(failing, "q") is False and C.choose_root(failing, "q", [("a", "A")]) == "a"
    assert C.asks_whole_flow(lambda p: '{"whole_flow": true}', "q") is True and C.asks_whole_flow(lambda p: '{"whole_flow": "yes"}', "q") is False
    heads = [("a", "Registration"), ("b", "Paging")]
    assert [C.choose_root(lambda p, x=x: x, "q", heads) for x in ("2", "It is 2.", "none", "7")] == ["b", "b", "a", "a"] and C.choose_root(lambda p: "1", "q", []) is None


def test_recovered_columns(spark):
    df = spark.range(1).select(F.lit(1).alias("c.chunk_id"), F.lit(2).alias("SPEC ID"), F.lit(3).alias("score"), F.lit(4).alias("d.score"))
    assert service.recovered(df, ["chunk_id", "spec_id", "score"]).columns == ["chunk_id", "spec_id", "score", "d.score"]


def test_fusion_cases(spark):
    from clausegraph.operators import fusion as X

    concepts = spark.createDataFrame([("smContextStatus",), ("SST",), ("Cause",)], "name string")
    asked = spark.createDataFrame([(1, "Which SST and which sm context statuss are causes?")], "qid int, question string")
    assert {r["name"] for r in X.concepts_named(asked, concepts).collect()} == {"SST", "smContextStatus", "Cause"}
    rows = spark.createDataFrame([("x H I\n1 2 3 4 y", ["H", "I"], [["1", "2"], ["3", "4"]]), ("H I 1 2", ["H", "I"], [["1", "2"], ["3", "9"]]), ("none", ["H"], [["1"]])], "c string, h array<string>, r array<array<string>>")
    assert [tuple(r["x"]) for r in rows.select(X.locate_table(F.col("c"), F.col("h"), F.col("r")).alias("x")).collect()] == [(True, 2, False), (True, 1, True), (False, 0, False)]
    heads = spark.createDataFrame([("a", "Registration of devices", "", 2), ("b", "Paging", "Registration", 1)], "chunk_id string, title string, path string, size int")
    best = X.shortlist(spark.createDataFrame([(1, "registration")], "qid int, question string"), heads).collect()
    assert [r["chunk_id"] for r in best] == ["a", "b"]
    assert [r["term"] for r in X.sanity(spark.createDataFrame([("AMF",)], "term string"), ["AMF", "SMF"]).collect()] == ["SMF"]
    roots = questions.root_headings(spark.createDataFrame([(1, "how does registration of a device of TS 23.502 work"), (2, "how does registration of a device work")], "qid int, question string"), heads.withColumn("spec_id", F.lit("ts_23_502")))
    assert [(r["qid"], r["chunk_id"], r["coverage"]) for r in roots.collect()] == [(1, "a", 1.0)]
    chunks = spark.createDataFrame([("a", "s", "2", "x"), ("b", "s", "2.1", "x"), ("c", "s", "3", "x"), ("d", "s", "4", "Nx_A_B")], "chunk_id string, spec_id string, section_id string, title string")
    says = spark.createDataFrame([("b", "Nx_A_B"), ("d", "Nx_A_B")], "chunk_id string, op string")
    refs = spark.createDataFrame([("b", "c"), ("b", "a")], "src string, dst string")
    assert {(r["chunk_id"], r["role"]) for r in questions.closure(roots, chunks, refs, says).collect()} == {("a", "main"), ("b", "main"), ("c", "ref"), ("d", "op_def")}


def test_store(spark, sf, tmp_path):
    from clausegraph.plans import store

    g = order_graph(spark, sf)
    store.write(g, f"{tmp_path}/g")
    back = store.read(spark, f"{tmp_path}/g")
    assert back.chunks.count() == g.chunks.count() and back.refs.count() == g.refs.count()
    store.wipe(spark, f"{tmp_path}/g")
    assert not (tmp_path / "g").exists()
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 9, 2)], "k string, v int, seq int")
    assert {(r["k"], r["v"]) for r in store.upsert(old, new, ["k"], "seq").collect()} == {("a", 9), ("b", 2)}
    good, bad = store.checked(old, F.col("v") > 1)
    assert good.count() == 1 and bad.count() == 1
    assert store.backfill(old, new.unionByName(old), ["k"]).count() == 0
    ends = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [tuple(r) for r in store.with_both_ends(ends, nodes, nodes).select("src", "dst").collect()] == [("a", "b")]
    rows = spark.createDataFrame([("x y", None), ("kept", [1.0])], "content string, embedding array<float>")
    found = {r["content"]: r["embedding"] for r in store.embed_missing(rows, dim=8).collect()}
    assert found["kept"] == [1.0] and len(found["x y"]) == 8 and sum(v * v for v in found["x y"]) == pytest.approx(1)
    gold = spark.createDataFrame([(1, "ts_23_501_5.1")], "qid int, chunk_id string")
    tables = spark.createDataFrame([("ts_23_501", "ts_23_501_5.1", "t1"), ("ts_23_502", "x", "t2")], "spec_id string, chunk_id string, table string")
    assert [r["table"] for r in store.snapshot_tables(gold, tables).collect()] == ["t1"]


def test_definitions_stand_on_any_line(spark, tmp_path):
    from clausegraph.plans import registered

    text = "alpha a first line of words\n\n  PDU session: a connection of a kind\nfor the purposes of this: nothing is defined\nshort: few\nomega the last line of words"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registered()[0]["t3_definition_lines"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, "alpha", "a first line of words"), (1, 2, "PDU session", "a connection of a kind"), (1, 5, "omega", "the last line of words")]
