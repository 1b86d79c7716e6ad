"""Agents in common rounds: every tool, planning, limits, and the same results as one question at a time."""

import pytest

from clausegraph.plans import agents, service
from clausegraph.plans.graph import order_graph


@pytest.fixture(scope="module")
def graph(spark, sf):
    return order_graph(spark, sf)


def test_rounds_agree_with_single_questions(spark, graph):
    asked = spark.createDataFrame([(i, f"question {i}") for i in range(6)], "qid int, question string")

    def policy(question, found):
        k = int(question.split()[1])
        steps = [("spec_search", {"spec": k}), ("term_search", {"term": k + 1}), ("nothing", {}), ("expand", {"chunk_id": found[0]["chunk_id"] if found else -1}), ("inspect", {"chunk_id": 32})]
        if k == 5 or len(found) > 15:
            return {"tool": "finish"}
        tool, args = steps[len(found) % len(steps)]
        return {"tool": tool, "args": args}

    found, log = agents.search(graph, asked, policy)
    rows = {}
    for r in found.orderBy("qid", "place").collect():
        rows.setdefault(r["qid"], []).append((r["chunk_id"], r["via"]))
    for k in range(6):
        single = service.Agent(graph, policy).run(f"question {k}")
        assert rows.get(k, []) == [(f["chunk_id"], f["via"]) for f in single]
    assert {r["tool"] for r in log.collect()} >= {"spec_search", "finish"}


def test_tools(spark, graph):
    graph.chunks.createOrReplaceTempView("chunks")
    some = graph.chunks.orderBy("chunk_id").first()
    tools = agents.Tools(graph, views=["chunks"])
    calls = lambda arg: spark.createDataFrame([(1, arg), (2, "")], "qid int, arg string")
    titled = {r["chunk_id"] for r in tools.title_search(calls("urgent CLAUSE")).collect()}
    assert titled and titled <= {r["chunk_id"] for r in graph.chunks.where("title like '%URGENT clause%'").collect()}
    assert not tools.title_search(calls("rgent clause")).collect()
    assert next(r["chunk_id"] for r in tools.vector_search(calls(some["content"])).collect() if r["ord"] == 1 and r["qid"] == 1) is not None
    sql = f"SELECT chunk_id AS `CHUNK ID`, title FROM chunks WHERE chunk_id <= {some['chunk_id']}"
    assert [r["chunk_id"] for r in tools.query(calls(sql)).collect()] == [some["chunk_id"]]
    assert tools.query(calls("SELECT reflect('java.lang.Math', 'abs', 1) AS chunk_id")) is None
    assert tools.query(calls("SELECT nope FROM chunks")) is None


def test_planning_and_limits(spark, graph):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, question string")

    def planner(question, notes):
        if question == "b":
            return {"tool": "what"}
        return {"tool": "search_titles", "args": {"phrase": "clause 2.1"}} if not notes else {"tool": "finish", "args": {"gaps": notes[0]["names"][:1] + ["more"]}}

    plans = {r["qid"]: r["plan"] for r in agents.plan_gaps(graph, asked, planner).collect()}
    assert plans[2] == [] and len(plans[1]) == 2 and "clause 2.1" in plans[1][0] and plans[1][1] == "more"
    policy = lambda q, found, plan: {"tool": "spec_search", "args": {"spec": len(plan) + len(found)}}
    found, log = agents.search(graph, asked, policy, rounds=3, most=12, planner=planner)
    sizes = {r["qid"]: r["count"] for r in found.groupBy("qid").count().collect()}
    assert sizes == {1: 12, 2: 12} and log.where("round = 1 and qid = 1").first()["arg"] == "2" and log.where("round = 3").count() == 0
    ticks = iter([0, 0, 9, 9, 9])
    found, log = agents.search(graph, asked, lambda q, f: {"tool": "spec_search", "args": {"spec": len(f)}}, seconds=5, clock=lambda: next(ticks))
    assert {r["round"] for r in log.collect()} == {1} and found.count() == 20
    assert agents.search(graph, asked.limit(0), policy, planner=planner)[0].count() == 0
