"""The review store's log and its folds."""

from pyspark.sql import functions as F

from clausegraph.plans import review_store as S


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_fold_by_column_with_deletions_and_defaults(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert S.open_log(spark, path).count() == 0
    one = frame(spark, [(1, "q1", 7, "yes", 1, 100), (1, "q1", 8, None, 2, 100), (None, "q1", 8, "x", 3, 100)], "campaign_id long, qid string, reviewer_id long, c1 string, ord long, at long")
    assert S.append(spark, path, S.events(one, "ratings")) == 1
    two = frame(spark, [(1, "q1", 7, "good", "final", 1, 200)], "campaign_id long, qid string, reviewer_id long, verdict string, status string, ord long, at long")
    assert S.append(spark, path, S.events(two, "ratings")) == 2
    rows = {r["reviewer_id"]: r for r in S.fold(S.open_log(spark, path), "ratings").collect()}
    assert set(rows) == {7, 8} and (rows[7]["c1"], rows[7]["verdict"], rows[7]["status"], rows[7]["revision"], rows[7]["created_at"], rows[7]["updated_at"]) == ("yes", "good", "final", 1, 100, 200)
    assert rows[8]["status"] == "draft" and rows[8]["c1"] is None
    S.append(spark, path, S.events(two.select("campaign_id", "qid", "reviewer_id", "ord", "at"), "ratings", S.DELETE))
    assert {r["reviewer_id"] for r in S.fold(S.open_log(spark, path), "ratings").collect()} == {8}
    S.append(spark, path, S.events(two.withColumn("verdict", F.lit(None).cast("string")), "ratings"))
    again = S.fold(S.open_log(spark, path), "ratings").where("reviewer_id = 7").first()
    assert (again["c1"], again["verdict"], again["revision"]) == (None, None, 0)


def test_columns_of_later_schemas_have_defaults_and_campaigns_take_theirs_along(spark, tmp_path):
    path = f"{tmp_path}/log"
    made = frame(spark, [(1, "a", 1), (2, "b", 2), (3, "b", 3)], "id long, name string, ord long")
    asked = frame(spark, [(1, "q", 5), (2, "q", 6)], "campaign_id long, qid string, ord long")
    S.append(spark, path, S.events(made, "campaigns").unionByName(S.events(asked, "questions")).unionByName(S.events(asked.withColumn("reviewer_id", F.lit(4)), "ratings")))
    log = S.open_log(spark, path)
    assert [(r["status"], r["all_raters"]) for r in S.fold(log, "campaigns").collect()] == [("open", 0)] * 3
    assert [tuple(r) for r in S.conflicts(log, "campaigns").collect()] == [("name", "b", 2)]
    assert [r["in_scope"] for r in S.fold(log, "questions").collect()] == [1, 1]
    S.append(spark, path, S.events(made.where("id = 2").select("id", "ord"), "campaigns", S.DELETE))
    log = S.open_log(spark, path)
    assert {r["id"] for r in S.fold(log, "campaigns").collect()} == {1, 3}
    assert {r["campaign_id"] for r in S.fold(log, "questions").collect()} == {1}
    assert {r["campaign_id"] for r in S.fold(log, "ratings").collect()} == {1, 2}
    assert S.conflicts(log, "campaigns").count() == 0 and S.conflicts(log, "ratings").count() == 0


def test_queue(spark):
    q = S.events(frame(spark, [(1, "a", 1, 1), (1, "b", 1, 2), (1, "c", 0, 3)], "campaign_id long, qid string, in_scope int, ord long"), "questions")
    a = S.events(frame(spark, [(1, "a", 9, 2, 1), (1, "b", 9, 3, 2), (1, "c", 9, 1, 3), (1, "a", 8, 1, 4)], "campaign_id long, qid string, reviewer_id long, order_idx int, ord long"), "assignments")
    r = S.events(frame(spark, [(1, "a", 9, "final", 1), (1, "a", 8, "draft", 1)], "campaign_id long, qid string, reviewer_id long, status string, ord long"), "ratings")
    assert {tuple(x) for x in S.queue(q.unionByName(a).unionByName(r)).collect()} == {(1, 9, "b", 3), (1, 8, "a", 1)}
