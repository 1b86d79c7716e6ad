"""Review campaigns: samples, assignment, queues."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(questions: DataFrame, per_class: int, seed: int, chosen: DataFrame | None = None) -> DataFrame:
    """(qid, class): per_class questions of each class in the order of a seeded hash. What was chosen before stays, and more are added in the same order."""
    rows = questions.select("qid", "class", F.xxhash64(F.lit(seed), F.col("qid").cast("string")).alias("h"))
    if chosen is not None:
        rows = rows.join(chosen.select("qid", F.lit(0).alias("kept")), "qid", "left").withColumn("kept", F.coalesce("kept", F.lit(1)))
    else:
        rows = rows.withColumn("kept", F.lit(1))
    n = F.row_number().over(Window.partitionBy("class").orderBy("kept", "h", "qid"))
    return rows.withColumn("n", n).where(F.col("n") <= per_class).select("qid", "class")


def assign(items: list, reviewers: list, per_item: int, seed: int, done: dict | None = None) -> list[tuple]:
    """(item, reviewer) pairs, each item to per_item reviewers, greedily to those with the fewest; pairs in `done` stay.

    One campaign's items and reviewers, which people work through, so this runs on the driver.
    """
    rng, load = random.Random(seed), dict.fromkeys(reviewers, 0)
    pairs = [(i, r) for i, rs in (done or {}).items() for r in rs]
    for _, r in pairs:
        load[r] = load.get(r, 0) + 1
    for item in rng.sample(sorted(items), len(items)):
        has = {r for i, r in pairs if i == item}
        free = [r for r in reviewers if r not in has]
        rng.shuffle(free)
        for r in sorted(free, key=load.__getitem__)[: max(0, per_item - len(has))]:
            pairs.append((item, r))
            load[r] += 1
    return pairs


def next_unfinished(assignments: DataFrame, ratings: DataFrame) -> DataFrame:
    """(reviewer, item): each reviewer's first item in order that has no rating of theirs."""
    left = assignments.join(ratings.select("reviewer", "item"), ["reviewer", "item"], "left_anti")
    return left.groupBy("reviewer").agg(F.min_by("item", "ord").alias("item"))


def upsert(ratings: DataFrame, new: DataFrame) -> DataFrame:
    """Ratings with new ones in the place of those of the same reviewer, item and phase; phase 2 only after phase 1."""
    key = ["reviewer", "item", "phase"]
    first = ratings.unionByName(new).where("phase = 1").select("reviewer", "item").distinct()
    valid = new.where("phase = 1").unionByName(new.where("phase = 2").join(first, ["reviewer", "item"], "left_semi"))
    return ratings.join(valid.select(key), key, "left_anti").unionByName(valid)


def missing_prerequisites(ratings: DataFrame) -> DataFrame:
    """(reviewer, item) rated in phase 2 without a rating in phase 1; these are enrolled in phase 1 first."""
    key = ["reviewer", "item"]
    return ratings.where("phase = 2").select(key).distinct().join(ratings.where("phase = 1").select(key), key, "left_anti")
