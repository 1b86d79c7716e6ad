"""Retrieval metrics, agreement statistics and review bookkeeping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the normal quantile of the intervals.
Z = 1.96


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Share of the gold set among the first k of a list; null without gold. A list's repeats count towards k."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / F.size(F.array_distinct(gold)))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ranked, 1, k), gold).cast("int")


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    first = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def by_class(rows: DataFrame, *metrics: str) -> DataFrame:
    """Means a config and class, and over all classes (class 'all'), in one pass."""
    grouped = rows.rollup("config", "class").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    return grouped.where("config is not null").withColumn("class", F.coalesce("class", F.lit("all")))


def pool(runs: DataFrame, gold: DataFrame, depth: int = 5) -> DataFrame:
    """(qid, doc, is_gold, configs): the first `depth` of every run, with the gold."""
    shown = runs.select("qid", "config", F.explode(F.slice("ranked", 1, depth)).alias("doc")).withColumn("is_gold", F.lit(False))
    known = gold.select("qid", F.lit(None).cast("string").alias("config"), F.explode("gold").alias("doc"), F.lit(True).alias("is_gold"))
    rows = shown.select("qid", "config", "doc", "is_gold").unionByName(known)
    return rows.groupBy("qid", "doc").agg(F.max("is_gold").alias("is_gold"), F.array_join(F.array_sort(F.collect_set("config")), ",").alias("configs"))


def new_positives(pooled: DataFrame, judged: DataFrame) -> DataFrame:
    """(config, relevant, partial): pooled documents beyond the gold that are judged so, by the configurations that surfaced them. judged: qid, doc, label."""
    rows = pooled.where("not is_gold").join(judged.where(F.col("label").isin("RELEVANT", "PARTIAL")), ["qid", "doc"])
    rows = rows.select(F.explode(F.split("configs", ",")).alias("config"), "label")
    return rows.groupBy("config").agg(F.count_if(F.col("label") == "RELEVANT").alias("relevant"), F.count_if(F.col("label") == "PARTIAL").alias("partial"))


def wilson(p: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of the Wilson score interval."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def label_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))


def percent_agreement(ratings: DataFrame) -> DataFrame:
    """(items, agreed): over items with two ratings or more."""
    items = ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("d")).where("n >= 2")
    return items.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg((F.col("d") == 1).cast("int")), 6).alias("agreed"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """(kappa) for any number of raters an item, two at least."""
    counts = label_counts(ratings).withColumn("n", F.sum("c").over(Window.partitionBy("item"))).where("n >= 2")
    observed = counts.groupBy("item").agg(((F.sum(F.col("c") * F.col("c")) - F.first("n")) / (F.first("n") * (F.first("n") - 1))).alias("p")).agg(F.avg("p").alias("po"))
    shares = counts.groupBy("label").agg(F.sum("c").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    return observed.crossJoin(shares).select(F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).when(F.col("pe").isNotNull(), 1.0), 6).alias("kappa"))  # one row each; null without items


def krippendorff(ratings: DataFrame) -> DataFrame:
    """(alpha), nominal, over items with two ratings or more."""
    counts = label_counts(ratings).withColumn("n", F.sum("c").over(Window.partitionBy("item"))).where("n >= 2")
    off = counts.agg(F.sum(F.col("c") * (F.col("n") - F.col("c")) / (F.col("n") - 1)).alias("d"), F.sum("c").alias("t"))
    shares = counts.groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    apart = F.col("t") * F.col("t") - F.col("s")  # 0 where all labels agree
    alpha = F.when(apart == 0, 1.0).otherwise(1 - F.try_divide(F.col("d") * (F.col("t") - 1), apart))
    return off.crossJoin(shares).select(F.round(alpha, 6).alias("alpha"))  # one row each; null without items


def pairwise_cohen(ratings: DataFrame) -> DataFrame:
    """(r1, r2, items, kappa, pabak) for raters r1 < r2 over the items that both rated; pabak is for the number of labels in all ratings, null for one."""
    a = ratings.select("item", F.col("rater").alias("r1"), F.col("label").alias("l1"))
    b = ratings.select("item", F.col("rater").alias("r2"), F.col("label").alias("l2"))
    cells = a.join(b, "item").where("r1 < r2").groupBy("r1", "r2", "l1", "l2").agg(F.count(F.lit(1)).alias("c"))
    total = cells.groupBy("r1", "r2").agg(F.sum("c").alias("items"), F.sum(F.when(F.col("l1") == F.col("l2"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy("r1", "r2", F.col("l1").alias("l")).agg(F.sum("c").alias("x"))
    right = cells.groupBy("r1", "r2", F.col("l2").alias("l")).agg(F.sum("c").alias("y"))
    chance = left.join(right, ["r1", "r2", "l"]).groupBy("r1", "r2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("items"), F.coalesce("xy", F.lit(0)) / (F.col("items") * F.col("items"))
    labels = ratings.agg(F.countDistinct("label").alias("k"))  # one row
    return total.join(chance, ["r1", "r2"], "left").crossJoin(F.broadcast(labels)).select("r1", "r2", "items", F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"), F.round(F.try_divide(F.col("k") * po - 1, F.col("k") - 1), 6).alias("pabak"))


def needs_adjudication(ratings: DataFrame, keep: str) -> DataFrame:
    """Items whose raters differ, or where any does not say `keep`."""
    items = ratings.groupBy("item").agg(F.countDistinct("label").alias("d"), F.bool_and(F.col("label") == keep).alias("kept"))
    return items.where((F.col("d") > 1) | ~F.col("kept")).select("item")


def worst_label(ratings: DataFrame, order: list[str]) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    return ratings.groupBy("item").agg(F.min_by("label", rank).alias("label"))


def passes(ratings: DataFrame, good: str) -> DataFrame:
    """(any_pass, all_pass, rating_pass): shares of items with any or all ratings good, and of ratings."""
    items = ratings.groupBy("item").agg(F.bool_or(F.col("label") == good).alias("a"), F.bool_and(F.col("label") == good).alias("b"), F.count_if(F.col("label") == good).alias("g"), F.count(F.lit(1)).alias("n"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return items.agg(share("a").alias("any_pass"), share("b").alias("all_pass"), F.round(F.sum("g") / F.sum("n"), 6).alias("rating_pass"))


def paired_bootstrap(pairs: DataFrame, rounds: int = 2000, seed: int = 20260817, least: int = 30) -> DataFrame:
    """(group, n, delta, low, high, p) of the mean difference a - b, by resampling questions.

    Each group is one bounded set of questions; groups under `least` get no interval.
    """
    import numpy as np
    import pandas as pd

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("qid")["a"].to_numpy(float) - rows.sort_values("qid")["b"].to_numpy(float)
        out = {"group": [key[0]], "n": [len(d)], "delta": [float(d.mean())], "low": [None], "high": [None], "p": [None]}
        if len(d) >= least:
            rng = np.random.default_rng(seed)
            means = np.sort([d[rng.integers(0, len(d), len(d))].mean() for _ in range(rounds)])
            tail = min((means <= 0).mean(), (means >= 0).mean())
            out |= {"low": [float(np.quantile(means, 0.025))], "high": [float(np.quantile(means, 0.975))], "p": [float(min(1.0, 2 * tail))]}
        return pd.DataFrame(out)

    return pairs.groupBy("group").applyInPandas(one, "group string, n long, delta double, low double, high double, p double")


def poisson_steps(most: int = 12) -> list[int]:
    """Where a hash of 32 bits reaches the weights 1, 2, ... of a Poisson variable of mean 1."""
    out, term, total = [], math.exp(-1), math.exp(-1)
    for k in range(1, most + 1):
        out.append(int(total * (1 << 32)))
        term /= k
        total += term
    return out


def hashed_bootstrap(pairs: DataFrame, rounds: int = 2000, seed: int = 20260817, least: int = 30) -> DataFrame:
    """(group, n, delta, low, high, p) as paired_bootstrap, for groups of any size.

    Instead of drawing questions, each question counts in each round as often as a Poisson variable of mean 1
    says, which a hash of seed, question and round decides. So sums of a round add up over tasks before they
    meet, and no group is in one task; the same questions give the same interval in any order. Differences
    count with six decimals. A round in which no question counts is none.
    """
    diff = pairs.select("group", F.col("qid").cast("string").alias("qid"), F.round(F.col("a") - F.col("b"), 6).cast("decimal(18,6)").alias("d")).where("d is not null")
    whole = diff.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d").cast("double") / F.count(F.lit(1)), 9).alias("delta"))
    # A few rows become rounds times as many, so they are spread over all cores first, however small they are.
    many = diff.join(whole.where(F.col("n") >= least).select("group"), "group", "left_semi").repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "qid")
    each = many.select("group", "qid", "d", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    # Eight hexadecimal digits compare as the numbers do; without a filter on the weight the hash is taken once a row.
    hashed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", F.col("round").cast("string")).cast("binary")), 1, 8)
    weight, steps = F, poisson_steps()
    for k, step in enumerate(steps):
        weight = weight.when(F.col("h") < f"{step:08x}", k)
    counted = each.select("group", "round", "d", hashed.alias("h")).withColumn("w", weight.otherwise(len(steps)))
    sums = counted.groupBy("group", "round").agg(F.sum(F.col("w") * F.col("d")).cast("double").alias("s"), F.sum("w").alias("w")).where("w > 0")
    means = sums.select("group", "round", F.round(F.col("s") / F.col("w"), 9).alias("m"))
    tail = F.least(F.avg((F.col("m") <= 0).cast("int")), F.avg((F.col("m") >= 0).cast("int")))
    ends = means.groupBy("group").agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p"))
    return whole.join(ends, "group", "left").select("group", "n", "delta", "low", "high", "p")


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "positive").when(high < 0, "negative").when(low.isNotNull(), "zero")


def trust(rows: DataFrame, least: int = 1) -> DataFrame:
    """(group, n, score, flagged) of rows (groups, score, flagged): a row counts once in each of its groups and in 'all'; groups under `least` rows are left out."""
    each = rows.select(F.explode(F.array_distinct(F.concat("groups", F.array(F.lit("all"))))).alias("group"), "score", "flagged")
    found = each.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"), F.count_if(F.col("flagged")).alias("flagged"))
    return found.where(F.col("n") >= least)


def inherited(own: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """A run's files, and its parent's for configs that it has not."""
    return own.unionByName(parent.join(own.select(key).distinct(), key, "left_anti"))


def subsets(sets: DataFrame) -> DataFrame:
    """Names of sets (folder, name, items) that are strict subsets of another in their folder.

    Only distinct sets are compared, and a set only with those that hold its rarest item of the folder.
    """
    named = sets.select("folder", "name", F.array_sort(F.array_distinct("items")).alias("items"))
    distinct = named.groupBy("folder", "items").agg(F.count(F.lit(1)).alias("_"))
    each = distinct.select("folder", "items", F.explode("items").alias("item"))
    rare = each.groupBy("folder", "item").agg(F.count(F.lit(1)).alias("df"))
    key = each.join(rare, ["folder", "item"]).groupBy("folder", "items").agg(F.min_by("item", F.struct("df", "item")).alias("item"))
    larger = each.select("folder", "item", F.col("items").alias("other"))
    within = key.join(larger, ["folder", "item"]).where((F.size("items") < F.size("other")) & (F.size(F.array_except("items", "other")) == 0)).select("folder", "items").distinct()
    some = named.where(F.size("items") > 0).join(within, ["folder", "items"], "left_semi")
    none = named.where(F.size("items") == 0).join(each.select("folder").distinct(), "folder", "left_semi")
    return some.unionByName(none).select("folder", "name").distinct()


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict, bands: int = 1000) -> DataFrame:
    """(by, one column a rank): the value at each rank (from 0, a function of the group's size) of a group's sorted values.

    Values fall into `bands` equal bands between the group's ends, counted first in tasks; only the band
    that holds a rank is ordered, so a group of any size never meets in one task unless its values do.
    """
    ends = rows.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n"))
    band = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(bands - 1), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bands))).otherwise(0)
    placed = rows.where(F.col(value).isNotNull()).join(ends, by).withColumn("_band", band)
    counts = placed.groupBy(by, "_band").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    run = Window.partitionBy(by).orderBy("_band")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).alias("rank")) for name, rank in ranks.items()]))
    counts = counts.withColumn("_to", F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c")).select(by, "_band", "_from", "_to", asked.alias("_a"))
    held = counts.where((F.col("_a.rank") >= F.col("_from")) & (F.col("_a.rank") < F.col("_to"))).select(by, "_band", "_from", "_a.name", "_a.rank")
    near = placed.select(by, "_band", value).join(held.select(by, "_band").distinct(), [by, "_band"], "left_semi").groupBy(by, "_band", value).agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_upto", F.sum("_c").over(Window.partitionBy(by, "_band").orderBy(value)))
    found = near.join(held, [by, "_band"]).where(F.col("_from") + F.col("_upto") > F.col("rank")).groupBy(by, "name").agg(F.min(value).alias("v"))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
