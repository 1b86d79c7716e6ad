"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Base statistics come from each whole text; a document that fails a base rule is out. The others get
a vector of transformed statistics (FEATURES), and each language and source gets a minimum-covariance-
determinant estimate of their centre and scatter:

- Three starts, all about the coordinatewise medians: the squared median deviations alone, the
  covariance of spatial signs, and that of squashed (tanh) standard scores.
- A concentration step keeps the COVERAGE share of rows with the smallest distances and takes its
  mean and covariance. After FIRST_STEPS steps each group goes on with the start of the smallest
  determinant, until no group's determinant falls any more (MOST_STEPS steps at the most).
- A row is rejected where its squared Mahalanobis distance, over the consistency factor (the median
  distance against that of a chi-squared variable), passes the chi-squared quantile of 1 - TAIL.

Many statistics are exactly zero for most rows, so the squares of FLOORS (what is taken as ordinary
spread) are added to the variances, as in the regularised form of the estimate. Statistics of text
have heavier tails than normal ones, so TAIL is small. Steps are grouped aggregates over a narrow
checkpointed table; Cholesky factors and distances are column expressions. Quantiles come from
histograms (a thirty-second of a floor for medians, 1/200 for distances), which tasks count first, so
a group of any size meets as a few thousand rows and the results do not depend on partitions.

A group with fewer than LEAST_ROWS rows, ten a statistic, takes the estimate of its language, then of
all rows; with fewer still nothing is rejected.

Windows of three words are compared by 64-bit hash inside one text.

Defined cases: a null text has no word; null languages and sources are groups of their own;
repeated rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, cut, join_hot, load

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
COVERAGE, FIRST_STEPS, MOST_STEPS, LEAST_ROWS, TAIL, LEAST_FALL = 0.75, 2, 30, 60, 1e-15, 1e-3
#: Name: (expression over the statistics, least standard deviation).
FEATURES = {
    "word_length": ("ln(word_chars / n_words)", 0.05),
    "words": ("ln(n_words)", 0.5),
    "symbols": ("sqrt(n_symbols / n_words)", 0.06),
    "dup_lines": ("sqrt(n_dup_lines / (n_lines + 1))", 0.08),
    "repeats": ("sqrt(n_repeat_words / n_words)", 0.06),
    "capitals": ("sqrt(n_capitals / word_chars)", 0.05),
}
P, FLOORS = len(FEATURES), [f for _, f in FEATURES.values()]
PAIRS = [(i, j) for i, j in itertools.product(range(P), repeat=2) if j <= i]
PARAMS = [*[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i, j in PAIRS]]


def chi2_quantile(tail: float, degrees: int = P) -> float:
    """What a chi-squared variable of even degrees passes with the probability `tail`."""
    half = degrees // 2
    over = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
    low, high = 0.0, 2000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) > tail else (low, middle)
    return low


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    rows = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_h"),
    )
    # Only texts with some window twice need the positions: equal hashes stand side by side once sorted.
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(e["h"] == F.get("_s", j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("_s", j + 1)["h"], F.lit(False))
    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda e: e["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _x(j: int) -> Column:
    return F.col(f"x{j}")


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution in the Cholesky factor (columns m{j}, l{i}_{j})."""
    for i in range(P):
        v = _x(i) - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", v / F.col(f"l{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(*[f"y{i}" for i in range(P)])


def _cholesky(groups: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """From means m{i} and covariances s{i}_{j}: the factor's columns and log_det, that of the covariance with the squared floors added to its diagonal."""
    for j in range(P):
        for i in range(j, P):
            v = F.col(f"s{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            if i == j:
                v = F.sqrt(F.greatest(v + F.lit(FLOORS[i] ** 2), F.lit(FLOORS[i] ** 2 / 100)))  # the second against rounding alone
            else:
                v = v / F.col(f"l{j}_{j}")
            groups = groups.withColumn(f"l{i}_{j}", v)
    return groups.select(*keep, *PARAMS, sum((2 * F.log(F.col(f"l{i}_{i}")) for i in range(1, P)), 2 * F.log("l0_0")).alias("log_det"))


def _levels(rows: DataFrame) -> DataFrame:
    """(lang, source) -> _g, the finest of (language and source), language, all that has LEAST_ROWS rows; null if none has."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    every = sizes.agg(F.sum("n").alias("n_all"))
    joined = sizes.join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(every))  # one row
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    group = F.when(F.col("n") >= LEAST_ROWS, name("lang", "source")).when(F.col("n_lang") >= LEAST_ROWS, name("lang")).when(F.col("n_all") >= LEAST_ROWS, F.lit("{}"))
    return joined.select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), group.alias("_g"))


def _bin(d2: Column) -> Column:
    """The bin of a distance, of 1/200 of its size."""
    return F.floor(F.log(F.greatest(d2, F.lit(1e-12))) * 200)


def _quantiles(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """The first bin of each group of binned (by, bin) up to which `share` of its rows lie: by, q."""
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    run = counts.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    return run.where(F.col("below") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias("q"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """_g and q{i}, the median of each value to 1/32 of its floor."""
    bins = F.array(*[F.round(v / F.lit(f / 32)).cast("long") for v, f in zip(values, FLOORS, strict=True)])
    found = _quantiles(rows.select("_g", F.posexplode(bins).alias("i", "bin")), ["_g", "i"], 0.5)
    return found.groupBy("_g").agg(*[F.max(F.when(F.col("i") == i, F.col("q") * F.lit(f / 32))).alias(f"q{i}") for i, f in enumerate(FLOORS)])


def _joined(rows: DataFrame, params: DataFrame, sizes: DataFrame, groups: int, total: int) -> DataFrame:
    """rows with their group's parameters: by broadcast if the groups are few enough, else with no group in one task."""
    if groups * 300 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(params), "_g")
    return join_hot(rows, params.join(sizes, "_g"), "_g", "_n", total)


def estimates(rows: DataFrame) -> DataFrame:
    """(_g, means, factor, log_det, scale) by minimum covariance determinant over rows (_g, x0..)."""
    sizes = cut(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    groups, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    place = lambda params: _joined(rows, params, sizes, groups, total)
    middle = cut(_medians(rows, [_x(i) for i in range(P)]).select("_g", *[F.col(f"q{i}").alias(f"m{i}") for i in range(P)]))
    spread = _medians(place(middle), [F.abs(_x(i) - F.col(f"m{i}")) for i in range(P)])
    spread = cut(middle.join(spread.select("_g", *[F.sqrt(F.pow(F.col(f"q{i}") * 1.4826, 2) + FLOORS[i] ** 2).alias(f"w{i}") for i in range(P)]), "_g"))
    z = place(spread).select("_g", *[((_x(i) - F.col(f"m{i}")) / F.col(f"w{i}")).alias(f"z{i}") for i in range(P)])
    z = z.withColumn("r", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))), F.lit(1e-9)))
    signs = {(i, j): F.col(f"z{i}") * F.col(f"z{j}") / F.col("r") / F.col("r") * P for i, j in PAIRS}
    tanh = {(i, j): F.tanh(f"z{i}") * F.tanh(f"z{j}") for i, j in PAIRS}
    shapes = z.groupBy("_g").agg(*[F.avg(v).alias(f"{k}{i}_{j}") for k, by in (("a", signs), ("b", tanh)) for (i, j), v in by.items()]).join(spread, "_g")
    own = lambda k, i, j: (F.lit(float(i == j)) if k is None else F.col(f"{k}{i}_{j}")) * F.col(f"w{i}") * F.col(f"w{j}")
    starts = F.array(*[F.struct(F.lit(n).alias("start"), *[own(k, i, j).alias(f"s{i}_{j}") for i, j in PAIRS]) for n, k in enumerate((None, "a", "b"))])
    params = cut(_cholesky(shapes.select("_g", *[f"m{i}" for i in range(P)], F.inline(starts)), ("_g", "start")))
    # A group's starts are columns of the same rows here, so that their minima are of one group.
    steps = 0
    while True:
        far = with_distance(place(params)).withColumn("bin", _bin(F.col("d2")))
        near = cut(_quantiles(far.select("_g", "start", "bin"), ["_g", "start"], COVERAGE).select(F.col("_g").alias("_ng"), F.col("start").alias("_ns"), "q"))
        near = F.broadcast(near) if groups * 3 * 64 <= BROADCAST_BYTES else near
        core = far.join(near, (F.col("_g") == F.col("_ng")) & (F.col("start") == F.col("_ns"))).where("bin <= q")
        dev = lambda i: _x(i) - F.col(f"m{i}")  # noqa: E731  about the last centre, which keeps the sums small
        sums = core.groupBy("_g", "start").agg(*[F.first(f"m{i}").alias(f"c{i}") for i in range(P)], *[F.avg(dev(i)).alias(f"d{i}") for i in range(P)], *[F.avg(dev(i) * dev(j)).alias(f"p{i}_{j}") for i, j in PAIRS])
        new = cut(_cholesky(sums.select("_g", "start", *[(F.col(f"c{i}") + F.col(f"d{i}")).alias(f"m{i}") for i in range(P)], *[(F.col(f"p{i}_{j}") - F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]), ("_g", "start")))
        steps += 1
        if steps < FIRST_STEPS:
            params = new
        elif steps == FIRST_STEPS:  # the start of the smallest determinant
            best = cut(new.groupBy("_g").agg(F.min_by(F.struct("start", *PARAMS, "log_det"), F.struct("log_det", "start")).alias("p")).select("_g", "p.*"))
            params = best
        else:
            fell = new.join(best.select("_g", F.col("log_det").alias("_last")), "_g").where(F.col("log_det") < F.col("_last") - LEAST_FALL).drop("_last")
            params = cut(fell)
            if params.isEmpty():
                break
            best = cut(best.join(params.select("_g"), "_g", "left_anti").unionByName(params))
            if steps >= MOST_STEPS:
                break
    best = best.drop("start")
    median = _quantiles(with_distance(place(best)).select("_g", _bin(F.col("d2")).alias("bin")), ["_g"], 0.5)
    scale = median.select("_g", F.greatest(F.lit(1.0), F.exp((F.col("q") + 0.5) / 200) / F.lit(chi2_quantile(0.5))).alias("scale"))
    return cut(best.join(scale, "_g"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and distance (squared, over its scale; null where not judged)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = statistics(named, "text", ("doc_id", "lang", "source")).withColumn("base_failed", failed)
    stats = cut(stats.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.expr(e)) for i, (e, _) in enumerate(FEATURES.values())}))
    judged = stats.where("not base_failed")
    levels = cut(_levels(judged))
    levels = _small(levels, levels.count(), 96)
    placed = lambda rows: rows.join(levels, F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left").drop("_gl", "_gs")
    grouped = cut(placed(stats))
    params = estimates(grouped.where("not base_failed and _g is not null").select("_g", *[f"x{i}" for i in range(P)])).drop("log_det")
    rows = grouped.join(_small(params, params.count(), 300), "_g", "left")
    rows = with_distance(rows)
    far = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(far, F.lit(0.0)) <= chi2_quantile(tail))).alias("kept"), far.alias("distance"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))
