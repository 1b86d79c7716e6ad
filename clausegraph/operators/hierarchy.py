"""Section trees and references between clauses, by equality joins on exploded prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T


def ancestors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, spec_id, section_id, ancestor, depth) for every proper prefix of a section id."""
    return chunks.select("chunk_id", "spec_id", "section_id", F.posexplode(T.prefixes(F.col("section_id"))).alias("depth", "ancestor"))


def distinct_sections(chunks: DataFrame) -> DataFrame:
    """One chunk a section: the one with the largest id (the last wins)."""
    return chunks.groupBy("spec_id", "section_id").agg(F.max("chunk_id").alias("chunk_id"))


def nearest_ancestors(chunks: DataFrame) -> DataFrame:
    """(child, parent): the deepest prefix that is a section, with no theta join."""
    sections = distinct_sections(chunks)
    found = ancestors(sections).join(sections.select("spec_id", F.col("section_id").alias("ancestor"), F.col("chunk_id").alias("parent")), ["spec_id", "ancestor"])
    return found.groupBy(F.col("chunk_id").alias("child")).agg(F.max_by("parent", "depth").alias("parent"))


def parents(chunks: DataFrame) -> DataFrame:
    """Sections that have a descendant (a semi join)."""
    sections = distinct_sections(chunks)
    return sections.join(ancestors(sections).select("spec_id", F.col("ancestor").alias("section_id")).distinct(), ["spec_id", "section_id"], "left_semi")


def leaves(chunks: DataFrame) -> DataFrame:
    sections = distinct_sections(chunks)
    return sections.join(ancestors(sections).select("spec_id", F.col("ancestor").alias("section_id")).distinct(), ["spec_id", "section_id"], "left_anti")


def heading_paths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path): the titles of the ancestors that exist, outermost first, joined by ' > '."""
    sections = distinct_sections(chunks).join(chunks.select("chunk_id", "title"), "chunk_id")
    found = ancestors(chunks).join(sections.select("spec_id", F.col("section_id").alias("ancestor"), F.col("title")), ["spec_id", "ancestor"])
    paths = found.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "title"))), lambda x: x["title"]), " > ").alias("path"))
    return chunks.select("chunk_id").join(paths, "chunk_id", "left").select("chunk_id", F.coalesce("path", F.lit("")).alias("path"))


def resolve(cited: DataFrame, chunks: DataFrame, fanout: int = 12) -> DataFrame:
    """(src, dst, tier) of citations (src, spec_id, cited): the very clause but not itself, else up to
    `fanout` descendants (direct children only if there are more), else the clause without its -N suffix."""
    sections = distinct_sections(chunks)
    by_id = sections.select("spec_id", F.col("section_id").alias("cited"), F.col("chunk_id").alias("dst"))
    exact = cited.join(by_id, ["spec_id", "cited"]).where("src <> dst").select("src", "spec_id", "cited", "dst", F.lit(1).alias("tier"))
    below = ancestors(sections).select("spec_id", F.col("ancestor").alias("cited"), F.col("chunk_id").alias("dst"), (F.size(F.split("section_id", r"\.")) - F.size(F.split("ancestor", r"\."))).alias("down"))
    sizes = below.groupBy("spec_id", "cited").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("spec_id", "cited").orderBy("dst"))
    chosen = below.join(sizes, ["spec_id", "cited"]).where((F.col("n") <= fanout) | (F.col("down") == 1)).withColumn("rank", rank).where(F.col("rank") <= fanout)
    met = by_id.select("spec_id", "cited")
    missing = cited.join(met, ["spec_id", "cited"], "left_anti")
    spread = missing.join(chosen, ["spec_id", "cited"]).where("src <> dst").select("src", "spec_id", "cited", "dst", F.lit(2).alias("tier"))
    rest = missing.join(below.select("spec_id", "cited").distinct(), ["spec_id", "cited"], "left_anti").where(F.col("cited").rlike(r"-\d+$"))
    cut = rest.withColumn("base", F.regexp_replace("cited", r"-\d+$", "")).join(by_id.withColumnRenamed("cited", "base"), ["spec_id", "base"]).where("src <> dst").select("src", "spec_id", "cited", "dst", F.lit(3).alias("tier"))
    return exact.unionByName(spread).unionByName(cut).select("src", "dst", "tier").distinct()


def siblings(seeds: DataFrame, chunks: DataFrame, most: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(seed, chunk_id, source, rank): up to `most` neighbours of each seed (chunk_id) in the section tree, never itself.

    First, as `edge`, the other children of its parent that say 'shall', in any case; what is left of `most` is
    filled, as `prefix`, by sections of the same parent prefix and depth, whatever they say. Ties by id.
    edges: (child, parent), those of nearest_ancestors if none are given. A seed needs no more than the first few
    of a group, so only those of each group meet the seeds: a parent with very many children stays cheap.
    """
    edges = nearest_ancestors(chunks) if edges is None else edges
    own = seeds.select(F.col("chunk_id").alias("seed")).distinct()
    first = lambda rows, keys, k: rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))).where(F.col("n") <= k).drop("n")
    shall = chunks.where(F.lower("content").contains("shall")).select(F.col("chunk_id").alias("child"))
    below = edges.join(shall, "child", "left_semi").select("parent", F.col("child").alias("chunk_id"))
    by_edge = own.join(edges.select(F.col("child").alias("seed"), "parent"), "seed").join(first(below, ["parent"], most + 1), "parent")
    placed = chunks.select("chunk_id", "spec_id", T.parent_id(F.col("section_id")).alias("up"), T.level(F.col("section_id")).alias("deep")).where("up is not null")
    mine = placed.select(F.col("chunk_id").alias("seed"), "spec_id", "up", "deep").join(own, "seed", "left_semi")
    by_prefix = mine.join(first(placed, ["spec_id", "up", "deep"], 2 * most + 1), ["spec_id", "up", "deep"])
    found = by_edge.select("seed", "chunk_id", F.lit("edge").alias("source")).unionByName(by_prefix.select("seed", "chunk_id", F.lit("prefix").alias("source")))
    found = found.where("seed <> chunk_id").groupBy("seed", "chunk_id").agg(F.min("source").alias("source"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("source", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("seed", "chunk_id", "source", "rank")


def same_subject(chunks: DataFrame) -> DataFrame:
    """(chunk_id, same_as, n): clauses of one specification and title, where there are several and one of them defines: by their first definition, not as pairs."""
    key = ["spec_id", "title"]
    groups = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("chunk_type") == "definition", F.col("chunk_id"))).alias("same_as")).where("n > 1 and same_as is not null")
    return chunks.select("chunk_id", *key).join(groups, key).select("chunk_id", "same_as", "n")


# Fixed value: the least content of a clause that a hop may reach.
HOP_LEAST_CHARS = 100


def hops(seeds: DataFrame, refs: DataFrame, chunks: DataFrame, a_seed: int = 50, most: int = 40, by: str | None = None) -> DataFrame:
    """Targets within two citations of the seeds (seed, ord), never by one citation twice, of another
    specification and with content of HOP_LEAST_CHARS or more, with the fewest hops each; at most `a_seed` a seed, dealt round-robin, at most `most` in all, or for each value of
    the seeds' column `by`."""
    if by is None:
        return hops(seeds.withColumn("_all", F.lit(0)), refs, chunks, a_seed, most, "_all").drop("_all")
    one = seeds.join(refs.select(F.col("src").alias("seed"), F.col("dst").alias("target")), "seed").withColumn("hops", F.lit(1))
    two = one.join(refs.select(F.col("src").alias("target"), F.col("dst").alias("next")), "target").where("not (seed = target and target = next)").select(by, "seed", "ord", F.col("next").alias("target"), F.lit(2).alias("hops"))
    found = one.select(by, "seed", "ord", "target", "hops").unionByName(two).where("seed <> target").groupBy(by, "seed", "ord", "target").agg(F.min("hops").alias("hops"))
    found = found.join(chunks.select(F.col("chunk_id").alias("seed"), F.col("spec_id").alias("own")), "seed")
    far = chunks.where(F.length("content") >= HOP_LEAST_CHARS).select(F.col("chunk_id").alias("target"), F.col("spec_id").alias("other"))
    found = found.join(far, "target").where("own <> other").select(by, "seed", "ord", "target", "hops")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(by, "seed").orderBy("hops", "target"))).where(F.col("n") <= a_seed)
    best = found.withColumn("first", F.row_number().over(Window.partitionBy(by, "target").orderBy("hops", "n", "ord"))).where("first = 1")
    best = best.withColumn("turn", F.row_number().over(Window.partitionBy(by, "seed").orderBy("hops", "target")))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("turn", "ord", "target")))
    return best.where(F.col("place") <= most).select(by, "seed", "target", "hops", "turn")


def orphan_targets(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct targets (target) that are no id of ids (id), whole or as all that stands before one of its hyphens: ts_38_508 is there if ts_38_508-1 is."""
    parts = F.split("id", "-")
    heads = ids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))).alias("target"))
    return targets.select("target").distinct().join(heads, "target", "left_anti")
