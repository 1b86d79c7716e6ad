"""From elements of documents to clause chunks, and the checks that chunks must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators.extract import citations


def sections(elements: DataFrame) -> DataFrame:
    """(path, pos, section_id, title, content, tables): every element belongs to the latest heading.

    The body starts at the first h1, or at the first other heading that reads as a clause and is no
    line of contents; it ends at the change history. Annex roots may be paragraphs.
    """
    is_heading = F.col("tag").rlike("^h[1-6]$")
    head = F.when(is_heading, T.heading(F.col("text")))
    root = F.when(is_heading | (F.col("tag") == "p"), T.annex(F.col("text")))
    rows = elements.withColumn("head", F.coalesce(head, root))
    title = F.coalesce("head.title", "text")
    rows = rows.withColumn("stops", is_heading & T.is_change_history(title) | (root.isNotNull() & T.is_change_history(title)))
    starts = is_heading & ((F.col("tag") == "h1") | (head.isNotNull() & ~F.col("text").rlike(T.CONTENTS_LINE)))
    doc = Window.partitionBy("path")
    rows = rows.withColumn("first", F.min(F.when(starts, F.col("pos"))).over(doc)).where("pos >= first")
    rows = rows.withColumn("last", F.min(F.when(F.col("stops"), F.col("pos"))).over(doc)).where("last is null or pos < last")
    so_far = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.last(F.when(F.col("head").isNotNull(), F.col("pos")), ignorenulls=True).over(so_far)).where("at is not null")
    own = F.col("pos") == F.col("at")
    said = F.when(~own & F.col("text").isNotNull(), F.struct("pos", "text"))
    table = F.when(F.col("cells").isNotNull() & (F.size("cells") > 0), F.struct("pos", F.struct(F.col("cells")[0].alias("headers"), F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda r: F.exists(r, lambda c: c != "")).alias("rows")).alias("table")))
    return rows.groupBy("path", F.col("at").alias("pos")).agg(
        F.max(F.when(own, F.col("head.id"))).alias("section_id"),
        F.max(F.when(own, F.col("head.title"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), "\n").alias("content"),
        F.transform(F.array_sort(F.collect_list(table)), lambda x: x["table"]).alias("tables"),
    )


def key_terms(chunks: DataFrame, key: str = "chunk_id", most: int = 10) -> DataFrame:
    """(key, key_terms): upper-case words of two to six letters, the most frequent first, ties by first place."""
    found = chunks.select(key, F.posexplode(F.regexp_extract_all("content", F.lit(T.KEY_TERM), 1)).alias("pos", "term"))
    counts = found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "term"))), 1, most), lambda x: x["term"]).alias("key_terms"))


def chunks(found: DataFrame, about: DataFrame, limit: int = T.MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks of sections and their documents' metadata (path, spec_id, version, title).

    Long sections are cut at lines into parts p2, p3..; a number that comes again gets ~2, ~3..; tables
    stay with the first part. Sections without text give no chunk but name their descendants' paths.
    """
    about = about.select("path", "spec_id", "version", F.col("title").alias("spec_title"))
    joined = found.join(about, "path")
    named = joined.where("title <> ''").groupBy("spec_id", F.col("section_id").alias("ancestor")).agg(F.max_by("title", "pos").alias("name"))
    parts = joined.where(F.trim("content") != "").select("*", F.posexplode(T.split_lines(F.col("content"), limit)).alias("k", "part")).where(F.trim("part") != "")
    base = F.when(F.col("k") == 0, F.col("section_id")).otherwise(F.concat(F.col("section_id"), F.lit("p"), (F.col("k") + 1).cast("string")))
    rows = parts.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("spec_id", "base").orderBy("path", "pos", "k")))
    rows = rows.withColumns({"id": F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("~", "base", "n")), "name": F.when(F.col("k") == 0, F.col("title")).otherwise(F.concat(F.col("title"), F.lit(" (part "), (F.col("k") + 1).cast("string"), F.lit(")")))})
    rows = rows.select(
        F.concat_ws("_", "spec_id", "id").alias("chunk_id"), "spec_id", "spec_title", "version", F.col("id").alias("section_id"), F.col("section_id").alias("_of"), F.col("name").alias("section_title"), F.col("part").alias("content"),
        T.content_type(F.col("name"), F.col("part")).alias("chunk_type"), F.when(F.col("k") == 0, F.col("tables")).alias("tables"), T.word_count(F.col("part")).alias("word_count"), T.complexity(F.col("part")).alias("complexity_score"),
    )
    above = rows.select("chunk_id", "spec_id", F.posexplode(T.prefixes(F.col("_of"))).alias("depth", "ancestor")).join(named, ["spec_id", "ancestor"])
    paths = above.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", "name"))).alias("p"))
    rows = rows.join(paths, "chunk_id", "left").join(key_terms(rows), "chunk_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "section_path": F.coalesce(F.transform("p", lambda x: x["name"]), none), "section_path_ids": F.coalesce(F.transform("p", lambda x: x["ancestor"]), none),
        "content_metadata": F.struct("word_count", "complexity_score", F.coalesce("key_terms", none).alias("key_terms")),
    })
    return citations(rows.drop("p", "_of", "word_count", "complexity_score", "key_terms"))


def repair_tails(rows: DataFrame) -> DataFrame:
    """(chunk_id, pos, section_id, title, content) for chunks whose text has swallowed annex roots; a plan, nothing is written."""
    lines = rows.select("chunk_id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("root", T.annex(F.col("line")))
    at = F.last(F.when(F.col("root").isNotNull(), F.col("pos")), ignorenulls=True).over(Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("at", at).where("at is not null")
    return lines.groupBy("chunk_id", F.col("at").alias("pos")).agg(F.max("root.id").alias("section_id"), F.max("root.title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("root").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("content"))


def violations(rows: DataFrame, limit: int = T.MAX_CHUNK_CHARS) -> DataFrame:
    """(check, chunk_id): what breaks an invariant of the corpus. Empty means it is sound."""
    out = None

    def add(name: str, bad: DataFrame) -> None:
        nonlocal out
        one = bad.select(F.lit(name).alias("check"), F.col("chunk_id"))
        out = one if out is None else out.unionByName(one)

    external = rows.select("chunk_id", "spec_id", "section_id", F.explode("cross_references.external").alias("r"))
    add("spec_id format", rows.where(~F.col("spec_id").rlike(r"^t[sr]_\d{2}_\d+(-\d+)*$")))
    add("section_id format", rows.where(~F.col("section_id").rlike(r"^(\d+[A-Za-z]?|[A-Z]{1,2})(\.\d+[A-Za-z]?)*(p\d+)?(~\d+)?$")))
    add("empty content", rows.where(F.trim(F.coalesce("content", F.lit(""))) == ""))
    add("chunk prefix", rows.where(~F.col("chunk_id").startswith(F.concat(F.col("spec_id"), F.lit("_")))))
    add("unique ids", rows.groupBy("chunk_id").count().where("count > 1"))
    add("target format", external.where(~F.col("r.target_spec").rlike(r"^t[sr]_\d{2}_\d+")))
    add("self reference", external.where(F.col("r.target_spec") == F.col("spec_id")))
    add("over the limit", rows.where((F.length("content") > limit) & F.col("content").contains("\n")))
    add("path shape", rows.where(F.size("section_path") != F.size("section_path_ids")))
    add("word count", rows.where(F.col("content_metadata.word_count") != T.word_count(F.col("content"))))
    return out


def structure_tags(questions: DataFrame) -> DataFrame:
    """(qid, tags) of (qid, gold): 'multi-spec' for two specifications or more, 'clustered' for more clauses than specifications among several."""
    specs = F.size(F.array_distinct(F.transform("gold", lambda g: F.regexp_replace(g, r"_[^_]*$", ""))))
    n = F.size("gold")
    tags = F.filter(F.array(F.when(specs >= 2, "multi-spec"), F.when((specs >= 2) & (n > specs), "clustered")), lambda t: t.isNotNull())
    return questions.select("qid", tags.alias("tags"))


def tag_check(tagged: DataFrame, known: DataFrame, tags: tuple[str, ...] = ("multi-spec", "clustered")) -> DataFrame:
    """(tag, both, said_only, known_only): how the tags' rules (qid, tags) agree with known tags (qid, known)."""
    rows = tagged.join(known, "qid").select("tags", "known", F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    said, right = F.array_contains("tags", F.col("tag")), F.array_contains("known", F.col("tag"))
    return rows.groupBy("tag").agg(F.count_if(said & right).alias("both"), F.count_if(said & ~right).alias("said_only"), F.count_if(right & ~said).alias("known_only"))
