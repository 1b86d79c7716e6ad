"""Sources and sinks of the corpus: archives, word-processor files, HTML, clause JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions import text as T

REFERENCE = "struct<internal: array<struct<ref_type: string, ref_id: string>>, external: array<struct<target_spec: string, ref_type: string, ref_id: string, confidence: double>>>"
TABLE = "struct<headers: array<string>, rows: array<array<string>>>"
CHUNK = f"chunk_id: string, section_id: string, section_title: string, content: string, chunk_type: string, cross_references: {REFERENCE}, content_metadata: struct<word_count: int, complexity_score: double, key_terms: array<string>>, tables: array<{TABLE}>, section_path: array<string>, section_path_ids: array<string>"
#: One JSON file a specification.
DOCUMENT = f"metadata struct<specification_id: string, version: string, title: string, file_path: string, release: string>, export_info struct<export_date: string, total_chunks: int, pipeline_version: string>, chunks array<struct<{CHUNK}>>"
#: An element of a document in reading order: h1..h6, p, or table (row 0 has the headers).
ELEMENT = "path string, pos int, tag string, text string, cells array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def zip_members(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the main-body files in all archives below a folder; archives that can't be read give nothing.

    An archive is one row, but its members leave it one by one. Other members are not unpacked.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for n in z.namelist():
                            if n.lower().endswith(".docx"):
                                yield pd.DataFrame([(f"{path}!{n.rsplit('/', 1)[-1]}", z.read(n))], columns=["path", "content"])
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder)
    found = files.select("path", "content").mapInPandas(run, "path string, content binary")
    return found.where(T.is_main_body(F.regexp_extract("path", r"([^/!]*)$", 1)))


def _docx(data: bytes) -> list[tuple[str, str | None, list | None]]:
    """The headings, paragraphs and tables of a word-processor file, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str | None, list | None]] = []

    def text(node: ElementTree.Element) -> str:
        return "".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in node.iter()).strip()

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = name[7:] if name.lower().startswith("heading") and name[7:].isdigit() else ""
            if said := text(node):
                out.append((f"h{min(6, int(level))}" if level else "p", said, None))
        elif node.tag == f"{_W}tbl":
            cells = [[" ".join(filter(None, map(text, c.iter(f"{_W}p")))) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
            out.append(("table", None, cells))
    return out


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str | None, list | None]] = []
        self.tag, self.text, self.skip = "", [], 0
        self.table: list[list[str]] | None = None

    def _end(self) -> None:
        said = "".join(self.text).strip()
        self.text = []
        if self.table is None and self.tag and said:
            self.out.append((self.tag, said, None))
        self.tag = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self._end()
            self.table = []
        elif self.table is not None and tag == "tr":
            self.table.append([])
        elif self.table is not None and tag in ("td", "th"):
            self.text = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
            if self.table is None:
                self._end()
                self.tag = tag
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table is not None:
            self.out.append(("table", None, self.table))
            self.table = None
        elif self.table is not None and tag in ("td", "th") and self.table:
            self.table[-1].append(" ".join("".join(self.text).split()))
            self.text = []
        elif self.table is None and tag == self.tag:
            self._end()

    def handle_data(self, data):
        if not self.skip and (self.tag or self.table is not None):
            self.text.append(data)


def _html(data: str) -> list[tuple[str, str | None, list | None]]:
    parser = _Elements()
    parser.feed(data or "")
    parser.close()
    parser._end()
    return parser.out


def _elements(df: DataFrame, parse) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                rows += [(path, i, *e) for i, e in enumerate(parse(data))]
            yield pd.DataFrame(rows, columns=["path", "pos", "tag", "text", "cells"])

    return df.select("path", "content").mapInPandas(run, ELEMENT)


def docx_elements(files: DataFrame) -> DataFrame:
    """Elements of (path, content) files."""
    return _elements(files, _docx)


def html_elements(pages: DataFrame) -> DataFrame:
    """Elements of (path, content) pages."""
    return _elements(pages, _html)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row a clause from JSON files, one a specification; files that can't be parsed are left out."""
    docs = spark.read.schema(DOCUMENT + ", _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return docs.where("metadata is not null").select(F.col("metadata.specification_id").alias("spec_id"), F.col("metadata.title").alias("spec_title"), F.col("metadata.version").alias("version"), F.explode("chunks").alias("c")).select("spec_id", "spec_title", "version", "c.*")


def write_documents(chunks: DataFrame, folder: str) -> None:
    """One JSON file a specification below folder; the committer makes it appear whole or not at all."""
    names = [x.split(":")[0].strip() for x in ("chunk_id: s", "section_id: s", "section_title: s", "content: s", "chunk_type: s", "cross_references: s", "content_metadata: s", "tables: s", "section_path: s", "section_path_ids: s")]
    docs = chunks.groupBy("spec_id", "spec_title", "version").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("chunks"))
    out = docs.select(
        F.struct(F.col("spec_id").alias("specification_id"), "version", F.col("spec_title").alias("title"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("release")).alias("metadata"),
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("export_date"), F.size("chunks").alias("total_chunks"), F.lit("1").alias("pipeline_version")).alias("export_info"),
        "chunks",
    )
    out.write.mode("overwrite").json(folder)


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose derived name is not among those done."""
    return files.join(done.select("name").distinct(), "name", "left_anti")


def parts_or_last(files: DataFrame) -> DataFrame:
    """Of (spec, stem, file): all files of specifications with one stem, which are its parts; of the others, which come in several versions, the last file by name."""
    one = files.groupBy("spec").agg((F.count_distinct("stem") == 1).alias("_parts"), F.max("file").alias("_last"))
    return files.join(one, "spec").where(F.col("_parts") | (F.col("file") == F.col("_last"))).drop("_parts", "_last")


def metadata(elements: DataFrame) -> DataFrame:
    """(path, spec_id, version, title, release): from the first 5000 characters, else from the file's name."""
    opening = elements.where("text is not null").groupBy("path").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n"), 1, 5000).alias("head"))
    found = r"3GPP\s+TS\s+(\d+\.\d+(?:-\d+)?)\s+V(\d+\.\d+\.\d+)"
    name = F.regexp_replace(F.regexp_extract("path", r"([^/!]*)$", 1), r"\.[^.]*$", "")
    digits = r"(\d{2})(\d{3})(?:-(\d+))?"
    part = F.regexp_extract(name, digits, 3)
    from_name = F.when(name.rlike(digits), F.concat(F.regexp_extract(name, digits, 1), F.lit("."), F.regexp_extract(name, digits, 2), F.when(part != "", F.concat(F.lit("-"), part)).otherwise("")))
    said = F.col("head").rlike(found)
    number = F.when(said, F.regexp_extract("head", found, 1)).otherwise(from_name)
    version = F.when(said, F.regexp_extract("head", found, 2)).otherwise("Unknown")
    rows = opening.select("path", F.coalesce(number, name).alias("number"), version.alias("version"), said.alias("said"))
    return rows.select("path", F.concat(F.lit("ts_"), F.regexp_replace("number", r"\.", "_")).alias("spec_id"), "version", F.concat(F.lit("3GPP "), F.when(F.col("number").rlike(r"^\d+\."), F.concat(F.lit("TS "), F.col("number"))).otherwise(F.col("number"))).alias("title"), F.when(F.col("said"), F.concat(F.lit("Rel-"), F.substring_index("version", ".", 1))).otherwise("Unknown").alias("release"))
