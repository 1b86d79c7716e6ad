"""Exact dedup by two-pass Bloom filtering, in DataFrame functions alone.

Pass one counts the documents by the top SLOT_BITS bits of their normalised text's hash, in tasks
first: one long a document and no text. (A bitmap a task would be larger: at 16 bits a row each task
would send 2 bytes for every row of the whole table, not of its own.) The slots that were met twice
make the filter of possibly repeated hashes. Pass two tests each row against that filter: rows that
miss it are unique and pass straight through, and only the rest shuffle.

The filter is a blocked Bloom filter: a slot picks one word of 64 bits and three bits in it. It has a
word for every WORD_KEYS slots or fewer, so it grows with what is repeated and lets the same share
through in error at every size. Words are broadcast within BROADCAST_BYTES; beyond that rows' hashes
meet their words by shuffle, but for the words that many rows share, which are still broadcast. What
the filter lets through changes no result: equality is decided on the SHA-256 of the normalised
text, never on the filter's hash.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; of rows that
repeat both doc_id and text, all are reported and exactly one is kept; an empty table gives an
empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import BROADCAST_BYTES, ascii_lower, cut, join_hot, load

SLOT_BITS, WORD_KEYS, WORD_BYTES, KEY_BYTES = 40, 4, 32, 128


def slot_of(sha: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(sha), 64 - SLOT_BITS)


def _mask(slot: Column) -> Column:
    """The bits that a slot sets in its word."""
    h = F.xxhash64(slot, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


class Filter:
    """The filter of the slots that rows of `hashes` (column _sha) meet at least twice."""

    def __init__(self, hashes: DataFrame, total: int):
        slots = cut(hashes.select(slot_of(F.col("_sha")).alias("_slot")).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2"))
        self.total, self.words = total, 1 << max(0, (slots.count() // WORD_KEYS).bit_length())
        table = slots.groupBy(self._word(F.col("_slot")).alias("_word")).agg(F.bit_or(_mask(F.col("_slot"))).alias("_bits"), F.sum("_n").alias("_n"))
        self.table, self.small = cut(table), self.words * WORD_BYTES <= BROADCAST_BYTES

    def _word(self, slot: Column) -> Column:
        return F.xxhash64(slot).bitwiseAND(F.lit(self.words - 1))

    def mark(self, rows: DataFrame) -> DataFrame:
        """Adds _possible to rows (_sha and others): whether the filter holds all bits of the row's slot."""
        rows, slot = rows.withColumn("_word", self._word(slot_of(F.col("_sha")))), slot_of(F.col("_sha"))
        if self.small:
            found = rows.join(F.broadcast(self.table.drop("_n")), "_word", "left")
        else:
            found = join_hot(rows, self.table, "_word", "_n", self.total, "left")
        return found.withColumn("_possible", F.coalesce(F.col("_bits").bitwiseAND(_mask(slot)) == _mask(slot), F.lit(False))).drop("_word", "_bits")


def _sha(text_col: str) -> Column:
    return F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = cut(docs.select(F.col(id_col).alias("doc_id"), _sha(text_col).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    total = hashed.count()
    marked = Filter(hashed, total).mark(hashed)
    possible = marked.where("_possible").drop("_possible")
    groups = cut(possible.groupBy("_sha").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")).withColumn("_n", F.col("group_size")))
    resolved = join_hot(possible, groups, "_sha", "_n", total)
    alone = marked.where("not _possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(resolved.select("doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_sha").alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts the one with the largest id.

    Which ids and hashes go is decided without the texts. Rows that miss the filter never shuffle; the
    others meet the ids that go by broadcast within BROADCAST_BYTES, else dealt by id and hash, so that
    no group of copies meets in one task.
    """
    hashed = cut(docs.select(F.col(id_col).alias("_id"), _sha(text_col).alias("_sha")))
    total = hashed.count()
    repeated = Filter(hashed, total)
    each = cut(repeated.mark(hashed).where("_possible").groupBy("_sha", "_id").agg(F.count(F.lit(1)).alias("_times")))
    groups = cut(each.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.sum("_times").alias("_size"), F.count(F.lit(1)).alias("_n")).where("_size > 1").drop("_size"))
    ruled = cut(join_hot(each, groups, "_sha", "_n", total).select(F.col("_sha").alias("_gone_sha"), F.col("_id").alias("_gone"), F.col("_id").eqNullSafe(F.col("_keep")).alias("_stays"), "_times"))
    gone, again = ruled.where("not _stays or _times > 1"), ruled.where("_stays and _times > 1").drop("_stays", "_times")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    marked = repeated.mark(docs.select(F.col(id_col).alias("_id"), _sha(text_col).alias("_sha"), doc)) if repeated.small else docs.select(F.col(id_col).alias("_id"), _sha(text_col).alias("_sha"), doc, F.lit(True).alias("_possible"))
    met = (F.col("_sha") == F.col("_gone_sha")) & F.col("_id").eqNullSafe(F.col("_gone"))
    small = lambda t: F.broadcast(t) if t.count() * KEY_BYTES <= BROADCAST_BYTES else t
    possible = marked.where("_possible")
    stay = possible.join(small(gone), met, "left_anti").select("_doc")
    stay = marked.where("not _possible").select("_doc").unionByName(stay)
    if not again.isEmpty():  # rows that repeat both id and text
        stay = stay.unionByName(possible.join(small(again), met, "left_semi").dropDuplicates(["_sha"]).select("_doc"))
    return stay.select("_doc.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
