"""Language-model scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end mark (0xFF, which UTF-8 never has); before it stand end marks
too. Each byte is eight binary choices, and each choice has a context tree over the preceding bytes,
up to `depth` of them. A node keeps the Krichevsky-Trofimov estimate of its zeros and ones, and the
weighted probability of a node is half its own block estimate plus half the product of its
children's. Given the training corpus, the next bit's probability is then exactly a mixture over
the depths: at each node its own estimate with weight w, and the child's mixture with 1 - w, where w
is the share of the node's own estimate in its weighted probability. A context not met in training
says one half. The score is the log10 probability of the text; bits_per_byte is its code length.

The corpus gives the counts of all (depth + 1)-byte strings, which determine every node of every
tree; they are counted over all training texts, in tasks first and then by a grouping. The depth is
the same at every size. Strings are dealt by the SPLIT bytes before their last, so that all nodes of
depth SPLIT and more that a string meets stand in its partition; the nodes above, 256 x 255 of depth
1 and 255 of depth 0 at the most, are made of sums over the partitions and broadcast. HEAD_STRINGS of
the most frequent strings or fewer are broadcast with their probabilities (some 12 MB); rows carry the
strings that are not among them, and these are answered in the partitions of the trees and joined.

The base score needs every word's count. The HEAD_WORDS most frequent words are broadcast; rows
carry the words that are not among them, and these meet their counts in a join.

Defined cases: a null text is empty, that is, its end alone; repeated rows are counted and scored
each; with no training text every bit has probability one half and the base score is 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import bucket_of, cut, load, slices

DEPTH, SPLIT, HEAD_STRINGS, PART_STRINGS, HEAD_WORDS, HELD_ROWS = 5, 2, 1 << 20, 1 << 16, 300_000, 400_000
END, SLOT_BITS, MOST_DEPTH = 0xFF, 22, 6  # a string of 7 bytes and a place among 256 rows fill 64 bits
_u = np.uint64


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def strings(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte string that ends at each byte and end mark of the texts, as integers; where each text's begin."""
    pad, parts = bytes([END]) * depth, []
    for t in texts:
        parts += [pad, t.encode("utf-8", "surrogatepass"), bytes([END])]
    sizes = np.array([len(p) for p in parts[1::3]], np.int64) + 1
    b = np.frombuffer(b"".join(parts), np.uint8).astype(_u)
    keys = np.zeros(len(b) - depth, _u)
    for j in range(depth + 1):
        keys = (keys << _u(8)) | b[j : len(b) - depth + j]
    wanted = np.ones(len(b), bool)
    begins = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    for j in range(depth):
        wanted[begins + j] = False
    return keys[wanted[depth:]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; good to 1e-12 for x >= 0.5."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    half = 0.5723649429247001  # log gamma(1/2)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - 2 * half


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zeros and ones of each (context, bits so far): the bits stand behind a leading one. Sorted strings hold each node's in one run."""
    x, context, names, zeros, ones = keys & _u(255), keys >> _u(8) << _u(8), [], [], []
    if not len(keys):
        return keys, counts, counts
    for k in range(8):
        name = context | _u(1 << k) | (x >> _u(8 - k))
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        one = np.add.reduceat(counts * ((x >> _u(7 - k)) & _u(1)), first)
        names.append(name[first])
        ones.append(one)
        zeros.append(np.add.reduceat(counts, first) - one)
    order = np.argsort(np.concatenate(names))
    return np.concatenate(names)[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def _parents(nodes: np.ndarray, depth: int) -> np.ndarray:
    """Names of the nodes' ancestors of that depth."""
    return (((nodes >> _u(8)) & _u((1 << (8 * depth)) - 1)) << _u(8)) | (nodes & _u(255))


def _level(depth: int, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[tuple, np.ndarray]:
    """The level (depth, names, own weights, chances of a one), and the log weighted probabilities; below: the log product over each node's children."""
    total = own = log_kt(zeros, ones)
    log_w = np.zeros_like(own)
    if below is not None:
        total = np.logaddexp(own, below) - np.log(2)
        log_w = own - np.log(2) - total
    return (depth, node, np.exp(np.minimum(log_w, 0)).astype(np.float32), ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)), total


def levels_of(keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 0) -> tuple[list[tuple], tuple]:
    """The levels from `depth` to `least`; and names, zeros, ones and log weighted probabilities of the last. keys: distinct (depth + 1)-byte strings, all that share their nodes of depth `least`."""
    order = np.argsort(keys)
    k, n, levels, below = keys[order].astype(_u), counts[order].astype(np.float64), [], None
    for d in range(depth, least - 1, -1):
        if d < depth:
            k, at = np.unique(k & _u((1 << (8 * d + 8)) - 1), return_inverse=True)
            n = np.bincount(at, n, len(k))
        node, zeros, ones = _nodes(k, n)
        if levels:
            below = np.bincount(np.searchsorted(node, _parents(levels[-1][1], d)), total, len(node))
        level, total = _level(d, node, zeros, ones, below)
        levels.append(level)
    return levels, (node, zeros, ones, total)


def log10_by(levels: list[tuple], keys: np.ndarray) -> np.ndarray:
    """log10 probability of each string's last byte after the others, by the mixture over the levels, deepest first."""
    out = np.zeros(len(keys))
    x, context = keys & _u(255), keys >> _u(8)
    for k in range(8):
        p, one = np.full(len(keys), 0.5), ((x >> _u(7 - k)) & _u(1)).astype(bool)
        for d, node, w, p1 in levels:
            if not len(node):
                continue
            name = ((context & _u((1 << (8 * d)) - 1)) << _u(8)) | _u(1 << k) | (x >> _u(8 - k))
            at = np.minimum(np.searchsorted(node, name), len(node) - 1)
            own = p1[at].astype(np.float64)
            weight = w[at].astype(np.float64)
            p = np.where(node[at] == name, weight * np.where(one, own, 1 - own) + (1 - weight) * p, 0.5)
        out += np.log10(p)
    return out


class Known:
    """Strings with their log10 probabilities."""

    def __init__(self, keys: np.ndarray, log10: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.log10, self.slots = keys[order].astype(_u), log10[order].astype(np.float32), None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each string, 0 where it is not known; and the places of those that are not."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.arange(len(keys))
        spread = lambda k: ((k * _u(0x9E3779B97F4A7C15)) >> _u(64 - SLOT_BITS)).astype(np.int64)
        if self.slots is None:  # made by each worker, once
            self.slots = np.zeros(1 << SLOT_BITS, np.int32)
            self.slots[spread(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        at = self.slots[spread(keys)]
        out = self.log10[at].astype(np.float64)
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            distinct, back = np.unique(keys[miss], return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            unmet = self.keys[at] != distinct
            out[miss] = np.where(unmet, 0, self.log10[at].astype(np.float64))[back]
            miss = miss[unmet[back]]
        return out, miss


class Tree:
    """The weighted context trees of all bit positions in one place, as one sorted table a depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        """keys: the distinct (depth + 1)-byte strings."""
        self.depth, self.levels = depth, levels_of(keys, counts, depth)[0]
        self.known = Known(keys, self.log10_of(keys.astype(_u)))
        self.keys = self.known.keys

    def log10_of(self, keys: np.ndarray) -> np.ndarray:
        return log10_by(self.levels, keys)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10_of by table where the string was met in training."""
        out, miss = self.known.find(keys)
        out[miss] = self.log10_of(keys[miss])
        return out


def count_corpus(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, word, n): the count of each (depth + 1)-byte string (word null) and of each word (gram null; the end is the empty word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, counts, held = [], [], 0

        def grams():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        def out_grams(k, n):
            for at in range(0, len(k), 50_000):
                part = k[at : at + 50_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.binary()), pa.array(n[at : at + 50_000])], ["gram", "word", "n"])

        def out_words():
            pairs = list(words.items())
            words.clear()
            for at in range(0, len(pairs), 50_000):
                w, n = zip(*pairs[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["gram", "word", "n"])

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for t in texts:
                words.update(words_of(t))
            words[b""] += len(texts)
            k, n = np.unique(strings(texts, depth)[0], return_counts=True)
            keys.append(k)
            counts.append(n.astype(np.float64))
            held += len(k)
            if held > 2 * HELD_ROWS:
                k, n = grams()
                keys, counts, held = [k], [n.astype(np.float64)], len(k)
                if held > HELD_ROWS:
                    yield from out_grams(k, n)
                    keys, counts, held = [], [], 0
            if len(words) > HELD_ROWS:
                yield from out_words()
        if keys:
            yield from out_grams(*grams())
        yield from out_words()

    return texts.mapInArrow(run, "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


def fit_tree(counts: DataFrame, depth: int = DEPTH) -> Tree:
    """One tree in one place, for corpora whose strings fit there. Scoring does not use it: what it makes of a corpus that fits, Trees makes of any."""
    table = counts.where("gram is not null").select("gram", "n").toArrow()
    return Tree(table["gram"].to_numpy().astype(_u), table["n"].to_numpy(), depth)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Strings and counts of a partition."""
    held = [(b.column(0).to_numpy(zero_copy_only=False).astype(_u), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, _u), np.zeros(0, np.int64))


class Trees:
    """The weighted context trees over partitions: grams is (gram, n) of distinct (depth + 1)-byte strings."""

    def __init__(self, grams: DataFrame, depth: int):
        self.grams, self.depth, self.split, self.size = grams, depth, min(SPLIT, depth), grams.count()
        split, parts = self.split, F.aggregate(F.array_sort(F.collect_list("below")), F.lit(0.0), lambda a, x: a + x)  # in one order; 256 at the most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, zeros, ones, total = levels_of(*_whole(batches), depth, split)[1]
            k, at = np.unique(_parents(node, split - 1), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), *(pa.array(np.bincount(at, v, len(k))) for v in (zeros, ones, total))], ["node", "zeros", "ones", "below"])

        self.top: list[tuple] = []
        if split:
            table = self._dealt(grams, self.size).mapInArrow(run, "node long, zeros double, ones double, below double")
            table = table.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), parts.alias("below")).toArrow().sort_by("node")
            node, (zeros, ones, below) = table["node"].to_numpy().astype(_u), (table[c].to_numpy() for c in ("zeros", "ones", "below"))
            for d in range(split - 1, -1, -1):
                if d < split - 1:
                    node, at = np.unique(_parents(node, d), return_inverse=True)
                    zeros, ones, below = (np.bincount(at, v, len(node)) for v in (zeros, ones, total))
                level, total = _level(d, node, zeros, ones, below)
                self.top.append(level)

    def _dealt(self, grams: DataFrame, size: int) -> DataFrame:
        shared = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * self.split)) - 1))
        return grams.repartition(size // PART_STRINGS + 1, shared)

    def log10_of(self, asked: DataFrame, size: int) -> DataFrame:
        """(gram, log10) of the `size` strings of asked (gram), met in training or not."""
        depth, split = self.depth, self.split
        top = self.grams.sparkSession.sparkContext.broadcast(self.top)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts = _whole(batches)
            met = counts > 0
            levels = [*levels_of(keys[met], counts[met], depth, split)[0], *top.value]
            keys = keys[~met]
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(log10_by(levels, part))], ["gram", "log10"])

        both = self.grams.select("gram", "n").unionByName(asked.select("gram", F.lit(0).cast("long").alias("n")))
        return self._dealt(both, self.size + size).mapInArrow(run, "gram long, log10 double")

    def known(self, most: int) -> Known:
        """About `most` of the most frequent strings; all, where there are no more."""
        least = _least(self.grams, most)
        table = self.log10_of(self.grams.where(F.col("n") > least), min(self.size, most)).toArrow()
        return Known(table["gram"].to_numpy().astype(_u), table["log10"].to_numpy())


def _least(rows: DataFrame, most: int) -> int:
    """The least count such that no more than `most` of the rows (n) lie above it, to one part in 64 of a doubling: exact, from a histogram of a few thousand rows."""
    bands = rows.groupBy(F.floor(F.log2("n") * 64).alias("band")).agg(F.max("n").alias("last"), F.count(F.lit(1)).alias("rows"))
    held = 0
    for r in sorted(bands.collect(), key=lambda r: -r["last"]):
        held += r["rows"]
        if held > most:
            return r["last"]
    return 0


def score_texts(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, and whether the row was trained on."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"a depth is 0 to {MOST_DEPTH}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(trained_on, F.lit(False)).alias("trained"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = cut(count_corpus(rows.where("trained").select("text"), depth))
    words = counts.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = words.where(F.col("n") > _least(words, HEAD_WORDS)).toArrow()
    divisor = total + 0.1 * (distinct + 1)
    known = dict(zip(head["word"].to_pylist(), range(head.num_rows), strict=True))
    logs = np.append(np.log10((head["n"].to_numpy() + 0.1) / divisor), 0.0)
    trees = Trees(counts.where("gram is not null").select("gram", "n"), depth)
    sent = docs.sparkSession.sparkContext.broadcast((trees.known(HEAD_STRINGS), known, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent, known, logs = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            keys, begins = strings(texts, depth)
            log10, miss = frequent.find(keys)
            score = np.add.reduceat(log10, begins)
            # A text's place among the 256 of a slice stands above the bits of a string, which are 56 at the most.
            above = _u(8 * depth + 8)
            unmet, unmet_n = np.unique((np.searchsorted(begins, miss, "right") - 1).astype(_u) << above | keys[miss], return_counts=True)
            starts = np.append(np.searchsorted(unmet, np.arange(len(texts)).astype(_u) << above), len(unmet)).astype(np.int32)
            strings_ = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array((unmet & _u((1 << int(above)) - 1)).astype(np.int64)), pa.array(unmet_n)], ["gram", "times"]))
            n_tokens, hits, base, tail, tail_n, bounds = [], [], [], [], [], [0]
            for t in texts:
                words = [*words_of(t), b""]
                at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
                n_tokens.append(len(words))
                hits.append(len(words) - len(missing))
                base.append(float(logs[at].sum()))
                rest = Counter(words[i] for i in missing.tolist())
                tail += rest.keys()
                tail_n += rest.values()
                bounds.append(len(tail))
            size = np.diff(np.append(begins, len(keys)))
            others = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(tail_n, pa.int64())], ["word", "tf"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base), pa.array(score), pa.array(size, pa.int64()), others, strings_],
                ["row", "doc_id", "trained", "n_tokens", "hits", "base", "score", "size", "others", "strings"],
            )
            row += len(texts)

    scored = cut(rows.mapInArrow(run, "row long, doc_id long, trained boolean, n_tokens long, hits long, base double, score double, size long, others array<struct<word: binary, tf: long>>, strings array<struct<gram: long, times: long>>"))
    # The rest of the words: each document has one row for each, and frequent words are not among them.
    rest = scored.select("row", F.inline("others")).join(words, "word", "left")
    log = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.1) / F.lit(float(divisor)))
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("more"), F.sum(F.col("tf") * log).alias("rest"))
    # The rest of the strings, likewise.
    met = scored.select("row", F.inline("strings"))
    asked = cut(met.select("gram").distinct())
    met = met.join(trees.log10_of(asked, asked.count()), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("more_score"))
    scored = scored.drop("others", "strings").join(rest, "row", "left").join(met, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return scored.select(
        "doc_id", "trained", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("size")).alias("bits_per_byte")
    )


def op9_ctw(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_texts(docs, bucket_of(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
