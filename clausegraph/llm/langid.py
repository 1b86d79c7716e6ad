"""Language identification by multilingual mixture inference.

A document is taken as a mixture of languages: each byte trigram of its letters is drawn from one
language's trigram distribution. Expectation-maximisation estimates the proportions; the set of
languages is the one of best penalised likelihood, each further language costing PENALTY times the
log of the number of trigrams. The answer is the language with the largest proportion in that set.

Fitting: trigram counts of labelled documents, hashed into buckets. Every label is a language; the model has
at most CELLS numbers (52 MB), so there are BUCKETS of them for up to 200 labels and half as many for each
doubling beyond, down to LEAST_BUCKETS (from some 50,000 labels on the model grows). SAMPLE_DOCS is the (expected) number of labelled documents a language is fitted
on, chosen by a hash of the id; languages with fewer use all of theirs. The prior of a language
is its share of the labelled documents fitted on. A document's set may be of any size: languages
join it in the order of their proportions while the penalised likelihood rises.

Defined cases: a null text, or one without a letter, is 'und' with score 0 and no languages; so is
every text when there is no labelled document; null labels are not learned from; repeated rows get
equal answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import bucket_of, load, slices

BUCKETS, LEAST_BUCKETS, CELLS, SAMPLE_DOCS, PENALTY, SMOOTHING, ROUNDS = 1 << 16, 1 << 8, 200 << 16, 4000, 3.0, 0.1, 25
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that can be part of a letter in UTF-8 keep their value; all others count as a space.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def buckets_for(languages: int, cells: int = CELLS) -> int:
    n = BUCKETS
    while n > LEAST_BUCKETS and n * languages > cells:
        n //= 2
    return n


def trigrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket (of a power of two, up to BUCKETS) of each trigram that has a letter in it, over the whole lower-cased text."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code[code != 0x202020] * np.uint32(2654435761)) >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray):
        """counts: languages x buckets."""
        self.languages, self.buckets = languages, counts.shape[1]
        smooth = counts + SMOOTHING
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32) if languages else np.zeros((self.buckets, 0), np.float32)
        self.log_prior = np.log(np.maximum(prior, 1e-12))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, its proportion, proportions of the selected set)."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, {}
        count = np.bincount(trigrams(text, self.buckets), minlength=self.buckets)
        at = np.flatnonzero(count)
        if not len(at):
            return "und", 0.0, {}
        c, log_p = count[at].astype(np.float64), self.log_p[at].astype(np.float64)
        base = log_p.max(axis=1)
        p, total = np.exp(log_p - base[:, None]), c.sum()
        alone = c @ (log_p - base[:, None])
        best = int(np.argmax(alone + self.log_prior))
        cost = PENALTY * np.log(total + 1)
        share, full = self._em(p, c, total)
        chosen, shares, value = [best], np.ones(1), alone[best]
        if full - value > cost:  # else no larger set can be worth its cost
            order = [best, *[k for k in np.argsort(-share).tolist() if k != best]]
            for size in range(2, len(order) + 1):
                share, log_l = self._em(p[:, order[:size]], c, total)
                if log_l - cost * (size - 1) <= value:
                    break
                chosen, shares, value = order[:size], share, log_l - cost * (size - 1)
        top = int(np.argmax(shares))
        return self.languages[chosen[top]], float(min(1.0, shares[top])), {self.languages[k]: float(s) for k, s in zip(chosen, shares, strict=True)}

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood (against the best language of each trigram)."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            new = share * ((c / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(c @ np.log(p @ share))


def fit(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, cells: int = CELLS) -> Model:
    """Fits on rows for which `labelled` holds and the label is not null."""
    known = docs.where(labelled & F.col(lang_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("l")).count().collect()
    languages = sorted(r["l"] for r in sizes)
    total = sum(r["count"] for r in sizes)
    by = {r["l"]: r["count"] for r in sizes}
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    shares = docs.sparkSession.createDataFrame([(l, min(1.0, sample_docs / by[l])) for l in languages], "_lang string, _share double")
    asked = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(shares), "_lang")  # a row a label
    chosen = asked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(1 << 20) * F.col("_share"))
    index, buckets = {l: i for i, l in enumerate(languages)}, buckets_for(len(languages), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    found.setdefault(lang, np.zeros(buckets, np.int64))
                    found[lang] += np.bincount(trigrams(text, buckets), minlength=buckets)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), index[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = chosen.select("_lang", "_text").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages * buckets rows
    counts = np.zeros((len(languages), buckets))
    counts[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, counts, np.array([by[l] / total for l in languages]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred, score, languages (the selected set with its proportions)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in held.dtypes[:-1]) + ", lang_pred string, score double, languages map<string, double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sent.value.infer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score, sets = zip(*found, strict=True) if found else ((), (), ())
            arrays = [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "lang_pred", "score", "languages"])

    return held.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with their columns, that have a language with a proportion of at least `least`. Fitted on all labelled rows' sample."""
    model = fit(docs, F.lit(True), id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sent.value.infer(t if isinstance(t, str) else None) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(docs, fit(docs, ~F.col("held_out")), keep=("held_out",))
