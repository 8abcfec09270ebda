"""Quality classifier: naive Bayes support vectors.

Features are indicators of word n-grams (one and two words) and of n-grams over word shapes (one to three; a shape is the
word's character classes with runs collapsed, and says if the word repeats the one before), hashed to `2 ** BITS`
columns. Each indicator is scaled by the log ratio of its smoothed class counts, and a linear model is fitted on the
scaled, length-normalised vectors by dual coordinate descent on the hinge loss. The model is learnt from a bounded
sample: class counts from `COUNT_ROWS` labelled training rows at most, the descent from `FIT_ROWS` of them, those with the
least hash of their id. So the sample's ids can be broadcast, and no text is shuffled. Scores take every text whole.

Behaviour at the edges: a null or empty text has only the bias and still gets a score; a document with several labels
counts as good if at least half of them say so; null labels are ignored; without labels of both classes every score is
the share of good labels, or 1 without any; repeated rows get a row each; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import repeats as R
from granary.session import scratch_path

BITS, COUNT_ROWS, FIT_ROWS, SMOOTH = 18, 20_000, 4000, 1.0
ROUNDS, COST, STEEP = 12, 1.0, 4.0

_CLASS = np.zeros(256, np.uint8)  # what a shape tells apart
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = [4 + i for i in range(32)]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every indicator that is set, sorted by text."""
    begins, ends, runs = R.tokens(raw, bounds, R.SPACES)
    n = len(begins)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = R.run_symbols(raw, begins, ends)
    kind = _CLASS[raw]
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[begins] = True
    at = np.flatnonzero(turn)
    shapes = R.mix(R.spans_hash(R.prefix_sums(R.byte_symbols()[kind[at]]), np.searchsorted(at, begins), np.searchsorted(at, ends)))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(runs))
    again = np.zeros(n, bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = shapes + again.astype(R.U)
    hashes, texts = [], []
    for kind_of, symbols, most in ((1, words, 2), (2, shapes, 3)):
        grams = np.zeros(n, R.U)
        for size in range(1, most + 1):
            grams = R.mix(grams[: n - size + 1] * R.U(31) + symbols[size - 1 :] + R.U(kind_of * 8 + size))
            inside = text[: n - size + 1] == text[size - 1 :]
            hashes.append(grams[inside])
            texts.append(text[: n - size + 1][inside])
            if size < most:
                grams = grams[: n - size]
            if n <= size:
                break
    cell = np.concatenate(texts).astype(np.uint64) << R.U(BITS) | np.concatenate(hashes) >> R.U(64 - BITS)
    cell = np.unique(cell)
    return (cell >> R.U(BITS)).astype(np.int64), (cell & R.U((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # on indicators, the log-count ratios multiplied in
    ratios: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        out = np.full(n, self.bias)
        for i, j in R.steps(bounds):
            text, column = features(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            size = np.sqrt(np.maximum(np.bincount(text, self.ratios[column] ** 2, j - i), 1e-12))
            out[i:j] += np.bincount(text, self.weights[column], j - i) / size
        return 1 / (1 + np.exp(-STEEP * out))


def _training(labelled: DataFrame) -> DataFrame:
    """(good, doc, columns) per task: class counts of every column, and the columns of the rows that are fitted on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        names = ["good", "doc", "columns", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            raw, bounds = R.texts_of(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False)
            doc = batch.column("doc_key").to_numpy(zero_copy_only=False)
            fit = batch.column("fit").to_numpy(zero_copy_only=False)
            out = []
            for i, j in R.steps(bounds):
                text, column = features(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                for c in (0, 1):
                    counts[c] += np.bincount(column[good[i:j][text] == c], minlength=1 << BITS)
                edge = np.searchsorted(text, np.arange(j - i + 1))
                out += [(int(good[i + k]), int(doc[i + k]), column[edge[k] : edge[k + 1]].astype(np.int32).tobytes(), None) for k in np.flatnonzero(fit[i:j])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for c in (0, 1):
            set_ = np.flatnonzero(counts[c])
            if len(set_):
                columns, n = pa.array([set_.astype(np.int32).tobytes()], kinds[2]), pa.array([counts[c][set_].tobytes()], kinds[3])
                yield pa.RecordBatch.from_arrays([pa.array([c], kinds[0]), pa.array([None], kinds[1]), columns, n], names=names)

    return labelled.mapInArrow(rows, "good int, doc long, columns binary, counts binary")


def _summed(parts: DataFrame) -> DataFrame:
    """(good, n, columns): class counts of all tasks, a row per class and slice of columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, column, n = [], [], []
            for g, c, k in zip(*(batch.column(x).to_pylist() for x in ("good", "columns", "counts")), strict=True):
                column.append(np.frombuffer(c, np.int32))
                n.append(np.frombuffer(k, np.int64))
                good.append(np.full(len(column[-1]), g, np.int32))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (good, column, n)], names=["good", "column", "n"])

    cells = parts.where("counts is not null").mapInArrow(rows, "good int, column int, n long")
    return cells.groupBy("column").agg(*[F.sum(F.when(F.col("good") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, sign: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss; row i has values[rows[i]] in its columns, scaled to length 1."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    scale = [1 / max(np.sqrt((values[r] ** 2).sum()), 1e-6) for r in rows]
    order = np.random.default_rng(17)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x = values[rows[i]] * scale[i]
            gradient = sign[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the training folds of `labels` (doc_id, quality)."""
    spark = docs.sparkSession
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_key")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    votes = votes.where(fold(F.col("doc_key")) != 1)
    share, classes = votes.agg(F.avg("good"), F.count_distinct("good")).first()
    if classes != 2:
        return Model(np.zeros(1), np.zeros(1), 0.0, 1.0 if share is None else float(share))
    chosen = votes.withColumn("h", F.xxhash64("doc_key")).orderBy("h", "doc_key").limit(count_rows)
    last = chosen.orderBy("h", "doc_key").limit(fit_rows).agg(F.max("h")).first()[0]
    chosen = F.broadcast(chosen.select("doc_key", "good", (F.col("h") <= last).alias("fit")))  # count_rows rows at most
    texts = R.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_key"), "text")
    path = scratch_path(spark, "training")
    _training(texts.join(chosen, "doc_key").select("doc_key", "text", "good", "fit")).write.parquet(path)
    parts = spark.read.parquet(path)
    counts = _summed(parts).toPandas()  # at most 2 ** BITS rows
    sample = parts.where("counts is null").select("good", "doc", "columns").toPandas().sort_values(["doc", "good"])  # at most fit_rows
    if sample["good"].nunique() < 2:
        return Model(np.zeros(1), np.zeros(1), 0.0, float(share))
    both = np.full((2, 1 << BITS), SMOOTH)
    for c in (0, 1):
        both[c][counts["column"].to_numpy()] += counts[f"n{c}"].to_numpy()
    ratios = np.log(both[1] / both[1].sum()) - np.log(both[0] / both[0].sum())
    rows = [np.frombuffer(c, np.int32) for c in sample["columns"]]
    w, bias = dual_coordinate_descent(rows, ratios, np.where(sample["good"] == 1, 1.0, -1.0))
    del rows, sample, counts, both
    R.release()
    return Model(w * ratios, ratios, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = R.texts_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(raw, bounds))], names=["doc_id", "score"])

    found = R.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """`docs` without the documents that score below `least`."""
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = R.texts_of(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(model.score(raw, bounds) >= least))

    return R.small_batches(docs).mapInArrow(rows, schema)
