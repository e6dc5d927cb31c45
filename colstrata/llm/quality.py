"""A quality classifier: cumulative-link regression on graded ratings.

A document's features are the distinct hashes of its words (case folded), of the
runs of other characters between them, and of coarse classes of its shape. One
vector of weights over the hash buckets gives a score s, and ordered thresholds
t1 < t2 < ... give P(grade <= k) = logistic(t[k+1] - s), so every grade shares the
weights. The expected grade ranks documents and the tail probability selects them.

The fit uses a bounded sample of labelled documents (`sample`, by a hash of
doc_id, so it doesn't depend on order); everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

_SLICE = 8 << 20
_LETTERS = ~tk.SEPARATORS
_SPACE_ONLY = np.zeros(256, bool)
_SPACE_ONLY[[9, 10, 11, 12, 13, 32]] = True


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document, one after the other, and n + 1 offsets."""
    n = len(offsets) - 1
    mask = np.uint64((1 << bits) - 1)
    low = tk.lower(buf)
    s, e, doc = tk.words(low, offsets, tk.SEPARATORS)
    word = tk.hash_spans(low, s, e, 1)
    # what stands between words, without white space
    other = _LETTERS | _SPACE_ONLY
    s2, e2, doc2 = tk.words(buf, offsets, other)
    mark = tk.hash_spans(buf, s2, e2, 2)
    key = np.concatenate([doc.astype(np.uint64) << np.uint64(32) | word & mask, doc2.astype(np.uint64) << np.uint64(32) | mark & mask])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key

    def per(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    kinds = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=n)
    shape = [
        np.floor(10 * per((buf >= 65) & (buf <= 90)) / size),
        np.floor(10 * per(tk.SEPARATORS[buf] & ~_SPACE_ONLY[buf]) / size),
        np.floor(10 * per((buf >= 48) & (buf <= 57)) / size),
        np.floor(10 * kinds / words) * 32 + np.floor(np.log2(words)),
        np.floor(np.diff(offsets) / words),
    ]
    coarse = np.concatenate([np.arange(n, dtype=np.uint64) << np.uint64(32) | tk.mix(x.astype(np.uint64) + np.uint64((k + 3) << 40)) & mask for k, x in enumerate(shape)])
    key = np.concatenate([key, coarse])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> np.uint64(32)).astype(np.int64)
    return (key & mask).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


@dataclass
class Ordinal:
    """Weights over buckets, and the thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    #: the tail probability of the best grade that all but a stated share of held-out documents of it reach
    cut: float = 0.5

    def score(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), self.weights[ids], len(ends) - 1)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document and each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def slopes(score: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean negative log-likelihood by each score and by each threshold."""
    grades, n = len(cuts) + 1, len(score)
    t = np.concatenate([[-np.inf], cuts, [np.inf]])
    lo, hi = np.where(grade == 0, 0.0, _logistic(t[grade] - score)), np.where(grade == grades - 1, 1.0, _logistic(t[grade + 1] - score))
    p = np.maximum(hi - lo, 1e-12)
    by_cut = np.zeros(grades - 1)
    np.add.at(by_cut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -hi * (1 - hi) / p, 0) / n)
    np.add.at(by_cut, np.maximum(grade - 1, 0), np.where(grade > 0, lo * (1 - lo) / p, 0) / n)
    return (1 - lo - hi) / n, by_cut


def fit_ordinal(ids: np.ndarray, ends: np.ndarray, grade: np.ndarray, grades: int, bits: int, epochs: int = 25, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, least_docs: int = 4) -> Ordinal:
    """Adaptive gradient descent on the cumulative-link likelihood; the order of rows is the order of steps.

    Buckets of fewer than least_docs documents keep weight 0, as do unseen ones.
    """
    keep = np.bincount(ids, minlength=1 << bits)[ids] >= least_docs
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    ids = ids[keep]
    weights, power = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(1, len(grade)), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    first = np.maximum.accumulate(first + np.arange(len(first)) * 1e-3)
    # the first threshold, and logarithms of the steps to the next ones
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    theta_power = np.full(len(theta), 1e-2)
    n = len(grade)

    def cuts() -> np.ndarray:
        return np.concatenate([theta[:1], theta[:1] + np.cumsum(np.exp(np.clip(theta[1:], -20, 20)))])

    for _ in range(epochs):
        for a in range(0, n, batch):
            b = min(n, a + batch)
            x = ids[ends[a] : ends[b]]
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            s = np.bincount(row, weights[x], b - a)
            slope, cut = slopes(s, cuts(), grade[a:b])
            at, which = np.unique(x, return_inverse=True)
            g = np.bincount(which, slope[row], len(at))
            g += decay * weights[at]
            power[at] += g * g
            weights[at] -= rate * g / np.sqrt(power[at])
            tail = np.cumsum(cut[::-1])[::-1]
            step = np.concatenate([tail[:1], tail[1:] * np.exp(np.clip(theta[1:], -20, 20))])
            theta_power += step * step
            theta -= rate * step / np.sqrt(theta_power)
    return Ordinal(weights, cuts(), bits)


def rating(quality: Column, toxic: Column) -> Column:
    """Grades of the labels: 0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, F.lit(0)).when(quality == 0, F.lit(1)).when(quality == 1, F.lit(2))


def _rows(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(ends)[which]
    return tk.gather(ids, ends[:-1][which], size), np.concatenate([[0], np.cumsum(size)])


def fit_and_cut(ids: np.ndarray, ends: np.ndarray, grade: np.ndarray, bits: int, loss: float, folds: int = 5) -> Ordinal:
    """A model of all rows, with the cut that loses the share `loss` of the best grade, as measured on each fold by a model of the others.

    With too few rows for that (fewer than two grades beside some fold, or no
    held-out document of the best grade) the cut is 0.5.
    """
    grades = int(grade.max()) + 1
    fold = np.arange(len(grade)) % folds
    tails = []
    for f in range(folds):
        inside, held = np.flatnonzero(fold != f), np.flatnonzero((fold == f) & (grade == grades - 1))
        if len(held) and len(np.unique(grade[inside])) > 1:
            m = fit_ordinal(*_rows(ids, ends, inside), grade[inside], grades, bits)
            tails.append(m.above(m.score(*_rows(ids, ends, held)))[:, -1])
    model = fit_ordinal(ids, ends, grade, grades, bits)
    if tails:
        model.cut = float(np.quantile(np.concatenate(tails), loss, method="lower"))
    return model


def train(docs: DataFrame, ratings: DataFrame, sample: int = 20_000, bits: int = 18, loss: float = 0.01, text: str = "text", doc_id: str = "doc_id", grade: str = "grade") -> Ordinal | None:
    """A model of up to `sample` rated documents, or None if they have fewer than two grades.

    ratings: doc_id and grade from 0 up. Rows with a null are left out; of
    several grades of one document the least counts.
    """
    rated = ratings.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.col(f"`{grade}`").cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade >= 0")
    # a bounded number of rows
    picked = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("_id"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tk.flat(batch.column(2))
            for a, b in tk.slices(offsets, _SLICE):
                ids, ends = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["id", "grade", "ids"])

    found = texts.join(F.broadcast(picked), "_id").select("_id", "_grade", "t").mapInArrow(lambda batches: tk.released(run(batches)), "id bigint, grade int, ids array<int>").toArrow()
    grade_of = found.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grade_of)) < 2:
        return None
    key = tk.mix(found.column("id").to_numpy().astype(np.int64).view(np.uint64))
    lists = found.column("ids").combine_chunks().take(pa.array(np.lexsort((grade_of, key))))
    sizes = np.asarray(lists.value_lengths())
    order = np.lexsort((grade_of, key))
    return fit_and_cut(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), grade_of[order], bits, loss)


def score_quality(docs: DataFrame, model: Ordinal | None, text: str = "text", doc_id: str = "doc_id", least: int | None = None) -> DataFrame:
    """doc_id, expected_grade and tail_probability: of `least` grade or better, the best one by default."""
    picked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = "doc_id bigint, expected_grade double, tail_probability double"
    if model is None:
        return picked.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.thresholds) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offsets = tk.flat(batch.column(1))
            for a, b in tk.slices(offsets, _SLICE):
                above = m.above(m.score(*features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.bits)))
                none = np.asarray(batch.column(1).slice(a, b - a).is_null())
                tail = above[:, k - 1] if k > 0 else np.ones(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(above.sum(1), mask=none), pa.array(tail, mask=none)], names=["doc_id", "expected_grade", "tail_probability"])

    return picked.mapInArrow(lambda batches: tk.released(run(batches)), schema)


def select_quality(docs: DataFrame, ratings: DataFrame, sample: int = 20_000, bits: int = 18, least: int | None = None, probability: float | None = None, loss: float = 0.01, text: str = "text", doc_id: str = "doc_id", grade: str = "grade") -> DataFrame:
    """The documents whose tail probability is `probability` or more, with their scores.

    By default the limit is the one that loses the share `loss` of held-out
    documents of the best grade (in five folds of the sample), or 0.5 where
    `least` is another grade.

    Nulls: a null text has no score and isn't selected; an empty one has the
    score of its shape; a null doc_id stays null. Very long texts are read whole.
    A tail probability equal to the limit is selected. Repeated rows are scored
    each. Without two grades to learn from, no document has a score and none is
    selected. An empty table gives no row. Other columns are not read.
    """
    model = train(docs, ratings, sample, bits, loss, text, doc_id, grade)
    if probability is None:
        probability = model.cut if model is not None and least is None else 0.5
    return score_quality(docs, model, text, doc_id, least).where(F.col("tail_probability") >= probability)
