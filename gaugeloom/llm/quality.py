"""Quality classifier: ordinal regression with cumulative logits on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all grades and ordered
thresholds t_1 < t_2 < ... The expected grade is the sum of these chances; a document is
selected by the chance of reaching a chosen grade. x holds the logarithms of the term
counts of the whole text, scaled to length one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import hashedterms as ht, textbytes as tb
from .shared import whole_row

BITS = 18
#: Entries that training handles at a time.
BLOCK = 1 << 18


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    scale: float

    def latent(self, slab: tb.Slab) -> np.ndarray:
        row, term, n = ht.counted(*ht.slab_terms(slab, BITS), BITS)
        return _project(row, term, n, self.weights, len(slab.starts), self.scale)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(i, i + BLOCK) for i in range(0, n, BLOCK))


def _sums(key: np.ndarray, value: Callable[[slice], np.ndarray], size: int) -> np.ndarray:
    """Sums of value(block) by key, a block of entries at a time: temporary arrays stay small however large the sample."""
    out = np.zeros(size)
    for b in _blocks(len(key)):
        out += np.bincount(key[b], value(b), size)
    return out


def _values(row: np.ndarray, n: np.ndarray, rows: int, scale: float) -> np.ndarray:
    v = np.log1p(n)
    factor = scale / np.maximum(np.sqrt(_sums(row, lambda b: v[b] * v[b], rows)), 1e-12)
    for b in _blocks(len(v)):
        v[b] *= factor[row[b]]
    return v


def _project(row: np.ndarray, term: np.ndarray, n: np.ndarray, weights: np.ndarray, rows: int, scale: float) -> np.ndarray:
    return np.bincount(row, weights[term] * _values(row, n, rows, scale), rows)


def fit_ordinal(row: np.ndarray, term: np.ndarray, n: np.ndarray, grade: np.ndarray, grades: int, steps: int = 100, rate: float = 0.1, l2: float = 3e-3, scale: float = 8.0) -> OrdinalModel:
    """Adam on the whole sample: -log(P(>=g) - P(>=g+1)) with thresholds kept in order by exponentials of their gaps.

    Without rated rows the model is flat: every grade is as likely."""
    rows = len(grade)
    weights = np.zeros(1 << BITS)
    theta = np.concatenate([[-float(grades - 2) / 2], np.zeros(grades - 2)])  # first threshold, log gaps
    thresholds = lambda th: th[0] + np.concatenate([[0.0], np.cumsum(np.exp(th[1:]))])
    if rows == 0:
        return OrdinalModel(weights, thresholds(theta), scale)
    x = _values(row, n, rows, scale)
    m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
    a1, a2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        t = np.concatenate([[-np.inf], thresholds(theta), [np.inf]])
        s = _sums(row, lambda b: weights[term[b]] * x[b], rows)
        up, down = ht.sigmoid(s - t[grade]), ht.sigmoid(s - t[grade + 1])  # P(>=g), P(>=g+1)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / p, down * (1 - down) / p
        ds = (dd - du) / rows
        g = _sums(term, lambda b: ds[row[b]] * x[b], 1 << BITS) + l2 * weights  # noqa: B023
        dt = np.bincount(grade, du, grades + 1)[:grades] / rows
        dt = dt - np.concatenate([[0.0], np.bincount(grade, dd, grades)[: grades - 1] / rows])
        dt = dt[1:grades]
        gap = np.exp(theta[1:])
        gt = np.concatenate([[dt.sum()], gap * np.cumsum(dt[::-1])[::-1][1:]])
        for v, d, q1, q2 in ((weights, g, m1, m2), (theta, gt, a1, a2)):
            q1 *= 0.9
            q1 += 0.1 * d
            q2 *= 0.999
            q2 += 0.001 * d * d
            v -= rate * (q1 / (1 - 0.9**step)) / (np.sqrt(q2 / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(weights, thresholds(theta), scale)


#: Grades: 0 poor; 1 well written but toxic; 2 well written and clean.
GRADES = 3


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, target: the grade that the two marks give; without a mark of quality a row is left out."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2))
    return ht.one_label(labels, grade)


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, seed: int = 11) -> OrdinalModel:
    """Fits on at most ``most`` rated documents, chosen by a hash of doc_id, in one task."""

    def fit(row: np.ndarray, term: np.ndarray, n: np.ndarray, grade: np.ndarray) -> dict[str, np.ndarray]:
        model = fit_ordinal(row, term, n, grade, GRADES)
        return {"weights": model.weights, "thresholds": model.thresholds, "scale": np.array([model.scale])}

    got = ht.trained(docs, ratings(labels), BITS, most, seed, fit)
    if not got:
        return fit_ordinal(*[np.zeros(0, np.int64)] * 4, GRADES)
    return OrdinalModel(got["weights"], got["thresholds"], float(got["scale"][0]))


def score(docs: DataFrame, model: OrdinalModel, columns: list[str]) -> DataFrame:
    """``columns`` with _p_usable = P(grade >= 1), _p_clean = P(grade >= 2) and _expected_grade of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights: a fixed size

    def fit(slab: tb.Slab) -> dict[str, np.ndarray]:
        own = shared.value
        s = own.latent(slab)
        tail = [ht.sigmoid(s - t) for t in own.thresholds]
        return {"_p_usable": tail[0], "_p_clean": tail[-1], "_expected_grade": np.sum(tail, axis=0)}

    return ht.map_texts(docs, columns, "_p_usable double, _p_clean double, _expected_grade double", fit)


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 6000) -> DataFrame:
    """doc_id, expected_grade, p_usable, p_clean and keep (p_usable >= least) of every row.

    Null and empty texts have no terms and get the chances of the thresholds alone. A
    null doc_id is scored like any other. Repeated rows get the same values. Texts are
    read whole, one slab of texts at a time. Labels with null marks or of unknown
    documents teach nothing; clashing repeats count as the lower grade. An empty table
    gives no rows. Other columns are not read.
    """
    scored = score(docs, train(docs, labels, most), ["doc_id"])
    return scored.select("doc_id", F.col("_expected_grade").alias("expected_grade"), F.col("_p_usable").alias("p_usable"), F.col("_p_clean").alias("p_clean"), (F.col("_p_usable") >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 6000) -> DataFrame:
    """The rows of ``docs`` that select_quality keeps, with all their columns, whatever their names.

    Null and empty texts stay or go by the thresholds alone; repeated rows share their
    fate; an empty table stays empty.
    """
    model = train(docs, labels, most)
    return score(docs.select(whole_row(docs)), model, ["row"]).where(F.col("_p_usable") >= least).select("row.*")
