"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} v_i . v_j) over the distinct active terms of a
whole text: the products of the factors v learn pairs, such as an insult beside the
mention of a group, that added weights miss. A term is active if it goes with label 1 in
the training rows, alone or as a member of a pair that tells more than its members; a
text of any length so has few active terms, and terms that tell nothing cannot add up to
a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import hashedterms as ht, textbytes as tb

BITS = 22
#: Length of the factors.
RANK = 4


@dataclass
class FactorModel:
    terms: np.ndarray  # active terms, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # a row a term

    def score(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """row, at: distinct pairs of a row and the place of a term in ``terms``."""
        total = np.full(rows, self.bias) + np.bincount(row, self.weights[at], rows)
        for v in self.factors.T:
            total += 0.5 * (np.bincount(row, v[at], rows) ** 2 - np.bincount(row, v[at] ** 2, rows))
        return ht.sigmoid(total)

    def find(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        pairs = np.unique(row[hit].astype(np.int64) * len(self.terms) + at[hit])
        return pairs // len(self.terms), pairs % len(self.terms)


def _divergence(q: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(q * np.log(q / share)) + np.nan_to_num((1 - q) * np.log((1 - q) / (1 - share)))


def active_terms(row: np.ndarray, term: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """Terms of at least ``least`` training rows that go with label 1 beyond chance, alone or in pairs.

    A term in n rows, a of them with label 1, is beyond chance if n times the divergence
    of a/n from the share of label 1 exceeds the logarithm of the number of terms tried
    (Chernoff's bound: about one term by chance, whatever the size of the sample).
    """
    share = label.mean()
    having = np.bincount(term, minlength=1 << BITS)
    some = np.flatnonzero(having >= least)
    n, a = having[some], np.bincount(term, label[row], 1 << BITS)[some]
    q = a / n
    alone = some[(q > share) & (n * _divergence(q, share) > np.log(max(len(some), 2)))]
    return np.union1d(alone, paired_terms(row, term, label, least))


#: Terms whose pairs are tried.
PAIRED = 1024


def paired_terms(row: np.ndarray, term: np.ndarray, label: np.ndarray, least: int) -> np.ndarray:
    """Terms of pairs that go with label 0 or 1 further than either member's own share or that of all rows.

    Tried are the pairs of the PAIRED terms that most rows with label 1 have, but for
    those in three quarters of all rows; the same bound holds as for single terms, with the number
    of pairs tried. Two terms that tell nothing alone so become active if they tell
    something together or apart.
    """
    both = np.unique(row.astype(np.int64) << BITS | term)
    row, term = both >> BITS, both & ((1 << BITS) - 1)
    having, toxic = np.bincount(term, minlength=1 << BITS), np.bincount(term, label[row], 1 << BITS)
    tried = np.flatnonzero((toxic >= least) & (having * 4 <= 3 * len(label)))
    tried = np.sort(tried[np.lexsort((tried, -toxic[tried]))[:PAIRED]])
    if len(tried) < 2:
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(tried, term), len(tried) - 1)
    hit = tried[at] == term
    together, together_toxic = np.zeros((2, len(tried), len(tried)))
    row, at = row[hit], at[hit]
    for first in range(0, len(label), 2048):
        a, z = np.searchsorted(row, [first, first + 2048])
        x = np.zeros((min(2048, len(label) - first), len(tried)), np.float32)
        x[row[a:z] - first, at[a:z]] = 1
        together += x.T @ x
        x = x[label[first : first + 2048] == 1]
        together_toxic += x.T @ x
    own = toxic[tried] / having[tried]
    q = together_toxic / np.maximum(together, 1)
    high, low = np.maximum(np.maximum.outer(own, own), label.mean()), np.minimum(np.minimum.outer(own, own), label.mean())
    beyond = np.where(q > high, _divergence(q, np.minimum(high, 1 - 1e-9)), np.where(q < low, _divergence(q, np.maximum(low, 1e-9)), 0.0))
    found = (together >= least) & (together * beyond > np.log(max(len(tried) * (len(tried) - 1) / 2, 2)))
    np.fill_diagonal(found, False)
    return tried[found.any(1)]


def fit_factors(row: np.ndarray, term: np.ndarray, label: np.ndarray, rank: int = RANK, steps: int = 200, rate: float = 0.03, l2: float = 1e-4, least: int = 4, seed: int = 5) -> FactorModel:
    """Adam on the whole sample with logistic loss. Without rows of both labels the score is flat."""
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 0.5) / (len(label) + 1.0)
        return FactorModel(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    terms = active_terms(row, term, label, least)
    model = FactorModel(terms, 0.0, np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.05, (len(terms), rank)))
    own, at = model.find(row, term)
    rows = len(label)
    value = {"b": np.array([np.log((label.mean() + 1e-6) / (1 - label.mean() + 1e-6))]), "w": model.weights, "v": model.factors}
    m = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in value.items()}
    for step in range(1, steps + 1):
        model.bias = float(value["b"][0])
        err = (model.score(own, at, rows) - label) / rows
        e = err[own]
        gv = np.empty_like(model.factors)
        for f, v in enumerate(model.factors.T):
            s = np.bincount(own, v[at], rows)
            gv[:, f] = np.bincount(at, e * (s[own] - v[at]), len(terms))
        grads = {"b": np.array([err.sum()]), "w": np.bincount(at, e, len(terms)) + l2 * model.weights, "v": gv + l2 * model.factors}
        for k, g in grads.items():
            q1, q2 = m[k]
            q1 *= 0.9
            q1 += 0.1 * g
            q2 *= 0.999
            q2 += 0.001 * g * g
            value[k] -= rate * (q1 / (1 - 0.9**step)) / (np.sqrt(q2 / (1 - 0.999**step)) + 1e-8)
    model.bias = float(value["b"][0])
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 10000, seed: int = 13) -> FactorModel:
    """Fits on at most ``most`` labelled documents that are not held out, chosen by a hash of doc_id, in one task."""
    rated = ht.one_label(labels.where(~held_out(F.col("doc_id"))), F.when(F.col("toxic") > 0, 1).when(F.col("toxic") <= 0, 0))

    def fit(row: np.ndarray, term: np.ndarray, _: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        model = fit_factors(row, term, label)
        return {"terms": model.terms, "bias": np.array([model.bias]), "weights": model.weights, "factors": model.factors.ravel()}

    got = ht.trained(docs, rated, BITS, most, seed, fit)
    if not got:
        return fit_factors(*[np.zeros(0, np.int64)] * 3)
    return FactorModel(got["terms"].astype(np.int64), float(got["bias"][0]), got["weights"], got["factors"].reshape(len(got["terms"]), RANK))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 10000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts have no active term and get the score of the bias. Repeated rows
    get the same score. Texts are read whole, one slab of texts at a time. Null labels
    teach nothing; of clashing labels the lower counts. An empty table gives no rows. No
    column but text is read for the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))  # active terms of a bounded sample: at most its distinct terms

    def fit(slab: tb.Slab) -> dict[str, np.ndarray]:
        own = shared.value
        row, at = own.find(*ht.slab_terms(slab, BITS))
        return {"score": own.score(row, at, len(slab.starts))}

    scored = ht.map_texts(docs, ["doc_id"], "score double", fit)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
