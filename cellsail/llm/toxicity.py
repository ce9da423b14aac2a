"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic texts and unlabelled
ones. Its risk estimator corrects for the class prior, and is kept from going
negative as in Kiryo et al. (2017): when the estimated risk of the negatives
falls below zero, the step undoes it instead of following it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import ALNUM, LOWER, Block, U, byte_grams, word_hashes, words
from cellsail.llm.training import add_rows, count_columns, dot_rows, feature_rows, labelled, score_texts, sigmoid

WORD_BITS, GRAM_BITS, GRAM = 17, 18, 5
N_FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: Rows of either sample, in expectation. Both are of labelled rows; the second does not look at the label.
MAX_POSITIVE, MAX_UNLABELLED = 1200, 2500
#: Standard errors by which a feature must be commoner among the positives.
MIN_Z = 2.5
#: Penalty of a weight's size, and the size from which it counts.
SPARSE, MIN_WEIGHT = 1e-4, 0.2


@dataclass
class ToxicityModel:
    w: np.ndarray
    bias: float


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which hashed words and character n-grams a text has, in lower case."""
    buf = LOWER[block.buf]
    w = words(block, buf, ALNUM)
    word = (word_hashes(buf, w) >> U(64 - WORD_BITS)).astype(np.int64)
    gram = (byte_grams(buf, GRAM, block.end) >> U(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)
    doc = np.concatenate([w.doc, np.repeat(np.arange(block.n), block.end - block.start + 1)])
    keys = np.sort((doc << 20) | np.concatenate([word, gram]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys >> 20, keys & ((1 << 20) - 1), np.ones(len(keys))


def _margins(block: Block, model: ToxicityModel) -> np.ndarray:
    """As the sum of the weights of a text's features, each counted once."""
    buf = LOWER[block.buf]
    w = words(block, buf, ALNUM)
    word = (word_hashes(buf, w) >> U(64 - WORD_BITS)).astype(np.int64)
    gram = (byte_grams(buf, GRAM, block.end) >> U(64 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS)
    on_word, on_gram = np.flatnonzero(model.w[word]), np.flatnonzero(model.w[gram])
    keys = np.unique(np.concatenate([w.doc[on_word] << 20 | word[on_word], block.doc_of(on_gram) << 20 | gram[on_gram]]))
    return model.bias + np.bincount(keys >> 20, weights=model.w[keys & ((1 << 20) - 1)], minlength=block.n)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, steps: int = 300) -> ToxicityModel:
    """Fit on texts with a usable positive label, and on texts of usable rows whose label is not looked at.

    prior is the share of positives among the latter; by default that of the usable
    labels. The samples have max_positive and max_unlabelled rows in expectation.
    Without positives every text scores near 0. Rows of null ids teach nothing, and
    ids that labels repeat count once, or not at all if their labels differ.
    """
    ids = labelled(labels.filter(F.col(label) == 1), label, usable, max_positive)
    if prior is None:
        known = labels.filter(usable & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).collect()[0][0]
        prior = float(known or 0.0)
    prior = min(max(prior, 1e-3), 0.5)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    hidden = labels.filter(usable & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    share = min(1.0, max_unlabelled / max(hidden.count(), 1))
    hidden = hidden.filter(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("y", F.lit(0.0))
    known = texts.join(F.broadcast(ids), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    free = texts.join(F.broadcast(hidden), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    y, at, cols, _ = feature_rows(known.select("text", "y", "order").union(free.select("text", "y", "order")), _features, binary=True)
    positive = y > 0.5
    n_pos, n_free = int(positive.sum()), int((~positive).sum())
    if n_pos == 0 or n_free == 0:
        return ToxicityModel(np.zeros(N_FEATURES), -5.0)
    p = (count_columns(at, cols, positive, N_FEATURES) + 0.5) / (n_pos + 1)
    q = (count_columns(at, cols, ~positive, N_FEATURES) + 0.5) / (n_free + 1)
    chosen = (p - q) / np.sqrt(p * (1 - p) / n_pos + q * (1 - q) / n_free) > MIN_Z
    # a feature of positives only is 1 / prior times as common among them as among all texts
    chosen &= p > 0.25 / prior * q
    use = chosen[cols]
    starts = np.concatenate([[0], np.cumsum(use, dtype=np.int64)])[at]
    cols = cols[use]
    vals = np.ones(len(cols))
    w, bias = np.zeros(N_FEATURES), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.0
    in_p, in_u = positive / n_pos, ~positive / n_free
    for t in range(1, steps + 1):
        z = dot_rows(starts, cols, vals, w) + bias
        s = sigmoid(z)
        loss_neg = np.logaddexp(0, z)  # of calling a text negative
        negative_risk = (in_u * loss_neg).sum() - prior * (in_p * loss_neg).sum()
        g_pos, g_neg = prior * in_p * (s - 1), in_u * s - prior * in_p * s
        g = g_pos + g_neg if negative_risk >= 0 else -g_neg
        grad, gb = add_rows(starts, cols, vals, g, N_FEATURES) + SPARSE * np.sign(w), g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-7) * chosen
        bias -= rate * mb / (np.sqrt(vb) + 1e-7)
    # what the penalty holds near zero would still add up over a very long text
    return ToxicityModel(np.where(np.abs(w) < MIN_WEIGHT, 0.0, w), bias)


def score(docs: DataFrame, model: ToxicityModel, carry: list[str]) -> DataFrame:
    """carry columns and score, 0 to 1. Null and empty texts get the score of no feature.

    Repeated rows get equal scores, an empty table none; texts of any length are
    taken whole. A carried column may not be named score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, carry, lambda b: sigmoid(_margins(b, shared.value)))
