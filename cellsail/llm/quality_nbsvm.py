"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams and character n-grams are scaled by the log ratio of
their counts in the two classes (Wang and Manning, 2012). A linear hinge-loss
model on them is fitted by dual coordinate descent (Hsieh et al., 2008), and
its margin is calibrated on rows it was not fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import NOT_SPACE, Block, U, byte_grams, windows, word_hashes, words
from cellsail.llm.training import MAX_TRAIN_ROWS, count_columns, dot_rows, feature_rows, labelled, platt, score_texts, sigmoid

WORD_BITS, PAIR_BITS, GRAM_BITS, GRAM = 17, 17, 16, 3
_PAIR, _GRAM = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS)
N_FEATURES = _GRAM + (1 << GRAM_BITS)


@dataclass
class NbSvmModel:
    r: np.ndarray
    w: np.ndarray
    a: float
    b: float


def _indicators(block: Block) -> tuple[np.ndarray, np.ndarray]:
    w = words(block, block.buf, NOT_SPACE)
    h = word_hashes(block.buf, w)
    _, pair_doc, pair = windows(h, w, 2)
    doc = np.concatenate([w.doc, pair_doc, np.repeat(np.arange(block.n), block.end - block.start + 1)])
    col = np.concatenate([
        (h >> U(64 - WORD_BITS)).astype(np.int64),
        (pair >> U(64 - PAIR_BITS)).astype(np.int64) + _PAIR,
        (byte_grams(block.buf, GRAM, block.end) >> U(64 - GRAM_BITS)).astype(np.int64) + _GRAM,
    ])
    keys = np.sort((doc << 20) | col)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys >> 20, keys & ((1 << 20) - 1)


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, col = _indicators(block)
    return doc, col, np.ones(len(doc))


def dual_coordinate_descent(at: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """w that minimises |w|^2 / 2 + sum cost * max(0, 1 - y * x.w), y of -1 and 1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(size), np.zeros(len(y))
    norm = np.add.reduceat(np.append(vals**2, 0.0), at[:-1]) * (np.diff(at) > 0) if len(y) else np.zeros(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            if norm[i] == 0:
                continue
            c, v = cols[at[i] : at[i + 1]], vals[at[i] : at[i + 1]]
            g = y[i] * float(w[c] @ v) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[c] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, cost: float = 4.0) -> NbSvmModel:
    """Fit on usable labelled rows, max_rows of them in expectation.

    Without rows of both classes, every text scores the share of label 1 (0.5
    without any row). Of an id that labels repeat the label counts once, or not at
    all if its labels differ; all rows of documents with the id are learned from.
    """
    ids = labelled(labels, label, usable, max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    y, at, cols, _ = feature_rows(sample, _features, binary=True)
    good = y > 0.5
    if good.all() or not good.any():
        share = float(good.mean()) if len(y) else 0.5
        return NbSvmModel(np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fold = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    p = 1 + count_columns(at, cols, good & ~fold, N_FEATURES)
    q = 1 + count_columns(at, cols, ~good & ~fold, N_FEATURES)
    r = np.log((p / p.sum()) / (q / q.sum()))
    x = r[cols].astype(np.float32)
    x /= np.repeat(np.sqrt(dot_rows(at, cols, x, r) + 1e-12).astype(np.float32), np.diff(at))
    share = good[~fold].mean() if good[~fold].any() and not good[~fold].all() else 0.5
    costs = np.where(fold, 0.0, cost * np.where(good, 0.5 / share, 0.5 / (1 - share)))
    w = dual_coordinate_descent(at, cols, x, np.where(good, 1.0, -1.0), costs, N_FEATURES)
    margin = dot_rows(at, cols, x, w)
    a, b = platt(margin[fold], y[fold]) if fold.any() else platt(margin, y)
    return NbSvmModel(r, w, a, b)


def _margins(block: Block, m: NbSvmModel) -> np.ndarray:
    doc, col = _indicators(block)
    r = m.r[col]
    return np.bincount(doc, weights=m.w[col] * r, minlength=block.n) / np.sqrt(np.bincount(doc, weights=r * r, minlength=block.n) + 1e-12)


def score(docs: DataFrame, model: NbSvmModel, carry: list[str]) -> DataFrame:
    """carry columns and score, 0 to 1; null and empty texts are scored as any other, by the newline that ends them.

    Repeated rows get equal scores, an empty table none; texts of any length are
    taken whole. A carried column may not be named score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, carry, lambda b: sigmoid(shared.value.a * _margins(b, shared.value) + shared.value.b))
