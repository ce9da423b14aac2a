"""Quality rules: counts of each text, and a calibrated logistic regression.

The classifier is a logistic regression over hashed words, pairs of words and
character n-grams, trained on a bounded sample of labelled rows, calibrated on the part of
the sample it was not trained on, and scored in Arrow batches. A text is kept if
it passes the base rules and its probability reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import NOT_SPACE, Block, U, Words, blocks, char_grams, prefix_hash, span_hash, sums_by_doc, windows, word_hashes, words
from cellsail.llm.training import add_rows, dot_rows, feature_rows, labelled, platt, sigmoid

WORD_BITS, PAIR_BITS, GRAM_BITS, GRAM = 16, 16, 16, 3
_PAIR = 1 << WORD_BITS
_GRAM = _PAIR + (1 << PAIR_BITS)
N_FEATURES = _GRAM + (1 << GRAM_BITS)
#: Rows of the training sample, in expectation.
MAX_TRAIN_ROWS = 2500
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
THRESHOLD = 0.5

_symbol = np.zeros(256, dtype=bool)
_symbol[list(b"#*$%&|<>")] = True
_first_byte = (np.arange(256) & 0xC0) != 0x80


@dataclass
class QualityModel:
    w: np.ndarray
    a: float
    b: float


def _ids(block: Block, w: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of words, of pairs and of characters, the text of each pair, and each text's first and number of characters."""
    _, pair_doc, pair = windows(h, w, 2)
    gram, first, length = char_grams(block, GRAM)
    word = (h >> U(64 - WORD_BITS)).astype(np.int64)
    return word, (pair >> U(64 - PAIR_BITS)).astype(np.int64) + _PAIR, (gram >> U(64 - GRAM_BITS)).astype(np.int64) + _GRAM, pair_doc, first, length


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's share of each word, pair of words and character n-gram."""
    w = words(block, block.buf, NOT_SPACE)
    word, pair, gram, pair_doc, _, length = _ids(block, w, word_hashes(block.buf, w))
    of_gram = np.repeat(np.arange(block.n), length)
    doc = np.concatenate([w.doc, pair_doc, of_gram])
    share = np.concatenate([1.0 / w.count[w.doc], 1.0 / w.count[pair_doc], 1.0 / length[of_gram]])
    keys, inverse = np.unique(doc * N_FEATURES + np.concatenate([word, pair, gram]), return_inverse=True)
    return keys // N_FEATURES, keys % N_FEATURES, np.bincount(inverse, weights=share, minlength=len(keys))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, steps: int = 80) -> QualityModel:
    """Fit on labelled rows that are usable, max_rows of them in expectation.

    Four fifths of the sample fit the weights, the rest the calibration. With no
    labelled row the model scores every text 1, so that the base rules decide. Of an
    id that labels repeat the label counts once, or not at all if its labels differ.
    """
    ids = labelled(labels, label, F.lit(True) if usable is None else usable, max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    y, at, cols, vals = feature_rows(sample, _features)
    if len(y) == 0:
        return QualityModel(np.zeros(N_FEATURES), 0.0, 40.0)
    # word shares carry less than those of characters, which every text has
    fold = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), dtype=bool)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) * ~fold
    # a share's own scale: columns of rare features would hardly move without it
    scale = 1.0 / np.sqrt(add_rows(at, cols, vals.astype(np.float64) ** 2, np.ones(len(y)) / len(y), N_FEATURES) + 1e-8)
    x = vals * scale[cols].astype(np.float32)
    w, m, v = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    bias = mb = vb = 0.0
    for t in range(1, steps + 1):
        g = (sigmoid(dot_rows(at, cols, x, w) + bias) - y) * weight
        grad, gb = add_rows(at, cols, x, g, N_FEATURES) + 1e-5 * w, g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-6)
        bias -= rate * mb / (np.sqrt(vb) + 1e-6)
    margin = dot_rows(at, cols, x, w) + bias
    a, b = platt(margin[fold], y[fold]) if fold.any() else (1.0, 0.0)
    return QualityModel(w * scale, a, b + a * bias)


def _base(block: Block, w: Words, h: np.ndarray) -> list[np.ndarray]:
    starts = prefix_hash(block.buf)
    at = np.concatenate([[0], np.cumsum(_first_byte[block.buf], dtype=np.int64)])
    word_chars = sums_by_doc(at[w.end] - at[w.start], w.first, w.count)
    seen = np.concatenate([[0], np.cumsum(_symbol[block.buf], dtype=np.int64)])
    n_symbols = seen[block.end] - seen[block.start]
    # lines; the newline that the block adds ends the last one
    end = np.flatnonzero(block.buf == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has], end[has]
    doc = block.doc_of(start)
    line = span_hash(starts, start, end)
    order = np.lexsort((line, doc))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    n_dup_lines = np.bincount(doc[order][again], minlength=block.n)
    first, doc, x = windows(h, w, WINDOW)
    order = np.lexsort((x, doc))
    same = (x[order][1:] == x[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + WINDOW + 1, dtype=np.int64)
    hit = first[order][twice]
    cover[hit] += 1
    cover[hit + WINDOW] -= 1
    n_repeat = sums_by_doc((np.cumsum(cover)[: len(h)] > 0).astype(np.int64), w.first, w.count)
    return [w.count.astype(np.int64), word_chars, n_symbols, n_dup_lines.astype(np.int64), n_repeat]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def apply_rules(docs: DataFrame, model: QualityModel, carry: list[str], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """carry columns, the base counts, base_failed, kept, and the probability behind kept.

    A null or empty text has no words and fails. Repeated rows get equal results, an
    empty table none, texts of any length are taken whole, and carried columns may
    not have the names of the results. A probability equal to the threshold is kept.
    """
    kept = docs.select(*carry, text_col)
    schema = kept.select(*carry).schema
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("probability", "double")
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                w = words(b, b.buf, NOT_SPACE)
                h = word_hashes(b.buf, w)
                base = _base(b, w, h)
                word, pair, gram, pair_doc, first, length = _ids(b, w, h)
                n = np.maximum(w.count, 1)
                margin = (sums_by_doc(m.w[word], w.first, w.count) + np.bincount(pair_doc, weights=m.w[pair], minlength=b.n)) / n + np.add.reduceat(m.w[gram], first) / length
                p = sigmoid(m.a * margin + m.b)
                failed = (base[0] < MIN_WORDS) | (100 * base[4] > MAX_REPEAT_PERCENT * base[0])
                rest = batch.slice(b.row, b.n)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], *map(pa.array, base), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], schema.names)

    return kept.mapInArrow(work, schema)
