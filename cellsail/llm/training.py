"""Bounded training samples, sparse rows in numpy, and probability calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import Block, blocks, unused

#: Rows of a training sample, in expectation; a hash of the id picks them, alike at every run.
MAX_TRAIN_ROWS = 3000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def keep_fraction(doc_id: Column, fraction: float) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("train")), F.lit(1 << 30)) < int(min(1.0, fraction) * (1 << 30))


def labelled(labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, y) of about max_rows labelled ids at most, those with one label only."""
    one = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"), F.max(label).cast("double").alias("y2")).filter("y = y2").select("doc_id", "y")
    total = one.count()
    return one.filter(keep_fraction(F.col("doc_id"), max_rows / max(total, 1)))


def feature_rows(docs: DataFrame, features: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]], text_col: str = "text", binary: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Features of a bounded sample as compressed sparse rows: (y, row starts, columns, values).

    docs has text_col, y and order; rows come back by order. features gives the
    text, column and value of each entry of a block, by ascending text. binary: all
    values are 1 and only the columns reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                doc, col, val = features(b)
                at = np.searchsorted(doc, np.arange(b.n + 1))
                rest = batch.slice(b.row, b.n)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(1), rest.column(2), pa.array([col[i:j].astype(np.int32).tobytes() for i, j in zip(at, at[1:])], pa.binary()), pa.array([b"" if binary else val[i:j].astype(np.float32).tobytes() for i, j in zip(at, at[1:])], pa.binary())],
                    ["y", "order", "cols", "vals"],
                )

    found = docs.select(text_col, F.col("y").cast("double"), F.col("order").cast("long")).mapInArrow(work, "y double, order long, cols binary, vals binary").toArrow().to_pandas().sort_values(["order", "y"], kind="stable")
    cols = [np.frombuffer(x, np.int32) for x in found["cols"]]
    vals = [np.frombuffer(x, np.float32) for x in found["vals"]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in cols])]).astype(np.int64)
    empty = [np.zeros(0, np.int32)]
    return found["y"].to_numpy(), starts, np.concatenate(cols or empty), None if binary else np.concatenate(vals or [np.zeros(0, np.float32)])


def count_columns(starts: np.ndarray, cols: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """How many of the rows marked have each column."""
    return np.bincount(cols[np.repeat(rows, np.diff(starts))], minlength=size)


def dot_rows(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, w: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum((w[cols] * vals).astype(np.float64))])
    return sums[starts[1:]] - sums[starts[:-1]]


def add_rows(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows, each times its g."""
    return np.bincount(cols, weights=np.repeat(g, np.diff(starts)) * vals, minlength=size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), fitted by Newton steps to smoothed targets."""
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    if len(y) == 0:
        return 1.0, 0.0
    scale = float(np.abs(margin).max()) or 1.0
    m = margin / scale
    t = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    p = np.array([0.0, float(np.log((up + 1) / (down + 1)))])
    x = np.stack([m, np.ones_like(m)], 1)

    def loss(q):
        z = x @ q
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-6 * q @ q)

    for _ in range(steps):
        s = sigmoid(x @ p)
        grad = x.T @ (s - t) + 2e-6 * p
        hess = (x * (s * (1 - s))[:, None]).T @ x + np.eye(2) * 1e-6
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(p - size * step) > loss(p):
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(p[0], 0.0) / scale), float(p[1])


def score_texts(docs: DataFrame, carry: list[str], margins: Callable[[Block], np.ndarray], text_col: str = "text") -> DataFrame:
    """carry columns and a double score of each row, in Arrow batches."""
    kept = docs.select(*carry, F.col(text_col).alias(unused("_text", carry)))
    schema = docs.select(*carry).schema.add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                rest = batch.slice(b.row, b.n)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(np.asarray(margins(b), dtype=np.float64))], [*carry, "score"])

    return kept.mapInArrow(work, schema)
