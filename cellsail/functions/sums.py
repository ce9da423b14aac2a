"""Matrices as sums of what each task adds up, merged by Spark row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_sum(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], height: int, width: int) -> np.ndarray:
    """Sum of the height x width matrices that part makes of each task's rows; rows of zeros are not passed on."""
    names = [f"s{j}" for j in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches)
        has = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), *(pa.array(total[has, j]) for j in range(width))], ["i", *names])

    parts = rows.mapInArrow(work, "i int, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((height, width))
    if found.num_rows:
        out[found["i"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    return out


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column whose lists all have width numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
