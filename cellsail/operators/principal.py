"""Principal components of sparse cells, by a block Krylov iteration whose every step is one pass over the cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.sums import matrix_sum
from cellsail.tables import written

#: Numbers of the dense slice that a task makes of some cells at a time.
SLICE = 1 << 22
#: Blocks that the basis may have before it starts again from its best vectors.
BLOCKS = 6
#: Directions shorter than this part of the longest one are taken for rounding.
TINY = 1e-10


def _independent(block: np.ndarray, image: np.ndarray, basis: np.ndarray, basis_image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """block without what the basis has, and with directions of length 1 at right angles, in the product x' image(y); image goes along."""
    length = np.sqrt(np.maximum((block * image).sum(axis=0), 0))
    block, image = block[:, length > 0] / length[length > 0], image[:, length > 0] / length[length > 0]
    for _ in range(2):
        share = basis_image.T @ block
        block, image = block - basis @ share, image - basis_image @ share
        value, vector = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        keep = value > TINY * max(1.0, float(value.max(initial=0)))
        turn = vector[:, keep] / np.sqrt(value[keep])
        block, image = block @ turn, image @ turn
    return block, image


def largest_eigenvectors(size: int, k: int, apply: Callable[[np.ndarray], np.ndarray], product: Callable[[np.ndarray], np.ndarray] | None = None, extra: int = 10, limit: float = 1e-9, turns: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, descending, and eigenvectors of M = B A, where product gives A x (x if it is None) and apply gives B x.

    A and B are symmetric and not negative, so M is symmetric in the product x' A y;
    eigenvectors have length 1 in it. Each turn widens a basis by what its best
    vectors lack, at the cost of one call of either function, until every
    eigenvector's residual is within limit of the largest value; size x (k + extra)
    x BLOCKS numbers are held. Fewer than k come back if M has fewer that are not 0.
    """
    width = min(k + extra, size)
    image_of = product or (lambda x: x)
    block = np.random.default_rng(seed).normal(size=(size, width))
    basis, image, moved = (np.zeros((size, 0)) for _ in range(3))
    for _ in range(turns):
        block, block_image = _independent(block, image_of(block), basis, image)
        if not block.shape[1]:
            break
        basis, image, moved = np.hstack([basis, block]), np.hstack([image, block_image]), np.hstack([moved, apply(block_image)])
        t = image.T @ moved
        value, vector = np.linalg.eigh((t + t.T) / 2)
        best = vector[:, ::-1][:, :width]
        value = value[::-1][:width]
        block = moved @ best - (basis @ best) * value
        rest = np.linalg.norm(block[:, :k], axis=0) / np.maximum(np.linalg.norm((basis @ best)[:, :k], axis=0), 1e-300)
        if basis.shape[1] >= size or (rest <= limit * max(float(value[0]), 1e-300)).all():
            break
        if basis.shape[1] + width > BLOCKS * width:
            basis, image, moved = basis @ best, image @ best, moved @ best
    t = image.T @ moved
    value, vector = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(value)[::-1][:k]
    order = order[value[order] > TINY * max(float(value.max(initial=0)), 1e-300)]
    return value[order], basis @ vector[:, order]


def cell_vectors(frame: ExpressionFrame, genes: list) -> DataFrame:
    """(cell, i, v): places and values of what each of frame's cells has of these genes; missing values count as 0."""
    spark = frame.expr.sparkSession
    index = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], f"gene {dict(frame.genes.dtypes)['gene']}, i int")
    own = frame.fill_missing().expr.filter("value <> 0").join(index, "gene").groupBy("cell").agg(F.collect_list(F.struct("i", "value")).alias("x"))
    none = F.array().cast("array<struct<i:int,value:double>>")
    rows = frame.cells.select("cell").join(own, "cell", "left").withColumn("x", F.coalesce("x", none))
    return rows.select("cell", F.col("x.i").alias("i"), F.col("x.value").alias("v"))


def dense_slices(batch: pa.RecordBatch, size: int, at: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """First row and dense values of slices of a batch with places and values in columns at and at + 1."""
    step = max(1, SLICE // max(size, 1))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        out = np.zeros((part.num_rows, size))
        index, value = part.column(at), part.column(at + 1)
        row = np.repeat(np.arange(part.num_rows), np.diff(index.offsets.to_numpy()))
        out[row, index.flatten().to_numpy()] = value.flatten().to_numpy()
        yield start, out


@dataclass(frozen=True)
class Principal:
    """Components over genes: weights(genes x k) of length 1, the deviation that each explains times the root of the cells, and the genes' means."""

    genes: list
    mean: np.ndarray
    weights: np.ndarray
    deviations: np.ndarray
    vectors: DataFrame

    def arrays(self, vectors: DataFrame | None = None) -> DataFrame:
        """(cell, z): each cell's places on all components."""
        vectors = self.vectors if vectors is None else vectors
        cell = vectors.schema["cell"].dataType.simpleString()
        mean, size, shared = self.mean, len(self.genes), vectors.sparkSession.sparkContext.broadcast(self.weights)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, x in dense_slices(batch, size):
                    z = (x - mean) @ shared.value
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(z)), lists], ["cell", "z"])

        return vectors.mapInArrow(work, f"cell {cell}, z array<double>")

    def places(self, vectors: DataFrame | None = None) -> DataFrame:
        """(cell, component, value), components from 0."""
        return self.arrays(vectors).select("cell", F.posexplode("z").alias("component", "value"))


def principal_components(frame: ExpressionFrame, k: int = 50, seed: int = 0) -> Principal:
    """The k components of the largest variance of centred values, fewer if cells or genes do not have so many.

    Missing values are 0. Nothing of genes x genes or cells x cells is built: the
    driver and each task hold genes x some multiples of k numbers. The largest
    weight of a component is positive. Cells are told apart by their id alone.
    """
    genes = sorted(r[0] for r in frame.genes.select("gene").collect())
    n = frame.cells.count()
    place = {g: i for i, g in enumerate(genes)}
    mean = np.zeros(len(genes))
    for r in frame.fill_missing().keep_genes(frame.genes).expr.groupBy("gene").agg(F.sum("value").alias("s")).collect():
        mean[place[r["gene"]]] = r["s"] / max(n, 1)
    vectors = written(cell_vectors(frame, genes), "cell-vectors")
    k = min(k, n, len(genes))
    if not k:
        return Principal(genes, mean, np.zeros((len(genes), 0)), np.zeros(0), vectors)

    def apply(x: np.ndarray) -> np.ndarray:
        shared = vectors.sparkSession.sparkContext.broadcast(x)
        size = len(genes)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((size, shared.value.shape[1]))
            for batch in batches:
                for _, rows in dense_slices(batch, size):
                    rows -= mean
                    total += rows.T @ (rows @ shared.value)
            return total

        out = matrix_sum(vectors, part, size, x.shape[1])
        shared.unpersist()
        return out

    value, weights = largest_eigenvectors(len(genes), k, apply, seed=seed)
    sign = np.where(weights[np.abs(weights).argmax(axis=0), np.arange(weights.shape[1])] < 0, -1.0, 1.0) if weights.size else 1.0
    return Principal(genes, mean, weights * sign, np.sqrt(np.maximum(value, 0)), vectors)
