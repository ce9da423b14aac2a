"""Canonical correlation of data sets that share their genes, and genes and metagenes of its components.

Cells are many and genes are few here, so all is expressed by the genes x genes
products of the standardized sets, which are sums over cells; a cell's place is
its standardized values times weights of genes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.sums import matrix_sum
from cellsail.operators.principal import dense_slices, largest_eigenvectors
from cellsail.operators.scoring import gene_moments
from cellsail.tables import written

#: Genes up to which the sets' products are made: a matrix of so many rows and columns in each task.
MAX_GENES = 2000
#: Tasks that sum products, each of which passes on one matrix.
SUM_TASKS = 32
#: Deviations up to this count as none.
TINY = 1e-8


@dataclass
class Standardized:
    """A set of cells, the order of its genes, and their means and inverse deviations (0 for a constant gene)."""

    vectors: DataFrame  # cell, i, v: indices and values of what is stored
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, batch: pa.RecordBatch) -> np.ndarray:
        return _dense(batch, self.mean, self.scale)


def _dense(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.zeros((batch.num_rows, len(mean)))
    index, value = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(batch.num_rows), np.diff(index.offsets.to_numpy()))
    out[row, index.flatten().to_numpy()] = value.flatten().to_numpy()
    return (out - mean) * scale


def standardized(frame: ExpressionFrame, genes: list) -> Standardized:
    """frame's cells over these genes; missing values count as 0."""
    place = {g: i for i, g in enumerate(genes)}
    spark = frame.expr.sparkSession
    index = spark.createDataFrame([(g, i) for g, i in place.items()], f"gene {dict(frame.genes.dtypes)['gene']}, i int")
    sub = frame.fill_missing().keep_genes(index)
    mean, scale = np.zeros(len(genes)), np.zeros(len(genes))
    for r in gene_moments(sub).collect():  # one row a gene
        mean[place[r["gene"]]] = r["mean"] or 0.0
        sd = float(np.sqrt(r["variance"] or 0.0))
        scale[place[r["gene"]]] = 1 / sd if sd > TINY else 0.0
    own = sub.expr.join(F.broadcast(index), "gene").groupBy("cell").agg(F.collect_list(F.struct("i", "value")).alias("x"))
    none = F.array().cast("array<struct<i:int,value:double>>")
    vectors = frame.cells.select("cell").join(own, "cell", "left").withColumn("x", F.coalesce("x", none))
    return Standardized(vectors.select("cell", F.col("x.i").alias("i"), F.col("x.value").alias("v")), mean, scale)


def products(x: Standardized) -> np.ndarray:
    """genes x genes sums of products over all cells."""
    mean, scale = x.mean, x.scale

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                z = _dense(batch.slice(at, 1000), mean, scale)
                total += z.T @ z
        for i in range(len(mean)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].tobytes()], pa.binary())], ["i", "row"])

    def add(key, rows):
        total = sum(np.frombuffer(r) for r in rows["row"])
        return rows.iloc[:1].assign(row=[total.tobytes()])

    parts = x.vectors.coalesce(SUM_TASKS).mapInArrow(work, "i int, row binary")
    out = np.zeros((len(mean), len(mean)))
    for r in parts.groupBy("i").applyInPandas(add, "i int, row binary").toLocalIterator():
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def places(x: Standardized, weights: np.ndarray) -> DataFrame:
    """(cell, component, value): standardized values times weights(genes x components)."""
    cell = x.vectors.schema["cell"].dataType.simpleString()
    mean, scale = x.mean, x.scale
    shared = x.vectors.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                z = _dense(part, mean, scale) @ shared.value
                k = z.shape[1]
                cells = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                yield pa.RecordBatch.from_arrays([cells, pa.array(np.tile(np.arange(k, dtype=np.int32), part.num_rows)), pa.array(z.ravel())], ["cell", "component", "value"])

    return x.vectors.mapInArrow(work, f"cell {cell}, component int, value double")


@dataclass
class Components:
    """Weights(genes x components) of each set, and each component's correlation."""

    genes: list
    weights: list[np.ndarray]
    correlations: np.ndarray
    products: list[np.ndarray]


def _root(a: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(a)
    return (vector * np.sqrt(np.maximum(value, 0))) @ vector.T


def two_set_components(a: np.ndarray, b: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of both sets for the k largest singular vectors of X Y', from X'X and Y'Y, and the correlations of X'u and Y'v.

    With R the root of Y'Y, they come from the eigenvectors of R X'X R. The largest
    weight of each component in the first set is positive.
    """
    root = _root(b)
    value, vector = np.linalg.eigh(root @ a @ root)
    order = np.argsort(value)[::-1][:k]
    order = order[value[order] > TINY * max(float(value.max()), 1.0)]
    sigma = np.sqrt(value[order])
    u = root @ vector[:, order] / sigma
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    v = a @ u / sigma
    return [u, v], np.array([np.corrcoef(x, y)[0, 1] for x, y in zip((a @ u).T, (b @ v).T)])


def large_set_components(x: Standardized, y: Standardized, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """As two_set_components, of sets of many genes: X'X and Y'Y are only applied to some vectors at a time, each time in one pass over the cells."""

    def applied(z: Standardized) -> Callable[[np.ndarray], np.ndarray]:
        size, mean, scale = len(z.mean), z.mean, z.scale
        rows = written(z.vectors, "standardized")

        def apply(w: np.ndarray) -> np.ndarray:
            shared = rows.sparkSession.sparkContext.broadcast(w)

            def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                total = np.zeros((size, shared.value.shape[1]))
                for batch in batches:
                    for _, dense in dense_slices(batch, size):
                        dense = (dense - mean) * scale
                        total += dense.T @ (dense @ shared.value)
                return total

            return matrix_sum(rows, part, size, w.shape[1])

        return apply

    a, b = applied(x), applied(y)
    value, u = largest_eigenvectors(len(x.mean), k, b, a)
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    seen = a(u)
    v = seen / np.sqrt(value)
    return [u, v], np.array([np.corrcoef(p, q)[0, 1] for p, q in zip(seen.T, b(v).T)])


def many_set_components(grams: list[np.ndarray], k: int, turns: int = 25, limit: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each set for k components, one after the other.

    A component starts at each set's own largest singular vector. In turn each set's
    vector becomes the sum of what the others' vectors say of its cells, less what
    earlier components explain, until the objective changes by less than limit.
    """
    n = len(grams)
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    norm = lambda a, s: np.sqrt(max(float(s @ a @ s), 1e-300))
    correlations = []
    for c in range(k):
        w = []
        for a in grams:
            value, vector = np.linalg.eigh(a)
            s = vector[:, -1 - c] if c < len(value) else vector[:, 0]
            w.append(s / norm(a, s))
        before = 0.0
        for _ in range(turns):
            for i, a in enumerate(grams):
                s = sum(grams[j] @ w[j] for j in range(n) if j != i)
                for t in found[i]:
                    s = s - (t @ a @ s) * t
                w[i] = s / norm(a, s)
            now = sum(float((grams[i] @ w[i]) @ (grams[j] @ w[j])) for i in range(n) for j in range(i))
            if abs(now - before) <= limit * max(abs(before), 1e-300):
                break
            before = now
        sign = -1.0 if w[0][np.abs(w[0]).argmax()] < 0 else 1.0
        for i in range(n):
            found[i].append(sign * w[i])
        seen = [grams[i] @ w[i] for i in range(n)]
        correlations.append(np.mean([np.corrcoef(seen[i], seen[j])[0, 1] for i in range(n) for j in range(i)]))
    return [np.stack(x, 1) for x in found], np.array(correlations)


def canonical_components(frames: list[ExpressionFrame], k: int = 20) -> tuple[Components, list[DataFrame]]:
    """Components of two sets or more over the genes that all share, and (cell, component, value) of each set's cells.

    Two sets of more than MAX_GENES genes have no products; more sets of so many are an error.
    """
    if len(frames) < 2:
        raise ValueError("two sets at least")
    shared = frames[0].genes.select("gene")
    for f in frames[1:]:
        shared = shared.join(f.genes.select("gene"), "gene", "left_semi")
    genes = sorted(r[0] for r in shared.collect())
    if len(genes) > MAX_GENES and len(frames) > 2:
        raise ValueError(f"more than {MAX_GENES} genes of more than two sets")
    if k > len(genes):
        raise ValueError(f"{k} components of {len(genes)} genes")
    sets = [standardized(f, genes) for f in frames]
    if len(genes) > MAX_GENES:
        weights, correlations = large_set_components(*sets, k)
        return Components(genes, weights, correlations, []), [places(x, w) for x, w in zip(sets, weights)]
    grams = [products(x) for x in sets]
    weights, correlations = two_set_components(*grams, k) if len(sets) == 2 else many_set_components(grams, k)
    return Components(genes, weights, correlations, grams), [places(x, w) for x, w in zip(sets, weights)]


def metagenes(found: Components, n: int = 30) -> list[list]:
    """For each component the n genes that tell it best in every set, best first.

    A gene's score in a set is its product with the component over its length. Genes
    without a score in some set come last, then those whose signs differ between
    sets; of the others the weakest score counts.
    """
    out = []
    for c in range(found.weights[0].shape[1]):
        scores = []
        for w, a in zip(found.weights, found.products):
            length = np.sqrt(np.diag(a))
            scores.append(np.divide(a @ w[:, c], length, out=np.full(len(length), np.nan), where=length > 0))
        s = np.array(scores)
        missing = np.isnan(s).sum(axis=0)
        agree = np.abs(np.nansum(np.sign(s), axis=0)) == len(scores)
        weakest = np.nan_to_num(np.abs(s)).min(axis=0)
        out.append([found.genes[i] for i in np.lexsort((np.arange(len(missing)), -weakest, ~agree, missing))[:n]])
    return out


def scaled_to_reference(reference: DataFrame, other: DataFrame, low: float = 0.025, high: float = 0.975) -> tuple[DataFrame, DataFrame]:
    """(cell, component, value) of both sets, with each component's low and high quantiles at 0 and 1."""

    def scaled(rows: DataFrame) -> DataFrame:
        q = rows.groupBy("component").agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))
        span = F.col("high") - F.col("low")
        return rows.join(F.broadcast(q), "component").select("cell", "component", F.coalesce(F.try_divide(F.col("value") - F.col("low"), span), F.lit(0.0)).alias("value"))

    return scaled(reference), scaled(other)
