"""Removal of batches from principal components by soft clusters that are pressed to mix batches (the published Harmony method).

Clusters, batch counts and corrections are small and live in the driver as sums over
cells. A cell's soft assignment is never stored: it follows from its place, the
centroids and the penalty under which its block was last updated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellsail.frame import ExpressionFrame
from cellsail.functions.sums import list_matrix, matrix_sum
from cellsail.operators.principal import principal_components
from cellsail.tables import written


@dataclass(frozen=True)
class Settings:
    """theta: weight of mixing for all variables or each one; lamb: ridge of the correction; tau: cells a cluster below which theta is discounted."""

    clusters: int | None = None
    sigma: float = 0.1
    theta: float | tuple[float, ...] = 1.0
    lamb: float = 1.0
    tau: float = 0.0
    block_size: float = 0.05
    rounds: int = 10
    inner: int = 20
    limit: float = 1e-4
    seed: int = 0


@dataclass(frozen=True)
class Clusters:
    """Centroids (clusters x d) and, for each block of cells, the penalty (clusters x levels) of its assignments."""

    centroids: np.ndarray
    penalty: np.ndarray
    sigma: float

    def assign(self, places: np.ndarray, levels: np.ndarray, block: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Soft assignments (cells x clusters) and distances of places of length 1."""
        distance = 2 * (1 - places @ self.centroids.T)
        score = -distance / self.sigma
        share = np.exp(score - score.max(axis=1, keepdims=True))
        blocks = np.broadcast_to(block, len(places))
        pressed = np.ones_like(share)
        for b in np.unique(blocks):
            own = blocks == b
            pressed[own] = self.penalty[b][:, levels[own]].sum(axis=2).T  # summed over the variables of a cell
        share *= pressed
        return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12), distance


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _levels(cells: DataFrame, batches: list[str]) -> tuple[DataFrame, list[int]]:
    """(cell, levels): the number of each variable's level, counted through all variables; null is a level of its own. And levels of each variable."""
    out, sizes = cells.select("cell", *[F.col(b).alias(f"b{i}") for i, b in enumerate(batches)]), []
    numbers = []
    for i in range(len(batches)):
        found = out.select(f"b{i}").distinct().orderBy(F.col(f"b{i}").asc_nulls_last()).withColumnRenamed(f"b{i}", "level")
        rows = [(r["level"], sum(sizes) + j) for j, r in enumerate(found.collect())]
        sizes.append(len(rows))
        table = out.sparkSession.createDataFrame(rows, f"level {dict(out.dtypes)[f'b{i}']}, n{i} int")
        out = out.join(F.broadcast(table), F.col(f"b{i}").eqNullSafe(F.col("level"))).drop("level")
        numbers.append(f"n{i}")
    return out.select("cell", F.array(*numbers).alias("levels")), sizes


def _block(blocks: int, seed: int) -> Column:
    """The block of a cell, by a hash of its id."""
    return F.pmod(F.xxhash64(F.col("cell"), F.lit(f"block-{seed}")), F.lit(blocks)).cast("int").alias("block")


def noise(k: int, seed: int) -> Column:
    """Gumbel noise of a cell for the choice of centroid k."""
    h = F.pmod(F.xxhash64(F.col("cell"), F.lit(f"centroid-{seed}-{k}")), F.lit(1 << 52)).cast("double")
    return (-F.log(-F.log((h + 0.5) / float(1 << 52)))).alias("noise")


def first_centroids(state: DataFrame, k: int, d: int, seed: int) -> np.ndarray:
    """k cells' places, each drawn with odds of its distance from the nearest one so far (the first alike); one row a task reaches the driver for each."""
    chosen = np.zeros((0, d))
    for c in range(k):

        def best(batches: Iterator[pa.RecordBatch], before=chosen) -> Iterator[pa.RecordBatch]:
            top, place = -np.inf, None
            for batch in batches:
                u = list_matrix(batch.column(0), d)
                far = np.ones(len(u)) if not len(before) else np.maximum((1 - u @ before.T).min(axis=1), 0)
                with np.errstate(divide="ignore"):
                    key = np.log(far) + batch.column(1).to_numpy()
                if len(key) and key.max() > top:
                    top, place = float(key.max()), u[key.argmax()]
            if place is not None:
                yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([place.tolist()])], ["key", "u"])

        found = state.select("u", noise(c, seed)).mapInArrow(best, "key double, u array<double>").orderBy(F.col("key").desc(), "u").first()
        if found is None:  # all cells are centroids' copies
            break
        chosen = np.vstack([chosen, found["u"]])
    return unit(chosen)


@dataclass
class _Sums:
    """Of one block of cells: assignments by level, assigned places, mass of clusters, and the parts of the objective."""

    by_level: np.ndarray
    places: np.ndarray
    mass: np.ndarray
    error: float
    entropy: float


def _block_sums(state: DataFrame, clusters: Clusters, sigma: float, levels: int, d: int, place: str = "u", before: str | None = None) -> np.ndarray:
    """(blocks, clusters, levels + d + 3) sums of assignments by place (or by the places before the last correction) times levels and places."""
    shared = state.sparkSession.sparkContext.broadcast(clusters)
    k, blocks = len(clusters.centroids), len(clusters.penalty)
    width = levels + d + 3

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((blocks, k, width))
        model = shared.value
        for batch in batches:
            block, at, u = batch.column(0).to_numpy(), list_matrix(batch.column(1), len(batch.column(1)[0]) if batch.num_rows else 1), list_matrix(batch.column(2), d)
            r, distance = model.assign(list_matrix(batch.column(3), d), at, block)
            for b in np.unique(block):
                own = block == b
                rb = r[own]
                for v in range(at.shape[1]):
                    for level in np.unique(at[own, v]):
                        total[b, :, level] += rb[at[own, v] == level].sum(axis=0)
                total[b, :, levels : levels + d] += rb.T @ u[own]
                total[b, :, levels + d] += rb.sum(axis=0)
                total[b, :, levels + d + 1] += (rb * distance[own]).sum(axis=0)
                total[b, :, levels + d + 2] += (rb * np.log(np.maximum(rb, 1e-300))).sum(axis=0) * sigma
        return total.reshape(blocks * k, width)

    rows = state.select("block", "levels", F.col(place).alias("u"), F.col(before or place).alias("from"))
    out = matrix_sum(rows, part, blocks * k, width).reshape(blocks, k, width)
    shared.unpersist()
    return out


def _correction(state: DataFrame, clusters: Clusters, levels: int, d: int, lamb: float) -> np.ndarray:
    """(clusters, 1 + levels, d): ridge fits of places on levels, one for each cluster by its assignments; the constant's row is 0."""
    shared = state.sparkSession.sparkContext.broadcast(clusters)
    k, size = len(clusters.centroids), 1 + levels

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k, size, size + d))
        for batch in batches:
            block, at, z = batch.column(0).to_numpy(), list_matrix(batch.column(1), len(batch.column(1)[0]) if batch.num_rows else 1), list_matrix(batch.column(2), d)
            r, _ = shared.value.assign(list_matrix(batch.column(3), d), at, block)
            design = np.zeros((len(z), size))
            design[:, 0] = 1
            design[np.arange(len(z))[:, None], 1 + at] = 1
            both = np.hstack([design, z])
            for c in range(k):
                total[c] += (design * r[:, c : c + 1]).T @ both
        return total.reshape(k * size, size + d)

    sums = matrix_sum(state.select("block", "levels", "z", "u"), part, k * size, size + d).reshape(k, size, size + d)
    shared.unpersist()
    ridge = np.diag([0.0, *[lamb] * levels])
    # a level without cells, or no ridge at all, leaves the system singular: the shortest solution then
    fit = np.stack([np.linalg.lstsq(s[:, :size] + ridge, s[:, size:], rcond=1e-12)[0] for s in sums])
    fit[:, 0] = 0
    return fit


def _corrected(state: DataFrame, clusters: Clusters, fit: np.ndarray, d: int) -> DataFrame:
    """State with c, the corrected places, u, these at length 1, and before, u until now."""
    shared = state.sparkSession.sparkContext.broadcast((clusters, fit))
    schema = state.select("cell", "block", "levels", "z").schema
    for name in ("c", "u", "before"):
        schema = schema.add(name, ArrayType(DoubleType()))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, z = list_matrix(batch.column(2), len(batch.column(2)[0])), list_matrix(batch.column(3), d)
            r, _ = model.assign(list_matrix(batch.column(4), d), at, batch.column(1).to_numpy())
            c = z - sum(np.einsum("nk,knd->nd", r, w[:, 1 + at[:, v]]) for v in range(at.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists(c), lists(unit(c)), batch.column(4)], [*schema.names])

    return state.select("cell", "block", "levels", "z", "u").mapInArrow(work, schema)


def mixed_places(places: DataFrame, cells: DataFrame, batches: list[str], settings: Settings = Settings()) -> tuple[DataFrame, list[float]]:
    """(cell, z) with batches removed from the places (cell, z array) of all cells, and the objective at the start and after each round.

    In an inner turn centroids move to their cells' mean direction; then the blocks of
    cells, in an order drawn anew, are assigned again, each against the counts of all
    others. A round ends with a ridge correction of the first places in each cluster. Rounds
    end when the objective falls by less than limit of itself, or rises.
    """
    n, d = places.count(), len((places.select("z").first() or [[]])[0])
    if not n or not d or not batches:
        return places, []
    of_level, sizes = _levels(cells, batches)
    levels = sum(sizes)
    blocks = int(np.ceil(1 / settings.block_size))
    k = settings.clusters or max(1, min(round(n / 30), 100))
    unit_of = F.transform("z", lambda x: x / F.greatest(F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12)))
    state = written(places.join(of_level, "cell").select("cell", _block(blocks, settings.seed), "levels", "z", F.col("z").alias("c"), unit_of.alias("u"), unit_of.alias("before")), "harmony", by="block")
    counts = np.zeros(levels)
    for r in state.select(F.explode("levels").alias("level")).groupBy("level").agg(F.count("*").alias("n")).collect():
        counts[r["level"]] = r["n"]
    share = counts / n
    theta = np.concatenate([np.full(s, t) for s, t in zip(sizes, np.broadcast_to(settings.theta, len(sizes)))])
    if settings.tau > 0 and settings.clusters:
        theta = theta * (1 - np.exp(-((counts / (settings.clusters * settings.tau)) ** 2)))
    start = first_centroids(state, k, d, settings.seed)
    k = len(start)
    clusters = Clusters(start, np.full((blocks, k, levels), 1 / len(sizes)), settings.sigma)  # no penalty yet: 1 for each cell

    def parts(s: np.ndarray) -> _Sums:
        return _Sums(s[..., :levels], s[..., levels : levels + d], s[..., levels + d], float(s[..., levels + d + 1].sum()), float(s[..., levels + d + 2].sum()))

    def objective(sums: np.ndarray) -> float:
        s = parts(sums)
        seen, expected = s.by_level.sum(axis=0), np.outer(s.mass.sum(axis=0), share)
        return s.error + s.entropy + float((settings.sigma * theta * np.log((seen + 1) / (expected + 1)) * seen).sum())

    sums = _block_sums(state, clusters, settings.sigma, levels, d)
    history = [objective(sums)]
    rng = np.random.default_rng(settings.seed)
    for turn in range(settings.rounds):
        if turn:  # the assignments are the old ones, the places new
            sums = _block_sums(state, clusters, settings.sigma, levels, d, before="before")
        for _ in range(settings.inner):
            clusters = replace(clusters, centroids=unit(parts(sums).places.sum(axis=0)), penalty=clusters.penalty.copy())
            for b in rng.permutation(blocks):
                others = parts(np.delete(sums, b, axis=0))
                seen, expected = others.by_level.sum(axis=0), np.outer(others.mass.sum(axis=0), share)
                clusters.penalty[b] = ((expected + 1) / (seen + 1)) ** theta
                sums[b] = _block_sums(state.filter(F.col("block") == int(b)), clusters, settings.sigma, levels, d)[b]
        fit = _correction(state, clusters, levels, d, settings.lamb)
        state = written(_corrected(state, clusters, fit, d), "harmony", by="block")
        history.append(objective(sums))
        if (history[-2] - history[-1]) / (abs(history[-2]) + 1e-12) < settings.limit:
            break
    return state.select("cell", F.col("c").alias("z")), history


def harmony(frame: ExpressionFrame, batches: list[str], components: int = 50, settings: Settings = Settings()) -> DataFrame:
    """The columns of cells and PC1, PC2, ...: principal components of the frame with batches removed; as they are without batches.

    A null batch is a level of its own. Missing values are 0. Of components that
    would be 0 for all cells none is made.
    """
    found = principal_components(frame, components, settings.seed)
    names = [f"PC{i + 1}" for i in range(len(found.deviations))]
    if clash := {*names} & {*frame.cells.columns}:
        raise ValueError(f"columns named like components: {sorted(clash)}")
    rows, _ = mixed_places(written(found.arrays(), "harmony-places"), frame.cells, batches, settings)
    return frame.cells.join(rows.select("cell", *[F.col("z")[i].alias(name) for i, name in enumerate(names)]), "cell")
