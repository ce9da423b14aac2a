"""Batch effects: how many genes a variable touches, and linear removal."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame

#: Columns that a design may have: each gene's fit is a system of so many equations.
MAX_DESIGN = 256


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    out = 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def p_of_r(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    df = n - 2
    if df <= 0 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    return _beta_fraction(df / 2, 0.5, 1 - r * r)


def critical_r(n: int, alpha: float = 0.05) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if p_of_r(mid, n) >= alpha else (low, mid)
    return high


def _correlations(frame: ExpressionFrame, z: DataFrame) -> DataFrame:
    """(gene, level, r) with each column of z(cell, level, z), from sums over stored values; 0 without variance.

    Both sides are taken around their means: that of z for all, that of a gene in
    the sums. Cells whose z is missing take no part.
    """
    z = z.filter("z IS NOT NULL")
    centre = z.groupBy("level").agg(F.avg("z").alias("mz"), F.count("*").alias("n"))
    z = z.join(F.broadcast(centre.select("level", "mz")), "level").select("cell", "level", (F.col("z") - F.col("mz")).alias("z"))
    zs = z.groupBy("level").agg(F.count("*").alias("n"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz"))
    own = frame.expr.filter("value <> 0").join(z, "cell")
    mean = own.groupBy("gene", "level").agg(F.sum("value").alias("sx"), F.count("*").alias("k"), F.sum(F.col("value") * F.col("z")).alias("sxz"))
    mean = mean.join(F.broadcast(zs), "level").withColumn("mx", F.col("sx") / F.col("n"))
    spread = own.join(mean.select("gene", "level", "mx"), ["gene", "level"]).groupBy("gene", "level").agg(F.sum((F.col("value") - F.col("mx")) ** 2).alias("q"))
    rows = mean.join(spread, ["gene", "level"])
    var = (F.col("q") + (F.col("n") - F.col("k")) * F.col("mx") ** 2) * (F.col("szz") - F.col("sz") ** 2 / F.col("n"))
    cov = F.col("sxz") - F.col("mx") * F.col("sz")
    return rows.select("gene", "level", F.when(var > 0, cov / F.sqrt(F.when(var > 0, var))).otherwise(0.0).alias("r"))


def batch_score(frame: ExpressionFrame, column: str, discrete: bool, alpha: float = 0.05) -> DataFrame:
    """One row, score: share of genes whose correlation with the column, or with any of its values, has p < alpha."""
    if discrete:
        levels = frame.cells.select(F.col(column).alias("level")).distinct()
        z = frame.cells.select("cell", F.col(column).alias("own")).crossJoin(F.broadcast(levels)).select("cell", "level", F.coalesce(F.col("own") == F.col("level"), F.lit(False)).cast("double").alias("z"))
    else:
        z = frame.cells.select("cell", F.lit(0).alias("level"), F.col(column).cast("double").alias("z"))
    # of as many pairs as the correlations have; indicators are known for all cells
    limit = critical_r((frame.cells if discrete else z.filter("z IS NOT NULL")).count(), alpha)
    hit = _correlations(frame, z).groupBy("gene").agg(F.max(F.abs("r")).alias("r"))
    out = frame.genes.select("gene").join(hit, "gene", "left")
    return out.agg(F.avg((F.coalesce("r", F.lit(0.0)) > limit).cast("double")).alias("score"))


@dataclass(frozen=True)
class BatchModel:
    """A linear fit of each gene on batch variables: weights(gene, w), w by column of the design.

    The design has a constant, an indicator for each level but the first of the
    discrete variables, and the continuous ones as they are.
    """

    discrete: list[str]
    continuous: list[str]
    levels: dict[str, list] = field(default_factory=dict)
    weights: DataFrame | None = None
    nonzero_only: bool = False
    log_link: bool = False

    @property
    def width(self) -> int:
        return 1 + sum(len(v) - 1 for v in self.levels.values()) + len(self.continuous)

    def design(self, cells: DataFrame) -> DataFrame:
        """(cell, z): the columns that are not 0 of each cell's row, as (i, z). Cells with a missing value of a variable, or a level that the fit did not see, are left out."""
        at, items, known = 1, [F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("z"))], []
        for name, levels in self.levels.items():
            place = F.array_position(F.array(*map(F.lit, levels)), F.col(name)) if levels else F.lit(0)
            known.append(place > 0)
            items.append(F.when(place > 1, F.struct((place - 2 + at).cast("int").alias("i"), F.lit(1.0).alias("z"))))
            at += max(len(levels) - 1, 0)
        for j, name in enumerate(self.continuous):
            items.append(F.struct(F.lit(at + j).alias("i"), F.col(name).cast("double").alias("z")))
        known += [F.col(c).cast("double").isNotNull() for c in self.continuous]
        rows = cells
        for k in known:
            rows = rows.filter(k)
        return rows.select("cell", F.array_compact(F.array(*items)).alias("z"))


def _solver(common: np.ndarray | None, width: int):
    """Least squares from the sums of each gene; common: sums of products over all cells, of which those of missing values go."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for pairs, sums in zip(xx, xy):
            a, b = np.zeros((width, width)), np.zeros(width)
            for r in pairs if pairs is not None else ():
                a[r["i"], r["j"]] = r["v"]
            for r in sums if sums is not None else ():
                b[r["i"]] = r["v"]
            a = a if common is None else common - a
            # columns of one scale, so that small ones are not taken for rounding
            scale = np.sqrt(np.maximum(np.diag(a), 0))
            scale[scale == 0] = 1.0
            out.append((np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (b / scale) / scale).tolist())
        return pd.Series(out)

    return solve


def fit_batch(frame: ExpressionFrame, discrete: list[str] = (), continuous: list[str] = (), nonzero_only: bool = False, log_link: bool = False) -> BatchModel:
    """Fit of each gene by its normal equations, whose sums come from stored values only.

    nonzero_only fits on values that are not 0; negative values are an error then.
    The log link fits logarithms and needs nonzero_only. Missing values take no part.
    """
    if log_link and not nonzero_only:
        raise ValueError("the log link needs nonzero_only")
    if nonzero_only and not frame.expr.filter("value < 0").isEmpty():
        raise ValueError("negative values cannot be fitted with nonzero_only")
    levels = {}
    for name in discrete:
        rows = frame.cells.select(name).dropna().distinct().limit(MAX_DESIGN + 1).collect()
        levels[name] = sorted(r[0] for r in rows)
    model = BatchModel(list(discrete), list(continuous), levels, None, nonzero_only, log_link)
    if model.width > MAX_DESIGN:
        raise ValueError(f"more than {MAX_DESIGN} columns in the design")
    if len(discrete) == 1 and not continuous:
        return replace(model, weights=_level_weights(frame, model))
    z = model.design(frame.cells)
    own = frame.expr.join(z, "cell")
    first = lambda x: F.explode(F.col(x))
    y = F.log("value") if log_link else F.col("value")
    known = own.filter("value <> 0")
    xy = known.select("gene", y.alias("y"), first("z").alias("e")).groupBy("gene", "e.i").agg(F.sum(F.col("y") * F.col("e.z")).alias("v"))
    xy = xy.groupBy("gene").agg(F.collect_list(F.struct("i", "v")).alias("xy"))  # as many as the design has columns
    products = lambda d: d.select("gene", first("z").alias("e"), "z").select("gene", "e", first("z").alias("f")).groupBy("gene", F.col("e.i").alias("i"), F.col("f.i").alias("j")).agg(F.sum(F.col("e.z") * F.col("f.z")).alias("v"))
    xx = products(known if nonzero_only else own.filter("value IS NULL")).groupBy("gene").agg(F.collect_list(F.struct("i", "j", "v")).alias("xx"))
    common = None
    if not nonzero_only:
        common = np.zeros((model.width, model.width))
        for r in products(z.withColumn("gene", F.lit(0))).collect():  # MAX_DESIGN squared at most
            common[r["i"], r["j"]] = r["v"]
    rows = frame.genes.select("gene").join(xx, "gene", "left").join(xy, "gene", "left")
    weights = rows.select("gene", _solver(common, model.width)("xx", "xy").alias("w"))
    return BatchModel(model.discrete, model.continuous, levels, weights, nonzero_only, log_link)


def _level_weights(frame: ExpressionFrame, model: BatchModel) -> DataFrame:
    """(gene, w) of a design of one discrete variable: means of its levels, by sums over stored values."""
    name, levels = model.discrete[0], model.levels[model.discrete[0]]
    of = frame.cells.select("cell", F.col(name).alias("level")).filter(F.col("level").isin(levels))
    y = F.log("value") if model.log_link else F.col("value")
    own = frame.expr.join(of, "cell").groupBy("gene", "level").agg(F.sum(F.when(F.col("value") != 0, y)).alias("s"), F.count_if(F.col("value") != 0).alias("on"), F.count_if(F.col("value").isNull()).alias("missing"))
    own = own.join(F.broadcast(of.groupBy("level").agg(F.count("*").alias("size"))), "level")
    n = F.col("on") if model.nonzero_only else F.col("size") - F.col("missing")
    means = own.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("level", F.coalesce(F.try_divide("s", n), F.lit(0.0))))).alias("m"))  # one entry a level
    rows = frame.genes.select("gene").join(means, "gene", "left")
    mean = [F.coalesce(F.try_element_at("m", F.lit(v)), F.lit(0.0)) for v in levels]
    return rows.select("gene", F.array(*(mean[:1] or [F.lit(0.0)]), *[m - mean[0] for m in mean[1:]]).alias("w"))


def remove_batch(frame: ExpressionFrame, model: BatchModel) -> ExpressionFrame:
    """Values less the fit, back through the link. A model fitted elsewhere can be replayed; genes that it lacks, and cells out of its design, stay.

    With nonzero_only zeros stay zero, and for the identity link the others are
    shifted by the gene's least value (zeros included) and by a hundredth of the
    deviation of the whole matrix.
    """
    if model.nonzero_only and not frame.expr.filter("value < 0").isEmpty():
        raise ValueError("negative values cannot be corrected with nonzero_only")
    d = frame.expr.filter("value <> 0 OR value IS NULL") if model.nonzero_only else frame.dense().expr
    d = d.join(model.design(frame.cells), "cell", "left").join(model.weights, "gene", "left")
    fitted = F.coalesce(F.aggregate("z", F.lit(0.0), lambda acc, x: acc + x["z"] * F.get("w", x["i"])), F.lit(0.0))
    left = F.col("value") - fitted
    # what a fit explains in full is 0, not the rounding of its arithmetic
    v = F.exp(F.log("value") - fitted) if model.log_link else F.when(F.abs(left) < 1e-9 * F.abs("value"), 0.0).otherwise(left)
    out = d.select("cell", "gene", F.when(F.col("z").isNull(), F.col("value")).otherwise(v).alias("value"))
    return frame.with_expr(_shifted(frame, out) if model.nonzero_only and not model.log_link else out)


def _shifted(frame: ExpressionFrame, out: DataFrame) -> DataFrame:
    size = F.broadcast(frame.n_cells().crossJoin(frame.genes.agg(F.count("*").alias("n_genes"))))
    low = out.groupBy("gene").agg(F.min("value").alias("low"), F.count("*").alias("stored"))
    # around the mean, in a second pass
    mean = out.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"), F.count_if(F.col("value").isNull()).alias("missing")).crossJoin(size)
    n = F.col("n_cells") * F.col("n_genes") - F.col("missing")
    mean = mean.select(F.try_divide("s", n).alias("mean"), n.alias("n"), "n_cells")
    spread = out.crossJoin(F.broadcast(mean)).filter("value IS NOT NULL").groupBy("mean", "n", "n_cells").agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("q"), F.count("*").alias("k"))
    sd = spread.select(F.sqrt((F.col("q") + (F.col("n") - F.col("k")) * F.col("mean") ** 2) / F.col("n")).alias("sd"), "n_cells")
    out = out.join(low, "gene").crossJoin(F.broadcast(sd))
    least: Column = F.when(F.col("stored") < F.col("n_cells"), F.least(F.col("low"), F.lit(0.0))).otherwise(F.col("low"))
    return out.select("cell", "gene", F.when(F.col("value") != 0, F.col("value") - least + 0.01 * F.col("sd")).when(F.col("value").isNotNull(), 0.0).alias("value"))


def remove_discrete(frame: ExpressionFrame, column: str, **how) -> ExpressionFrame:
    """Values less their gene's mean in the batch."""
    return remove_batch(frame, fit_batch(frame, [column], **how))


def remove_mixed(frame: ExpressionFrame, discrete: str, continuous: str, **how) -> ExpressionFrame:
    """Values less a joint fit on the batch's indicators and a continuous column."""
    return remove_batch(frame, fit_batch(frame, [discrete], [continuous], **how))


def remove_continuous(frame: ExpressionFrame, column: str, **how) -> ExpressionFrame:
    """Values less the fit on one column."""
    return remove_batch(frame, fit_batch(frame, [], [column], **how))


def batch_scores(frame: ExpressionFrame, discrete: list[str] = (), continuous: list[str] = (), alpha: float = 0.05) -> dict[str, float | None]:
    """The score of each batch variable, from one row each; None where it has none."""
    return {c: batch_score(frame, c, c in set(discrete), alpha).first()["score"] for c in [*discrete, *continuous]}
