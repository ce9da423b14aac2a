"""What a plot of values needs: a bounded sample, densities, and scales and digits of thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.quantiles import order_statistics

#: Values of a sample, and bins of a density; so many rows reach the driver at most.
SAMPLE, BINS = 20_000, 8192


def log10_scale(x: Column) -> Column:
    return F.log10(1 + x)


def from_log10_scale(x: Column) -> Column:
    return F.pow(F.lit(10.0), x) - 1


def threshold_digits(low: float, high: float) -> int:
    """Decimals to which thresholds between low and high are rounded."""
    span = high - low
    return max(4 - math.floor(math.log10(span)), 1) if span > 0 else 1


def display_values(frame: ExpressionFrame) -> DataFrame:
    """(cell, gene, value) of the finite values that are not 0."""
    v = F.col("value")
    return frame.expr.select("cell", "gene", "value").filter(v.isNotNull() & (v != 0) & ~F.isnan(v) & (F.abs(v) != float("inf")))


def display_sample(frame: ExpressionFrame, size: int = SAMPLE) -> DataFrame:
    """(cell, gene, value): at most size of display_values, with the least and the largest one.

    The others are those of the least hashes of cell and gene: 13 hexadecimal digits of md5, equal
    ones together by the pair. A selection by digits finds the last hash, so the sample is the same however
    rows are split, and no task sorts more than it.
    """
    if size < 2:
        raise ValueError("a sample has two values at least")
    rows = display_values(frame)
    pair = F.concat(F.col("cell").cast("string"), F.lit(":"), F.col("gene").cast("string"))
    rows = rows.withColumn("pair", pair).withColumn("hash", F.conv(F.substring(F.md5("pair"), 1, 13), 16, 10).cast("long"))
    first = F.struct("value", "hash", "pair")
    ends = rows.agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high")).first()
    if ends["n"] <= size:
        return rows.select("cell", "gene", "value")

    def same(e) -> Column:
        return (F.col("value") == F.lit(e["value"])) & (F.col("hash") == F.lit(e["hash"])) & (F.col("pair") == F.lit(e["pair"]))

    inner = rows.filter(~same(ends["low"]) & ~same(ends["high"]))
    many = size - 2
    if not many:
        return rows.filter(same(ends["low"]) | same(ends["high"])).select("cell", "gene", "value")
    # 52 bits of a hash are exact as a double
    last = order_statistics(inner.withColumn("all", F.lit(0)), ["all"], "hash", lambda n: [F.lit(many - 1)]).first()["stats"][0]
    chosen = inner.filter(F.col("hash") <= F.lit(int(last))).orderBy("hash", "pair").limit(many)
    return rows.filter(same(ends["low"]) | same(ends["high"])).unionByName(chosen).select("cell", "gene", "value")


def density(rows: DataFrame, value: str, points: int = 1000, low: float | None = None, high: float | None = None) -> DataFrame:
    """(place, x, density) at evenly spaced points: Gaussian kernels of Scott's width around the values.

    The points span the values and a fortieth of their range beyond either end, or low to
    high. Values are summed by bins, each with its count, mean and spread, which
    merge; the kernel of a bin is that at its mean, corrected for the spread. With fewer than two values the
    density is 1 / points everywhere, of equal values 0. Null and infinite values are left out.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    x = rows.select(v.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    ends = x.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_samp("x").alias("sd")).first()
    n, least, most = ends["n"], ends["low"] or 0.0, ends["high"] or 0.0
    pad = (most - least) * 0.025
    grid = np.linspace(least - pad if low is None else low, most + pad if high is None else high, points)
    if n < 2:
        found = np.full(points, 1 / points)
    elif not ends["sd"]:
        found = np.zeros(points)
    else:
        width, step = ends["sd"] * n ** (-1 / 5), (most - least) / BINS
        at = F.least(F.floor((F.col("x") - least) / step), F.lit(BINS - 1))
        off = F.col("x") - (least + (F.col("bin") + 0.5) * step)
        sums = x.withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("q")).toArrow()
        c, s, q = (sums[k].to_numpy().astype(float) for k in ("n", "s", "q"))
        mean = least + (sums["bin"].to_numpy() + 0.5) * step + s / c
        spread = (q - s * s / c) / width**2
        found = np.zeros(points)
        for i in range(0, len(c), 1024):
            u = (grid[:, None] - mean[None, i : i + 1024]) / width
            found += np.exp(-0.5 * u * u) @ c[i : i + 1024] + 0.5 * ((u * u - 1) * np.exp(-0.5 * u * u)) @ spread[i : i + 1024]
        found /= n * width * math.sqrt(2 * math.pi)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(grid, found))], "place int, x double, density double")
