"""Biweight statistics and average ranks, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _median(x: Column, keys: list[str]) -> Column:
    return F.median(x).over(Window.partitionBy(*keys))


def biweight_midcorrelation(rows: DataFrame, keys: list[str], x: str, y: str, c: float = 9.0) -> DataFrame:
    """(keys, bicor) of the pairs (x, y) of each group; null where a median absolute deviation is 0."""
    d = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for v in ("x", "y"):
        d = d.withColumn(f"d{v}", F.col(v) - _median(F.col(v), keys))
        d = d.withColumn(f"mad{v}", _median(F.abs(f"d{v}"), keys))
        u = F.try_divide(F.col(f"d{v}"), c * F.col(f"mad{v}"))
        d = d.withColumn(f"t{v}", F.when(F.abs(u) < 1, F.col(f"d{v}") * (1 - u * u) * (1 - u * u)).when(u.isNotNull(), 0.0))
    sums = d.groupBy(*keys).agg(F.sum(F.col("tx") * F.col("ty")).alias("xy"), F.sum(F.col("tx") ** 2).alias("xx"), F.sum(F.col("ty") ** 2).alias("yy"))
    return sums.select(*keys, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("bicor"))


def biweight_location(rows: DataFrame, keys: list[str], x: str, c: float = 6.0) -> DataFrame:
    """(keys, location); the median where the median absolute deviation is 0."""
    d = rows.select(*keys, F.col(x).cast("double").alias("x")).withColumn("m", _median(F.col("x"), keys))
    d = d.withColumn("mad", _median(F.abs(F.col("x") - F.col("m")), keys))
    u = F.try_divide(F.col("x") - F.col("m"), c * F.col("mad"))
    w = F.when(F.abs(u) < 1, (1 - u * u) ** 2).otherwise(0.0)
    s = d.groupBy(*keys).agg(F.first("m").alias("m"), F.sum(w).alias("w"), F.sum(w * (F.col("x") - F.col("m"))).alias("wx"))
    return s.select(*keys, (F.col("m") + F.coalesce(F.try_divide("wx", "w"), F.lit(0.0))).alias("location"))


def _deviations(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and, for each column, its deviation d from the group's median and the median absolute deviation mad."""
    d = rows.select(*keys, *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(names)])
    for i in range(len(names)):
        d = d.withColumn(f"d{i}", F.col(f"x{i}") - _median(F.col(f"x{i}"), keys))
        d = d.withColumn(f"mad{i}", _median(F.abs(f"d{i}"), keys))
    return d


def median_absolute_deviation(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, mad); missing values are left out."""
    return _deviations(rows, keys, [x]).groupBy(*keys).agg(F.max("mad0").alias("mad"))


def biweight_midcovariance(rows: DataFrame, keys: list[str], x: str, y: str, c: float = 9.0, modify_sample_size: bool = False) -> DataFrame:
    """(keys, midcovariance) of the pairs (x, y); 0 where a median absolute deviation is 0.

    modify_sample_size counts the pairs that both weights keep instead of all.
    """
    d = _deviations(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y])
    for i in (0, 1):
        u = F.try_divide(F.col(f"d{i}"), c * F.col(f"mad{i}"))
        u2 = u * u
        inside = u2 < 1
        d = d.withColumn(f"in{i}", F.coalesce(inside, F.lit(False))).withColumn(f"t{i}", F.when(inside, F.col(f"d{i}") * (1 - u2) ** 2).otherwise(0.0)).withColumn(f"w{i}", F.when(inside, (1 - u2) * (1 - 5 * u2)).otherwise(0.0))
    n = F.count_if(F.col("in0") & F.col("in1")) if modify_sample_size else F.count("*")
    s = d.groupBy(*keys).agg(n.alias("n"), F.sum(F.col("t0") * F.col("t1")).alias("xy"), F.sum("w0").alias("a"), F.sum("w1").alias("b"))
    return s.select(*keys, F.coalesce(F.try_divide(F.col("n") * F.col("xy"), F.col("a") * F.col("b")), F.lit(0.0)).alias("midcovariance"))


def biweight_midvariance(rows: DataFrame, keys: list[str], x: str, c: float = 9.0, modify_sample_size: bool = False) -> DataFrame:
    """(keys, midvariance)."""
    return biweight_midcovariance(rows, keys, x, x, c, modify_sample_size).withColumnRenamed("midcovariance", "midvariance")


def biweight_scale(rows: DataFrame, keys: list[str], x: str, c: float = 9.0, modify_sample_size: bool = False) -> DataFrame:
    """(keys, scale), the root of the midvariance."""
    return biweight_midvariance(rows, keys, x, c, modify_sample_size).select(*keys, F.sqrt("midvariance").alias("scale"))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank from 1, equal values with the mean of theirs."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho)."""
    r = rows.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return r.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"))
