"""Exact order statistics of many groups at once, by counting digits of the values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from cellsail.tables import written

#: Bits that a pass settles, and rows of a table that is broadcast.
DIGIT, SMALL = 16, 50_000
_LOW = np.int64((1 << 63) - 1)


@F.pandas_udf(LongType())
def _whole(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _LOW, bits))


@F.pandas_udf(DoubleType())
def _double(u: pd.Series) -> pd.Series:
    bits = u.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _LOW, bits).view(np.float64))


def _kept(rows: DataFrame, small: bool) -> DataFrame:
    """rows, worked out: SMALL rows or fewer go through the driver, others to a table."""
    return rows.sparkSession.createDataFrame(rows.toArrow()) if small else written(rows, "order-places")


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], small: bool, *more: Column) -> DataFrame:
    """rows with what other has for their keys, null keys too."""
    other = other.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + list(more)
    return rows.join(F.broadcast(other) if small else other, on).drop(*[f"{k}_" for k in keys])


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: Callable[[Column], list[Column]], weight: str | None = None) -> DataFrame:
    """(keys, n, stats): for each group the values at places(n), counted from 0 in ascending order of its n values; null beyond them.

    weight is a column of whole numbers, how often a row counts: a group's values that
    are not stored are one row. Null and NaN values are left out. Values become
    whole numbers of the same order; four passes settle 16 bits of each place wanted,
    by counts of the rows that share what is settled. So no group is sorted or held anywhere.
    """
    names = [f"k{i}" for i in range(len(keys))]
    x = F.col(value).cast("double")
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], x.alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).filter("x IS NOT NULL AND NOT isnan(x) AND w > 0")
    own = written(own.select(*names, _whole("x").alias("u"), "w"), "order")
    totals = own.groupBy(*names).agg(F.sum("w").alias("n"))
    many = len(places(F.lit(1)))
    small = totals.limit(SMALL // max(many, 1) + 1).count() <= SMALL // max(many, 1)
    totals = _kept(totals, small)
    state = totals.select(*names, "n", F.posexplode(F.array(*[p.cast("long") for p in places(F.col("n"))])).alias("t", "left"))
    state = state.filter("left >= 0 AND left < n").withColumn("settled", F.lit(0).cast("long"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        upper = F.shiftright("u", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("long")
        wanted = state.select(*names, "settled").distinct()
        counts = _joined(own.withColumn("upper", upper), wanted, names, small, F.col("upper") == F.col("settled")).groupBy(*names, "settled", F.shiftright("u", shift).alias("next")).agg(F.sum("w").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*names, "t").orderBy("next"))
        found = _joined(counts.withColumnRenamed("settled", "settled2"), state, names, small, F.col("settled") == F.col("settled2")).withColumn("upto", upto)
        found = found.filter("left >= upto - c AND left < upto")
        state = _kept(found.select(*names, "n", "t", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("next").alias("settled")), small)
    stats = state.select(*names, "t", _double("settled").alias("v")).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    out = totals.withColumnsRenamed({n: f"{n}_" for n in names}).join(stats, [F.col(f"{n}_").eqNullSafe(F.col(n)) for n in names], "left")
    return out.select(*[F.col(f"{n}_").alias(k) for n, k in zip(names, keys)], "n", F.array(*[F.try_element_at("m", F.lit(t)) for t in range(many)]).alias("stats"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """(keys, n, q): for each group the quantiles at these shares, with linear interpolation between values."""

    def places(n: Column) -> list[Column]:
        return [f(F.lit(float(s)) * (n - 1)) for s in shares for f in (F.floor, F.ceil)]

    found = order_statistics(rows, keys, value, places, weight)

    def between(i: int) -> Column:
        low, high, at = F.col("stats")[2 * i], F.col("stats")[2 * i + 1], F.lit(float(shares[i])) * (F.col("n") - 1)
        return F.when(at == F.floor(at), low).otherwise(low + (high - low) * (at - F.floor(at)))

    return found.select(*keys, "n", F.array(*[between(i) for i in range(len(shares))]).alias("q"))


def with_zeros(rows: DataFrame, keys: list[str], value: str, sizes: DataFrame) -> DataFrame:
    """(keys, value, weight): rows, and for each group of sizes (keys, size) one row of 0 that stands for what it lacks to its size."""
    stored = rows.groupBy(*keys).agg(F.count("*").alias("stored"))
    short = sizes.join(stored, keys, "left").select(*keys, F.lit(0.0).alias(value), (F.col("size") - F.coalesce("stored", F.lit(0))).alias("weight"))
    return rows.select(*keys, value, F.lit(1).cast("long").alias("weight")).unionByName(short.withColumn("weight", F.col("weight").cast("long")).filter("weight > 0"))
