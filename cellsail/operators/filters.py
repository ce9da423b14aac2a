"""Quality metrics of cells and genes, and filters by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame

METRICS = {"total_counts": lambda: F.coalesce(F.sum("value"), F.lit(0.0)), "detection": lambda: F.count_if(F.col("value") != 0)}


def metric(frame: ExpressionFrame, side: str, name: str) -> DataFrame:
    """(side, metric) of every cell or gene, those without a value too; missing values count nothing."""
    side_table = frame.cells if side == "cell" else frame.genes
    found = frame.expr.groupBy(side).agg(METRICS[name]().alias("metric"))
    zero = F.lit(0.0) if name == "total_counts" else F.lit(0)
    return side_table.select(side).join(found, side, "left").withColumn("metric", F.coalesce("metric", zero))


def _between(x: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return ok


def filter_side(frame: ExpressionFrame, side: str, name: str, low: float | None = None, high: float | None = None) -> ExpressionFrame:
    """Cells or genes whose metric lies within the bounds, both inclusive; without bounds, all."""
    if low is None and high is None:
        return frame
    keep = metric(frame, side, name).filter(_between(F.col("metric"), low, high))
    return frame.keep_cells(keep) if side == "cell" else frame.keep_genes(keep)


def zap(frame: ExpressionFrame, low: float | None = None, high: float | None = None, strict: bool = False) -> ExpressionFrame:
    """Set values outside the bounds to 0. An upper bound alone sets those below it to 0, unless strict."""
    if low is None and high is None:
        return frame
    v = F.col("value")
    if low is None and not strict:
        out = v < high
    else:
        out = ~_between(v, low, high)
    return frame.with_values(F.when(out, 0.0).otherwise(v))
