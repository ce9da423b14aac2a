"""Transforms of values, cells and genes."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.operators.scoring import gene_moments


def log_scale(frame: ExpressionFrame, base: float | None = 2) -> ExpressionFrame:
    """log(1 + value) to base 2, 10 or, for None, e; null where the value is -1 or less."""
    v = F.when(F.col("value") > -1, F.col("value") + 1)
    if base in (2, 10):
        return frame.with_values(F.log2(v) if base == 2 else F.log10(v))
    return frame.with_values(F.log1p(v - 1) if base in (None, math.e) else F.log(v) / math.log(base))


def binarize(frame: ExpressionFrame, threshold: float = 1, strict: bool = False) -> ExpressionFrame:
    """1 where value >= threshold (> if strict), else 0; missing is 0. Zeros that turn 1 become rows."""
    if (0 > threshold) if strict else (0 >= threshold):
        frame = frame.dense()
    hit = F.col("value") > threshold if strict else F.col("value") >= threshold
    return frame.with_values(F.coalesce(hit, F.lit(False)).cast("double"))


def _cell_sums(frame: ExpressionFrame):
    sums = frame.expr.groupBy("cell").agg(F.sum("value").alias("s"))
    guarded = F.when(F.coalesce("s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("s")).alias("s")
    return frame.cells.join(sums, "cell", "left").select("cell", guarded)


def normalize_cells(frame: ExpressionFrame, method: str = "cpm") -> ExpressionFrame:
    """Divide by the cell's sum (0 counts as 1), times 1e6 (cpm), 1e4 (cp10k) or the median of these sums."""
    scale = {"cpm": 1e6, "cp10k": 1e4}
    total = F.sum("value").over(Window.partitionBy("cell"))
    share = F.col("value") / F.when(total == 0, 1.0).otherwise(total)
    if method in scale:
        return frame.with_values(share * scale[method])
    if method != "median":
        raise ValueError(f"unknown method {method!r}")
    factor = _cell_sums(frame).agg(F.median("s").alias("factor"))
    return frame.with_expr(frame.expr.withColumn("value", share).crossJoin(F.broadcast(factor)).select("cell", "gene", (F.col("value") * F.col("factor")).alias("value")))


def normalize_groups(frame: ExpressionFrame, group: str, method: str = "cpm", compat: bool = False) -> ExpressionFrame:
    """Divide by the group's total, times 1e6 or the least median of cell sums of a group; compat cuts totals to integers."""
    if method not in ("cpm", "median"):
        raise ValueError(f"unknown method {method!r}")
    labels = frame.cells.select("cell", F.col(group).alias("_group"))
    sums = _cell_sums(frame).join(labels, "cell")
    raw = frame.expr.join(labels, "cell").groupBy("_group").agg(F.sum("value").alias("total"))
    if compat:
        raw = raw.withColumn("total", F.floor("total").cast("double"))
    factor = sums.groupBy("_group").agg(F.median("s").alias("m")).agg(F.min("m").alias("factor")) if method == "median" else frame.cells.sparkSession.range(1).select(F.lit(1e6).alias("factor"))
    out = frame.expr.join(labels, "cell").join(raw, "_group").crossJoin(F.broadcast(factor))
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return frame.with_expr(out.select("cell", "gene", (F.col("value") / total * F.col("factor")).alias("value")))


def standardize(frame: ExpressionFrame, lower: float | None = None, upper: float | None = None) -> ExpressionFrame:
    """z-scores of each gene over all cells, then clipped. A constant gene, or one with a missing value, is 0."""
    m = gene_moments(frame).select("gene", "mean", F.sqrt("variance").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    z = F.greatest(z, F.lit(float(lower))) if lower is not None else z
    z = F.least(z, F.lit(float(upper))) if upper is not None else z
    return frame.with_expr(frame.dense().expr.join(m, "gene").select("cell", "gene", z.alias("value")))
