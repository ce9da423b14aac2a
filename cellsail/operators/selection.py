"""Selection of variable genes and of genes with more dropout than their expression explains."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.operators.scoring import gene_moments


def variable_genes(frame: ExpressionFrame, method: str = "dispersion", n_genes: int = 1000, n_groups: int | None = 20) -> DataFrame:
    """(gene, bin, z) of the n_genes of highest z-score within bins of equal width of the mean's percentile rank.

    One row a gene: the windows below see as many rows as there are genes. Equal
    scores at the cut go to the gene first by name.
    """
    m = gene_moments(frame, skip_missing=True)
    score = {"dispersion": F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide("variance", "mean")), "variance": F.col("variance"), "mean": F.col("mean")}[method]
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.rank().over(Window.orderBy("mean")) - 1
    same = F.count("*").over(Window.partitionBy("mean"))
    g = F.count("*").over(everyone)
    p = m.withColumn("score", score).withColumn("p", (left + left + same + 1) * 50.0 / g).withColumn("g", g)
    low, high = F.min("p").over(everyone), F.max("p").over(everyone)
    p = p.withColumn("low", F.when(low == high, low - 0.5).otherwise(low)).withColumn("high", F.when(low == high, high + 0.5).otherwise(high))
    k = F.least(F.lit(max(1, n_groups or 1)), F.col("g")).cast("int")
    # an edge below p for each i < k, and the last edge, which is exactly high
    below = F.size(F.filter(F.sequence(F.lit(0), k - 1), lambda i: F.col("low") + i * ((F.col("high") - F.col("low")) / k) < F.col("p")))
    p = p.withColumn("bin", F.greatest(F.lit(1), below + (F.col("high") < F.col("p")).cast("int")))
    w = Window.partitionBy("bin")
    sd = F.stddev_pop("score").over(w)
    p = p.withColumn("z", F.coalesce(F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd), F.lit(0.0)))
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.round("z", 9).desc(), "gene"))).filter(F.col("place") <= n_genes).select("gene", "bin", "z")


def dropout_statistics(frame: ExpressionFrame, threshold: float = 0, at_least: int = 0) -> DataFrame:
    """(gene, zero_rate, mean_expr): share of cells not above threshold, and mean log2 over the share above.

    Values that are not positive count as themselves in the mean. Genes with fewer
    than at_least cells above the threshold have null statistics.
    """
    v = F.col("value")
    found = frame.expr.groupBy("gene").agg(F.count_if(v > threshold).alias("hits"), F.sum(F.when(v > 0, F.log2(F.when(v > 0, v))).otherwise(v)).alias("s"), F.count_if(v.isNull()).alias("missing"))
    found = frame.genes.select("gene").join(found, "gene", "left").fillna({"hits": 0, "s": 0.0, "missing": 0}).crossJoin(F.broadcast(frame.n_cells()))
    det = F.col("hits") / F.col("n_cells")
    mean = F.try_divide(F.try_divide(F.col("s"), F.col("n_cells") - F.col("missing")), det)
    enough = F.col("hits") >= at_least
    return found.select("gene", F.when(enough, 1 - det).alias("zero_rate"), F.when(enough, mean).alias("mean_expr"))


def dropout_by_curve(stats: DataFrame, decay: float = 1.0, x_offset: float = 5.0, y_offset: float = 0.02) -> DataFrame:
    """Genes above the curve exp(-decay * (mean - x_offset)) + y_offset."""
    return stats.filter(F.col("zero_rate") > F.exp(-decay * (F.col("mean_expr") - x_offset)) + y_offset)


def dropout_top(stats: DataFrame, n_genes: int, decay: float = 1.0, y_offset: float = 0.02) -> DataFrame:
    """Genes that the curve selects when it is moved so that n_genes are above it.

    Without decay the curve is a level of 1 + y_offset wherever it is, which no share exceeds.
    A gene is above the curve at offset b if its key is more than b, so no search is
    needed: the n_genes of largest key among those above 0, and all from 10 on.
    """
    if decay == 0:
        return stats.withColumn("key", F.lit(0.0)).filter(F.col("zero_rate") > 1 + y_offset)
    over = F.col("zero_rate") - y_offset
    key = F.col("mean_expr") + F.log(F.when(over > 0, over)) / decay
    keyed = stats.withColumn("key", key).filter("key > 0")
    place = F.row_number().over(Window.orderBy(F.col("key").desc(), "gene"))
    return keyed.withColumn("place", place).filter((F.col("place") <= n_genes) | (F.col("key") >= 10)).drop("place")


def curve_points(decay: float = 1.0, x_offset: float = 5.0, y_offset: float = 0.02, x_max: float = 20.0, n: int = 200) -> list[tuple[float, float]]:
    """(mean, zero rate) along the curve, from 0 to x_max, where it is at most 1."""
    xs = (x_max * i / (n - 1) for i in range(n))
    return [(x, y) for x in xs if (y := math.exp(-decay * (x - x_offset)) + y_offset) <= 1]


def dropout_genes(frame: ExpressionFrame, n_genes: int, decay: float = 1.0, y_offset: float = 0.02, threshold: float = 0, at_least: int = 0) -> DataFrame:
    out = dropout_top(dropout_statistics(frame, threshold, at_least), n_genes, decay, y_offset)
    if out.limit(n_genes).count() < n_genes:
        warnings.warn(f"fewer than {n_genes} genes lie above a curve", stacklevel=2)
    return out
