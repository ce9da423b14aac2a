"""Summaries of clusters of cells, and over- and under-expression of genes in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.quantiles import quantiles
from cellsail.tables import written

AGGREGATES = ("mean", "median", "min", "max", "fraction")


def summarize(frame: ExpressionFrame, cluster: str, how: str = "mean", max_genes: int | None = None) -> DataFrame:
    """(cluster, gene, value) of all genes, or of the first max_genes by name; null where a value is missing.

    Sums run over stored values, and the cells of a cluster that lack a gene enter as
    so many zeros, in the median by an exact selection.
    """
    if how not in AGGREGATES:
        raise ValueError(f"unknown summary {how!r}")
    sub = frame if max_genes is None else frame.keep_genes(frame.genes.orderBy("gene").limit(max_genes))
    of = frame.cells.select("cell", F.col(cluster).alias("cluster"))
    rows = sub.expr.join(of, "cell").select("cluster", "gene", "value")
    sizes = of.groupBy("cluster").agg(F.count("*").alias("size")).crossJoin(sub.genes.select("gene"))
    v = F.col("value")
    seen = rows.groupBy("cluster", "gene").agg(F.count("*").alias("stored"), F.count_if(v.isNull()).alias("missing"), F.sum("value").alias("s"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(v > 0).alias("on"))
    grid = _beside(sizes, seen).fillna(0, ["stored", "missing", "on"])
    zero = F.when(F.col("stored") < F.col("size"), F.lit(0.0))
    value = {"mean": F.coalesce("s", F.lit(0.0)) / F.col("size"), "min": F.least("min", zero), "max": F.greatest("max", zero), "fraction": F.col("on") / F.col("size")}
    if how == "median":
        # zeros of whole clusters beside the stored ones: with null clusters too
        short = grid.select("cluster", "gene", F.lit(0.0).alias("value"), (F.col("size") - F.col("stored")).alias("weight")).filter("weight > 0")
        weighted = rows.withColumn("weight", F.lit(1).cast("long")).unionByName(short)
        middle = quantiles(weighted, ["cluster", "gene"], "value", [0.5], "weight").select("cluster", "gene", F.col("q")[0].alias("middle"))
        grid, value["median"] = _beside(grid, middle), F.col("middle")
    return grid.select("cluster", "gene", F.when(F.col("missing") == 0, value[how]).alias("value"))


def _beside(grid: DataFrame, found: DataFrame) -> DataFrame:
    """grid(cluster, gene, ...) with what is found for its rows; a null cluster is one like others."""
    other = found.withColumnsRenamed({"cluster": "cluster_", "gene": "gene_"})
    return grid.join(other, F.col("cluster").eqNullSafe(F.col("cluster_")) & (F.col("gene") == F.col("gene_")), "left").drop("cluster_", "gene_")


def normalize_summary(summary: DataFrame, log: bool = True, z_score: bool = True, clip: float = 3.0) -> DataFrame:
    """log1p, z-scores over clusters clipped at clip, then scaled to 0..1 over the whole table."""
    w, everyone = Window.partitionBy("gene"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = summary.withColumn("value", F.log1p("value")) if log else summary
    if z_score:
        z = (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-10)
        out = out.withColumn("value", F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))
    low, high = F.min("value").over(everyone), F.max("value").over(everyone)
    return out.withColumn("value", (F.col("value") - low) / (high - low + 1e-12))


def contingency(summary: DataFrame, genes: list) -> DataFrame:
    """One row a cluster, one column a gene."""
    return summary.groupBy("cluster").pivot("gene", genes).agg(F.first("value"))


def expression_counts(frame: ExpressionFrame, cluster: str) -> DataFrame:
    """(cluster, gene, k, in_cluster, expressing, total): cells of the cluster that express the gene, and the margins."""
    labels = frame.cells.select("cell", F.col(cluster).alias("cluster"))
    on = frame.expr.filter("value > 0").join(labels, "cell")
    k = on.groupBy("cluster", "gene").agg(F.count("*").alias("k"))
    size = labels.groupBy("cluster").agg(F.count("*").alias("in_cluster"))
    n = on.groupBy("gene").agg(F.count("*").alias("expressing"))
    grid = size.crossJoin(frame.genes.select("gene")).crossJoin(F.broadcast(labels.agg(F.count("*").alias("total"))))
    return grid.join(n, "gene", "left").join(k, ["cluster", "gene"], "left").fillna({"k": 0, "expressing": 0}).select("cluster", "gene", "k", "in_cluster", "expressing", "total")


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.float64)))])


def _tails(upper: bool):
    """P(X <= k), or P(X >= k), of rows of hypergeometric parameters."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, drawn: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
        k, drawn, good, total = (x.to_numpy(np.int64) for x in (k, drawn, good, total))
        least, most = np.maximum(0, drawn + good - total), np.minimum(drawn, good)
        low, high = (np.maximum(k, least), most) if upper else (least, np.minimum(k, most))
        out, fact = np.zeros(len(k)), _log_factorials(int(total.max()) if len(total) else 0)
        n = np.maximum(high - low + 1, 0)
        # rows in turns of a bounded number of terms
        turn = np.cumsum(n) // 2_000_000
        for t in np.unique(turn):
            rows = np.flatnonzero((turn == t) & (n > 0))
            row = np.repeat(rows, n[rows])
            x = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            d, g, m = drawn[row], good[row], total[row]
            logs = fact[g] - fact[x] - fact[g - x] + fact[m - g] - fact[d - x] - fact[m - g - d + x] - fact[m] + fact[d] + fact[m - d]
            out += np.bincount(row, weights=np.exp(logs), minlength=len(out))
        return pd.Series(np.minimum(out, 1.0))

    return tail


def enrichment(frame: ExpressionFrame, cluster: str) -> DataFrame:
    """(cluster, gene, fraction, low, high, either): hypergeometric P(X <= k), P(X >= k) and the smaller."""
    c = expression_counts(frame, cluster)
    args: list[Column] = [F.col(x) for x in ("k", "in_cluster", "expressing", "total")]
    c = c.withColumn("low", _tails(False)(*args)).withColumn("high", _tails(True)(*args))
    return c.select("cluster", "gene", (F.col("k") / F.col("in_cluster")).alias("fraction"), "low", "high", F.least("low", "high").alias("either"))


def top_overall(scores: DataFrame, n: int, by: str = "either") -> DataFrame:
    """(gene, p): the n genes of smallest p in any cluster, each once."""
    w = Window.partitionBy("cluster").orderBy(F.round(by, 12), "gene")
    best = scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return best.groupBy("gene").agg(F.min(by).alias("p")).orderBy(F.round("p", 12), "gene").limit(n)


def top_per_cluster(scores: DataFrame, n: int, by: str = "either") -> DataFrame:
    """(cluster, gene, p): for each cluster in order, the n smallest p of genes that no earlier cluster took.

    In rounds: each cluster offers for its n best genes that were not refused to it, and
    a gene refuses all but the first cluster that offers. What nobody is refused any more
    is what the clusters take one after the other. A cluster's n * clusters best genes are
    all that it can need.
    """
    order = scores.select("cluster").distinct()
    order = order.select(F.col("cluster").alias("of"), F.row_number().over(Window.orderBy("cluster")).alias("number"))  # one row a cluster
    best = Window.partitionBy("number").orderBy(F.round("p", 12), "gene")
    rows = scores.select("cluster", "gene", F.col(by).alias("p")).join(F.broadcast(order), F.col("cluster").eqNullSafe(F.col("of"))).drop("of")
    rows = written(rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n * order.count()), "best-genes")
    refused = None
    while True:
        left = rows if refused is None else rows.join(refused, ["number", "gene"], "left_anti")
        offers = left.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
        offers = written(offers.withColumn("first", F.min("number").over(Window.partitionBy("gene"))), "offers")
        new = offers.filter("number > first").select("number", "gene")
        if new.isEmpty():
            return offers.select("cluster", "gene", "p")
        refused = new if refused is None else refused.unionByName(new)


def impute_means(summary: DataFrame) -> DataFrame:
    """Missing values of (cluster, gene, value) as the mean of the gene's others, 0 if it has none."""
    mean = F.avg("value").over(Window.partitionBy("gene"))
    return summary.withColumn("value", F.coalesce("value", mean, F.lit(0.0)))


def with_margins(rows: DataFrame, row: str, column: str, value: str = "value") -> DataFrame:
    """(row, column, value) with a sum for each row, for each column and for all; the margin's name is null."""
    return rows.cube(row, column).agg(F.sum(value).alias(value), F.grouping_id().alias("margin"))


def select_classes(frame: ExpressionFrame, column: str, classes: list) -> ExpressionFrame:
    """Cells of any of the classes."""
    return frame.keep_cells(frame.cells.filter(F.col(column).isin(list(classes))))


def flag_selection(cells: DataFrame, chosen: DataFrame, name: str = "selected") -> DataFrame:
    """cells with a column that says which are among the chosen."""
    own = chosen.select("cell").distinct().withColumn("flag", F.lit(True))
    return cells.join(own, "cell", "left").withColumn(name, F.coalesce("flag", F.lit(False))).drop("flag")


def scores_of(scores: DataFrame, genes: DataFrame) -> DataFrame:
    """Enrichment of genes given by id, as text."""
    ids = genes.select(F.col("gene").cast("string").alias("id")).distinct()
    return scores.join(ids, scores["gene"].cast("string") == ids["id"], "left_semi")


def shared_genes(*lists: DataFrame) -> DataFrame:
    """(gene) as text: those that are in all lists."""
    found = None
    for rows in lists:
        own = rows.select(F.col("gene").cast("string").alias("gene"))
        found = own if found is None else found.intersect(own)
    return found.distinct()


def result_table(frame: ExpressionFrame, cluster: str, genes: list, how: str = "mean") -> DataFrame:
    """One row a cluster, one column for each of the genes, in their order."""
    sub = frame.keep_genes(frame.genes.filter(F.col("gene").isin(list(genes))))
    return contingency(summarize(sub, cluster, how, max(len(genes), 1)), list(genes))
