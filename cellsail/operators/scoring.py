"""Scores of genes and of cells."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.quantiles import order_statistics, with_zeros
from cellsail.tables import written


def gene_moments(frame: ExpressionFrame, skip_missing: bool = False) -> DataFrame:
    """(gene, n, mean, variance, has_missing): population moments over all cells, absent rows as 0.

    The variance is taken around the mean, in a second pass. skip_missing leaves
    missing values out; else a gene with one has null moments.
    """
    n = F.broadcast(frame.n_cells())
    first = frame.expr.groupBy("gene").agg(F.sum("value").alias("s"), F.count("value").alias("known"), F.count_if(F.col("value").isNull()).alias("missing"))
    first = frame.genes.select("gene").join(first, "gene", "left").crossJoin(n).fillna({"s": 0.0, "known": 0, "missing": 0})
    used = F.col("n_cells") - F.col("missing")
    first = first.withColumn("mean", F.try_divide("s", used))
    spread = frame.expr.filter("value IS NOT NULL").join(first.select("gene", "mean"), "gene").groupBy("gene").agg(F.sum(F.pow(F.col("value") - F.col("mean"), 2)).alias("q"))
    out = first.join(spread, "gene", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    variance = F.try_divide(F.col("q") + (used - F.col("known")) * F.col("mean") * F.col("mean"), used)
    ok = F.lit(True) if skip_missing else F.col("missing") == 0
    return out.select("gene", used.alias("n"), F.when(ok, F.col("mean")).alias("mean"), F.when(ok, variance).alias("variance"), (F.col("missing") > 0).alias("has_missing"))


def score_genes(frame: ExpressionFrame) -> DataFrame:
    """(gene, mean, variance, dispersion, cv); a mean of 0 counts as 1 in the ratios."""
    guarded = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    m = gene_moments(frame)
    return m.select("gene", "mean", "variance", (F.col("variance") / guarded).alias("dispersion"), (F.sqrt("variance") / guarded).alias("cv"))


def top_genes(scores: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n best; null is last, equal scores come in reverse order of genes."""
    return scores.orderBy(F.col(by).desc_nulls_last(), F.col("gene").desc()).limit(n)


def information_gain(frame: ExpressionFrame, label: str, bins: int = 4) -> DataFrame:
    """(gene, info_gain): entropy of the label less its entropy within bins of equal counts of the gene.

    A value's bin is the share of smaller ones among the other cells, times bins, floored, so the single largest has one of its own;
    missing values are 0. Bins end at exact order statistics, in which what is not
    stored enters as one row of zeros; no gene's values meet in one task.
    """
    labels = frame.cells.select("cell", F.col(label).alias("_y"))
    x = frame.fill_missing().expr.select("cell", "gene", "value")
    sizes = frame.genes.select("gene").crossJoin(F.broadcast(frame.n_cells().withColumnRenamed("n_cells", "size")))
    # a value is in bin b or above if b * (n - 1) / bins others are smaller: it is above the last of these
    edges = order_statistics(with_zeros(x, ["gene"], "value", sizes), ["gene"], "value", lambda n: [F.ceil(F.lit(b) * (n - 1) / F.lit(bins)) - 1 for b in range(1, bins + 1)], "weight")
    edges = edges.select("gene", F.array_compact("stats").alias("edges"))

    def bin_of(v: Column) -> Column:
        return F.size(F.filter("edges", lambda e: v > e)).alias("bin")

    stored = x.join(labels, "cell").join(edges, "gene").groupBy("gene", bin_of(F.col("value")), "_y").agg(F.count("*").alias("n"))
    all_y = labels.groupBy("_y").agg(F.count("*").alias("size"))
    known = stored.groupBy("gene", F.col("_y").alias("_y2")).agg(F.sum("n").alias("stored"))
    grid = edges.crossJoin(F.broadcast(all_y)).join(known.withColumnRenamed("gene", "gene2"), (F.col("gene") == F.col("gene2")) & F.col("_y").eqNullSafe(F.col("_y2")), "left")
    zeros = grid.select("gene", bin_of(F.lit(0.0)), "_y", (F.col("size") - F.coalesce("stored", F.lit(0))).alias("n")).filter("n > 0")
    counts = stored.unionByName(zeros).groupBy("gene", "bin", "_y").agg(F.sum("n").alias("n"))
    n_bin = F.sum("n").over(Window.partitionBy("gene", "bin"))
    n_y = F.sum("n").over(Window.partitionBy("gene", "_y"))
    n = F.sum("n").over(Window.partitionBy("gene"))
    gain = F.col("n") / n * F.log2(F.col("n") * n / (n_bin * n_y))
    return counts.withColumn("g", gain).groupBy("gene").agg(F.sum("g").alias("info_gain"))


def score_cells(frame: ExpressionFrame, markers: DataFrame, method: str = "mean") -> DataFrame:
    """(cell, score) over the marker genes that the data has: mean, normalized, median, max or fraction.

    normalized divides each gene by its population deviation first. Missing values
    are left out, but count as not expressed in the fraction; a cell with none known has a null score.
    Without any matching marker every score is 1. Values that are not stored enter as so many zeros.
    """
    sub = frame.keep_genes(markers)
    k = F.broadcast(sub.genes.agg(F.count("*").alias("k")))
    d = sub.expr
    if method == "normalized":
        sd = F.sqrt("variance")
        scale = gene_moments(sub, skip_missing=True).select("gene", F.when(sd > 0, sd).otherwise(1.0).alias("scale"))
        d = d.join(scale, "gene").select("cell", "gene", (F.col("value") / F.col("scale")).alias("value"))
    seen = d.groupBy("cell").agg(F.count("*").alias("stored"), F.count_if(F.col("value").isNull()).alias("missing"), F.sum("value").alias("s"), F.max("value").alias("most"), F.count_if(F.col("value") > 0).alias("on"))
    rows = frame.cells.select("cell").join(seen, "cell", "left").crossJoin(k).fillna(0, ["stored", "missing", "on"])
    known = F.col("k") - F.col("missing")
    if method in ("mean", "normalized"):
        score = F.try_divide(F.coalesce("s", F.lit(0.0)), known)
    elif method == "max":
        score = F.when(F.col("stored") < F.col("k"), F.greatest("most", F.lit(0.0))).otherwise(F.col("most"))
    elif method == "fraction":
        score = F.try_divide(F.col("on"), F.col("k"))
    elif method == "median":
        sizes = frame.cells.select("cell").crossJoin(k).withColumnRenamed("k", "size")
        middle = with_zeros(d, ["cell"], "value", sizes).groupBy("cell").agg(F.percentile("value", F.lit(0.5), F.col("weight")).alias("middle"))
        rows, score = rows.join(middle, "cell", "left"), F.col("middle")
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.select("cell", F.when(F.col("k") == 0, 1.0).otherwise(score).alias("score"))


def regression_scores(frame: ExpressionFrame, target: str) -> DataFrame:
    """(gene, f, r2): F statistic of a linear fit of the cells' target on each gene, and the share of variance it explains.

    From sums over stored values around the means. A gene or target without
    variance has r2 0; a perfect fit has a null f. Cells without a target take no part.
    """
    from cellsail.operators.batch import _correlations

    z = frame.cells.select("cell", F.lit(0).alias("level"), F.col(target).cast("double").alias("z"))
    n = F.broadcast(z.filter("z IS NOT NULL").agg(F.count("*").alias("n")))
    r = frame.genes.select("gene").join(_correlations(frame, z), "gene", "left").crossJoin(n)
    r2 = F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))
    return r.select("gene", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f"), r2.alias("r2"))


def score_table(genes: DataFrame, scores: dict[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """One row a gene with the scores of all scorers; a gene that one does not know has null there.

    Each has (gene, score...). One column takes the scorer's name, several name_1 and
    on. A scorer given as a function is worked out by itself: if it fails, its scores are
    missing, under its name, and a warning says why. Infinite scores become the largest double.
    """
    out = genes
    for name, found in scores.items():
        if callable(found):
            try:
                found = written(found(), "scores")
            except Exception as e:  # whatever a scorer raises
                warnings.warn(f"{name}: {e}", stacklevel=2)
                out = out.withColumn(name, F.lit(None).cast("double"))
                continue
        own = [c for c in found.columns if c != "gene"]
        new = [name] if len(own) == 1 else [f"{name}_{i + 1}" for i in range(len(own))]
        most = float(sys.float_info.max)
        held = [F.greatest(F.least(F.col(c).cast("double"), F.lit(most)), F.lit(-most)).alias(x) if dict(found.dtypes)[c] in ("double", "float") else F.col(c).alias(x) for c, x in zip(own, new)]
        out = out.join(found.select("gene", *held), "gene", "left")
    return out


class OrganismMismatch(ValueError):
    """Markers and data are of different organisms."""


def check_organism(data_taxid, marker_taxid) -> None:
    """An id that is not known is no mismatch."""
    if data_taxid not in (None, "") and marker_taxid not in (None, "") and str(data_taxid) != str(marker_taxid):
        raise OrganismMismatch(f"organism {data_taxid} of the data, {marker_taxid} of the markers")


def match_markers(genes: DataFrame, markers: DataFrame, gene_id: str = "gene", marker_id: str = "gene") -> DataFrame:
    """(gene) of the genes whose id is, as text, among the markers'; unknown ids (null, empty or ?) match nothing."""
    known = lambda c: F.col(c).isNotNull() & ~F.trim(F.col(c).cast("string")).isin("", "?")
    ids = markers.filter(known(marker_id)).select(F.col(marker_id).cast("string").alias("marker")).distinct()
    own = genes.filter(known(gene_id))
    return own.join(ids, own[gene_id].cast("string") == ids["marker"], "left_semi").select("gene")
