"""Alignment of data sets over canonical components: genes of components, projection on them, common ranges, shared correlation.

Sets are ordered by size, the largest first: it is the reference that others are
moved to. Places are (cell, component, value); what a cell does not store of a gene is 0 and
enters all sums, ranks and medians in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.functions.quantiles import quantiles, with_zeros
from cellsail.operators.alignment import Components, canonical_components
from cellsail.tables import written

SCORINGS = ("pearson", "spearman", "bicor")
#: Biweight: deviations from so many median absolute deviations on have no weight.
REACH = 9.0


def _by_gene(frame: ExpressionFrame, value: Column, places: DataFrame) -> DataFrame:
    """(gene, component, s): sums of value of stored pairs times places, in one pass over what is stored for all components."""
    k = places.agg(F.max("component")).first()[0]
    if k is None:
        return frame.genes.select("gene", F.lit(0).alias("component"), F.lit(0.0).alias("s")).limit(0)
    own = places.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("component", "value"))).alias("m"))  # as many as components
    own = own.select("cell", *[F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0.0)).alias(f"w{j}") for j in range(k + 1)])
    sums = frame.expr.select("cell", "gene", value.alias("value")).join(own, "cell").groupBy("gene").agg(F.array(*[F.sum(F.col("value") * F.col(f"w{j}")) for j in range(k + 1)]).alias("s"))
    found = sums.select("gene", F.posexplode("s").alias("component", "s"))
    grid = frame.genes.select("gene").crossJoin(F.broadcast(places.select("component").distinct()))
    return grid.join(found, ["gene", "component"], "left").fillna(0.0, ["s"])


def _sizes(frame: ExpressionFrame) -> DataFrame:
    return frame.genes.select("gene").crossJoin(F.broadcast(frame.n_cells().withColumnRenamed("n_cells", "size")))


def _biweight(x: Column, middle: Column, spread: Column) -> Column:
    """Deviation times its weight; null without any spread."""
    u = F.try_divide(x - middle, REACH * spread)
    return F.when(F.abs(u) < 1, (x - middle) * (1 - u * u) * (1 - u * u)).when(u.isNotNull(), 0.0)


def _median_and_spread(rows: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, middle, spread): median and median absolute deviation, both exact."""
    middle = quantiles(rows, [key], value, [0.5], weight).select(key, F.col("q")[0].alias("middle"))
    away = rows.join(middle, key).withColumn("away", F.abs(F.col(value) - F.col("middle")))
    spread = quantiles(away, [key], "away", [0.5], weight).select(key, F.col("q")[0].alias("spread"))
    return middle.join(spread, key)


def _bicor(frame: ExpressionFrame, places: DataFrame) -> DataFrame:
    """(gene, component, score): biweight midcorrelation of each gene with each component; null where a spread is 0."""
    genes = _median_and_spread(with_zeros(frame.expr, ["gene"], "value", _sizes(frame)), "gene", "value", "weight")
    genes = written(genes.withColumn("zero", _biweight(F.lit(0.0), F.col("middle"), F.col("spread"))), "bicor-genes")
    of = _median_and_spread(places, "component", "value")
    w = places.join(F.broadcast(of), "component").select("cell", "component", _biweight(F.col("value"), F.col("middle"), F.col("spread")).alias("value"))
    w = written(w, "bicor-places")
    totals = w.groupBy("component").agg(F.sum("value").alias("sw"), F.sum(F.col("value") ** 2).alias("sww"))
    stored = frame.expr.join(genes, "gene").select("cell", "gene", _biweight(F.col("value"), F.col("middle"), F.col("spread")).alias("t"), "zero")
    own = stored.groupBy("gene").agg(F.count("*").alias("stored"), F.sum(F.col("t") ** 2).alias("tt"))
    own = _sizes(frame).join(genes, "gene").join(own, "gene", "left").fillna(0, ["stored"]).fillna(0.0, ["tt"])
    own = own.select("gene", "zero", (F.col("tt") + (F.col("size") - F.col("stored")) * F.col("zero") ** 2).alias("sxx"))
    # sums over stored pairs of what these have beyond a zero, and what all would have if they were zeros
    beyond = _by_gene(frame.with_expr(stored.select("cell", "gene", (F.col("t") - F.col("zero")).alias("value"))), F.col("value"), w.na.fill(0.0, ["value"]))
    rows = beyond.join(own, "gene").join(F.broadcast(totals), "component")
    return rows.select("gene", "component", F.try_divide(F.col("s") + F.col("zero") * F.col("sw"), F.sqrt(F.col("sxx") * F.col("sww"))).alias("score"))


def _ranked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with rank, from 1, equal values with the mean of theirs; by the counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    ranks = counts.select(F.col(key).alias("_k"), F.col(value).alias("_v"), (upto - (F.col("_c") - 1) / 2).alias("rank"))
    return rows.join(ranks, (F.col(key) == F.col("_k")) & (F.col(value) == F.col("_v"))).drop("_k", "_v")


def _spearman(frame: ExpressionFrame, places: DataFrame) -> DataFrame:
    """(gene, component, score): rank correlation of each gene with each component; null for a constant side."""
    x = frame.fill_missing().expr
    sizes = _sizes(frame)
    counts = with_zeros(x, ["gene"], "value", sizes).groupBy("gene", "value").agg(F.sum("weight").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("gene").orderBy("value"))
    ranks = written(counts.withColumn("rank", upto - (F.col("c") - 1) / 2).join(sizes, "gene"), "ranks")
    middle = (F.col("size") + 1) / 2
    spread = ranks.groupBy("gene").agg(F.sum(F.col("c") * (F.col("rank") - middle) ** 2).alias("sxx"))
    zero = ranks.filter("value = 0").select("gene", F.col("rank").alias("zero"))
    r = x.join(ranks.select("gene", "value", "rank"), ["gene", "value"]).join(zero, "gene", "left")
    beyond = r.select("cell", "gene", (F.col("rank") - F.coalesce("zero", F.lit(0.0))).alias("value"))
    w = _ranked(places, "component", "value").join(F.broadcast(places.groupBy("component").agg(F.count("*").alias("n"))), "component")
    w = written(w.select("cell", "component", (F.col("rank") - (F.col("n") + 1) / 2).alias("value")), "ranks")
    totals = w.groupBy("component").agg(F.sum(F.col("value") ** 2).alias("sww"))
    # places' ranks sum to 0, so the rank that zeros share adds nothing
    rows = _by_gene(frame.with_expr(beyond), F.col("value"), w).join(spread, "gene").join(F.broadcast(totals), "component")
    return rows.select("gene", "component", F.try_divide(F.col("s"), F.sqrt(F.col("sxx") * F.col("sww"))).alias("score"))


def gene_scores(frame: ExpressionFrame, places: DataFrame, method: str = "pearson") -> DataFrame:
    """(gene, component, score) of every gene and component. pearson is the product with the component over the gene's length. Null where there is none. Missing values are 0."""
    frame = frame.fill_missing()
    if method == "pearson":
        length = frame.expr.groupBy("gene").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("length"))
        return _by_gene(frame, F.col("value"), places).join(length, "gene", "left").select("gene", "component", F.try_divide("s", "length").alias("score"))
    if method == "spearman":
        return _spearman(frame, places)
    if method == "bicor":
        return _bicor(frame, places)
    raise ValueError(f"unknown scoring {method!r}")


def metagenes(scores: list[DataFrame], n: int = 30) -> DataFrame:
    """(component, gene, rank): the n genes that tell a component best in all sets, rank from 1.

    Genes without a score in some set come last, then those whose signs are not the
    same in all; of the others the weakest score counts; ties by gene.
    """
    first = scores[0].select("gene", "component", F.array("score").alias("scores"))
    for s in scores[1:]:
        first = first.join(s.withColumnRenamed("score", "_s"), ["gene", "component"]).select("gene", "component", F.array_append("scores", F.col("_s")).alias("scores"))
    missing = F.size(F.filter("scores", lambda x: x.isNull()))
    apart = ~F.forall("scores", lambda x: F.coalesce(F.signum(x) == F.signum(F.col("scores")[0]), F.lit(False)))
    weakest = F.array_min(F.transform("scores", lambda x: F.coalesce(F.abs(x), F.lit(0.0))))
    order = Window.partitionBy("component").orderBy("missing", "apart", F.col("weakest").desc(), "gene")
    ranked = first.select("gene", "component", missing.alias("missing"), apart.alias("apart"), weakest.alias("weakest")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("component", "gene", "rank")


def projected(frame: ExpressionFrame, places: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cell, component, value): each cell's product with the component's genes, each weighed by its own product with the component."""
    frame = frame.fill_missing()
    genes = F.broadcast(_by_gene(frame, F.col("value"), places).join(chosen.select("component", "gene"), ["component", "gene"]))  # components times genes of each
    found = frame.expr.join(genes, "gene").groupBy("cell", "component").agg(F.sum(F.col("value") * F.col("s")).alias("value"))
    grid = frame.cells.select("cell").crossJoin(F.broadcast(chosen.select("component").distinct()))
    return grid.join(found, ["cell", "component"], "left").fillna(0.0, ["value"])


def reference_range(places: DataFrame, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """places with each component's low and high percentiles at 0 and 1; 0 for one without any spread."""
    q = quantiles(places, ["component"], "value", [low / 100, high / 100])
    value = F.coalesce(F.try_divide(F.col("value") - F.col("q")[0], F.col("q")[1] - F.col("q")[0]), F.lit(0.0))
    return places.join(F.broadcast(q), "component").select("cell", "component", value.alias("value"))


def quantile_shift(reference: DataFrame, other: DataFrame) -> DataFrame:
    """other, each component moved up by the least difference, without sign, of its nine deciles from the reference's."""
    deciles = [z / 10 for z in range(1, 10)]
    a, b = (quantiles(x, ["component"], "value", deciles).select("component", F.col("q").alias(n)) for x, n in ((reference, "a"), (other, "b")))
    shift = a.join(b, "component").select("component", F.array_min(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("shift"))
    return other.join(F.broadcast(shift), "component").select("cell", "component", (F.col("value") + F.col("shift")).alias("value"))


def shared_correlation(frames: list[ExpressionFrame], places: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """(dataset, component, shared): mean biweight midcorrelation, without sign, of a component with its genes in each set; those that have none are left out."""
    out = []
    for i, (f, p) in enumerate(zip(frames, places)):
        found = gene_scores(f.keep_genes(chosen.select("gene").distinct()), p, "bicor").join(chosen, ["component", "gene"])
        out.append(found.groupBy("component").agg(F.avg(F.abs("score")).alias("shared")).select(F.lit(i).alias("dataset"), "component", "shared"))
    return reduce(DataFrame.unionByName, out)


class AlignmentError(ValueError):
    """The data sets cannot be aligned."""


def _sets(frame: ExpressionFrame, source: str) -> tuple[list, list[ExpressionFrame]]:
    """Sources by size, the largest first and equal ones in their order, and the cells of each."""
    counts = frame.cells.groupBy(source).agg(F.count("*").alias("n")).collect()
    if any(r[source] is None for r in counts):
        raise AlignmentError("cells without a source")
    if len(counts) < 2:
        raise AlignmentError("two sources at least")
    if min(r["n"] for r in counts) < 2:
        raise AlignmentError("a source with a single cell")
    order = [r[source] for r in sorted(counts, key=lambda r: (-r["n"], r[source]))]
    return order, [frame.keep_cells(frame.cells.filter(F.col(source) == F.lit(v))) for v in order]


@dataclass(frozen=True)
class AlignmentModel:
    """What a fit knows: sources by size, places of their cells, genes of components, and how well components agree."""

    source: str
    sources: list
    components: Components
    places: list[DataFrame]
    chosen: DataFrame

    @property
    def correlations(self) -> list[float]:
        return [float(x) for x in self.components.correlations]

    def genes_of_components(self) -> DataFrame:
        """(gene, component, rank)."""
        return self.chosen.select("gene", "component", "rank")

    def shared_correlations(self, frame: ExpressionFrame) -> DataFrame:
        """(source, component, shared)."""
        _, frames = _sets(frame, self.source)
        found = shared_correlation(frames, self.places, self.chosen)
        return found.select(F.element_at(F.array(*map(F.lit, self.sources)), F.col("dataset") + 1).alias(self.source), "component", "shared")

    def transform(self, frame: ExpressionFrame, normalize: bool = True, quantile: float = 2.5) -> DataFrame:
        """(cell, component, value) of the cells that were fitted: their products with metagenes, the sets brought to one range.

        quantile bounds the range of the largest set; the others' range is that of 2.5 and 97.5 per cent.
        """
        order, frames = _sets(frame, self.source)
        if order != self.sources:
            raise AlignmentError("not the sources of the fit")
        found = [projected(f, p, self.chosen) for f, p in zip(frames, self.places)]
        if normalize:
            found = [written(x, "projected") for x in found]
            first = written(reference_range(found[0], quantile, 100 - quantile), "reference")
            found = [first, *(quantile_shift(first, written(reference_range(x), "ranged")) for x in found[1:])]
        return reduce(DataFrame.unionByName, found)


def fit_alignment(frame: ExpressionFrame, source: str, components: int = 20, n_metagenes: int = 30, scoring: str = "pearson") -> AlignmentModel:
    """Canonical components of the sets of cells that source names, and the genes of each component.

    Two sources at least, of two cells each, and no cell without one; fewer
    components than cells of the smallest set and than genes.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}")
    sources, frames = _sets(frame, source)
    if components > min(frames[-1].cells.count(), frame.genes.count()) - 1:
        raise AlignmentError("too many components")
    found, places = canonical_components(frames, components)
    places = [written(p, "canonical") for p in places]
    chosen = written(metagenes([gene_scores(f, p, scoring) for f, p in zip(frames, places)], n_metagenes), "metagenes")
    return AlignmentModel(source, sources, found, places, chosen)
