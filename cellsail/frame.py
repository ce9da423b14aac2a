"""Expression data as DataFrames: a sparse table of values, and a table for each side."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExpressionFrame:
    """expr(cell, gene, value), cells(cell, ...), genes(gene, ...).

    A pair without a row is 0, a null value is missing; NaN is not used. Cells and
    genes are unique in their tables, which may list more than expr has.
    """

    expr: DataFrame
    cells: DataFrame
    genes: DataFrame

    def with_expr(self, expr: DataFrame) -> ExpressionFrame:
        return replace(self, expr=expr)

    def with_values(self, value) -> ExpressionFrame:
        return self.with_expr(self.expr.withColumn("value", value))

    def n_cells(self) -> DataFrame:
        """One row, n_cells."""
        return self.cells.agg(F.count("*").alias("n_cells"))

    def dense(self) -> ExpressionFrame:
        """With a row for every pair; cells times genes rows, so for few genes or dense kernels only."""
        pairs = self.cells.select("cell").crossJoin(F.broadcast(self.genes.select("gene")) if self.genes.limit(100_001).count() <= 100_000 else self.genes.select("gene"))
        marked = self.expr.select("cell", "gene", "value", F.lit(True).alias("stored"))
        out = pairs.join(marked, ["cell", "gene"], "left")
        return self.with_expr(out.select("cell", "gene", F.when(F.col("stored"), F.col("value")).otherwise(F.lit(0.0)).alias("value")))

    def keep_cells(self, cells: DataFrame) -> ExpressionFrame:
        keep = cells.select("cell")
        return ExpressionFrame(self.expr.join(keep, "cell", "left_semi"), self.cells.join(keep, "cell", "left_semi"), self.genes)

    def keep_genes(self, genes: DataFrame) -> ExpressionFrame:
        keep = genes.select("gene")
        return ExpressionFrame(self.expr.join(keep, "gene", "left_semi"), self.cells, self.genes.join(keep, "gene", "left_semi"))

    def transpose(self) -> ExpressionFrame:
        return ExpressionFrame(
            self.expr.select(F.col("gene").alias("cell"), F.col("cell").alias("gene"), "value"),
            self.genes.withColumnRenamed("gene", "cell"),
            self.cells.withColumnRenamed("cell", "gene"),
        )

    def fill_missing(self) -> ExpressionFrame:
        return self.with_values(F.coalesce("value", F.lit(0.0)))


def from_long(expr: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None) -> ExpressionFrame:
    """From (cell, gene, value) rows; the sides default to what the rows name. NaN becomes null."""
    expr = expr.select("cell", "gene", F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double")).alias("value"))
    return ExpressionFrame(expr, cells if cells is not None else expr.select("cell").distinct(), genes if genes is not None else expr.select("gene").distinct())


def from_arrays(rows: DataFrame, cell: str, values: str, *metas: str) -> ExpressionFrame:
    """From one array of values a cell; genes are the positions from 0."""
    expr = rows.select(F.col(cell).alias("cell"), F.posexplode(values).alias("gene", "value"))
    return from_long(expr, rows.select(F.col(cell).alias("cell"), *metas))


def from_wide(rows: DataFrame, cell: str, genes: list[str], *metas: str) -> ExpressionFrame:
    """From one column a gene."""
    expr = rows.select(F.col(cell).alias("cell"), *genes).unpivot("cell", genes, "gene", "value")
    return from_long(expr, rows.select(F.col(cell).alias("cell"), *metas))
