"""Stacking samples: the cells of several frames over common or all genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame


def stack(frames: dict[str, ExpressionFrame], how: str = "intersection") -> ExpressionFrame:
    """Cells of all frames with a source column; cell ids become source:cell.

    intersection keeps the genes of all; union keeps every gene, and a gene that a
    frame lacks is missing, not 0, in that frame's cells.
    """
    genes = [f.genes.select("gene") for f in frames.values()]
    together = reduce(lambda a, b: a.intersect(b) if how == "intersection" else a.union(b).distinct(), genes)
    exprs, cells = [], []
    for name, f in frames.items():
        named = F.concat_ws(":", F.lit(name), F.col("cell").cast("string")).alias("cell")
        expr = f.expr.join(together, "gene", "left_semi").select(named, "gene", "value")
        if how == "union":
            lacking = together.join(f.genes.select("gene"), "gene", "left_anti")
            expr = expr.unionByName(f.cells.select(named).crossJoin(lacking).withColumn("value", F.lit(None).cast("double")))
        exprs.append(expr)
        cells.append(f.cells.select(named, *[c for c in f.cells.columns if c != "cell"], F.lit(name).alias("source")))
    return ExpressionFrame(reduce(lambda a, b: a.unionByName(b), exprs), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cells), together)
