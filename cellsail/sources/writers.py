"""Text files of frames, written by many tasks: folders of parts whose names follow the order of the lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.tables import written


def placed(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their place from 0 in the order of by, a column without ties: ranges are written, and of each only the size is looked at."""
    ranges = written(rows.orderBy(by).withColumn("id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("id", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int)
    shifts = rows.sparkSession.createDataFrame([(p, int(at) - (p << 33)) for (p, _), at in zip(sizes, first)], "part long, shift long")
    out = ranges.withColumn("part", part).join(F.broadcast(shifts), "part")
    return out.select(*rows.columns, (F.col("id") + F.col("shift")).alias(name))


def write_lines(body: DataFrame, order: list[str], line: Column, head: DataFrame | list[str], path: str) -> str:
    """Lines of head, in a part of their own, then a line for each row of body; sorted by ranges if order is given."""
    if isinstance(head, list):
        head = body.sparkSession.createDataFrame([(x,) for x in head], "value string")
    lines = (body.orderBy(*order) if order else body).select(line.alias("value"))
    head.coalesce(1).unionByName(lines).write.text(path)
    return path


def write_genes_in_rows(frame: ExpressionFrame, path: str, head: str = "gene", prefix: str = "", sep: str = "\t") -> str:
    """A table with a line for each gene and a column for each cell, prefix before its name, both in order.

    A line is put together from the stored values and the zeros between them, so the
    most that one task holds of a gene is its line; missing values are empty.
    """
    cells = placed(frame.cells.select("cell"), "cell", "at")
    n = cells.count()
    names = cells.agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit(prefix), F.col("cell").cast("string")).alias("name")))).alias("x"))
    first = names.select(F.concat_ws(sep, F.lit(head), F.transform("x", lambda v: v["name"])).alias("value"))
    values = frame.expr.join(cells, "cell").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("text")))).alias("x"))
    rows = frame.genes.select("gene").join(values, "gene", "left")
    zeros = lambda many: F.repeat(F.lit(f"{sep}0"), many.cast("int"))
    before = lambda i: F.coalesce(F.get("x", i - 1)["at"], F.lit(-1))
    stored = F.transform("x", lambda v, i: F.concat(zeros(v["at"] - before(i) - 1), F.lit(sep), v["text"]))
    rest = zeros(n - 1 - before(F.coalesce(F.size("x"), F.lit(0))))
    return write_lines(rows, ["gene"], F.concat(F.col("gene").cast("string"), F.coalesce(F.array_join(stored, ""), F.lit("")), rest), first, path)
