"""Queries that write the driver's tables as expression files of each kind and read them again, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsail.queries import _E1, _E3, Query, _table, brands, parts
from cellsail.sources import readers
from cellsail.sources.writers import placed, write_genes_in_rows, write_lines
from cellsail.tables import shared_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def read_count_annotated(spark: SparkSession, d: str) -> DataFrame:
    """A .count file and the .meta file beside it: totals of cells with what the annotation says of them."""
    f, folder = brands(spark, d), shared_path(spark, "counts")
    write_genes_in_rows(f, f"{folder}/brands.count", "id", "s")
    write_lines(f.cells, ["cell"], F.concat_ws("\t", F.concat(F.lit("s"), "cell"), F.col("nation").cast("string"), F.col("balance").cast("string")), ["cell\tnation\tbalance"], f"{folder}/brands.meta")
    got = readers.read_expression(spark, f"{folder}/brands.count")
    table, kinds = readers.typed(got.cells.select("cell", "nation", "balance"), max_discrete=1)
    total = got.expr.groupBy("cell").agg(F.sum("value").alias("total"))
    out = table.join(total, "cell", "left").select("cell", F.col("nation").cast("long").alias("nation"), F.round("balance", 2).alias("balance"), F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))
    return out.withColumns({"kind": F.lit(kinds["nation"]), "cell_kind": F.lit(kinds["cell"])})


def read_headers_labels(spark: SparkSession, d: str) -> DataFrame:
    """A table of cells in rows with two label columns and two header rows: what lands where."""
    f = brands(spark, d)
    genes = [r[0] for r in f.genes.orderBy("gene").collect()]
    wide = f.cells.join(f.expr, "cell", "left").groupBy("cell", "nation").pivot("gene", genes).agg(F.first("value"))
    line = F.concat_ws(",", F.concat(F.lit("s"), "cell"), F.col("nation").cast("string"), *[F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).cast("string") for g in genes])
    path = write_lines(wide, ["cell"], line, [",".join(["cell", "nation", *genes]), ",".join(["", "", *(g[6] for g in genes)])], f"{shared_path(spark, 'headers')}.csv")
    got = readers.read_expression(spark, path, genes_in_rows=False, n_headers=2, n_labels=2)
    sums = got.expr.join(got.cells, "cell").join(got.genes.select("gene", "header_2"), "gene").groupBy("nation", "header_2").agg(F.sum("value").alias("total"))
    return sums.select("nation", F.col("header_2").alias("maker"), F.round("total", 6).alias("total"))


def read_genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    """A VCF file of parts by nations, a call being whether the nation's suppliers ship more than 60 of the part, of a quality by the quantity."""
    line, supplier = _table(spark, d, "lineitem"), _table(spark, d, "supplier")
    q = line.join(supplier.select("s_suppkey", "s_nationkey"), line["l_suppkey"] == supplier["s_suppkey"]).groupBy("l_partkey", "s_nationkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    call = F.concat(F.when(F.col("q") > 60, "0/1").otherwise("0/0"), F.lit(":"), (F.col("q") % 50).cast("string"))
    nations = list(range(25))
    wide = q.groupBy("l_partkey").pivot("s_nationkey", nations).agg(F.first(call))
    text = F.concat_ws("\t", F.lit("1"), F.col("l_partkey").cast("string"), F.lit(".\tA\tC\t.\t.\t.\tGT:GQ"), *[F.coalesce(F.col(f"`{n}`"), F.lit("0/0:0")) for n in nations])
    path = write_lines(wide, ["l_partkey"], text, ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"n{n}" for n in nations)], f"{shared_path(spark, 'calls')}.vcf")
    f = readers.read_genotypes(spark, path, quality=10, frequency=2)
    return f.expr.filter("value = 1").select("cell", "gene", "value")


def read_triple_annotated(spark: SparkSession, d: str) -> DataFrame:
    """Genes of a MatrixMarket triple with annotations by their place."""
    f, folder = parts(spark, d), shared_path(spark, "triple")
    genes = placed(f.genes, "gene", "at").select("gene", (F.col("at") + 1).alias("i"))  # names of the file's sides, written in order
    cells = placed(f.cells.select("cell"), "cell", "at").select("cell", (F.col("at") + 1).alias("j"))
    entries = f.expr.join(genes, "gene").join(cells, "cell")
    size = (genes.count(), cells.count(), f.expr.count())
    write_lines(entries, [], F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("value").cast("string")), ["%%MatrixMarket matrix coordinate real general", "%", " ".join(map(str, size))], f"{folder}/matrix.mtx")
    write_lines(genes, ["gene"], F.concat(F.lit("g"), "gene", F.lit("\tsymbol"), F.col("gene") % 7), [], f"{folder}/features.tsv")
    write_lines(cells, ["cell"], F.concat(F.lit("c"), "cell"), [], f"{folder}/barcodes.tsv")
    part = _table(spark, d, "part").join(genes, F.col("p_partkey") == F.col("gene"))
    notes = write_lines(part, ["p_partkey"], F.concat_ws(",", F.concat(F.lit("g"), "p_partkey"), F.concat(F.lit('"'), "p_brand", F.lit(', brand"'))), ["gene,brand"], f"{folder}/notes.csv")
    got = readers.annotate_genes(readers.read_expression(spark, folder), readers.read_table(spark, notes))
    out = got.expr.join(got.genes, "gene").groupBy("brand", "symbol").agg(F.sum("value").alias("total"))
    return out.select("brand", "symbol", F.round("total", 6).alias("total"))


for _query, _sql in (
    (read_count_annotated, f"WITH {_E1} SELECT 's' || cell AS cell, CAST(nation AS BIGINT) AS nation, round(balance, 2) AS balance, round(coalesce(sum(value), 0), 6) AS total, 'continuous' AS kind, 'text' AS cell_kind FROM cells LEFT JOIN e USING (cell) GROUP BY ALL"),
    (read_headers_labels, f"WITH {_E1} SELECT CAST(nation AS VARCHAR) AS nation, substr(gene, 7, 1) AS maker, round(sum(value), 6) AS total FROM e JOIN cells USING (cell) GROUP BY ALL"),
    (read_genotype_calls, "WITH q AS (SELECT l_partkey, s_nationkey, CAST(sum(l_quantity) AS INTEGER) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), c AS (SELECT *, CASE WHEN q % 50 >= 10 THEN CASE WHEN q > 60 THEN 1.0::DOUBLE ELSE 0 END END AS v FROM q), k AS (SELECT l_partkey FROM c GROUP BY 1 HAVING sum(v) >= 2) SELECT 'n' || s_nationkey AS cell, '1-' || l_partkey AS gene, v AS value FROM c WHERE v = 1 AND l_partkey IN (SELECT l_partkey FROM k)"),
    (read_triple_annotated, f"WITH {_E3} SELECT p_brand || ', brand' AS brand, 'symbol' || (gene % 7) AS symbol, round(sum(value), 6) AS total FROM e JOIN part ON p_partkey = gene GROUP BY ALL"),
):
    QUERIES[_query.__name__], SQL[_query.__name__] = _query, _sql
