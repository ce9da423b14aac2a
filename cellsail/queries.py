"""Queries over the driver's tables, one for each operator, and equivalent SQL.

Counts of quantity by supplier (cell) and brand (gene) are the usual matrix, by
supplier and part the sparse one; embeddings by position are the dense, signed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame, from_arrays, from_long
from cellsail.functions.robust import biweight_location, biweight_midcorrelation, biweight_midcovariance, biweight_midvariance, biweight_scale, median_absolute_deviation, spearman
from cellsail.operators import alignment, batch, clusters, filters, scoring, selection, spatial, stack, transforms
from cellsail.plans import pipeline
from cellsail.sources import readers
from cellsail.sources.writers import write_genes_in_rows, write_lines
from cellsail.tables import shared_path

Query = Callable[[SparkSession, str], DataFrame]
MARKERS = ["Brand#11", "Brand#12", "Brand#23", "Brand#34", "Brand#55"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _counts(spark: SparkSession, d: str, gene: str) -> ExpressionFrame:
    part = _table(spark, d, "part")
    line = _table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    rows = line.join(part.select("p_partkey", "p_brand"), line["l_partkey"] == part["p_partkey"]) if gene == "p_brand" else line
    if gene == "l_partkey":  # nearly all pairs differ, so sums before the shuffle would only fill a task's memory
        rows = rows.repartition("l_suppkey", gene)
    expr = rows.groupBy(F.col("l_suppkey").alias("cell"), F.col(gene).alias("gene")).agg(F.sum("l_quantity").cast("double").alias("value"))
    cells = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").cast("double").alias("balance"))
    genes = part.select(F.col("p_brand" if gene == "p_brand" else "p_partkey").alias("gene")).distinct()
    return from_long(expr, cells, genes)


def brands(spark: SparkSession, d: str) -> ExpressionFrame:
    return _counts(spark, d, "p_brand")


def parts(spark: SparkSession, d: str) -> ExpressionFrame:
    return _counts(spark, d, "l_partkey")


def vectors(spark: SparkSession, d: str) -> ExpressionFrame:
    rows = _table(spark, d, "embeddings")
    xy = rows.withColumn("x", F.element_at("embedding", 1).cast("double")).withColumn("y", F.element_at("embedding", 2).cast("double"))
    return from_arrays(xy, "vec_id", "embedding", "label", "x", "y")


def _values(frame: ExpressionFrame, digits: int = 6, zeros: bool = False) -> DataFrame:
    out = frame.expr.select("cell", "gene", F.round("value", digits).alias("value"))
    return out if zeros else out.filter("value <> 0")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _markers(frame: ExpressionFrame) -> DataFrame:
    return frame.genes.filter(F.col("gene").isin(MARKERS)).select("gene")


def _halves(spark: SparkSession, d: str) -> dict[str, ExpressionFrame]:
    f = brands(spark, d)
    even, odd = f.keep_cells(f.cells.filter("cell % 2 = 0")), f.keep_cells(f.cells.filter("cell % 2 = 1"))
    return {"a": even.keep_genes(f.genes.filter("gene < 'Brand#40'")), "b": odd.keep_genes(f.genes.filter("gene > 'Brand#20'"))}


_E1 = """e AS (SELECT l_suppkey AS cell, p_brand AS gene, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cells AS (SELECT s_suppkey AS cell, s_nationkey AS nation, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier), genes AS (SELECT DISTINCT p_brand AS gene FROM part),
dense AS (SELECT cell, gene, coalesce(value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN e USING (cell, gene))"""
_E3 = """e AS (SELECT l_suppkey AS cell, l_partkey AS gene, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
cells AS (SELECT s_suppkey AS cell FROM supplier), genes AS (SELECT DISTINCT p_partkey AS gene FROM part)"""
_E4 = """e AS (SELECT vec_id AS cell, CAST(unnest(range(len(embedding))) AS INTEGER) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value, label FROM embeddings), dense AS (SELECT * FROM e),
cells AS (SELECT vec_id AS cell, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), genes AS (SELECT DISTINCT gene FROM e)"""
_IN = ", ".join(f"'{m}'" for m in MARKERS)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _register() -> None:
    for side in ("cell", "gene"):
        other = f"{side}s"
        _add(f"qc_{side}_total_counts", lambda s, d, side=side: _rounded(filters.metric(brands(s, d), side, "total_counts"), "metric"), f"WITH {_E1} SELECT {side}, round(coalesce(sum(value), 0), 6) AS metric FROM {other} LEFT JOIN e USING ({side}) GROUP BY 1")
        _add(f"qc_{side}_detection", lambda s, d, side=side: filters.metric(parts(s, d), side, "detection"), f"WITH {_E3} SELECT {side}, count(*) FILTER (value <> 0) AS metric FROM {other} LEFT JOIN e USING ({side}) GROUP BY 1")
        _add(f"filter_{side}s", lambda s, d, side=side: _values(filters.filter_side(parts(s, d), side, "detection", 20, 10_000)), f"WITH {_E3}, k AS (SELECT {side} FROM e GROUP BY 1 HAVING count(*) FILTER (value <> 0) BETWEEN 20 AND 10000) SELECT cell, gene, round(value, 6) AS value FROM e WHERE {side} IN (SELECT {side} FROM k) AND value <> 0")
    _add("zap_values", lambda s, d: _values(filters.zap(brands(s, d), 100, 900)), f"WITH {_E1} SELECT cell, gene, round(value, 6) AS value FROM e WHERE value BETWEEN 100 AND 900")
    _add("zap_upper_only", lambda s, d: _values(filters.zap(brands(s, d), None, 600)), f"WITH {_E1} SELECT cell, gene, round(value, 6) AS value FROM e WHERE value >= 600")
    for name, base, expr in (("log2", 2, "log2(value + 1)"), ("ln", None, "ln(value + 1)"), ("log10", 10, "log10(value + 1)")):
        _add(f"{name}_scale", lambda s, d, base=base: _values(transforms.log_scale(brands(s, d), base)), f"WITH {_E1} SELECT cell, gene, round({expr}, 6) AS value FROM e WHERE value <> 0")
    _add("binarize_ge", lambda s, d: _values(transforms.binarize(brands(s, d), 500)), f"WITH {_E1} SELECT cell, gene, 1.0::DOUBLE AS value FROM e WHERE value >= 500")
    _add("binarize_gt", lambda s, d: _values(transforms.binarize(brands(s, d), 0, strict=True)), f"WITH {_E1} SELECT cell, gene, 1.0::DOUBLE AS value FROM e WHERE value > 0")
    sums = "s AS (SELECT cell, CASE WHEN coalesce(sum(value), 0) = 0 THEN 1 ELSE sum(value) END AS s FROM cells LEFT JOIN e USING (cell) GROUP BY 1)"
    for method, factor in (("cpm", "1e6"), ("cp10k", "1e4"), ("median", "(SELECT median(s) FROM s)")):
        _add(f"normalize_{method}", lambda s, d, method=method: _values(transforms.normalize_cells(brands(s, d), method), 4), f"WITH {_E1}, {sums} SELECT cell, gene, round(value / s * {factor}, 4) AS value FROM e JOIN s USING (cell) WHERE value <> 0")
    groups = f"{sums}, g AS (SELECT nation, sum(value) AS total FROM e JOIN cells USING (cell) GROUP BY 1), m AS (SELECT min(m) AS m FROM (SELECT median(s) AS m FROM s JOIN cells USING (cell) GROUP BY nation))"
    for method, factor in (("cpm", "1e6"), ("median", "(SELECT m FROM m)")):
        _add(f"normalize_groups_{method}", lambda s, d, method=method: _values(transforms.normalize_groups(brands(s, d), "nation", method), 4), f"WITH {_E1}, {groups} SELECT cell, gene, round(value / total * {factor}, 4) AS value FROM e JOIN cells USING (cell) JOIN g USING (nation)")
    z = "z AS (SELECT cell, gene, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS value FROM dense WINDOW w AS (PARTITION BY gene))"
    _add("standardize", lambda s, d: _values(transforms.standardize(brands(s, d)), zeros=True), f"WITH {_E1}, {z} SELECT cell, gene, round(value, 6) AS value FROM z")
    _add("standardize_clipped", lambda s, d: _values(transforms.standardize(vectors(s, d), -1, 1), zeros=True), f"WITH {_E4}, {z} SELECT cell, gene, round(greatest(least(value, 1), -1), 6) AS value FROM z")
    moments = "mo AS (SELECT gene, avg(value) AS mean, var_pop(value) AS variance FROM dense GROUP BY 1)"
    for name, score in (("dispersion", "CASE WHEN mean = 0 THEN 0 ELSE variance / mean END"), ("variance", "variance"), ("mean", "mean")):
        _add(
            f"select_variable_{name}",
            lambda s, d, name=name: _rounded(selection.variable_genes(brands(s, d), name, 8, 4), "z"),
            f"""WITH {_E1}, {moments}, p AS (SELECT gene, {score} AS score, ((rank() OVER (ORDER BY mean) - 1) * 2 + count(*) OVER (PARTITION BY mean) + 1) * 50.0::DOUBLE / count(*) OVER () AS p FROM mo),
            r AS (SELECT *, min(p) OVER () - CASE WHEN min(p) OVER () = max(p) OVER () THEN 0.5 ELSE 0 END AS low, max(p) OVER () + CASE WHEN min(p) OVER () = max(p) OVER () THEN 0.5 ELSE 0 END AS high, least(4, count(*) OVER ()) AS k FROM p),
            b AS (SELECT gene, score, CAST(greatest(1, len(list_filter(range(k), lambda i: low + i * ((high - low) / k) < p)) + CASE WHEN high < p THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM r),
            zz AS (SELECT gene, bin, coalesce(CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 0) AS z FROM b WINDOW w AS (PARTITION BY bin))
            SELECT gene, bin, round(z, 6) AS z FROM zz ORDER BY round(z, 9) DESC, gene LIMIT 8""",
        )
    drop = "st AS (SELECT gene, 1 - count(*) FILTER (value > 0) / (SELECT count(*) FROM cells)::DOUBLE AS zero_rate, sum(CASE WHEN value > 0 THEN log2(value) ELSE value END) / nullif(count(*) FILTER (value > 0), 0) AS mean_expr FROM genes LEFT JOIN e USING (gene) GROUP BY 1)"
    _add("dropout_statistics", lambda s, d: _rounded(selection.dropout_statistics(parts(s, d)), "zero_rate", "mean_expr"), f"WITH {_E3}, {drop} SELECT gene, round(zero_rate, 6) AS zero_rate, round(mean_expr, 6) AS mean_expr FROM st")
    _add("dropout_select_curve", lambda s, d: selection.dropout_by_curve(selection.dropout_statistics(parts(s, d)), x_offset=4.0).select("gene"), f"WITH {_E3}, {drop} SELECT gene FROM st WHERE zero_rate > exp(-(mean_expr - 4.0)) + 0.02")
    _add("dropout_select_n", lambda s, d: selection.dropout_top(selection.dropout_statistics(parts(s, d)), 50).select("gene"), f"WITH {_E3}, {drop}, k AS (SELECT gene, mean_expr + ln(zero_rate - 0.02) AS key FROM st WHERE zero_rate > 0.02 AND mean_expr IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY key DESC, gene) AS i FROM k WHERE key > 0) SELECT gene FROM r WHERE i <= 50 OR key >= 10")
    scores = "sc AS (SELECT gene, mean, variance, variance / CASE WHEN mean = 0 THEN 1 ELSE mean END AS dispersion, sqrt(variance) / CASE WHEN mean = 0 THEN 1 ELSE mean END AS cv FROM mo)"
    _add("score_genes", lambda s, d: _rounded(scoring.score_genes(brands(s, d)), "mean", "variance", "dispersion", "cv", digits=4), f"WITH {_E1}, {moments}, {scores} SELECT gene, round(mean, 4) AS mean, round(variance, 4) AS variance, round(dispersion, 4) AS dispersion, round(cv, 4) AS cv FROM sc")
    _add("top_genes", top_genes, f"WITH {_E1}, {sums}, n AS (SELECT cell, gene, log2(value / s * 1e6 + 1) AS value FROM e JOIN s USING (cell)), {moments.replace('FROM dense', 'FROM (SELECT cell, gene, coalesce(n.value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN n USING (cell, gene))')}, {scores} SELECT gene, round(dispersion, 6) AS dispersion FROM sc ORDER BY dispersion DESC NULLS LAST, gene DESC LIMIT 5")
    _add("information_gain", lambda s, d: _rounded(scoring.information_gain(vectors(s, d), "label"), "info_gain"), f"WITH {_E4}, b AS (SELECT gene, label, floor(percent_rank() OVER (PARTITION BY gene ORDER BY value) * 4) AS bin FROM e), c AS (SELECT gene, bin, label, count(*) AS n FROM b GROUP BY ALL) SELECT gene, round(sum(n / t * log2(n * t / (nb * ny))), 6) AS info_gain FROM (SELECT gene, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY gene, bin)::DOUBLE AS nb, sum(n) OVER (PARTITION BY gene, label)::DOUBLE AS ny, sum(n) OVER (PARTITION BY gene)::DOUBLE AS t FROM c) GROUP BY 1")
    sub = f"x AS (SELECT cell, gene, value FROM dense WHERE gene IN ({_IN}))"
    for name, expr in (("mean", "avg(value)"), ("median", "median(value)"), ("max", "max(value)"), ("fraction", "avg(CASE WHEN value > 0 THEN 1 ELSE 0 END)"), ("normalized", "avg(value / CASE WHEN sd = 0 THEN 1 ELSE sd END)")):
        _add(f"score_cells_{name}", lambda s, d, name=name: _rounded(scoring.score_cells((f := brands(s, d)), _markers(f), name), "score"), f"WITH {_E1}, {sub}, y AS (SELECT *, stddev_pop(value) OVER (PARTITION BY gene) AS sd FROM x) SELECT cell, round({expr}, 6) AS score FROM y GROUP BY 1")
    halves = "h AS (SELECT 'a:' || cell AS cell, gene, value FROM e WHERE cell % 2 = 0 AND gene < 'Brand#40' UNION ALL SELECT 'b:' || cell, gene, value FROM e WHERE cell % 2 = 1 AND gene > 'Brand#20')"
    _add("stack_intersection", lambda s, d: _values(stack.stack(_halves(s, d))), f"WITH {_E1}, {halves} SELECT cell, gene, round(value, 6) AS value FROM h WHERE gene < 'Brand#40' AND gene > 'Brand#20'")
    _add("stack_union", lambda s, d: _values(stack.stack(_halves(s, d), "union"), zeros=True), f"WITH {_E1}, {halves} SELECT cell, gene, round(value, 6) AS value FROM h UNION ALL SELECT 'a:' || cell, gene, NULL FROM cells CROSS JOIN genes WHERE cell % 2 = 0 AND gene >= 'Brand#40' UNION ALL SELECT 'b:' || cell, gene, NULL FROM cells CROSS JOIN genes WHERE cell % 2 = 1 AND gene <= 'Brand#20'")
    dot = {"mean": "avg(value)", "median": "median(value)", "min": "min(value)", "max": "max(value)", "fraction": "avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END)"}
    for name, expr in dot.items():
        _add(f"dot_{name}", lambda s, d, name=name: _rounded(clusters.summarize(vectors(s, d), "label", name), "value"), f"WITH {_E4} SELECT label AS cluster, gene, round({expr}, 6) AS value FROM e GROUP BY ALL")
    fr = f"d AS (SELECT nation AS cluster, gene, ln(1 + avg(value)) AS v FROM dense JOIN cells USING (cell) GROUP BY ALL), zd AS (SELECT cluster, gene, greatest(-3, least(3, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10))) AS v FROM d WINDOW w AS (PARTITION BY gene))"
    _add("dot_normalized", lambda s, d: _rounded(clusters.normalize_summary(clusters.summarize(brands(s, d), "nation")), "value"), f"WITH {_E1}, {fr} SELECT cluster, gene, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER () + 1e-12), 6) AS value FROM zd")
    _add("contingency_wide", lambda s, d: clusters.contingency(_rounded(clusters.summarize(vectors(s, d), "label"), "value"), list(range(64))).select("cluster", *[F.col(str(i)).alias(f"g{i}") for i in range(64)]), f"WITH {_E4} SELECT label AS cluster, " + ", ".join(f"round(avg(value) FILTER (gene = {i}), 6) AS g{i}" for i in range(64)) + " FROM e GROUP BY 1")
    counts = "c AS (SELECT label AS cluster, gene, count(*) FILTER (value > 0) AS k, count(*) AS in_cluster FROM e GROUP BY ALL), t AS (SELECT c.*, sum(k) OVER (PARTITION BY gene)::BIGINT AS expressing, sum(in_cluster) OVER (PARTITION BY gene)::BIGINT AS total FROM c)"
    pmf = "exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(t - n + 1) - lgamma(m - x + 1) - lgamma(t - n - m + x + 1) - lgamma(t + 1) + lgamma(m + 1) + lgamma(t - m + 1))"
    tails = f"xs AS (SELECT cluster, gene, k, in_cluster AS m, expressing AS n, total AS t, unnest(range(greatest(0, in_cluster + expressing - total), least(in_cluster, expressing) + 1)) AS x FROM t), ps AS (SELECT *, {pmf} AS p FROM xs), en AS (SELECT cluster, gene, any_value(k) / any_value(m)::DOUBLE AS fraction, least(1, sum(p) FILTER (x <= k)) AS low, least(1, sum(p) FILTER (x >= k)) AS high FROM ps GROUP BY 1, 2)"
    _add("enrich_counts", lambda s, d: clusters.expression_counts(vectors(s, d), "label"), f"WITH {_E4}, {counts} SELECT cluster, gene, k, in_cluster, expressing, total FROM t")
    _add("enrichment", lambda s, d: _rounded(clusters.enrichment(vectors(s, d), "label"), "fraction", "low", "high", "either"), f"WITH {_E4}, {counts}, {tails} SELECT cluster, gene, round(fraction, 6) AS fraction, round(low, 6) AS low, round(high, 6) AS high, round(least(low, high), 6) AS either FROM en")
    _add("enrich_top_overall", lambda s, d: _rounded(clusters.top_overall(clusters.enrichment(vectors(s, d), "label"), 10), "p"), f"WITH {_E4}, {counts}, {tails}, r AS (SELECT *, least(low, high) AS p, row_number() OVER (PARTITION BY cluster ORDER BY round(least(low, high), 12), gene) AS i FROM en) SELECT gene, round(min(p), 6) AS p FROM r WHERE i <= 10 GROUP BY 1 ORDER BY round(min(p), 12), gene LIMIT 10")
    # ten labels, one after the other
    steps = ", ".join(f"g{i} AS MATERIALIZED (SELECT cluster, gene, p FROM en2 WHERE cluster = {i}" + (f" AND gene NOT IN ({' UNION ALL '.join(f'SELECT gene FROM g{j}' for j in range(i))})" if i else "") + " ORDER BY round(p, 12), gene LIMIT 3)" for i in range(10))
    _add("enrich_top_per_cluster", lambda s, d: _rounded(clusters.top_per_cluster(clusters.enrichment(vectors(s, d), "label"), 3), "p"), f"WITH {_E4}, {counts}, {tails}, en2 AS MATERIALIZED (SELECT cluster, gene, least(low, high) AS p FROM en), {steps} SELECT cluster, gene, round(p, 6) AS p FROM ({' UNION ALL '.join(f'SELECT * FROM g{i}' for i in range(10))})")
    given = [0, 5, 63, 64]
    _add("enrich_given_genes", lambda s, d: _rounded(clusters.scores_of(clusters.enrichment((f := vectors(s, d)), "label").select("cluster", "gene", F.col("either").alias("p")), f.genes.filter(F.col("gene").isin(given))), "p").select("cluster", "gene", "p"), f"WITH {_E4}, {counts}, {tails} SELECT cluster, gene, round(least(low, high), 6) AS p FROM en WHERE gene IN (0, 5, 63)")
    _add("cluster_result_table", lambda s, d: clusters.result_table(vectors(s, d), "label", [7, 3], "max").select("cluster", F.round("7", 6).alias("g7"), F.round("3", 6).alias("g3")), f"WITH {_E4} SELECT label AS cluster, round(max(value) FILTER (gene = 7), 6) AS g7, round(max(value) FILTER (gene = 3), 6) AS g3 FROM e GROUP BY 1")
    _add("score_cells_no_markers", lambda s, d: scoring.score_cells((f := brands(s, d)), f.genes.filter("gene = 'none'")), f"WITH {_E1} SELECT cell, 1.0::DOUBLE AS score FROM cells")
    _add("stack_sources", lambda s, d: stack.stack(_halves(s, d)).cells.groupBy("source").agg(F.count("*").alias("n"), F.min("cell").alias("first")), f"WITH {_E1} SELECT CASE cell % 2 WHEN 0 THEN 'a' ELSE 'b' END AS source, count(*) AS n, min(CASE cell % 2 WHEN 0 THEN 'a:' ELSE 'b:' END || cell) AS first FROM cells GROUP BY 1")
    _add("transposed_totals", lambda s, d: _rounded(filters.metric(brands(s, d).transpose(), "cell", "total_counts"), "metric"), f"WITH {_E1} SELECT gene AS cell, round(coalesce(sum(value), 0), 6) AS metric FROM genes LEFT JOIN e USING (gene) GROUP BY 1")
    _add("filter_without_bounds", lambda s, d: _values(filters.filter_side(parts(s, d), "cell", "detection")), f"WITH {_E3} SELECT cell, gene, round(value, 6) AS value FROM e WHERE value <> 0")
    _add("reduced_to_top_genes", lambda s, d: _values((f := brands(s, d)).keep_genes(scoring.top_genes(scoring.score_genes(f).select("gene", "mean"), "mean", 4))), f"WITH {_E1}, {moments}, k AS (SELECT gene FROM mo ORDER BY mean DESC, gene DESC LIMIT 4) SELECT cell, gene, round(value, 6) AS value FROM e WHERE gene IN (SELECT gene FROM k) AND value <> 0")
    _add("matrix_summary", lambda s, d: _rounded(readers.summary(parts(s, d)), "sparsity"), f"WITH {_E3} SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, round(1 - (SELECT count(*) FROM e WHERE value <> 0) / ((SELECT count(*) FROM cells) * (SELECT count(*) FROM genes))::DOUBLE, 6) AS sparsity")
    dz = "dz AS (SELECT gene, cell, value, balance AS z, nation FROM dense JOIN cells USING (cell))"
    _add("batch_correlation", lambda s, d: _rounded(batch._correlations((f := brands(s, d)), f.cells.select("cell", F.lit(0).alias("level"), F.col("balance").alias("z"))).select("gene", "r"), "r"), f"WITH {_E1}, {dz} SELECT gene, round(corr(value, z), 6) AS r FROM dz GROUP BY 1")
    # the correlation of p = 0.05 depends on the number of cells: 10, 100 and 1000 in the driver's tables
    limit = "(SELECT CASE count(*) " + " ".join(f"WHEN {n} THEN {batch.critical_r(n)!r}::DOUBLE" for n in (10, 100, 1000)) + " END FROM cells)"
    _add("batch_score_continuous", lambda s, d: _rounded(batch.batch_score(brands(s, d), "balance", False), "score"), f"WITH {_E1}, {dz}, r AS (SELECT gene, abs(corr(value, z)) AS r FROM dz GROUP BY 1) SELECT round(avg(CASE WHEN r > {limit} THEN 1.0 ELSE 0 END), 6) AS score FROM r")
    _add("batch_score_discrete", lambda s, d: _rounded(batch.batch_score(brands(s, d), "nation", True), "score"), f"WITH {_E1}, {dz}, l AS (SELECT DISTINCT nation AS level FROM cells), r AS (SELECT gene, max(r) AS r FROM (SELECT gene, level, abs(corr(value, CASE WHEN nation = level THEN 1.0 ELSE 0 END)) AS r FROM dz CROSS JOIN l GROUP BY ALL) GROUP BY 1) SELECT round(avg(CASE WHEN r > {limit} THEN 1.0 ELSE 0 END), 6) AS score FROM r")
    _add("regression_scores", lambda s, d: _rounded(scoring.regression_scores(brands(s, d), "balance"), "f", "r2"), f"WITH {_E1}, {dz}, r AS (SELECT gene, corr(value, z) ** 2 AS r2, count(*) AS n FROM dz GROUP BY 1) SELECT gene, round(r2 * (n - 2) / (1 - r2), 6) AS f, round(r2, 6) AS r2 FROM r")
    _add("score_table", lambda s, d: _rounded(scoring.score_table((f := brands(s, d)).genes, {"moments": scoring.score_genes(f).select("gene", "mean", "variance"), "r2": scoring.regression_scores(f, "balance").select("gene", "r2")}), "moments_1", "moments_2", "r2", digits=4), f"WITH {_E1}, {dz} SELECT gene, round(avg(value), 4) AS moments_1, round(var_pop(value), 4) AS moments_2, round(corr(value, z) ** 2, 4) AS r2 FROM dz GROUP BY 1")
    seen = "se AS (SELECT gene, nation, avg(value) AS m FROM dz WHERE cell % 2 = 0 GROUP BY ALL)"
    _add("batch_replay", lambda s, d: _values(batch.remove_batch((f := brands(s, d)).keep_cells(f.cells.filter("cell % 2 = 1")), batch.fit_batch(f.keep_cells(f.cells.filter("cell % 2 = 0")), ["nation"])), 5, zeros=True), f"WITH {_E1}, {dz}, {seen} SELECT cell, dz.gene, round(value - coalesce(m, 0), 5) AS value FROM dz LEFT JOIN se ON se.gene = dz.gene AND se.nation = dz.nation WHERE cell % 2 = 1")
    _add("batch_residual_discrete", lambda s, d: _values(batch.remove_discrete(brands(s, d), "nation"), zeros=True), f"WITH {_E1}, {dz} SELECT cell, gene, round(value - avg(value) OVER (PARTITION BY gene, nation), 6) AS value FROM dz")
    fit = "fi AS (SELECT gene, regr_slope(value, z) AS b, regr_intercept(value, z) AS a FROM dz GROUP BY 1)"
    mixed = "ce AS (SELECT cell, gene, value - avg(value) OVER (PARTITION BY gene, nation) AS y, z - avg(z) OVER (PARTITION BY gene, nation) AS x FROM dz), sl AS (SELECT gene, sum(x * y) / sum(x * x) AS b FROM ce GROUP BY 1)"
    _add("batch_residual_mixed", lambda s, d: _values(batch.remove_mixed(brands(s, d), "nation", "balance"), 4, zeros=True), f"WITH {_E1}, {dz}, {mixed} SELECT cell, gene, round(y - b * x, 4) AS value FROM ce JOIN sl USING (gene)")
    _add("batch_residual_continuous", lambda s, d: _values(batch.remove_continuous(brands(s, d), "balance"), zeros=True), f"WITH {_E1}, {dz}, {fit} SELECT cell, gene, round(value - a - b * z, 6) AS value FROM dz JOIN fi USING (gene)")
    shift = "nz AS (SELECT * FROM dz WHERE value <> 0), fi AS (SELECT gene, coalesce(regr_slope(value, z), 0) AS b, avg(value) - coalesce(regr_slope(value, z), 0) * avg(z) AS a FROM nz GROUP BY 1), rs AS (SELECT cell, gene, value - a - b * z AS v FROM nz JOIN fi USING (gene)), al AS (SELECT cell, gene, coalesce(v, 0) AS v FROM cells CROSS JOIN genes LEFT JOIN rs USING (cell, gene)), mn AS (SELECT gene, min(v) AS low FROM al GROUP BY 1)"
    _add("batch_nonzero_shift", lambda s, d: _values(batch.remove_continuous(brands(s, d), "balance", nonzero_only=True), 4), f"WITH {_E1}, {dz}, {shift} SELECT cell, gene, round(v - low + 0.01 * (SELECT stddev_pop(v) FROM al), 4) AS value FROM al JOIN mn USING (gene) WHERE v <> 0 AND round(v - low + 0.01 * (SELECT stddev_pop(v) FROM al), 4) <> 0")
    groups = "nz AS (SELECT * FROM dz WHERE value <> 0), rs AS (SELECT cell, gene, value - avg(value) OVER (PARTITION BY gene, nation) AS v FROM nz), al AS (SELECT cell, gene, coalesce(v, 0) AS v FROM cells CROSS JOIN genes LEFT JOIN rs USING (cell, gene)), mn AS (SELECT gene, min(v) AS low FROM al GROUP BY 1)"
    moved = "round(v - low + 0.01 * (SELECT stddev_pop(v) FROM al), 4)"
    _add("batch_nonzero_discrete", lambda s, d: _values(batch.remove_discrete(brands(s, d), "nation", nonzero_only=True), 4), f"WITH {_E1}, {dz}, {groups} SELECT cell, gene, {moved} AS value FROM al JOIN mn USING (gene) WHERE abs(v) > 1e-9 AND {moved} <> 0")
    _add("batch_log_link", lambda s, d: _values(batch.remove_discrete(brands(s, d), "nation", nonzero_only=True, log_link=True)), f"WITH {_E1}, {dz} SELECT cell, gene, round(exp(ln(value) - avg(ln(value)) OVER (PARTITION BY gene, nation)), 6) AS value FROM dz WHERE value <> 0")
    _add("class_filter", lambda s, d: _values(clusters.select_classes(brands(s, d), "nation", [0, 1, 2, 3])), f"WITH {_E1} SELECT cell, gene, round(value, 6) AS value FROM e JOIN cells USING (cell) WHERE nation IN (0, 1, 2, 3) AND value <> 0")
    _add("flag_selection", lambda s, d: clusters.flag_selection((f := brands(s, d)).cells, f.cells.filter("balance > 0")).select("cell", "selected"), f"WITH {_E1} SELECT cell, balance > 0 AS selected FROM cells")
    _add("dot_margins", lambda s, d: _rounded(clusters.with_margins(clusters.summarize(vectors(s, d), "label", "fraction"), "cluster", "gene"), "value"), f"WITH {_E4}, f AS (SELECT label AS cluster, gene, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS value FROM e GROUP BY ALL) SELECT cluster, gene, round(sum(value), 6) AS value, GROUPING(cluster, gene)::BIGINT AS margin FROM f GROUP BY CUBE (cluster, gene)")
    _add("impute_means", lambda s, d: _rounded(clusters.impute_means(stack.stack(_halves(s, d), "union").expr.withColumnRenamed("cell", "cluster")), "value"), f"WITH {_E1}, {halves}, u AS (SELECT cell, gene, value FROM h UNION ALL SELECT 'a:' || cell, gene, NULL FROM cells CROSS JOIN genes WHERE cell % 2 = 0 AND gene >= 'Brand#40' UNION ALL SELECT 'b:' || cell, gene, NULL FROM cells CROSS JOIN genes WHERE cell % 2 = 1 AND gene <= 'Brand#20') SELECT cell AS cluster, gene, round(coalesce(value, avg(value) OVER (PARTITION BY gene), 0), 6) AS value FROM u")
    _add("marker_genes", lambda s, d: scoring.match_markers((f := brands(s, d)).genes, _markers(f)), f"WITH {_E1} SELECT gene FROM genes WHERE gene IN ({_IN})")
    _add("enrich_shared_genes", lambda s, d: clusters.shared_genes((f := vectors(s, d)).genes.filter("gene < 40"), f.genes.filter("gene > 20")), f"WITH {_E4} SELECT CAST(gene AS VARCHAR) AS gene FROM genes WHERE gene BETWEEN 21 AND 39")
    _add("read_tsv", read_tsv, f"WITH {_E1} SELECT CAST(cell AS VARCHAR) AS cell, gene, round(value, 6) AS value FROM e WHERE value <> 0")
    _add("read_mtx", read_mtx, f"WITH {_E3} SELECT 'c' || cell AS cell, 'g' || gene AS gene, round(value, 6) AS value FROM e")
    _add("canonical_components", canonical_components)
    knn = "kn AS (SELECT src, dst FROM (SELECT a.cell AS src, b.cell AS dst, row_number() OVER (PARTITION BY a.cell ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell) AS i FROM cells a JOIN cells b ON a.cell <> b.cell) WHERE i <= 10)"
    _add("knn_edges", lambda s, d: spatial.knn_edges(vectors(s, d).cells, "x", "y", 10).select("src", "dst"), f"WITH {_E4}, {knn} SELECT src, dst FROM kn")
    zs = "zs AS (SELECT cell, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM e), zz AS (SELECT gene, count(*) AS n, sum(z * z) AS q FROM zs GROUP BY 1), sp AS (SELECT a.gene, count(*) AS w, sum(a.z * b.z) AS c, sum((a.z - b.z) ** 2) AS d FROM kn JOIN zs a ON a.cell = src JOIN zs b ON b.cell = dst AND b.gene = a.gene GROUP BY 1)"
    for name, method, expr in (("morans_i", "moran", "n / w * c / (q + 1e-16)"), ("gearys_c", "geary", "(n - 1) / (2 * w) * d / (q + 1e-16)")):
        _add(name, lambda s, d, method=method: _rounded(spatial.autocorrelation((f := vectors(s, d)), spatial.knn_edges(f.cells, "x", "y", 10), method), "score"), f"WITH {_E4}, {knn}, {zs} SELECT gene, round({expr}, 6) AS score FROM sp JOIN zz USING (gene)")
    pairs = "pr AS (SELECT gene, value AS x, cells.x AS y FROM e JOIN cells USING (cell) WHERE gene > 0), md AS (SELECT gene, median(x) AS mx, median(y) AS my FROM pr GROUP BY 1), ma AS (SELECT gene, median(abs(x - mx)) AS ax, median(abs(y - my)) AS ay FROM pr JOIN md USING (gene) GROUP BY 1), uv AS (SELECT gene, CASE WHEN abs((x - mx) / (9 * ax)) < 1 THEN (x - mx) * (1 - ((x - mx) / (9 * ax)) ** 2) ** 2 ELSE 0 END AS tx, CASE WHEN abs((y - my) / (9 * ay)) < 1 THEN (y - my) * (1 - ((y - my) / (9 * ay)) ** 2) ** 2 ELSE 0 END AS ty FROM pr JOIN md USING (gene) JOIN ma USING (gene))"
    _add("biweight_midcorrelation", lambda s, d: _rounded(biweight_midcorrelation(_against_first(s, d), ["gene"], "value", "x"), "bicor"), f"WITH {_E4}, {pairs} SELECT gene, round(sum(tx * ty) / sqrt(sum(tx * tx) * sum(ty * ty)), 6) AS bicor FROM uv GROUP BY 1")
    own = "md AS (SELECT gene, median(value) AS m FROM e GROUP BY 1), ma AS (SELECT gene, median(abs(value - m)) AS a FROM e JOIN md USING (gene) GROUP BY 1), u AS (SELECT gene, a, value - m AS x, ((value - m) / (9 * a)) ** 2 AS u FROM e JOIN md USING (gene) JOIN ma USING (gene))"
    mid = "count(*) * sum(CASE WHEN u < 1 THEN x * x * (1 - u) ** 4 ELSE 0 END) / sum(CASE WHEN u < 1 THEN (1 - u) * (1 - 5 * u) ELSE 0 END) ** 2"
    _add("median_absolute_deviation", lambda s, d: _rounded(median_absolute_deviation(vectors(s, d).expr, ["gene"], "value"), "mad"), f"WITH {_E4}, {own} SELECT gene, round(a, 6) AS mad FROM ma")
    _add("biweight_midvariance", lambda s, d: _rounded(biweight_midvariance(vectors(s, d).expr, ["gene"], "value"), "midvariance"), f"WITH {_E4}, {own} SELECT gene, round({mid}, 6) AS midvariance FROM u GROUP BY 1")
    _add("biweight_scale", lambda s, d: _rounded(biweight_scale(vectors(s, d).expr, ["gene"], "value"), "scale"), f"WITH {_E4}, {own} SELECT gene, round(sqrt({mid}), 6) AS scale FROM u GROUP BY 1")
    both = "md2 AS (SELECT gene, median(x) AS mx, median(y) AS my FROM pr GROUP BY 1), ma2 AS (SELECT gene, median(abs(x - mx)) AS ax, median(abs(y - my)) AS ay FROM pr JOIN md2 USING (gene) GROUP BY 1), w AS (SELECT gene, x - mx AS x, y - my AS y, ((x - mx) / (9 * ax)) ** 2 AS u, ((y - my) / (9 * ay)) ** 2 AS v FROM pr JOIN md2 USING (gene) JOIN ma2 USING (gene))"
    _add("biweight_midcovariance", lambda s, d: _rounded(biweight_midcovariance(_against_first(s, d), ["gene"], "value", "x"), "midcovariance"), f"WITH {_E4}, {pairs.split(', md AS')[0]}, {both} SELECT gene, round(count(*) * sum(CASE WHEN u < 1 AND v < 1 THEN x * (1 - u) ** 2 * y * (1 - v) ** 2 ELSE 0 END) / (sum(CASE WHEN u < 1 THEN (1 - u) * (1 - 5 * u) ELSE 0 END) * sum(CASE WHEN v < 1 THEN (1 - v) * (1 - 5 * v) ELSE 0 END)), 6) AS midcovariance FROM w GROUP BY 1")
    _add("biweight_location", lambda s, d: _rounded(biweight_location(vectors(s, d).expr, ["gene"], "value"), "location"), f"WITH {_E4}, md AS (SELECT gene, median(value) AS m FROM e GROUP BY 1), ma AS (SELECT gene, any_value(m) AS m, median(abs(value - m)) AS a FROM e JOIN md USING (gene) GROUP BY 1), u AS (SELECT gene, m, value - m AS x, CASE WHEN abs((value - m) / (6 * a)) < 1 THEN (1 - ((value - m) / (6 * a)) ** 2) ** 2 ELSE 0 END AS w FROM e JOIN ma USING (gene)) SELECT gene, round(any_value(m) + sum(w * x) / sum(w), 6) AS location FROM u GROUP BY 1")
    _add("spearman_pairs", lambda s, d: _rounded(spearman(_against_first(s, d), ["gene"], "value", "x"), "rho"), f"WITH {_E4}, rk AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY gene ORDER BY cells.x) + (count(*) OVER (PARTITION BY gene, cells.x) - 1) / 2 AS ry FROM e JOIN cells USING (cell) WHERE gene > 0) SELECT gene, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY 1")
    logs = "n AS (SELECT cell, gene, log2(value / s * 1e6 + 1) AS value FROM e JOIN s USING (cell)), nd AS (SELECT cell, gene, coalesce(n.value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN n USING (cell, gene)), mo AS (SELECT gene, avg(value) AS mean, var_pop(value) AS variance FROM nd GROUP BY 1)"
    cut = """p AS (SELECT gene, CASE WHEN mean = 0 THEN 0 ELSE variance / mean END AS score, ((rank() OVER (ORDER BY mean) - 1) * 2 + count(*) OVER (PARTITION BY mean) + 1) * 50.0::DOUBLE / count(*) OVER () AS p FROM mo), r AS (SELECT *, min(p) OVER () AS low, max(p) OVER () AS high FROM p),
        b AS (SELECT gene, score, greatest(1, len(list_filter(range(4), lambda i: low + i * ((high - low) / 4) < p))) AS bin FROM r), zz AS (SELECT gene, coalesce(CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 0) AS z FROM b WINDOW w AS (PARTITION BY bin)), kept AS (SELECT gene FROM zz ORDER BY round(z, 9) DESC, gene LIMIT 7)"""
    _add("pipeline_with_a_cut", lambda s, d: _values(pipeline.run(brands(s, d), [("normalize", {}), ("log", {}), ("variable_genes", {"n_genes": 7, "n_groups": 4}), ("standardize", {})]), zeros=True), f"WITH {_E1}, {sums}, {logs}, {cut} SELECT cell, gene, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS value FROM nd WHERE gene IN (SELECT gene FROM kept) WINDOW w AS (PARTITION BY gene)")
    _add("pipeline_dropout_curve", lambda s, d: _values(pipeline.run(parts(s, d), [("dropout_genes", {"n_genes": None, "x_offset": 4.0}), ("binarize", {"threshold": 30})])), f"WITH {_E3}, {drop} SELECT cell, gene, 1.0::DOUBLE AS value FROM e WHERE value >= 30 AND gene IN (SELECT gene FROM st WHERE zero_rate > exp(-(mean_expr - 4.0)) + 0.02)")
    _add("default_pipeline", lambda s, d: _values(pipeline.run(brands(s, d)), zeros=True), f"WITH {_E1}, {sums}, n AS (SELECT cell, gene, log2(value / s * 1e6 + 1) AS value FROM e JOIN s USING (cell)), {z.replace('FROM dense', 'FROM (SELECT cell, gene, coalesce(n.value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN n USING (cell, gene))')} SELECT cell, gene, round(value, 6) AS value FROM z")


def _against_first(spark: SparkSession, d: str) -> DataFrame:
    f = vectors(spark, d)
    return f.expr.filter("gene > 0").join(f.cells.select("cell", "x"), "cell")


def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Counts written as a table of genes in rows, and read again."""
    f = brands(spark, d)
    path = write_genes_in_rows(f, f"{shared_path(spark, "files")}/counts.tsv")
    return _values(readers.read_expression(spark, path))


def read_mtx(spark: SparkSession, d: str) -> DataFrame:
    """Counts written as a MatrixMarket triple, and read again."""
    f, folder = parts(spark, d), shared_path(spark, "files")
    n_genes, n_cells, n = f.genes.agg(F.max("gene")).first()[0] + 1, f.cells.agg(F.max("cell")).first()[0] + 1, f.expr.count()
    write_lines(f.expr, [], F.concat_ws(" ", F.col("gene") + 1, F.col("cell") + 1, F.col("value")), ["%%MatrixMarket matrix coordinate real general", f"{n_genes} {n_cells} {n}"], f"{folder}/matrix.mtx")
    for name, letter, many in (("genes.tsv", "g", n_genes), ("barcodes.tsv", "c", n_cells)):
        spark.range(0, many).select(F.concat(F.lit(letter), "id").alias("value")).write.text(f"{folder}/{name}")
    return _values(readers.read_mtx(spark, folder))


def canonical_components(spark: SparkSession, d: str) -> DataFrame:
    """(cell, component, value) of two halves of the cells over the brands."""
    f = brands(spark, d)
    halves = [f.keep_cells(f.cells.filter(f"cell % 2 = {i}")) for i in (0, 1)]
    _, places = alignment.canonical_components(halves, 3)
    return _rounded(places[0].unionByName(places[1]), "value", digits=4)


def top_genes(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: counts to log2 CPM, dispersion of each gene, the five largest."""
    f = transforms.log_scale(transforms.normalize_cells(brands(spark, d)))
    return scoring.top_genes(scoring.score_genes(f).select("gene", "dispersion"), "dispersion").select("gene", F.round("dispersion", 6).alias("dispersion"))


_register()
