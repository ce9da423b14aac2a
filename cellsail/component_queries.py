"""Queries of components, batch mixing and alignment over the driver's tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsail.frame import from_long
from cellsail.operators import align, alignment, display, harmony, principal
from cellsail.queries import _E1, _E3, _E4, Query, _rounded, _values, brands, parts, vectors
from cellsail.sources import readers
from cellsail.sources.writers import write_lines
from cellsail.tables import shared_path

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def principal_first(spark: SparkSession, d: str) -> DataFrame:
    """(gene, weight, deviation) of the first principal component of the brands."""
    found = principal.principal_components(brands(spark, d), 3)
    rows = [(g, float(w), float(found.deviations[0])) for g, w in zip(found.genes, found.weights[:, 0])]
    return _rounded(spark.createDataFrame(rows, "gene string, weight double, deviation double"), "weight", "deviation", digits=5)


def _first_component_sql(squarings: int = 14) -> str:
    """A high power of the genes' covariance has the first component in each column; it comes from repeated squaring."""
    power = ["p0 AS MATERIALIZED (SELECT a.gene AS i, b.gene AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.cell = b.cell GROUP BY ALL)"]
    for k in range(squarings):
        power.append(f"q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k} a JOIN p{k} b ON a.j = b.i GROUP BY ALL), p{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM q{k}) AS v FROM q{k})")
    return f"""WITH {_E1}, z AS MATERIALIZED (SELECT cell, gene, value - avg(value) OVER (PARTITION BY gene) AS z FROM dense), {", ".join(power)},
        best AS (SELECT j FROM p{squarings} GROUP BY j ORDER BY sum(v * v) DESC LIMIT 1),
        w AS (SELECT i AS gene, v / sqrt(sum(v * v) OVER ()) AS w FROM p{squarings} WHERE j = (SELECT j FROM best)),
        s AS (SELECT CASE WHEN arg_max(w, abs(w)) < 0 THEN -1 ELSE 1 END AS s FROM w), l AS (SELECT sqrt(sum(a.w * v * b.w)) AS l FROM p0 JOIN w a ON a.gene = i JOIN w b ON b.gene = j)
        SELECT gene, round(w * s, 5) AS weight, round(l, 5) AS deviation FROM w CROSS JOIN s CROSS JOIN l"""


def canonical_first(spark: SparkSession, d: str) -> DataFrame:
    """(set, gene, weight, correlation) of the first canonical component of two halves of the suppliers."""
    f = brands(spark, d)
    found, _ = alignment.canonical_components([f.keep_cells(f.cells.filter(f"cell % 2 = {i}")) for i in (0, 1)], 2)
    rows = [(i, g, float(x), float(found.correlations[0])) for i, w in enumerate(found.weights) for g, x in zip(found.genes, w[:, 0])]
    return _rounded(spark.createDataFrame(rows, "set int, gene string, weight double, correlation double"), "weight", "correlation", digits=5)


def _first_canonical_sql(squarings: int = 14) -> str:
    """A high power of Y'Y X'X has the first set's weights in each column."""
    power = ["p0 AS MATERIALIZED (SELECT b.i, a.j, sum(b.v * a.v) AS v FROM gb b JOIN ga a ON b.j = a.i GROUP BY ALL)"]
    for k in range(squarings):
        power.append(f"q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k} a JOIN p{k} b ON a.j = b.i GROUP BY ALL), p{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM q{k}) AS v FROM q{k})")
    return f"""WITH {_E1}, z AS MATERIALIZED (SELECT cell, cell % 2 AS part, gene, CASE WHEN stddev_pop(value) OVER w > 1e-8 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z FROM dense WINDOW w AS (PARTITION BY gene, cell % 2)),
        g AS MATERIALIZED (SELECT a.part, a.gene AS i, b.gene AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.cell = b.cell GROUP BY ALL), ga AS (SELECT i, j, v FROM g WHERE part = 0), gb AS (SELECT i, j, v FROM g WHERE part = 1), {", ".join(power)},
        best AS (SELECT j FROM p{squarings} GROUP BY j ORDER BY sum(v * v) DESC LIMIT 1), r AS MATERIALIZED (SELECT i, v FROM p{squarings} WHERE j = (SELECT j FROM best)),
        au AS (SELECT ga.i, sum(ga.v * r.v) AS v FROM ga JOIN r ON ga.j = r.i GROUP BY 1), l AS (SELECT sqrt(sum(r.v * au.v)) * CASE WHEN arg_max(r.v, abs(r.v)) < 0 THEN -1 ELSE 1 END AS l FROM r JOIN au ON r.i = au.i),
        u AS MATERIALIZED (SELECT i, v / l AS v FROM r CROSS JOIN l), su AS MATERIALIZED (SELECT i, v / l AS v FROM au CROSS JOIN l),
        bsu AS MATERIALIZED (SELECT gb.i, sum(gb.v * su.v) AS v FROM gb JOIN su ON gb.j = su.i GROUP BY 1), sg AS (SELECT sqrt(sum(su.v * bsu.v)) AS s FROM su JOIN bsu ON su.i = bsu.i),
        c AS (SELECT corr(su.v, bsu.v) AS c FROM su JOIN bsu ON su.i = bsu.i)
        SELECT CAST(part AS INTEGER) AS set, gene, round(w, 5) AS weight, round(c, 5) AS correlation FROM (SELECT 0 AS part, i AS gene, v AS w FROM u UNION ALL SELECT 1, i, v / s FROM su CROSS JOIN sg) CROSS JOIN c"""


def harmony_pcs(spark: SparkSession, d: str) -> DataFrame:
    """The components of the embeddings, with labels as batches; few turns, as each is some jobs."""
    settings = harmony.Settings(clusters=4, rounds=2, inner=2, block_size=0.5)
    out = harmony.harmony(vectors(spark, d), ["label"], 8, settings)
    return _rounded(out.drop("x", "y"), *[f"PC{i + 1}" for i in range(8)])


def _two_sets(spark: SparkSession, d: str):
    """Embeddings of even and of odd labels, and their first two numbers as places on two components."""
    f = vectors(spark, d)
    frames = [f.keep_cells(f.cells.filter(f"label % 2 = {i}")) for i in (0, 1)]
    return frames, [x.expr.filter("gene < 2").select("cell", F.col("gene").alias("component"), "value") for x in frames]


def _chosen(frames, places, n: int = 6) -> DataFrame:
    return align.metagenes([align.gene_scores(f, p) for f, p in zip(frames, places)], n)


def metagene_rank(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(*_two_sets(spark, d))


def component_spearman(spark: SparkSession, d: str) -> DataFrame:
    frames, places = _two_sets(spark, d)
    return _rounded(align.gene_scores(frames[0], places[0], "spearman"), "score")


def shared_correlation(spark: SparkSession, d: str) -> DataFrame:
    frames, places = _two_sets(spark, d)
    return _rounded(align.shared_correlation(frames, places, _chosen(frames, places)), "shared")


def component_bicor(spark: SparkSession, d: str) -> DataFrame:
    frames, places = _two_sets(spark, d)
    return _rounded(align.gene_scores(frames[1], places[1], "bicor"), "score")


def metagene_projection(spark: SparkSession, d: str) -> DataFrame:
    """Both sets on two metagenes, the second brought to the range and deciles of the first."""
    frames, places = _two_sets(spark, d)
    chosen = _chosen(frames, places)
    first, other = (align.reference_range(align.projected(f, p, chosen)) for f, p in zip(frames, places))
    return _rounded(first.unionByName(align.quantile_shift(first, other)), "value", digits=5)


def align_sources(spark: SparkSession, d: str) -> DataFrame:
    """The whole alignment of two halves of the suppliers over the brands."""
    f = brands(spark, d)
    halves = from_long(f.expr, f.cells.withColumn("half", F.when(F.col("cell") % 3 == 0, "a").otherwise("b")), f.genes)
    return _rounded(align.fit_alignment(halves, "half", 3, 8).transform(halves), "value", digits=4)


def display_sample(spark: SparkSession, d: str) -> DataFrame:
    return display.display_sample(parts(spark, d), 500)


def value_density(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(display.density(display.display_values(brands(spark, d)), "value", 200), "x", "density", digits=7)


def _quoted(x) -> Column:
    return F.concat(F.lit('"'), F.replace(x.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def _written_wide(spark: SparkSession, d: str) -> str:
    """One row a supplier, in their order, and one column a brand, with a separator, a quote and a line break in the names."""
    f = brands(spark, d)
    genes = [r[0] for r in f.genes.orderBy("gene").collect()]
    rows = f.cells.select("cell").join(f.expr, "cell", "left").groupBy("cell").pivot("gene", genes).agg(F.first("value"))
    line = F.concat_ws(",", _quoted(F.concat(F.lit('"s"\n'), "cell")), *[_quoted(F.coalesce(F.col(f"`{g}`"), F.lit(0.0))) for g in genes])
    head = F.concat_ws(",", *[_quoted(F.lit(x)) for x in ["id, quoted", *(g.replace("#", ',"') for g in genes)]])
    return write_lines(rows, ["cell"], line, spark.range(1).select(head.alias("value")), f"{shared_path(spark, 'files')}/wide.csv")


def read_csv_quoted(spark: SparkSession, d: str) -> DataFrame:
    return _values(readers.read_delimited(spark, _written_wide(spark, d), genes_in_rows=False))


#: Share of rows that read_sample takes.
_PERCENT = 30.0


def read_sample(spark: SparkSession, d: str) -> DataFrame:
    f = readers.read_delimited(spark, _written_wide(spark, d), genes_in_rows=False, rows_percent=_PERCENT)
    return _values(f)


def _kept_places(n: int = 1000) -> str:
    """Places in the file, from 0 with the header, that the reader's stream of draws keeps: the first four, and those whose draw is low enough."""
    drawn = np.random.RandomState(readers.SAMPLE_SEED).uniform(0, 100, n)
    return ", ".join(str(i) for i in [*range(readers.ALWAYS_KEPT), *(np.flatnonzero(drawn <= _PERCENT) + readers.ALWAYS_KEPT)])


_SETS = f"""{_E4.replace("CAST(unnest(embedding) AS DOUBLE) AS value, label", "CAST(unnest(embedding) AS DOUBLE) AS value, label % 2 AS part, label")},
p AS (SELECT cell, part, gene AS component, value AS w FROM e WHERE gene < 2),
sc AS (SELECT e.part, e.gene, component, sum(value * w) AS s, sum(value * w) / sqrt(sum(value * value)) AS score FROM e JOIN p ON e.cell = p.cell GROUP BY ALL),
rk AS (SELECT a.component, a.gene, CAST(row_number() OVER (PARTITION BY a.component ORDER BY CASE WHEN sign(a.score) = sign(b.score) THEN 0 ELSE 1 END, least(abs(a.score), abs(b.score)) DESC, a.gene) AS INTEGER) AS rank
  FROM sc a JOIN sc b ON a.gene = b.gene AND a.component = b.component AND a.part = 0 AND b.part = 1),
ch AS (SELECT * FROM rk WHERE rank <= 6)"""
_BICOR = """pr AS (SELECT e.part, e.gene, component, value AS x, w AS y FROM e JOIN p ON e.cell = p.cell),
md AS (SELECT part, gene, component, median(x) AS mx, median(y) AS my FROM pr GROUP BY ALL),
ma AS (SELECT part, gene, component, any_value(mx) AS mx, any_value(my) AS my, median(abs(x - mx)) AS ax, median(abs(y - my)) AS ay FROM pr JOIN md USING (part, gene, component) GROUP BY ALL),
tt AS (SELECT part, gene, component, CASE WHEN abs((x - mx) / (9 * ax)) < 1 THEN (x - mx) * (1 - ((x - mx) / (9 * ax)) ** 2) ** 2 ELSE 0 END AS a, CASE WHEN abs((y - my) / (9 * ay)) < 1 THEN (y - my) * (1 - ((y - my) / (9 * ay)) ** 2) ** 2 ELSE 0 END AS b FROM pr JOIN ma USING (part, gene, component)),
bc AS (SELECT part, gene, component, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS score FROM tt GROUP BY ALL)"""
_PHI = """f AS (SELECT e.part, cell, component, sum(value * s) AS v FROM e JOIN ch USING (gene) JOIN sc USING (part, gene, component) GROUP BY ALL),
q AS (SELECT part, component, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM f GROUP BY ALL),
r AS (SELECT part, cell, component, (v - lo) / (hi - lo) AS v FROM f JOIN q USING (part, component)),
t AS (SELECT part, component, z, quantile_cont(v, 0.1) FILTER (z = 1) AS d1, quantile_cont(v, 0.2) FILTER (z = 2) AS d2, quantile_cont(v, 0.3) FILTER (z = 3) AS d3, quantile_cont(v, 0.4) FILTER (z = 4) AS d4, quantile_cont(v, 0.5) FILTER (z = 5) AS d5, quantile_cont(v, 0.6) FILTER (z = 6) AS d6,
  quantile_cont(v, 0.7) FILTER (z = 7) AS d7, quantile_cont(v, 0.8) FILTER (z = 8) AS d8, quantile_cont(v, 0.9) FILTER (z = 9) AS d9 FROM r CROSS JOIN (SELECT unnest(range(1, 10)) AS z) GROUP BY ALL),
dc AS (SELECT part, component, z, coalesce(d1, d2, d3, d4, d5, d6, d7, d8, d9) AS dec FROM t),
sh AS (SELECT a.component, min(abs(a.dec - b.dec)) AS shift FROM dc a JOIN dc b ON a.component = b.component AND a.z = b.z AND a.part = 0 AND b.part = 1 GROUP BY 1)"""

for _name, _query, _sql in (
    ("principal_first", principal_first, _first_component_sql()),
    ("canonical_first", canonical_first, _first_canonical_sql()),
    ("harmony_pcs", harmony_pcs, None),
    ("metagene_rank", metagene_rank, f"WITH {_SETS} SELECT component, gene, rank FROM ch"),
    ("component_spearman", component_spearman, f"WITH {_SETS}, pr AS (SELECT e.gene, component, value AS x, w AS y FROM e JOIN p ON e.cell = p.cell WHERE e.part = 0), rr AS (SELECT gene, component, rank() OVER (PARTITION BY gene, component ORDER BY x) + (count(*) OVER (PARTITION BY gene, component, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY gene, component ORDER BY y) + (count(*) OVER (PARTITION BY gene, component, y) - 1) / 2 AS ry FROM pr) SELECT gene, component, round(corr(rx, ry), 6) AS score FROM rr GROUP BY ALL"),
    ("component_bicor", component_bicor, f"WITH {_SETS}, {_BICOR} SELECT gene, component, round(score, 6) AS score FROM bc WHERE part = 1"),
    ("shared_correlation", shared_correlation, f"WITH {_SETS}, {_BICOR} SELECT part AS dataset, component, round(avg(abs(score)), 6) AS shared FROM bc JOIN ch USING (gene, component) GROUP BY ALL"),
    ("metagene_projection", metagene_projection, f"WITH {_SETS}, {_PHI} SELECT cell, component, round(v + CASE WHEN part = 1 THEN shift ELSE 0 END, 5) AS value FROM r JOIN sh USING (component)"),
    ("align_sources", align_sources, None),
    ("display_sample", display_sample, f"WITH {_E3}, h AS (SELECT cell, gene, value, CAST('0x' || substr(md5(cell || ':' || gene), 1, 13) AS BIGINT) AS hash, cell || ':' || gene AS pair FROM e WHERE value <> 0), r AS (SELECT *, row_number() OVER (ORDER BY value, hash, pair) AS up, row_number() OVER (ORDER BY value DESC, hash DESC, pair DESC) AS down FROM h), k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN up = 1 OR down = 1 THEN 0 ELSE 1 END, hash, pair) AS i FROM r) SELECT cell, gene, value FROM k WHERE i <= 500"),
    ("value_density", value_density, f"WITH {_E1}, v AS (SELECT value FROM e WHERE value <> 0), s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2::DOUBLE) AS h FROM v), g AS (SELECT CAST(p AS INTEGER) AS place, lo - 0.025::DOUBLE * (hi - lo) + p * (1.05::DOUBLE * (hi - lo)) / 199 AS x, n, h FROM s CROSS JOIN (SELECT unnest(range(200)) AS p)) SELECT place, round(x, 7) AS x, round(sum(exp(-0.5::DOUBLE * ((x - value) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 7) AS density FROM g CROSS JOIN v GROUP BY place, x"),
    ("read_csv_quoted", read_csv_quoted, f"""WITH {_E1} SELECT '"s"' || chr(10) || cell AS cell, replace(gene, '#', ',"') AS gene, round(value, 6) AS value FROM e WHERE value <> 0"""),
    ("read_sample", read_sample, f"""WITH {_E1}, o AS (SELECT cell, row_number() OVER (ORDER BY cell) AS place FROM cells) SELECT '"s"' || chr(10) || cell AS cell, replace(gene, '#', ',"') AS gene, round(value, 6) AS value FROM e JOIN o USING (cell) WHERE value <> 0 AND place IN ({_kept_places()})"""),
):
    QUERIES[_name] = _query
    if _sql:
        SQL[_name] = _sql
