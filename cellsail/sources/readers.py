"""Expression files as frames: delimited text, MatrixMarket triples, annotations, genotype calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame, from_long
from cellsail.tables import written

#: Fixed values of the reproducible read-time sample: its seed, and the leading indices that are always kept.
SAMPLE_SEED, ALWAYS_KEPT = 0x667, 4
#: Draws that a task makes at a time.
DRAWS = 1 << 20
#: Lines that may be dropped from a file before what is left is counted up.
FEW = 50
#: Names of columns that are broadcast; more are joined as Spark chooses.
MAX_BROADCAST = 100_000
#: Stands for a separator between quotes while a record is split; no character of any text.
HELD = "\ufdd0"
#: A text column with at most so many distinct values is discrete.
MAX_DISCRETE = 50


class ReadError(ValueError):
    """The file cannot be read as what it should be."""


class InadequateHeaders(ReadError):
    """A file has fewer header rows or label columns than it was said to have."""


class AnnotationMismatch(ReadError):
    """An annotation table has another number of rows than the side it describes."""

    def __init__(self, side: str, expected: int, got: int):
        super().__init__(f"{side}: {expected} rows expected, {got} found")
        self.side, self.expected, self.got = side, expected, got


def plain_name(path: str) -> str:
    """The path without a compression suffix."""
    for suffix in (".gz", ".bz2", ".zip"):
        path = path.removesuffix(suffix)
    return path


def separator(path: str) -> str:
    return "," if plain_name(path).endswith(".csv") else "\t"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, id, value): lines with their file and split; ids ascend by one within a split."""
    m = F.col("_metadata")
    return spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(i, value): the lines of a text file that keep holds for, numbered from 0 in the order of the file.

    A line's number follows from its split's first number, one row a split, and its
    place in it, so nothing is sorted or shuffled; but if more than FEW lines are dropped, those
    kept are counted up within each split.
    """
    lines = _lines(spark, path)
    ok = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    splits = sorted((r["file"], r["start"], r["n"], r["low"], r["gone"]) for r in lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.count_if(~ok).alias("gone")).collect())
    first = np.concatenate([[0], np.cumsum([x[2] for x in splits])]).astype(int)
    shifts = spark.createDataFrame([(f, start, int(at) - low) for (f, start, _, low, _), at in zip(splits, first)], "file string, start long, shift long")
    placed = lines.join(shifts, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("i"), "value", "file", "start")
    gone = sum(x[4] for x in splits)
    if gone > FEW:
        kept = placed.filter(ok)
        before = np.concatenate([[0], np.cumsum([x[2] - x[4] for x in splits])]).astype(int)
        starts = spark.createDataFrame([(f, start, int(at)) for (f, start, *_), at in zip(splits, before)], "file string, start long, first long")
        place = F.row_number().over(Window.partitionBy("file", "start").orderBy("i")) - 1
        return kept.withColumn("place", place).join(starts, ["file", "start"]).select((F.col("first") + F.col("place")).alias("i"), "value")
    if not gone:
        return placed.select("i", "value")
    dropped = F.array(*[F.lit(r["i"]) for r in placed.filter(~ok).select("i").collect()])
    return placed.filter(ok).select((F.col("i") - F.size(F.filter(dropped, lambda x: x < F.col("i")))).alias("i"), "value")


def records(spark: SparkSession, path: str, quote: str | None = '"') -> DataFrame:
    """(i, value): the records of a text file that are not blank, numbered from 0; a quoted field may hold line breaks.

    Whether a line begins inside a field is the parity of the quotes before it, a sum over
    splits and within each. Lines of one record are put together wherever splits cut it.
    """
    blank = F.trim("value") == ""
    if not quote or spark.read.text(path).filter(F.col("value").contains(quote)).isEmpty():
        return numbered_lines(spark, path, ~blank)
    lines = _lines(spark, path).withColumn("q", F.length("value") - F.length(F.replace("value", F.lit(quote))))
    lines = written(lines, "lines")
    before, ends, shifts = 0, "", []
    for r in sorted(lines.groupBy("file", "start").agg(F.sum("q").alias("q")).collect()):
        if r["file"] != ends:
            if before % 2:
                raise ReadError(f"{ends}: a quoted field is not closed")
            before, ends = 0, r["file"]
        shifts.append((r["file"], r["start"], before % 2))
        before += r["q"]
    if before % 2:
        raise ReadError(f"{ends}: a quoted field is not closed")
    w = Window.partitionBy("file", "start").orderBy("id")
    own = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("own", own).join(spark.createDataFrame(shifts, "file string, start long, open int"), ["file", "start"])
    inside = (F.col("own") + F.col("open")) % 2 == 1
    lines = written(lines.select("file", "start", "id", "value", "q", inside.alias("inside"), (~inside & ~((F.col("q") == 0) & blank)).alias("begins")), "lines")
    first, starts = 0, []
    for r in sorted(lines.groupBy("file", "start").agg(F.count_if("begins").alias("n")).collect()):
        starts.append((r["file"], r["start"], first))
        first += r["n"]
    placed = lines.withColumn("own", F.count_if("begins").over(w)).join(spark.createDataFrame(starts, "file string, start long, first long"), ["file", "start"])
    placed = placed.filter("begins OR inside").withColumn("i", F.col("first") + F.col("own") - 1)
    alone = (F.col("q") % 2 == 0) & F.col("begins")
    parts = placed.filter(~alone).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("file", "start", "id", "value"))).alias("x"))
    return placed.filter(alone).select("i", "value").unionByName(parts.select("i", F.array_join(F.transform("x", lambda x: x["value"]), "\n").alias("value")))


def record_fields(value: Column, sep: str, quote: str | None = '"') -> Column:
    """The fields of a record: quotes around a field go, two within one are one, and separators between quotes are text."""
    plain = F.split(value, "\\Q" + sep + "\\E", -1)
    if not quote:
        return plain
    parts = F.split(value, "\\Q" + quote + "\\E", -1)

    def masked(x: Column, i: Column) -> Column:
        doubled = (i % 2 == 0) & (x == "") & (i > 0) & (i < F.size(parts) - 1)
        return F.when(i % 2 == 1, F.replace(x, F.lit(sep), F.lit(HELD))).when(doubled, F.lit(quote)).otherwise(x)

    joined = F.array_join(F.transform(parts, masked), "")
    free = F.transform(F.split(joined, "\\Q" + sep + "\\E", -1), lambda x: F.replace(x, F.lit(HELD), F.lit(sep)))
    return F.when(value.contains(quote), free).otherwise(plain)


def _unique(names: list[str]) -> list[str]:
    """Names with .1, .2 and on after those that came before."""
    seen, out = set(), []
    for name in names:
        new, n = name, 0
        while new in seen:
            n += 1
            new = f"{name}.{n}"
        seen.add(new)
        out.append(new)
    return out


def keep_list(rng: np.random.RandomState, n: int, percent: float) -> np.ndarray:
    """Indices of n that a sample of percent keeps: the leading ones, and others by one draw each."""
    drawn = rng.uniform(0, 100, max(0, n - ALWAYS_KEPT)) <= percent
    return np.flatnonzero(np.append(np.ones(min(n, ALWAYS_KEPT), dtype=bool), drawn))


def _sampled(percent: float | None) -> bool:
    """All of a hundred per cent is no sample, and draws nothing."""
    return percent is not None and percent < 100


def drawn_rows(body: DataFrame, percent: float, n_headers: int, drawn_before: int) -> DataFrame:
    """Rows of body(i, ...) that a sample keeps, i their place in the file: the leading ones, and others by one draw each.

    The draws are one stream of random numbers by place, after those drawn before. Each task
    goes through the stream up to its own places, so nothing a row is held or sent.
    """
    always = max(ALWAYS_KEPT, n_headers)
    at = body.columns.index("i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, pos = None, 0
        for batch in batches:
            i = batch.column(at).to_numpy()
            keep = i < always
            free = np.flatnonzero(~keep)
            order = free[np.argsort(i[free], kind="stable")]
            place = i[order] - always + drawn_before
            if len(order) and (rng is None or place[0] < pos):
                rng, pos = np.random.RandomState(SAMPLE_SEED), 0
            done = 0
            while done < len(order):
                if place[done] - pos >= DRAWS:
                    rng.random_sample(DRAWS)
                    pos += DRAWS
                    continue
                n = int(min(place[-1] - pos + 1, DRAWS))
                drawn = rng.random_sample(n) * 100 <= percent
                upto = int(np.searchsorted(place, pos + n))
                keep[order[done:upto]] = drawn[place[done:upto] - pos]
                done, pos = upto, pos + n
            yield batch.filter(pa.array(keep))

    return body.mapInArrow(work, body.schema)


def _columns(heads: DataFrame, width: int, n_headers: int, n_labels: int, percent: float | None) -> DataFrame:
    """(col, col_idx, header_2 and on) of the columns that are kept, from the header rows (i, f), which are lines of the file; without headers, positions."""
    more = [f"header_{i}" for i in range(2, n_headers + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r["f"] for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["i"])]
        if rows:
            kept = keep_list(np.random.RandomState(SAMPLE_SEED), width, percent) if _sampled(percent) else np.arange(width)
            at = [int(j) - n_labels for j in kept if j >= n_labels]
            names = _unique(rows[0][n_labels:]) if n_headers else [str(j) for j in range(width - n_labels)]
            others = [pa.array([h[j + n_labels] if j + n_labels < len(h) else None for j in at], pa.string()) for h in rows[1:n_headers]]
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in at], pa.string()), pa.array(at, pa.int32()), *others], ["col", "col_idx", *more])

    return heads.coalesce(1).mapInArrow(work, ", ".join(["col string", "col_idx int", *[f"{m} string" for m in more]]))


def read_delimited(spark: SparkSession, path: str, genes_in_rows: bool = True, sep: str | None = None, n_headers: int = 1, n_labels: int = 1, rows_percent: float | None = None, columns_percent: float | None = None, quote: str | None = '"') -> ExpressionFrame:
    """A delimited matrix; NaN and empty fields are missing, zeros are not stored.

    Fields may be quoted, with separators, line breaks and doubled quotes inside;
    quote None takes quotes as text. Of columns that share a name the later ones get
    .1, .2 and on, of rows that do, all but the first get their place in the file.

    The first of n_headers rows names the columns and the first of n_labels columns
    the rows. Further label columns become columns of the side of the rows, under
    the names of the header or label_2 and on; further header rows become columns of
    the other side, header_2 and on. Without headers or labels the names are
    positions from 0. A line of fewer fields has missing values at its end.

    rows_percent and columns_percent take a sample that is the same at every
    reading: positions in the file with its headers and labels, of which the leading
    ones are always kept. Both sides have their place in the file as row_idx or col_idx.
    """
    lines = records(spark, path, quote)
    sep = sep or separator(path)
    fields = record_fields(F.col("value"), sep, quote)
    heads = written(lines.filter(F.col("i") < max(n_headers, 1)).select("i", fields.alias("f")).repartition(1), "heads")
    known = [(r["n"], r["labels"]) for r in heads.orderBy("i").select(F.size("f").alias("n"), F.slice("f", 1, n_labels).alias("labels")).collect()]
    if len(known) < n_headers or not known or known[0][0] < n_labels:
        raise InadequateHeaders(f"{path}: {n_headers} header rows and {n_labels} label columns expected")
    width, labels = known[0]
    drawn = max(0, width - ALWAYS_KEPT) if _sampled(columns_percent) else 0
    cols = written(_columns(heads, width, n_headers, n_labels, columns_percent), "columns")
    body = lines.filter(F.col("i") >= n_headers).select("i", "value")
    if _sampled(rows_percent):
        body = drawn_rows(body, rows_percent, n_headers, drawn)
    label = F.get(fields, F.lit(0)) if n_labels else (F.col("i") - n_headers).cast("string")
    rows = body.select((F.col("i") - n_headers).alias("row_idx"), label.alias("row"), fields.alias("f"))
    if n_labels:
        twice = rows.groupBy("row").agg(F.count("*").alias("n"), F.min("row_idx").alias("first")).filter("n > 1").drop("n")
        if not twice.isEmpty():
            name = F.when(F.col("row_idx") != F.col("first"), F.concat("row", F.lit("."), F.col("row_idx"))).otherwise(F.col("row"))
            rows = rows.join(twice, "row", "left").select("row_idx", name.alias("row"), "f")
    more = [F.get("f", F.lit(j)).alias(labels[j] if n_headers and labels[j] else f"label_{j + 1}") for j in range(1, n_labels)]
    row_side = rows.select("row", "row_idx", *more)
    cells = rows.select("row", F.posexplode(F.slice("f", n_labels + 1, max(width - n_labels, 0))).alias("col_idx", "text"))
    at = cols.select("col", "col_idx")
    values = cells.join(F.broadcast(at) if width <= MAX_BROADCAST else at, "col_idx").select("row", "col", F.expr("try_cast(trim(text) AS double)").alias("value"))
    cell, gene = ("col", "row") if genes_in_rows else ("row", "col")
    expr = from_long(values.select(F.col(cell).alias("cell"), F.col(gene).alias("gene"), "value")).expr.filter("value IS NULL OR value <> 0")
    sides = {"row": row_side, "col": cols}
    return ExpressionFrame(expr, sides[cell].withColumnRenamed(cell, "cell"), sides[gene].withColumnRenamed(gene, "gene"))


def read_count(spark: SparkSession, path: str) -> ExpressionFrame:
    """A .count file, genes in rows, with the annotations of the .meta file of the same name if there is one."""
    frame = read_delimited(spark, path, sep="\t")
    meta = plain_name(path).removesuffix(".count") + ".meta"
    return annotate_cells(frame, read_table(spark, meta)) if _exists(spark, meta) else frame


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _companion(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of some files in a folder that is there, compressed or not."""
    for path in (f"{folder}/{name}{suffix}" for name in names for suffix in ("", ".gz")):
        if _exists(spark, path):
            return path
    raise ReadError(f"{folder}: none of {', '.join(names)} found")


def read_mtx(spark: SparkSession, folder: str, genes: str | None = None, barcodes: str | None = None, matrix: str | None = None, rows_percent: float | None = None, columns_percent: float | None = None) -> ExpressionFrame:
    """A 10x triple: genes are rows, cells columns, entries 1-based; the matrix is never made dense.

    rows_percent and columns_percent take a sample of genes and of cells that is the
    same at every reading: cells are drawn first, and if genes are sampled, after as many
    draws that nothing uses.

    Files not named are looked for: genes.tsv or features.tsv, barcodes.tsv and
    matrix.mtx, compressed or not. The first line that is no comment is the header,
    by its place in the file; entries that do not add up to it are an error.
    """
    path = f"{folder}/{matrix}" if matrix else _companion(spark, folder, ["matrix.mtx"])
    lines = numbered_lines(spark, path, (F.substring("value", 1, 1) != "%") & (F.trim("value") != ""))
    head = lines.filter("i = 0").first()
    try:
        n_genes, n_cells, n_entries = map(int, head["value"].split())
    except (TypeError, ValueError):
        raise InadequateHeaders(f"{path}: no line of three numbers before the entries") from None
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.filter("i > 0").select(parts[0].cast("int").alias("g"), parts[1].cast("int").alias("c"), parts[2].cast("double").alias("value"))
    if (got := entries.count()) != n_entries:
        raise ReadError(f"{path}: {n_entries} entries expected, {got} found")
    f = F.split("value", "\t")
    some = F.trim("value") != ""
    g = numbered_lines(spark, f"{folder}/{genes}" if genes else _companion(spark, folder, ["genes.tsv", "features.tsv"]), some)
    g = g.select((F.col("i") + 1).cast("int").alias("g"), f[0].alias("gene"), F.try_element_at(f, F.lit(2)).alias("symbol"))
    c = numbered_lines(spark, f"{folder}/{barcodes}" if barcodes else _companion(spark, folder, ["barcodes.tsv"]), some)
    c = c.select((F.col("i") + 1).cast("int").alias("c"), f[0].alias("cell"))
    for side, table, expected in (("genes", g, n_genes), ("cells", c, n_cells)):
        if (got := table.count()) != expected:
            raise AnnotationMismatch(side, expected, got)
    draws = max(0, n_cells - ALWAYS_KEPT)
    if _sampled(columns_percent):
        c = drawn_rows(c.withColumn("i", F.col("c").cast("long") - 1), columns_percent, 0, draws if _sampled(rows_percent) else 0).drop("i")
    if _sampled(rows_percent):
        g = drawn_rows(g.withColumn("i", F.col("g").cast("long") - 1), rows_percent, 0, draws * (2 if _sampled(columns_percent) else 1)).drop("i")
    expr = entries.join(g.select("g", "gene"), "g").join(c, "c").select("cell", "gene", "value")
    return ExpressionFrame(expr, c.select("cell", F.col("c").alias("cell_idx")), g.select("gene", "symbol", F.col("g").alias("gene_idx")))


def mtx_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row from the header alone: n_cells, n_genes and the share of pairs that are not stored."""
    head = numbered_lines(spark, path, (F.substring("value", 1, 1) != "%") & (F.trim("value") != "")).filter("i = 0")
    n = F.split(F.trim("value"), r"\s+")
    pairs = n[0].cast("double") * n[1].cast("double")
    return head.select(n[1].cast("long").alias("n_cells"), n[0].cast("long").alias("n_genes"), F.try_divide(pairs - n[2].cast("double"), pairs).alias("sparsity"))


def read_table(spark: SparkSession, path: str, sep: str | None = None, quote: str | None = '"') -> DataFrame:
    """An annotation table with a header, and the place of each row as i, from 0; fields may be quoted."""
    lines = records(spark, path, quote)
    sep = sep or separator(path)
    fields = record_fields(F.col("value"), sep, quote)
    head = lines.filter("i = 0").select(fields.alias("f")).first()
    if head is None:
        raise InadequateHeaders(f"{path}: no header")
    names = _unique([n.strip() or f"column_{j + 1}" for j, n in enumerate(head["f"])])
    return lines.filter("i > 0").select((F.col("i") - 1).alias("i"), *[F.get(fields, F.lit(j)).alias(n) for j, n in enumerate(names)])


def _annotated(side: DataFrame, name: str, table: DataFrame, label: str) -> DataFrame:
    """side with the columns of table by position; one that repeats the label goes."""
    index = next((c for c in side.columns if c in ("row_idx", "col_idx", f"{name}_idx")), None)
    if index is None:
        raise ReadError(f"the {name}s have no place in a file")
    # the places that are there, so that a sample or the numbers from 1 do not matter
    own, got = side.count(), table.count()
    if own != got:
        raise AnnotationMismatch(f"{name}s", own, got)
    base = side.agg(F.min(index)).collect()[0][0] or 0
    rows = table.withColumn("at", F.col("i") + base).drop("i")
    rows = rows.toDF(*[c if c == "at" or c not in side.columns else f"{c}_2" for c in rows.columns])
    out = side.join(rows, side[index] == rows["at"], "left").drop("at")
    same = [c for c in rows.columns if c != "at" and c == label]
    return out.drop(*same)


def annotate_cells(frame: ExpressionFrame, table: DataFrame, label: str = "cell") -> ExpressionFrame:
    """Columns of table(i, ...) for the cells, by position; another number of rows is an error."""
    return ExpressionFrame(frame.expr, _annotated(frame.cells, "cell", table, label), frame.genes)


def annotate_genes(frame: ExpressionFrame, table: DataFrame, label: str = "gene") -> ExpressionFrame:
    return ExpressionFrame(frame.expr, frame.cells, _annotated(frame.genes, "gene", table, label))


def typed(table: DataFrame, max_discrete: int = MAX_DISCRETE) -> tuple[DataFrame, dict[str, str]]:
    """table with its text columns of numbers as doubles, and the kind of each column: continuous, discrete or text.

    A column is continuous if all its values but empty ones are numbers, else
    discrete if it has at most max_discrete distinct values. One pass over the table.
    """
    text = [c for c, t in table.dtypes if t == "string"]
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS double)")
    filled = lambda c: F.trim(F.col(f"`{c}`")) != ""
    row = table.agg(F.lit(0).alias("none"), *[x for i, c in enumerate(text) for x in (F.count_if(filled(c) & number(c).isNull()).alias(f"odd{i}"), F.count_if(filled(c)).alias(f"n{i}"), F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))]).collect()[0]
    kinds = {c: "continuous" for c in table.columns if c not in text}
    out = table
    for i, c in enumerate(text):
        if row[f"odd{i}"] == 0 and row[f"n{i}"] > 0:
            kinds[c], out = "continuous", out.withColumn(c, number(c))
        else:
            kinds[c] = "discrete" if row[f"d{i}"] <= max_discrete else "text"
    return out, kinds


def read_expression(spark: SparkSession, path: str, format: str | None = None, **options) -> ExpressionFrame:
    """By extension, after a compression suffix is cut off: a .mtx file or a folder of a triple, .count, .csv, .vcf, else tab-separated."""
    name = plain_name(path.rstrip("/"))
    kind = format or next((k for k in ("mtx", "count", "csv", "vcf", "tsv", "txt", "tab") if name.endswith(f".{k}")), None) or ("mtx" if _is_folder(spark, path) else "tsv")
    readers: dict[str, Callable[..., ExpressionFrame]] = {"count": read_count, "vcf": read_genotypes, **dict.fromkeys(("csv", "tsv", "txt", "tab"), read_delimited)}
    if kind == "mtx":
        folder, _, file = path.rpartition("/") if name.endswith(".mtx") else (path, "", None)
        return read_mtx(spark, folder or ".", matrix=file, **options)
    if kind not in readers:
        raise ReadError(f"unknown format {kind!r}")
    return readers[kind](spark, path, **options)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def summary(frame: ExpressionFrame) -> DataFrame:
    """One row: n_cells, n_genes and sparsity, the share of pairs that are zero."""
    on = frame.expr.agg(F.count_if((F.col("value") != 0) | F.col("value").isNull()).alias("on"))
    sides = frame.n_cells().crossJoin(frame.genes.agg(F.count("*").alias("n_genes"))).crossJoin(on)
    return sides.select("n_cells", "n_genes", (1 - F.try_divide("on", F.col("n_cells") * F.col("n_genes"))).alias("sparsity"))


def read_genotypes(spark: SparkSession, path: str, quality: float | None = None, frequency: float | None = None) -> ExpressionFrame:
    """Calls of a VCF file: samples x variants CHROM-POS, 1 unless the genotype is 0/0.

    Calls with GQ below quality are missing; variants without a call go, and those
    whose calls sum to less than frequency.
    """
    lines = spark.read.text(path)
    names = lines.filter("value LIKE '#CHROM%'").first()[0].split("\t")[9:]
    f = F.split("value", "\t")
    calls = lines.filter("value NOT LIKE '#%'").select(F.concat_ws("-", f[0], f[1]).alias("gene"), F.split(f[8], ":").alias("keys"), F.posexplode(F.slice(f, 10, len(names))).alias("i", "call"))
    gq = F.coalesce(F.expr("try_cast(try_element_at(split(call, ':'), nullif(cast(array_position(keys, 'GQ') AS int), 0)) AS double)"), F.lit(0.0))
    value = (F.element_at(F.split("call", ":"), 1) != "0/0").cast("double")
    calls = calls.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("cell"), "gene", F.when(gq >= quality, value).alias("value") if quality is not None else value.alias("value"))
    keep = calls.groupBy("gene").agg(F.count("value").alias("n"), F.sum("value").alias("s")).filter("n > 0")
    keep = keep.filter(F.col("s") >= frequency) if frequency is not None else keep
    out = from_long(calls.join(keep.select("gene"), "gene", "left_semi"))
    return out
