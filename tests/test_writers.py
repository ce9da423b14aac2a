import glob
import uuid

import numpy as np
import pytest

import __spark_entry__
from cellsail import component_queries, queries, reader_queries, tables
from cellsail.frame import from_long
from cellsail.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_parts(spark, tmp_path, monkeypatch):
    """Every shuffle keeps its partitions, and files go to tmp_path."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    for module in (tables, queries, component_queries, reader_queries):
        monkeypatch.setattr(module, "shared_path", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    yield tmp_path
    spark.conf.set(name, before)


def in_order(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_places_over_ranges(spark, many_parts):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 * 3 AS key", "id").repartition(5)
    got = sorted(map(tuple, writers.placed(rows, "key", "at").collect()))
    assert [x[2] for x in got] == list(range(1000)) and [x[0] for x in got] == [3 * i for i in range(1000)]
    assert writers.placed(rows.limit(0), "key", "at").collect() == []


def test_genes_in_rows(spark, many_parts):
    rng = np.random.RandomState(5)
    dense = rng.randint(1, 9, (6, 40)) * (rng.uniform(size=(6, 40)) < 0.3)
    dense[2], dense[3, [0, -1]], dense[4] = 0, 5, 7
    rows = [(j * 2, f"g{i}", float(dense[i, j])) for i in range(6) for j in range(40) if dense[i, j]]
    rows = [(c, g, None if (c, g) == (8, "g4") else v) for c, g, v in rows]
    frame = from_long(spark.createDataFrame(rows, "cell long, gene string, value double"), spark.range(0, 80, 2).toDF("cell"), spark.createDataFrame([(f"g{i}",) for i in range(6)], "gene string"))
    path = writers.write_genes_in_rows(frame, str(many_parts / "wide.tsv"), "id", "s")
    text = lambda i, j: "" if (i, j) == (4, 4) else str(float(dense[i, j])) if dense[i, j] else "0"
    assert in_order(path) == ["\t".join(["id", *[f"s{2 * j}" for j in range(40)]]), *["\t".join([f"g{i}", *[text(i, j) for j in range(40)]]) for i in range(6)]]
    got = {(int(r["cell"][1:]), r["gene"], r["value"]) for r in readers.read_delimited(spark, path).expr.collect()}
    assert got == set(rows)


@pytest.mark.parametrize(("query", "file"), [("read_triple_annotated", "matrix.mtx"), ("read_mtx", "matrix.mtx"), ("read_genotype_calls", "calls-*.vcf"), ("read_headers_labels", "headers-*.csv"), ("read_tsv", "counts.tsv"), ("read_csv_quoted", "wide.csv")])
def test_files_are_written_by_many_tasks(spark, many_parts, query, file):
    assert __spark_entry__.queries()[query](spark, SF).count() > 0
    path = next(str(p) for p in many_parts.rglob(file))
    assert len(glob.glob(f"{path}/part-*")) > 2


@pytest.mark.parametrize("query", ["read_count_annotated", "read_tsv"])
def test_no_column_a_cell(spark, many_parts, monkeypatch, query):
    from pyspark.sql import GroupedData

    def pivot(*_):
        raise AssertionError("a column a cell")

    monkeypatch.setattr(GroupedData, "pivot", pivot)
    assert __spark_entry__.queries()[query](spark, SF).count() > 0


def test_headers_of_a_wide_file_stay_on_tasks(spark, tmp_path, monkeypatch):
    n = 3000
    (tmp_path / "w.tsv").write_text("\t".join(["id", "kind", *[f"c{i % 2000}" for i in range(n)]]) + "\n" + "\t".join(["", "", *map(str, range(n - 1))]) + "\n" + "\t".join(["g", "k", *["1"] * n]) + "\n")
    monkeypatch.setattr(readers, "MAX_BROADCAST", 100)
    f = readers.read_delimited(spark, str(tmp_path / "w.tsv"), n_headers=2, n_labels=2)
    assert {(r["cell"], r["col_idx"], r["header_2"]) for r in f.cells.collect()} == {(f"c{i}" if i < 2000 else f"c{i - 2000}.1", i, str(i) if i < n - 1 else None) for i in range(n)}
    assert f.expr.count() == n and f.genes.first()["kind"] == "k"
