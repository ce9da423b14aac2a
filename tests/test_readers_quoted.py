import csv
import io
import random

import numpy as np
import pytest

from cellsail.sources import readers


def split_small(spark, size=300):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    return before


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,"g,1",g2\n"c1",1,2\n"c,2",3,4\n')
    f = readers.read_delimited(spark, str(tmp_path / "q.csv"), genes_in_rows=False)
    assert {tuple(r) for r in f.expr.collect()} == {("c1", "g,1", 1.0), ("c1", "g2", 2.0), ("c,2", "g,1", 3.0), ("c,2", "g2", 4.0)}
    raw = readers.read_delimited(spark, str(tmp_path / "q.csv"), genes_in_rows=False, quote=None)
    assert '"c1"' in {r["cell"] for r in raw.cells.collect()}
    (tmp_path / "open.csv").write_text('id,a\n"c1,1\nc2,2\n')
    with pytest.raises(readers.ReadError):
        readers.read_delimited(spark, str(tmp_path / "open.csv"))


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(['a', 'b', ',', '"', "\n", "\t", "é", " "]) for _ in range(rng.randint(0, 8)))
    rows = [[f"r{i}", word(), word(), str(i)] for i in range(300)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["id", "x,1", "y", "n"], *rows])
    blank = text.getvalue().replace("\nr5", "\n\n  \nr5", 1)
    (tmp_path / "t.csv").write_bytes(blank.encode())
    before = split_small(spark)
    try:
        got = readers.read_table(spark, str(tmp_path / "t.csv"))
        assert got.columns == ["i", "id", "x,1", "y", "n"]
        found = [list(r)[1:] for r in sorted(got.collect(), key=lambda r: r["i"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == rows


def test_names_are_made_unique(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("id\ta\ta\tb\nx\t1\t2\t3\ny\t7\t8\t9\nx\t4\t5\t6\n")
    f = readers.read_delimited(spark, str(tmp_path / "d.tsv"), genes_in_rows=False)
    assert {tuple(r) for r in f.expr.filter("cell <> 'y'").collect()} == {("x", "a", 1.0), ("x", "a.1", 2.0), ("x", "b", 3.0), ("x.2", "a", 4.0), ("x.2", "a.1", 5.0), ("x.2", "b", 6.0)}
    assert sorted(r["cell"] for r in f.cells.collect()) == ["x", "x.2", "y"]


def test_many_blank_lines(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("id\ta\n" + "".join(f"r{i}\t{i}\n" + "\n" * (i % 3) for i in range(1, 200)))
    f = readers.read_delimited(spark, str(tmp_path / "b.tsv"))
    assert {(r["gene"], r["row_idx"]) for r in f.genes.collect()} == {(f"r{i}", i - 1) for i in range(1, 200)}


@pytest.mark.parametrize(("percent", "of_width"), [(40, 50), (100, 50), (0, 50), (30, None), (30, 100)])
def test_sampled_rows_follow_one_stream(spark, tmp_path, monkeypatch, percent, of_width):
    n, width = 900, 10
    (tmp_path / "s.tsv").write_text("\t".join(["id", *[f"c{i}" for i in range(width - 1)]]) + "\n" + "".join(f"r{i}\t" + "\t".join(["1"] * (width - 1)) + "\n" for i in range(n)))
    monkeypatch.setattr(readers, "DRAWS", 64)
    before = split_small(spark, 2000)
    try:
        f = readers.read_delimited(spark, str(tmp_path / "s.tsv"), rows_percent=percent, columns_percent=of_width)
        got = {int(r["gene"][1:]) for r in f.genes.collect()}
        columns = {r["col_idx"] for r in f.cells.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rng = np.random.RandomState(readers.SAMPLE_SEED)
    of_columns = rng.uniform(0, 100, width - 4) <= 50 if of_width == 50 else np.ones(width - 4, dtype=bool)
    of_rows = rng.uniform(0, 100, n + 1 - 4) <= percent
    assert columns == {j - 1 for j in range(1, width) if j < 4 or of_columns[j - 4]}
    assert got == {i for i in range(n) if i + 1 < 4 or of_rows[i + 1 - 4]}


@pytest.mark.parametrize(("genes", "cells"), [(50, None), (None, 50), (40, 60)])
def test_sampled_triples(spark, tmp_path, genes, cells):
    n_genes, n_cells = 30, 40
    entries = [(g, c) for g in range(n_genes) for c in range(n_cells) if (g + c) % 3 == 0]
    (tmp_path / "matrix.mtx").write_text(f"%%MatrixMarket\n{n_genes} {n_cells} {len(entries)}\n" + "".join(f"{g + 1} {c + 1} 2\n" for g, c in entries))
    (tmp_path / "genes.tsv").write_text("".join(f"g{i}\n" for i in range(n_genes)))
    (tmp_path / "barcodes.tsv").write_text("".join(f"c{i}\n" for i in range(n_cells)))
    f = readers.read_mtx(spark, str(tmp_path), rows_percent=genes, columns_percent=cells)
    rng = np.random.RandomState(readers.SAMPLE_SEED)
    if genes:
        rng.uniform(0, 100, n_cells - 4)
    kept_cells = {*range(4), *(np.flatnonzero(rng.uniform(0, 100, n_cells - 4) <= cells) + 4)} if cells else set(range(n_cells))
    kept_genes = {*range(4), *(np.flatnonzero(rng.uniform(0, 100, n_genes - 4) <= genes) + 4)} if genes else set(range(n_genes))
    assert {r["cell"] for r in f.cells.collect()} == {f"c{i}" for i in kept_cells} and {r["gene"] for r in f.genes.collect()} == {f"g{i}" for i in kept_genes}
    assert {(r["gene"], r["cell"]) for r in f.expr.collect()} == {(f"g{g}", f"c{c}") for g, c in entries if g in kept_genes and c in kept_cells}
