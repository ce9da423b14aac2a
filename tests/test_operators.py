import gzip

import numpy as np
import pytest

from cellsail.frame import from_long
from cellsail.operators import alignment, batch, clusters, filters, scoring, selection, spatial, stack, transforms
from cellsail.plans import pipeline
from cellsail.sources import readers


def frame(spark, rows, cells=None):
    data = [(i, j, None if v is None else float(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v is None or v != 0]
    names = spark.createDataFrame(cells or [(i,) for i in range(len(rows))], "cell int" if cells is None else "cell int, label int")
    return from_long(spark.createDataFrame(data, "cell int, gene int, value double"), names, spark.createDataFrame([(j,) for j in range(len(rows[0]))], "gene int"))


def matrix(f, shape):
    out = np.zeros(shape)
    for r in f.expr.collect():
        out[r["cell"], r["gene"]] = np.nan if r["value"] is None else r["value"]
    return out


def counts(seed, shape, missing=()):
    x = np.random.default_rng(seed).poisson(2.0, shape).astype(float)
    for at in missing:
        x[at] = np.nan
    return x


def as_rows(x):
    return [[None if np.isnan(v) else float(v) for v in r] for r in x]


def test_log_and_binarize(spark):
    x = counts(1, (5, 4))
    f = frame(spark, as_rows(x))
    assert np.allclose(matrix(transforms.log_scale(f), x.shape), np.log2(1 + x))
    assert np.allclose(matrix(transforms.log_scale(f, None), x.shape), np.log1p(x))
    assert np.array_equal(matrix(transforms.binarize(f, 2), x.shape), x >= 2)
    assert np.array_equal(matrix(transforms.binarize(f, 2, strict=True), x.shape), x > 2)
    assert matrix(transforms.binarize(f, 0), x.shape).all()


def test_normalize(spark):
    x = counts(2, (6, 5), [(2, 3)]) + 0.5
    f = frame(spark, as_rows(x))
    total = np.nansum(x, axis=1, keepdims=True)
    assert np.allclose(matrix(transforms.normalize_cells(f), x.shape), x / total * 1e6, equal_nan=True)
    assert np.allclose(matrix(transforms.normalize_cells(f, "median"), x.shape), x / total * np.median(total), equal_nan=True)
    y, label = counts(3, (7, 3)) + 1, np.array([0, 0, 1, 1, 1, 2, 2])
    g = frame(spark, as_rows(y), [(i, int(v)) for i, v in enumerate(label)])
    group = np.array([y[label == v].sum() for v in label])[:, None]
    least = min(np.median(y[label == v].sum(axis=1)) for v in range(3))
    assert np.allclose(matrix(transforms.normalize_groups(g, "label"), y.shape), y / group * 1e6)
    assert np.allclose(matrix(transforms.normalize_groups(g, "label", "median"), y.shape), y / group * least)
    with pytest.raises(ValueError):
        transforms.normalize_groups(g, "label", "cp10k")


def test_standardize_and_selection(spark):
    x = counts(4, (8, 3))
    x[:, 2] = 7
    want = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    assert np.allclose(matrix(transforms.standardize(frame(spark, as_rows(x))), x.shape), want)
    assert np.allclose(matrix(transforms.standardize(frame(spark, as_rows(x)), -0.5, 0.5), x.shape), np.clip(want, -0.5, 0.5))
    assert not matrix(transforms.standardize(frame(spark, as_rows(counts(4, (4, 1), [(1, 0)])))), (4, 1)).any()
    wide = np.column_stack([np.full(6, 5.0), 5 + np.arange(6) * 0.1, 50 + np.arange(6) * 9.0, np.full(6, 50.0)])
    assert {r["gene"] for r in selection.variable_genes(frame(spark, as_rows(wide)), n_genes=2, n_groups=2).collect()} == {1, 2}
    stats = spark.createDataFrame([("a", 1.0, 2.0)], "gene string, zero_rate double, mean_expr double")
    assert selection.dropout_top(stats, 5, decay=0).count() == 0
    assert all(abs(y - np.exp(-(x - 5)) - 0.02) < 1e-12 for x, y in selection.curve_points())


def test_gene_and_cell_scores(spark):
    x = np.column_stack([counts(6, 6) + 3, np.array([-3.0, -1, 0, 0, 1, 3]), np.zeros(6)])
    rows = {r["gene"]: r for r in scoring.score_genes(frame(spark, as_rows(x))).collect()}
    for j in range(3):
        mean, variance = x[:, j].mean(), x[:, j].var()
        assert np.allclose([rows[j][k] for k in ("mean", "variance", "dispersion", "cv")], [mean, variance, variance / (mean or 1), variance**0.5 / (mean or 1)])
    c = counts(7, (5, 4))
    by_cell = lambda df: [r["score"] for r in df.orderBy("cell").collect()]
    f = frame(spark, as_rows(c))
    assert np.allclose(by_cell(scoring.score_cells(f, f.genes)), c.mean(axis=1))
    assert np.allclose(by_cell(scoring.score_cells(f, f.genes, "median")), np.median(c, axis=1))
    assert by_cell(scoring.score_cells(f, f.genes.filter("gene < 0"))) == [1.0] * 5


def test_filters(spark):
    f = frame(spark, [[0, 0, 0], [0, 0, 1], [0, 1, 2], [1, 2, 3]])
    assert [r["metric"] for r in filters.metric(f, "cell", "detection").orderBy("cell").collect()] == [0, 1, 2, 3]
    assert [r["metric"] for r in filters.metric(f, "gene", "total_counts").orderBy("gene").collect()] == [1, 3, 6]
    assert filters.filter_side(f, "cell", "detection", 1, 2).cells.count() == 2
    assert np.array_equal(matrix(filters.zap(f, None, 2), (4, 3)), [[0, 0, 0], [0, 0, 0], [0, 0, 2], [0, 2, 3]])
    assert np.array_equal(matrix(filters.zap(f, None, 2, strict=True), (4, 3)), [[0, 0, 0], [0, 0, 1], [0, 1, 2], [1, 2, 0]])


def test_stack_union_is_missing_not_zero(spark):
    a, b = frame(spark, [[1, 2]]), frame(spark, [[3, 4]])
    b = b.__class__(b.expr.selectExpr("cell", "gene + 1 AS gene", "value"), b.cells, b.genes.selectExpr("gene + 1 AS gene"))
    both = stack.stack({"a": a, "b": b}, "union")
    assert {(r["cell"], r["gene"], r["value"]) for r in both.expr.collect()} == {("a:0", 0, 1.0), ("a:0", 1, 2.0), ("a:0", 2, None), ("b:0", 1, 3.0), ("b:0", 2, 4.0), ("b:0", 0, None)}
    assert {r["gene"] for r in stack.stack({"a": a, "b": b}).genes.collect()} == {1}


def test_batch_removal(spark):
    rng = np.random.default_rng(0)
    z, n = rng.normal(size=60), 60
    x = 10 + np.outer(z, [1.0, 0.0]) * 3 + rng.normal(size=(n, 2)) * 0.1
    f = frame(spark, x.tolist())
    f = f.__class__(f.expr, spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "cell int, z double"), f.genes)
    r = [abs(np.corrcoef(x[:, j], z)[0, 1]) for j in range(2)]
    assert batch.batch_score(f, "z", False).first()["score"] == np.mean([v > batch.critical_r(n) for v in r])
    clean = matrix(batch.remove_continuous(f, "z"), (n, 2))
    assert abs(np.corrcoef(clean[:, 0], z)[0, 1]) < 1e-6
    assert abs(batch.p_of_r(batch.critical_r(60), 60) - 0.05) < 1e-9


def test_enrichment_tails_sum(spark):
    f = frame(spark, [[1, 0], [1, 0], [0, 1], [0, 0]], [(0, 0), (1, 0), (2, 1), (3, 1)])
    rows = {(r["cluster"], r["gene"]): r for r in clusters.enrichment(f, "label").collect()}
    assert np.isclose(rows[(0, 0)]["high"], 1 / 6) and np.isclose(rows[(0, 0)]["low"], 1.0)
    assert [(r["cluster"], r["gene"]) for r in clusters.top_per_cluster(clusters.enrichment(f, "label"), 1).collect()] == [(0, 0), (1, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 1 -2\n2 2 7\n")
    (tmp_path / "genes.tsv").write_text("g1\tA\ng2\tB\ng3\tB\n\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\n\n")
    f = readers.read_mtx(spark, str(tmp_path))
    assert {tuple(r) for r in f.expr.collect()} == {("c1", "g1", 5.0), ("c1", "g3", -2.0), ("c2", "g2", 7.0)}
    assert readers.summary(f).first()["sparsity"] == 0.5
    (tmp_path / "t.tsv").write_text("GENE\tc1\tc2\ng1\t0\t2\ng2\t1.5\t\n")
    t = readers.read_delimited(spark, str(tmp_path / "t.tsv"))
    assert {tuple(r) for r in t.expr.collect()} == {("c2", "g1", 2.0), ("c1", "g2", 1.5), ("c2", "g2", None)}
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\t.\tA\tC\t.\t.\t.\tGT:GQ\t0/1:50\t0/0:3\n1\t20\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/0\n")
    v = readers.read_genotypes(spark, str(tmp_path / "v.vcf"), quality=10, frequency=1)
    assert {tuple(r) for r in v.expr.collect()} == {("s1", "1-10", 1.0), ("s2", "1-10", None)}


def test_headers_are_found_by_their_place(spark, tmp_path):
    (tmp_path / "features.tsv.gz").write_bytes(gzip.compress(b"g1\tA\ng2\tB\ng3\tC\n"))
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\nc3\n")
    for head in ("3 3 2", "3  3 2"):
        (tmp_path / "matrix.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n{head}\n3 3 2\n1 2 9\n")
        assert {tuple(r) for r in readers.read_expression(spark, str(tmp_path)).expr.collect()} == {("c3", "g3", 2.0), ("c2", "g1", 9.0)}
    assert tuple(readers.mtx_summary(spark, str(tmp_path / "matrix.mtx")).first())[:2] == (3, 3)
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n3 3 3\n3 3 2\n1 2 9\n")
    with pytest.raises(readers.ReadError):
        readers.read_mtx(spark, str(tmp_path))
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\n")
    (tmp_path / "matrix.mtx").write_text("3 3 1\n1 2 9\n")
    with pytest.raises(readers.AnnotationMismatch) as e:
        readers.read_mtx(spark, str(tmp_path))
    assert (e.value.side, e.value.expected, e.value.got) == ("cells", 3, 2)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert got.count() == 5000 and got.filter("value <> concat('line ', i)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_delimited_with_labels_headers_and_annotations(spark, tmp_path):
    (tmp_path / "d.csv").write_text("cell,batch,g1,g2\nkind,,x,y\na,b1,1,0\nb,b2,,3\n")
    f = readers.read_expression(spark, str(tmp_path / "d.csv"), genes_in_rows=False, n_headers=2, n_labels=2)
    assert {tuple(r) for r in f.expr.collect()} == {("a", "g1", 1.0), ("b", "g1", None), ("b", "g2", 3.0)}
    assert {(r["cell"], r["batch"]) for r in f.cells.collect()} == {("a", "b1"), ("b", "b2")}
    assert {(r["gene"], r["header_2"]) for r in f.genes.collect()} == {("g1", "x"), ("g2", "y")}
    with pytest.raises(readers.InadequateHeaders):
        readers.read_delimited(spark, str(tmp_path / "d.csv"), n_headers=9)
    (tmp_path / "n.count").write_text("id\tc0\tc1\nx\t1\t2\n")
    (tmp_path / "n.meta").write_text("name\trun\nfirst\t7\nsecond\t8\n")
    own = {r["cell"]: (r["name"], r["run"]) for r in readers.read_expression(spark, str(tmp_path / "n.count")).cells.collect()}
    assert own == {"c0": ("first", "7"), "c1": ("second", "8")}
    table = readers.read_table(spark, str(tmp_path / "n.meta"))
    typed, kinds = readers.typed(table)
    assert kinds["run"] == "continuous" and kinds["name"] == "discrete" and dict(typed.dtypes)["run"] == "double"
    with pytest.raises(readers.AnnotationMismatch):
        readers.annotate_genes(readers.read_count(spark, str(tmp_path / "n.count")), table)


def test_samples_are_the_same_at_every_reading(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("\t".join(["id", *[f"c{i}" for i in range(30)]]) + "\n" + "".join(f"r{i}\t" + "\t".join(["1"] * 30) + "\n" for i in range(40)))
    read = lambda: readers.read_delimited(spark, str(tmp_path / "s.tsv"), rows_percent=40, columns_percent=50)
    a, b = read(), read()
    assert {r["gene"] for r in a.genes.collect()} == {r["gene"] for r in b.genes.collect()} >= {"r0", "r1", "r2"}
    assert 3 <= a.genes.count() < 40 and 3 <= a.cells.count() < 30 and a.expr.count() == a.genes.count() * a.cells.count()


def test_batch_designs(spark):
    rng = np.random.default_rng(7)
    x, label, z = rng.poisson(3, (30, 4)).astype(float), np.arange(30) % 3, rng.normal(size=30)
    f = frame(spark, x.tolist(), [(i, int(v)) for i, v in enumerate(label)])
    f = type(f)(f.expr, f.cells.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "cell int, z double"), "cell"), f.genes)
    design = np.column_stack([np.ones(30), label == 1, label == 2, z]).astype(float)
    want = np.zeros_like(x)
    for j in range(4):
        on = x[:, j] > 0
        w = np.linalg.lstsq(design[on], np.log(x[on, j]), rcond=None)[0]
        want[on, j] = np.exp(np.log(x[on, j]) - design[on] @ w)
    model = batch.fit_batch(f, ["label"], ["z"], nonzero_only=True, log_link=True)
    assert np.allclose(matrix(batch.remove_batch(f, model), x.shape), want)
    half = f.keep_cells(f.cells.filter("cell < 10"))
    assert np.allclose(matrix(batch.remove_batch(half, model), x.shape)[:10], want[:10])
    y = x.copy()
    y[3, 1] = np.nan
    g = frame(spark, as_rows(y), [(i, int(v)) for i, v in enumerate(label)])
    got = matrix(batch.remove_discrete(g, "label"), x.shape)
    ok = ~np.isnan(y[:, 1])
    assert np.allclose(got[ok, 1], (y[ok, 1] - np.array([np.nanmean(y[label == v, 1]) for v in label])[ok])) and np.isnan(got[3, 1])
    with pytest.raises(ValueError):
        batch.fit_batch(frame(spark, [[-1.0, 2.0]], [(0, 0)]), ["label"], nonzero_only=True)
    with pytest.raises(ValueError):
        batch.fit_batch(f, ["label"], log_link=True)


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(size=(150, 2)) * 0.01, rng.uniform(-9, 9, (60, 2)), [[40.0, 40.0]], np.zeros((9, 2))])
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell int, x double, y double")
    want = set()
    for i, p in enumerate(xy):
        d = ((xy - p) ** 2).sum(axis=1)
        want |= {(i, int(j)) for j in sorted((j for j in range(len(xy)) if j != i), key=lambda j: (d[j], j))[:6]}
    assert {(r["src"], r["dst"]) for r in spatial.knn_edges(cells, "x", "y", 6).collect()} == want
    assert spatial.knn_edges(cells.limit(1), "x", "y", 6).count() == 0


def test_canonical_components(spark):
    rng = np.random.default_rng(4)
    sets = [rng.uniform(size=(n, 12)) for n in (30, 25, 20)]
    std = [(x - x.mean(axis=0)) / x.std(axis=0) for x in sets]
    frames = [frame(spark, x.tolist()) for x in sets]
    found, places = alignment.canonical_components(frames[:2], 3)
    u, _, v = np.linalg.svd(std[0] @ std[1].T)
    for own, rows in ((u[:, :3], places[0]), (v[:3].T, places[1])):
        got = np.zeros_like(own)
        for r in rows.collect():
            got[r["cell"], r["component"]] = r["value"]
        assert np.allclose(np.abs((got * own).sum(axis=0)), 1, atol=1e-8)
    assert len(alignment.metagenes(found, 5)[0]) == 5
    many, rows = alignment.canonical_components(frames, 4)
    for w, x in zip(many.weights, std):
        place = x @ w
        assert np.allclose(place.T @ place, np.eye(4), atol=1e-6)
    assert rows[2].count() == 80
    a, b = alignment.scaled_to_reference(places[0], places[1])
    assert a.count() == 90 and b.count() == 75


def test_scorer_table_and_markers(spark):
    genes = spark.createDataFrame([("1",), ("2",), ("?",)], "gene string")
    table = scoring.score_table(genes, {"a": spark.createDataFrame([("1", 0.5)], "gene string, s double"), "b": spark.createDataFrame([("2", 1.0, 2.0)], "gene string, p double, q double")})
    assert {tuple(r) for r in table.collect()} == {("1", 0.5, None, None), ("2", None, 1.0, 2.0), ("?", None, None, None)}
    assert [r["gene"] for r in scoring.match_markers(genes, spark.createDataFrame([(2,), (9,)], "gene int")).collect()] == ["2"]
    scoring.check_organism("9606", None)
    with pytest.raises(scoring.OrganismMismatch):
        scoring.check_organism("9606", 10090)


def test_pipeline_lint_and_run(spark):
    assert pipeline.warnings_for([("log", {}), ("dropout_genes", {})]) == ["dropout_genes after log"]
    out = matrix(pipeline.run(frame(spark, [[1, 2], [3, None], [5, 6]])), (3, 2))
    assert np.isfinite(out).all()


def test_joint_batch_removal(spark):
    rng = np.random.default_rng(5)
    n, label = 40, np.arange(40) % 3
    z = rng.integers(0, 50, n)
    x = rng.integers(0, 9, (n, 3)) + np.outer(label, [3, 0, 1]) + np.outer(z, [0.5, 1, 0])
    f = frame(spark, x.tolist(), [(i, int(label[i])) for i in range(n)])
    f = type(f)(f.expr, f.cells.join(spark.createDataFrame([(i, int(z[i])) for i in range(n)], "cell int, z int"), "cell"), f.genes)
    design = np.column_stack([label == 0, label == 1, label == 2, z]).astype(float)
    want = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    assert np.allclose(matrix(batch.remove_mixed(f, "label", "z"), x.shape), want)
