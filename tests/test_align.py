import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsail.frame import from_long
from cellsail.operators import align


def frame(spark, x, first=0, genes=None, **columns):
    rows = [(first + i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if np.isnan(v) or v != 0]
    names = list(columns)
    cells = spark.createDataFrame([(first + i, *(columns[c][i] for c in names)) for i in range(len(x))], "cell int" + "".join(f", {c} string" for c in names))
    return from_long(spark.createDataFrame(rows, "cell int, gene int, value double"), cells, spark.createDataFrame([(j,) for j in range(x.shape[1])], "gene int"))


def places_of(spark, w, first=0):
    return spark.createDataFrame([(first + i, j, float(v)) for i, r in enumerate(w) for j, v in enumerate(r)], "cell int, component int, value double")


def data(seed, n=40, genes=7, k=2):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(n, k))
    x = np.round((w @ rng.normal(size=(k, genes)) + rng.normal(size=(n, genes))) * 3) * (rng.random((n, genes)) < 0.7)
    x[:, 5] = rng.integers(1, 4, n)
    x[:, genes - 1] = 0
    return x, w


def rank(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def bicor(x, y):
    def t(v):
        m = np.median(v)
        mad = np.median(np.abs(v - m))
        if mad == 0:
            return np.full(len(v), np.nan)
        u = (v - m) / (9 * mad)
        return (v - m) * (1 - u**2) ** 2 * (np.abs(u) < 1)

    a, b = t(x), t(y)
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


def score(method, x, w):
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "pearson":
            return (w @ x) / np.linalg.norm(x)
        return np.corrcoef(rank(x), rank(w))[0, 1] if method == "spearman" else bicor(x, w)


@pytest.mark.parametrize("method", align.SCORINGS)
def test_gene_scores(spark, method):
    x, w = data(1)
    x[3, 0] = np.nan
    got = {(r["gene"], r["component"]): r["score"] for r in align.gene_scores(frame(spark, x), places_of(spark, w), method).collect()}
    x = np.nan_to_num(x)
    assert len(got) == x.shape[1] * 2
    for (j, c), s in got.items():
        want = score(method, x[:, j], w[:, c])
        assert (s is None) == bool(np.isnan(want)) and (s is None or np.isclose(s, want)), (j, c)


def test_metagenes_in_order(spark):
    scores = [{0: 0.5, 1: -0.9, 2: 0.4, 3: None, 4: 0.0, 5: 0.4}, {0: 0.6, 1: 0.8, 2: 0.7, 3: 0.9, 4: 0.0, 5: -0.4}]
    frames = [spark.createDataFrame([(g, 0, s) for g, s in x.items()], "gene int, component int, score double") for x in scores]
    got = [r["gene"] for r in align.metagenes(frames, 5).orderBy("rank").collect()]
    assert got == [0, 2, 4, 1, 5]  # those alike in sign, then those apart; 3 lacks a score


def test_projection_and_ranges(spark):
    (x, w), (y, v) = data(2, 50), data(3, 30)
    chosen = {0: [0, 2, 5], 1: [1, 3]}
    table = spark.createDataFrame([(c, g, i + 1) for c, gs in chosen.items() for i, g in enumerate(gs)], "component int, gene int, rank int")

    def phi(a, b):
        return np.stack([b[:, c] @ a[:, gs] @ a[:, gs].T for c, gs in chosen.items()], axis=1)

    def matrix(df):
        rows = sorted((r["cell"], r["component"], r["value"]) for r in df.collect())
        return np.array([r[2] for r in rows]).reshape(-1, 2)

    a = align.projected(frame(spark, x), places_of(spark, w), table)
    b = align.projected(frame(spark, y, 100), places_of(spark, v, 100), table)
    assert np.allclose(matrix(a), phi(x, w)) and np.allclose(matrix(b), phi(y, v))
    scaled = lambda p, low, high: (p - np.percentile(p, low, axis=0)) / (np.percentile(p, high, axis=0) - np.percentile(p, low, axis=0))
    ra, rb = align.reference_range(a, 10, 90), align.reference_range(b)
    assert np.allclose(matrix(ra), scaled(phi(x, w), 10, 90)) and np.allclose(matrix(rb), scaled(phi(y, v), 2.5, 97.5))
    sa, sb = scaled(phi(x, w), 10, 90), scaled(phi(y, v), 2.5, 97.5)
    deciles = np.arange(10, 100, 10)
    shift = np.abs(np.percentile(sa, deciles, axis=0) - np.percentile(sb, deciles, axis=0)).min(axis=0)
    assert np.allclose(matrix(align.quantile_shift(ra, rb)), sb + shift)
    flat = align.reference_range(places_of(spark, np.ones((5, 2))))
    assert set(matrix(flat).ravel()) == {0.0}


def test_alignment_of_sources(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(2.0, (60, 12)).astype(float)
    source = ["small" if i % 3 == 0 else "large" for i in range(60)]
    f = frame(spark, x, source=source)
    model = align.fit_alignment(f, "source", 3, 4)
    assert model.sources == ["large", "small"] and len(model.correlations) == 3
    genes = model.genes_of_components().collect()
    assert sorted((r["component"], r["rank"]) for r in genes) == [(c, i) for c in range(3) for i in range(1, 5)]
    shared = model.shared_correlations(f).collect()
    assert {(r["source"], r["component"]) for r in shared} == {(s, c) for s in ("large", "small") for c in range(3)} and all(0 <= r["shared"] <= 1 for r in shared)
    out = model.transform(f)
    assert out.count() == 180 and out.filter("value IS NULL OR isnan(value)").isEmpty()
    inside = out.join(f.cells, "cell").filter("source = 'large'").groupBy("component").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).collect()
    assert all(np.allclose(r["q"], [0, 1]) for r in inside)
    plain = model.transform(f, normalize=False)
    assert plain.count() == 180


def test_sources_that_cannot_be_aligned(spark):
    x = np.ones((5, 3))
    for source in (["a"] * 5, ["a", "a", "a", "a", "b"], ["a", "a", "b", "b", None]):
        with pytest.raises(align.AlignmentError):
            align.fit_alignment(frame(spark, x, source=source), "source", 1)
    with pytest.raises(align.AlignmentError):
        align.fit_alignment(frame(spark, x, source=["a", "a", "a", "b", "b"]), "source", 2)
    with pytest.raises(ValueError):
        align.fit_alignment(frame(spark, x, source=["a", "a", "a", "b", "b"]), "source", 1, scoring="other")
