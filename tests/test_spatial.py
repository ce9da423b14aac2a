import numpy as np
import pytest

from cellsail.frame import from_long
from cellsail.operators import spatial


def edges_by_hand(xy, k):
    xy = np.nan_to_num(np.array(xy, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    out = set()
    for i in range(len(xy)):
        with np.errstate(over="ignore"):
            d = ((xy - xy[i]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(xy)), d))
        out |= {(i, int(j)) for j in order[order != i][:k]}
    return out


def places(seed):
    rng = np.random.default_rng(seed)
    return {
        "spread": rng.normal(size=(150, 2)),
        "lattice": rng.integers(0, 4, size=(150, 2)).astype(float),
        "outlier": np.vstack([rng.normal(size=(150, 2)), [[1e9, -1e9], [1e300, 0]]]),
        "dense spots": np.vstack([rng.normal(size=(90, 2)) * 1e-6, rng.normal(size=(60, 2))]),
        "one place": np.vstack([np.zeros((60, 2)), rng.normal(size=(20, 2))]),
        "not finite": np.vstack([rng.normal(size=(20, 2)), [[np.nan, 1.0], [np.inf, np.nan], [0.0, -np.inf], [-0.0, 0.0]]]),
        "two": np.array([[0.0, 0.0], [1.0, 1.0]]),
    }


@pytest.mark.parametrize("name", list(places(0)))
def test_neighbours(spark, name):
    xy, k = places(4)[name], 6
    rows = [(i, None if i == 1 and name == "spread" else float(a), float(b), 1.0) for i, (a, b) in enumerate(xy)]
    if name == "spread":
        xy[1, 0] = np.nan
    got = [(r["src"], r["dst"]) for r in spatial.knn_edges(spark.createDataFrame(rows, "cell long, x double, y double, n double"), "x", "y", k).collect()]
    assert len(got) == len(set(got)) and set(got) == edges_by_hand(xy, k)


def test_no_neighbours(spark):
    none = spark.createDataFrame([], "cell long, x double, y double")
    assert spatial.knn_edges(none, "x", "y", 3).collect() == []
    assert spatial.knn_edges(spark.createDataFrame([(1, 0.0, 0.0)], "cell long, x double, y double"), "x", "y", 3).collect() == []


@pytest.mark.parametrize("method", ["moran", "geary"])
def test_autocorrelation_of_sparse_genes(spark, method):
    rng = np.random.default_rng(8)
    n, genes = 40, 6
    x = rng.normal(size=(n, genes)) * (rng.random((n, genes)) < 0.3)
    x[:, 3], x[:, 4], x[0, 0] = 2.5, 0, np.nan
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if np.isnan(v) or v != 0]
    ids = lambda m, name: spark.createDataFrame([(i,) for i in range(m)], f"{name} int")
    f = from_long(spark.createDataFrame(rows, "cell int, gene int, value double"), ids(n, "cell"), ids(genes, "gene"))
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 150), rng.integers(0, n, 150), rng.random(150)) if a != b]
    got = {r["gene"]: r["score"] for r in spatial.autocorrelation(f, spark.createDataFrame(pairs, "src int, dst int, w double"), method).collect()}
    w = np.zeros((n, n))
    for a, b, v in pairs:
        w[a, b] += v
    z = np.nan_to_num(x) - np.nan_to_num(x).mean(axis=0)
    for j in range(genes):
        q = (z[:, j] ** 2).sum() + 1e-16
        moran = n / w.sum() * (z[:, j] @ w @ z[:, j]) / q
        geary = (n - 1) / (2 * w.sum()) * (w * (z[:, None, j] - z[None, :, j]) ** 2).sum() / q
        assert np.isclose(got[j], moran if method == "moran" else geary, atol=1e-9), j
    with pytest.raises(ValueError):
        spatial.autocorrelation(f, spark.createDataFrame(pairs, "src int, dst int, w double"), "other")
