import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsail.frame import from_long
from cellsail.operators import alignment, batch, display


def frame(spark, x, cells=None, schema="cell int"):
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if np.isnan(v) or v != 0]
    return from_long(spark.createDataFrame(rows, "cell int, gene int, value double"), spark.createDataFrame(cells or [(i,) for i in range(len(x))], schema), spark.createDataFrame([(j,) for j in range(x.shape[1])], "gene int"))


@pytest.mark.parametrize("size", [2, 9, 40, 500])
def test_display_sample(spark, size):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (20, 10)).astype(float)
    x[0, 0] = np.nan
    got = {(r["cell"], r["gene"]): r["value"] for r in display.display_sample(frame(spark, x), size).collect()}
    pairs = [(float(x[i, j]), int(hashlib.md5(f"{i}:{j}".encode()).hexdigest()[:13], 16), f"{i}:{j}", (i, j)) for i in range(20) for j in range(10) if np.isfinite(x[i, j]) and x[i, j]]
    low, high = min(pairs), max(pairs)
    rest = sorted((p for p in pairs if p not in (low, high)), key=lambda p: p[1:3])
    want = pairs if len(pairs) <= size else [low, high, *rest[: size - 2]]
    assert got == {p[3]: p[0] for p in want}
    with pytest.raises(ValueError):
        display.display_sample(frame(spark, x), 1)


def test_density(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300), rng.normal(8, 0.1, 100), rng.integers(0, 3, 50)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    rows = sorted(display.density(df, "v", 200).collect())
    grid = np.linspace(x.min() - 0.025 * np.ptp(x), x.max() + 0.025 * np.ptp(x), 200)
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in rows], grid) and np.allclose([r["density"] for r in rows], want, rtol=1e-6, atol=1e-12)
    assert {r["density"] for r in display.density(df.limit(1), "v", 4).collect()} == {0.25}
    assert {r["density"] for r in display.density(spark.createDataFrame([(2.0,)] * 5, "v double"), "v", 4).collect()} == {0.0}


def test_scales(spark):
    row = spark.createDataFrame([(99.0,)], "x double").select(display.log10_scale(F.col("x")).alias("a")).select("a", display.from_log10_scale(F.col("a")).alias("b")).first()
    assert np.allclose(row, [2.0, 99.0])
    assert [display.threshold_digits(0, s) for s in (0, 0.05, 1, 12, 1e9)] == [1, 6, 4, 3, 1]


def test_cells_without_a_batch_stay(spark):
    x = np.array([[1.0], [2.0], [3.0], [10.0], [20.0], [100.0], [200.0]])
    label = ["a", "a", "a", "b", "b", None, None]
    f = frame(spark, x, [(i, v, None if v is None else float(i)) for i, v in enumerate(label)], "cell int, label string, z double")
    for model in (batch.fit_batch(f, ["label"]), batch.fit_batch(f, ["label"], nonzero_only=True, log_link=True)):
        got = {r["cell"]: r["value"] for r in batch.remove_batch(f, model).expr.collect()}
        assert got[5] == 100 and got[6] == 200
        if not model.log_link:
            assert np.allclose([got[i] for i in range(5)], [-1, 0, 1, -5, 5])
    both = {r["cell"]: r["value"] for r in batch.remove_mixed(f, "label", "z").expr.collect()}
    assert both[5] == 100 and both[6] == 200
    seen = batch.fit_batch(f.keep_cells(f.cells.filter("label = 'a'")), ["label"])
    replayed = {r["cell"]: r["value"] for r in batch.remove_batch(f, seen).expr.collect()}
    assert np.allclose([replayed[i] for i in range(3)], [-1, 0, 1]) and [replayed[i] for i in (3, 4, 5)] == [10, 20, 100]


def test_threshold_counts_known_covariates(spark):
    rng = np.random.default_rng(12)
    n, known = 200, 8
    z = rng.normal(size=known)
    x = rng.normal(size=(n, 30)) + 5
    x[:known] += np.outer(z, np.linspace(0, 2, 30))
    f = frame(spark, x, [(i, float(z[i]) if i < known else None) for i in range(n)], "cell int, z double")
    r = np.array([abs(np.corrcoef(x[:known, j], z)[0, 1]) for j in range(30)])
    share = (r > batch.critical_r(known)).mean()
    assert share != (r > batch.critical_r(n)).mean()
    assert np.isclose(batch.batch_score(f, "z", False).first()["score"], share)


def test_components_of_many_genes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.normal(size=(3, 25))
    x, y = (rng.normal(size=(n, 3)) @ shared * 2 + rng.normal(size=(n, 25)) for n in (30, 40))
    frames = [frame(spark, x), frame(spark, y)]
    few, places = alignment.canonical_components(frames, 3)
    monkeypatch.setattr(alignment, "MAX_GENES", 10)
    many, other = alignment.canonical_components(frames, 3)
    assert np.allclose(few.correlations, many.correlations)
    for a, b in zip(few.weights, many.weights):
        assert np.allclose(a, b, atol=1e-6)
    with pytest.raises(ValueError):
        alignment.canonical_components([*frames, frames[0]], 3)


def test_many_sets_by_hand(spark):
    rng = np.random.default_rng(9)
    shared = rng.normal(size=(4, 12))
    xs = [rng.normal(size=(n, 4)) @ shared * np.array([2.0]) + rng.normal(size=(n, 12)) for n in (20, 25, 30)]
    found, places = alignment.canonical_components([frame(spark, x) for x in xs], 2)
    zs = [(x - x.mean(axis=0)) / x.std(axis=0) for x in xs]
    done: list[list[np.ndarray]] = [[] for _ in zs]
    for c in range(2):  # over cells, with all products of sets as matrices
        w = [np.linalg.svd(z, full_matrices=False)[0][:, c] for z in zs]
        # a start's sign is free; as the library has it, from the genes' side
        for i, z in enumerate(zs):
            s = np.linalg.eigh(z.T @ z)[1][:, -1 - c]
            w[i] = z @ s / np.linalg.norm(z @ s)
        before = 0.0
        for _ in range(25):
            for i, z in enumerate(zs):
                v = sum(z @ (zs[j].T @ w[j]) for j in range(3) if j != i)
                for t in done[i]:
                    v = v - (t @ v) * t
                w[i] = v / np.linalg.norm(v)
            now = sum((zs[i].T @ w[i]) @ (zs[j].T @ w[j]) for i in range(3) for j in range(i))
            if abs(now - before) <= 1e-3 * max(abs(before), 1e-300):
                break
            before = now
        for i in range(3):
            done[i].append(w[i])
    for i, p in enumerate(places):
        got = np.zeros((len(xs[i]), 2))
        for r in p.collect():
            got[r["cell"], r["component"]] = r["value"]
        for c in range(2):
            assert np.isclose(abs(got[:, c] @ done[i][c]), 1, atol=1e-6), (i, c)
    for c in range(2):
        want = np.mean([np.corrcoef(zs[i].T @ done[i][c], zs[j].T @ done[j][c])[0, 1] for i in range(3) for j in range(i)])
        assert np.isclose(found.correlations[c], want, atol=1e-6)
