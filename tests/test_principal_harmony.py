import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsail.frame import from_long
from cellsail.operators import harmony, principal


def sparse(spark, x):
    rows = [(f"c{i:03}", j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if np.isnan(v) or v != 0]
    cells = spark.createDataFrame([(f"c{i:03}",) for i in range(len(x))], "cell string")
    return from_long(spark.createDataFrame(rows or [("c000", 0, 0.0)], "cell string, gene int, value double"), cells, spark.createDataFrame([(j,) for j in range(x.shape[1])], "gene int"))


def table(rows, width):
    found = sorted((r["cell"], list(r["z"])) for r in rows.collect())
    return np.array([z for _, z in found]).reshape(len(found), width)


@pytest.mark.parametrize(("n", "genes", "k"), [(120, 300, 6), (40, 12, 12), (6, 50, 50)])
def test_components_agree_with_svd(spark, n, genes, k):
    rng = np.random.default_rng(n)
    x = rng.poisson(1.0, (n, genes)) * (rng.random((n, genes)) < 0.3) + rng.normal(size=(n, 3)) @ rng.normal(size=(3, genes)) * (rng.random((n, genes)) < 0.2)
    x[0, 0] = np.nan
    x[2] = 0
    found = principal.principal_components(sparse(spark, x), k)
    dense = np.nan_to_num(x) - np.nan_to_num(x).mean(axis=0)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    s = s[:k][s[:k] > 1e-8]
    assert np.allclose(found.deviations, s)
    assert np.allclose(np.abs((found.weights * vt[: len(s)].T).sum(axis=0)), 1)
    assert np.allclose(found.weights.T @ found.weights, np.eye(len(s)))
    assert (found.weights[np.abs(found.weights).argmax(axis=0), np.arange(len(s))] > 0).all()
    assert np.allclose(table(found.arrays(), len(s)), dense @ found.weights)


def test_components_of_nothing(spark):
    assert principal.principal_components(sparse(spark, np.zeros((3, 4))), 2).weights.shape == (4, 0)


def test_eigenvectors_of_a_product():
    rng = np.random.default_rng(3)
    a, b = (y.T @ y for y in (rng.normal(size=(80, 60)), rng.normal(size=(90, 60)) * np.linspace(3, 0.01, 60)))
    value, vector = principal.largest_eigenvectors(60, 5, lambda x: b @ x, lambda x: a @ x, extra=4)
    assert np.allclose(value, np.sort(np.linalg.eigvals(b @ a).real)[::-1][:5])
    assert np.allclose(b @ a @ vector, vector * value, atol=1e-5 * value[0])
    assert np.allclose(vector.T @ a @ vector, np.eye(5), atol=1e-8)


def by_hand(z, levels, sizes, block, noise, settings):
    """The method with a matrix of assignments, cell by cell."""
    n, d = z.shape
    k, blocks = settings.clusters, int(np.ceil(1 / settings.block_size))
    phi = np.zeros((sum(sizes), n))
    for v in range(levels.shape[1]):
        phi[levels[:, v], np.arange(n)] = 1
    u = harmony.unit(z)
    y = [u[noise[0].argmax()]]
    for c in range(1, k):
        with np.errstate(divide="ignore"):
            y.append(u[(np.log(np.maximum(1 - np.max(u @ np.array(y).T, axis=1), 0)) + noise[c]).argmax()])
    y = np.array(y)
    theta = np.concatenate([np.full(s, t) for s, t in zip(sizes, np.broadcast_to(settings.theta, len(sizes)))])
    if settings.tau > 0:
        theta = theta * (1 - np.exp(-((phi.sum(axis=1) / (k * settings.tau)) ** 2)))
    share = phi.sum(axis=1) / n
    dist = 2 * (1 - y @ u.T)
    r = np.exp(-dist / settings.sigma)
    r /= r.sum(axis=0)

    def objective():
        o, e = r @ phi.T, np.outer(r.sum(axis=1), share)
        return (r * dist).sum() + settings.sigma * (r * np.log(np.maximum(r, 1e-300))).sum() + settings.sigma * (theta * np.log((o + 1) / (e + 1)) * o).sum()

    history, rng = [objective()], np.random.default_rng(settings.seed)
    for _ in range(settings.rounds):
        for _ in range(settings.inner):
            y = harmony.unit(r @ u)
            dist = 2 * (1 - y @ u.T)
            for b in rng.permutation(blocks):
                own, rest = block == b, block != b
                o, e = r[:, rest] @ phi[:, rest].T, np.outer(r[:, rest].sum(axis=1), share)
                new = np.exp(-dist[:, own] / settings.sigma) * ((((e + 1) / (o + 1)) ** theta) @ phi[:, own])
                r[:, own] = new / new.sum(axis=0)
        moe = np.vstack([np.ones(n), phi])
        out = z.T.copy()
        for c in range(k):
            w = np.linalg.solve((moe * r[c]) @ moe.T + np.diag([0, *[settings.lamb] * len(phi)]), (moe * r[c]) @ z)
            w[0] = 0
            out -= w.T @ (moe * r[c])
        u = harmony.unit(out.T)
        history.append(objective())
        if (history[-2] - history[-1]) / abs(history[-2]) < settings.limit:
            break
    return out.T, history


@pytest.mark.parametrize(("batches", "theta", "tau"), [(["a"], 1.0, 0.0), (["a", "b"], (2.0, 0.5), 3.0)])
def test_batches_are_mixed_as_by_hand(spark, batches, theta, tau):
    rng = np.random.default_rng(5)
    n, d = 90, 4
    a, b = rng.integers(0, 3, n), rng.integers(0, 2, n)
    z = rng.normal(size=(4, d))[rng.integers(0, 4, n)] * 3 + rng.normal(size=(3, d))[a] * 1.5 + rng.normal(size=(n, d)) * 0.4
    rows = [(f"c{i:03}", None if a[i] == 2 else f"batch{a[i]}", float(b[i]), z[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, a string, b double, z array<double>")
    settings = harmony.Settings(clusters=5, rounds=3, inner=3, block_size=0.3, theta=theta, tau=tau, limit=-1.0, seed=2)
    got, history = harmony.mixed_places(df.select("cell", "z"), df.drop("z"), batches, settings)
    drawn = df.orderBy("cell").select(harmony._block(4, 2), *[harmony.noise(c, 2).alias(f"n{c}") for c in range(5)]).collect()
    levels = np.stack([a, 3 + b] if len(batches) == 2 else [a], axis=1)
    want, steps = by_hand(z, levels, [3, 2][: len(batches)], np.array([r["block"] for r in drawn]), [np.array([r[f"n{c}"] for r in drawn]) for c in range(5)], settings)
    assert np.allclose(history, steps)
    assert np.allclose(table(got, d), want, atol=1e-8)


def test_harmony_brings_batches_together(spark):
    rng = np.random.default_rng(7)
    n, genes = 160, 20
    kind, batch = np.arange(n) % 2, rng.integers(0, 2, n)
    x = np.maximum(0, rng.normal(size=(2, genes))[kind] * 4 + rng.normal(size=(2, genes))[batch] * 1.5 + rng.normal(size=(n, genes)) + 6)
    f = sparse(spark, x)
    cells = spark.createDataFrame([(f"c{i:03}", int(batch[i]), int(kind[i])) for i in range(n)], "cell string, batch int, kind int")
    f = from_long(f.expr, cells, f.genes)
    settings = harmony.Settings(clusters=2, rounds=4, inner=4, block_size=0.5)

    def gap(df, by):
        p = df.toPandas()
        z = p[[c for c in p.columns if c.startswith("PC")]].to_numpy()
        return np.linalg.norm(z[p[by] == 0].mean(axis=0) - z[p[by] == 1].mean(axis=0))

    before, after = harmony.harmony(f, [], 5), harmony.harmony(f, ["batch"], 5, settings)
    assert after.columns == ["cell", "batch", "kind", "PC1", "PC2", "PC3", "PC4", "PC5"] and after.count() == n
    assert gap(after, "batch") < 0.4 * gap(before, "batch")
    assert gap(after, "kind") > 0.7 * gap(before, "kind")
    with pytest.raises(ValueError):
        harmony.harmony(from_long(f.expr, cells.withColumn("PC1", F.lit(1)), f.genes), ["batch"], 5)
