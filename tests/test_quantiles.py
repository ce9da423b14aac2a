import numpy as np
import pytest

from cellsail.functions import quantiles


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_of_groups(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        None: rng.normal(size=37),
        "a": np.array([3.5]),
        "b": rng.integers(-2, 3, 60).astype(float),
        "c": np.concatenate([rng.normal(size=9) * 10.0 ** rng.integers(-300, 300, 9), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf][: 4 + 0 * seed]]),
        "d": np.full(20, -7.25),
    }
    rows = [(g, 1, float(v)) for g, x in groups.items() for v in x] + [("a", 1, None), ("b", 1, float("nan")), ("e", 1, None)]
    shares = [0.0, 0.025, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "g string, n int, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g][0] == len(x)
        assert np.allclose(got[g][1], np.quantile(x, shares), rtol=1e-12, atol=0)


def test_values_not_stored_count_as_zeros(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) * (rng.random((50, 3)) < 0.4)
    x[:, 2] = 0
    rows = spark.createDataFrame([(j, float(v)) for r in x for j, v in enumerate(r) if v], "gene int, value double")
    sizes = spark.createDataFrame([(j, 50) for j in range(3)], "gene int, size int")
    found = quantiles.quantiles(quantiles.with_zeros(rows, ["gene"], "value", sizes), ["gene"], "value", [0.1, 0.5], "weight")
    assert {r["gene"]: r["n"] for r in found.collect()} == {0: 50, 1: 50, 2: 50}
    for r in found.collect():
        assert np.allclose(r["q"], np.quantile(x[:, r["gene"]], [0.1, 0.5]))


def test_places_beyond_a_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    got = {r["g"]: r["stats"] for r in quantiles.order_statistics(rows, ["g"], "v", lambda n: [n - 1, n, n - 2]).collect()}
    assert got == {"a": [2.0, None, 1.0], "b": [5.0, None, None]}
