import random

import pytest
from pyspark.sql import functions as F

from cellsail.operators import clusters, scoring


@pytest.mark.parametrize("seed", range(3))
def test_genes_are_taken_cluster_by_cluster(spark, seed):
    rng = random.Random(seed)
    rows = [(c, g, rng.choice([0.1, 0.2, 0.3, rng.random()])) for c in "abcde" for g in range(9)]
    n, taken, want = 3, set(), set()
    for c in "abcde":
        free = sorted((round(p, 12), g) for k, g, p in rows if k == c and g not in taken)[:n]
        taken |= {g for _, g in free}
        want |= {(c, g) for _, g in free}
    got = clusters.top_per_cluster(spark.createDataFrame(rows, "cluster string, gene int, either double"), n).collect()
    assert {(r["cluster"], r["gene"]) for r in got} == want and len(got) == len(want)


def test_a_scorer_that_fails_has_missing_scores(spark):
    genes = spark.createDataFrame([("a",), ("b",)], "gene string")
    good = spark.createDataFrame([("a", 1.0, 2), ("b", float("inf"), 3)], "gene string, x double, n int")
    bad = genes.withColumn("s", F.raise_error(F.lit("no")).cast("double"))

    def broken():
        raise ZeroDivisionError("none")

    with pytest.warns(UserWarning):
        out = scoring.score_table(genes, {"good": good, "late": lambda: bad, "broken": broken, "fine": lambda: good.select("gene", "x")})
    assert out.columns == ["gene", "good_1", "good_2", "late", "broken", "fine"]
    rows = {r["gene"]: r for r in out.collect()}
    assert rows["a"]["good_1"] == 1 and rows["a"]["late"] is None and rows["a"]["broken"] is None
    assert rows["b"]["fine"] == rows["b"]["good_1"] == pytest.approx(1.7976931348623157e308)
