"""Plain Lloyd clustering of vectors in integers, so that no result depends on how rows are split or summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsail.llm.store import materialize

#: Components are whole numbers below this, so that a double holds them exactly.
LARGEST = 1 << 53
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the rows whose vector has exactly dims components, none null or non-finite; v holds floor(scale * x).

    A component from LARGEST on raises an error.
    """
    x = F.col("x").cast("array<double>")

    def usable(y):
        return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))

    def whole(y):
        scaled = y * float(scale)
        return F.when(F.abs(scaled) < float(LARGEST), F.floor(scaled)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("long"))

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    kept = rows.filter((F.size(x) == dims) & F.forall(x, usable))
    return kept.select("id", F.transform(x, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of seed:id, ties by the vector itself and null ids last; fewer if there are fewer."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, dims), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, the smaller one of equals, and the squared distance; in Python's integers where 64 bits could overflow."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, centroids))
    if 4 * most * most * x.shape[1] > _LONG:
        x, centroids = x.astype(object), centroids.astype(object)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(x)), at]


def _new_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of each centroid's vectors; those without vectors stay. At most k * (dims + 1) sums reach the driver."""
    k, dims = centroids.shape
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch["v"], dims)
            at, _ = nearest(x, held.value)
            x = x if int(np.abs(x).max(initial=0)) * len(x) <= _LONG else x.astype(object)
            for c in np.unique(at):
                own = x[at == c]
                total[c, 1:] += own.sum(axis=0)
                total[c, 0] += len(own)
        c, place = np.nonzero(np.repeat(total[:, :1] > 0, dims + 1, axis=1))
        yield pd.DataFrame({"cluster": c.astype(np.int32), "place": place.astype(np.int32), "total": [Decimal(int(t)) for t in total[c, place]]})

    found = vectors.select("v").mapInPandas(sums, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    held.unpersist()
    total = {(r["cluster"], r["place"]): int(r["total"]) for r in found}
    out = centroids.copy()
    for c in {c for c, _ in total}:
        out[c] = [total[c, i + 1] // total[c, 0] for i in range(dims)]
    return out


def _assigned(vectors: DataFrame, held: Broadcast, dims: int) -> DataFrame:
    """(id, cluster, over, rest): the distance is over * 2**63 + rest."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, d = nearest(_matrix(batch["v"], dims), held.value)
            over = [int(y) >> 63 for y in d] if d.dtype == object else np.zeros(len(d), np.int64)
            rest = [int(y) & _LONG for y in d] if d.dtype == object else d
            yield pd.DataFrame({"id": batch["id"], "cluster": at.astype(np.int32), "over": over, "rest": rest})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInPandas(work, f"id {kind}, cluster int, over long, rest long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3", scale: int = 1024) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, after rounds of Lloyd's iteration.

    Centroids are k vectors of dims integers: they, and their sums, are all that
    the driver and a broadcast hold. Rounds end early when no centroid moves, since
    later ones would change nothing.

    Vectors that are null, of another length or with a null, NaN or infinite
    component are left out. Rows that repeat an id or a vector count as often as
    they occur and get equal results; null ids are kept, hashed after all others.
    Of fewer than k vectors each is a centroid; without any the result is empty. A
    distance or sum beyond a long is null. Other columns are not read, whatever
    their names.
    """
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vector_col, dims, scale), "centroid-vectors")
    centroids = np.array(first_centroids(whole, k, seed), dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return whole.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        moved = _new_centroids(whole, centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    assigned = _assigned(whole, spark.sparkContext.broadcast(centroids), dims)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("over").cast("decimal(38,0)")).alias("over"), F.sum(F.col("rest").cast("decimal(38,0)")).alias("rest")).collect()

    def fits(over: int, rest: int) -> int | None:
        return rest if not over and rest <= _LONG else None

    inertia = fits(sum(int(r["over"]) for r in sums), sum(int(r["rest"]) for r in sums))
    each = [(r["cluster"], fits(int(r["over"]), int(r["rest"])), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    of_cluster = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", F.when(F.col("over") == 0, F.col("rest")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
