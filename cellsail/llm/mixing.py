"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents should
get. The whole copies are certain; the fractions are rounded together. A step
pairs a document with smaller ones and moves words from one side to the other, at
random but fair in expectation, until the document's fraction is 0 or 1. The
fractional words of a source thereby stay what they were, but for one last document.

Leaves of about LEAF documents of one source are rounded in parallel. Each
leaves one residual document at most, and a reduction tree combines the
residuals, FANOUT groups at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellsail.llm.store import materialize

LEAF, FANOUT = 4096, 64
#: No document gets more copies, so no target is above so many times its source's size.
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str) -> DataFrame:
    """(source, source_size, target) of each source from (source, size) rows.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating. A target
    of more than MAX_COPIES times the source's size stops there and the excess
    goes to the others by weight. That ends at one level such that every target is
    the smaller of level * weight and its bound; the level follows from running
    sums over the sources by bound / weight. The windows see one row a source.
    """
    by_source = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    w = by_source.withColumn("weight", weight).withColumn("bound", F.col("source_size").cast("double") * MAX_COPIES)
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / rest)
    # while sources that their level overfills are left out, levels rise; after that they fall
    level = F.max("level").over(everyone)
    return w.withColumn("final", level).select("source", "source_size", F.least(F.col("bound"), F.col("final") * F.col("weight")).alias("target"))


def round_fractions(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round all but one of p to 0 or 1, keeping sum(size * p): (0, 1 or -1 for the one left; its p).

    Documents come with the largest first. Each in turn is paired with all that come
    after it, which give or take words in proportion to what they can either way,
    until its own fraction is 0 or 1. Each p keeps its expectation; the one left is
    among the last, so it is small.
    """
    q, s = p.astype(np.float64).copy(), size.astype(np.float64)
    eps = 1e-12
    out = np.where(q <= eps, 0, np.where(q >= 1 - eps, 1, -1))
    rng = np.random.default_rng((draws * (1 << 52)).astype(np.uint64))
    left = np.flatnonzero(out < 0)
    for at, i in enumerate(left):
        rest = left[at + 1 :]
        while eps < q[i] < 1 - eps:
            able = np.minimum(q[rest], 1 - q[rest]) * s[rest]
            able[able <= eps * s[rest]] = 0.0
            total = able.sum()
            if total <= 0:
                break
            # mass is in words: what one loses, the others get
            up, down = min((1 - q[i]) * s[i], total), min(q[i] * s[i], total)
            move = up if rng.random() < down / (up + down) else -down
            q[i] += move / s[i]
            q[rest] -= move * able / total / s[rest]
        if q[i] <= eps or q[i] >= 1 - eps:
            out[i] = int(q[i] > 0.5)
    open_ = np.flatnonzero(out < 0)
    done = open_[(q[open_] <= eps) | (q[open_] >= 1 - eps)]
    out[done] = (q[done] > 0.5).astype(int)
    return out, q


def _draw(seed: int, level: int) -> Column:
    return (F.pmod(F.xxhash64("key", "size", "ordinal", F.lit(seed), F.lit(level)), F.lit(1 << 52)).cast("double") / float(1 << 52)).alias("draw")


def _round_group(last: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        # large first, so that the document left over tends to be small
        pdf = pdf.sort_values(["size", "key", "ordinal"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        out, q = round_fractions(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), pdf["draw"].to_numpy())
        if last:
            out = np.where(out < 0, (pdf["draw"].to_numpy() < q).astype(np.int64), out)
        return pdf.assign(extra=out, p=q).drop(columns=["draw"])

    return work


def mix(docs: DataFrame, carry: list[str], text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """carry columns, size, source_size, target, copies and taken of each row.

    Null and empty texts have size 0 and nothing is taken from them. Null is a
    source of its own. Repeated rows are separate documents. Draws and groups come
    from hashes of ids and sizes, so reruns agree, whatever the partitions.
    """
    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, inner)], F.col(source_col).alias("source"), F.xxhash64(F.col(id_col)).alias("key"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(rows, "mixing-sizes")
    goal = materialize(targets(rows, "source"), "mixing-targets")
    counts = rows.groupBy("source").count().withColumn("leaves", F.ceil(F.col("count") / LEAF)).drop("count")
    known = goal.join(counts, goal["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    both = rows.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = both.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole")).withColumn("ordinal", F.lit(0)).withColumn("node", F.pmod(F.xxhash64("key", "size", F.lit(seed)), F.col("leaves"))).drop("copies")
    done, level = [], 0
    n_nodes = counts.agg(F.max("leaves")).collect()[0][0] or 1
    while True:
        last = n_nodes <= 1
        given = state.select("*", _draw(seed, level))
        schema = StructType([*state.schema.fields, StructField("extra", LongType())])
        step = given.groupBy("source", "node").applyInPandas(_round_group(last), schema)
        step = materialize(step, f"mixing-level{level}")
        done.append(step.filter("extra >= 0"))
        if last:
            break
        n_nodes = -(-n_nodes // FANOUT)
        level += 1
        state = step.filter("extra < 0").drop("extra").withColumn("node", F.floor(F.col("node") / FANOUT))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.col("extra")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, inner)], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
