"""Resampling of documents towards a target text by hashed n-gram weights and Gumbel noise: the highest scores are drawn."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.radix import kth, up_to
from cellsail.llm.store import materialize
from cellsail.llm.textkit import ALNUM, LOWER, Block, blocks, sums_by_doc, words

RESULTS = ["n_features", "weight", "score", "rank"]
#: Spans of more bytes are hashed one by one.
_LONG_SPAN = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the bytes from start to end, for all spans at once byte by byte."""
    size = end - start
    out = np.zeros(len(start), dtype=np.uint32)
    for i in np.flatnonzero(size > _LONG_SPAN):
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    short = np.flatnonzero(size <= _LONG_SPAN)
    order = short[np.argsort(-size[short].astype(np.int8), kind="stable")]  # longest first, so that those still running come first
    left = np.bincount(size[short], minlength=_LONG_SPAN + 1)[::-1].cumsum()[::-1]
    at, c = start[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(_LONG_SPAN):
        n = left[i + 1]
        if not n:
            break
        c[:n] = _CRC[(c[:n] ^ buf[at[:n] + i]) & 255] ^ (c[:n] >> 8)
    out[order] = ~c
    return out


def run_buckets(block: Block, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to longest words, by ascending text for each length, and the words of each text."""
    buf = LOWER[block.buf]
    w = words(block, buf, ALNUM)
    start, end = w.start, w.end
    if longest > 1:  # the words again, one space after each, so that a run is one span
        size = w.end - w.start + 1
        end = np.cumsum(size)
        start = end - size
        buf = buf[np.arange(size.sum()) - np.repeat(start - w.start, size)]
        end = end - 1
        buf[end] = 32
    docs, found = [], []
    last = np.repeat(w.first + w.count, w.count)
    for n in range(1, longest + 1):
        i = np.flatnonzero(np.arange(len(start)) + n <= last)
        docs.append(w.doc[i])
        found.append(crc32_spans(buf, start[i], end[i + n - 1]) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64), w.count


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall in each bucket; at most buckets sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                total += np.bincount(run_buckets(b, longest, buckets)[1], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in target and source, floored."""
    buckets, big, all_target = len(target), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(int(t) + 1) * float(big + buckets) / (float(int(s) + 1) * float(all_target + buckets)))) for t, s in zip(target, source)], dtype=np.int64)


def weights(docs: DataFrame, carry: list[str], text_col: str, gains: np.ndarray, longest: int) -> DataFrame:
    """carry and n_words, n_features, weight of each row: the floored mean of its runs' gains, 0 without runs."""
    buckets = len(gains)
    held = docs.sparkSession.sparkContext.broadcast(gains)
    kept = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = docs.select(*carry).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                doc, bucket, n_words = run_buckets(b, longest, buckets)
                if longest > 1:
                    order = np.argsort(doc, kind="stable")
                    doc, bucket = doc[order], bucket[order]
                n = np.bincount(doc, minlength=b.n)
                total = sums_by_doc(held.value[bucket], np.cumsum(n) - n, n)
                rest = batch.slice(b.row, b.n)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], [*carry, "n_words", "n_features", "weight"])

    return kept.mapInArrow(work, schema)


def gumbel(id_col: Column, seed: str) -> Column:
    """Thousandths of Gumbel noise from the first 8 hex digits of sha256 of seed:id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """id_col, carry and n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with min_words words or more, percent of a hundred with the
    highest scores are drawn. A radix selection over score, id and row finds the
    exact last one, and only rows up to it are sorted, by ranges.

    A null or empty text has no features and weight 0. A null id is hashed as an
    empty one and comes after others of equal score; ids are whole numbers. Rows
    that share an id and a score, repeated ones among them, are drawn in the order
    in which they are read. Texts of any length are taken whole. An empty target
    counts 0 everywhere; an empty docs gives an empty result. Carried columns may
    have any names but those of the results.
    """
    if clash := {id_col, *carry} & set(RESULTS):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_body"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    names = [f"_carry{i}" for i in range(len(carry))]
    source = bucket_counts(own, "_body", longest, buckets)
    gains = bucket_gains(bucket_counts(target, text_col, longest, buckets), source)
    scored = weights(own, ["_id", *names], "_body", gains, longest)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)).withColumns({"_down": -F.col("score"), "_last": F.col("_id").isNull().cast("long"), "_at": F.coalesce("_id", F.lit(0).cast("long")), "_row": F.monotonically_increasing_id()})
    scored = materialize(scored, "resample-scores")
    keys = ["_down", "_last", "_at", "_row"]
    enough = F.col("n_words") >= min_words
    can = scored.filter(enough).select(*keys)
    draws = can.count() * percent // 100
    result = [F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, carry)], "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if draws == 0:
        return scored.select(*result, none)
    drawn = enough & up_to(keys, kth(can, keys, draws))
    # the high bits of an increasing id are the range, the low 33 the place in it
    placed = scored.filter(drawn).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*result, F.monotonically_increasing_id().alias("_place"))
    placed = materialize(placed, "resample-drawn").withColumn("_range", F.shiftright("_place", 33))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_range"], before))
        before += r["n"]
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "_range long, _before long")), "_range")
    ranked = ranked.select(id_col, *carry, "n_features", "weight", "score", (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return scored.filter(~drawn).select(*result, none).unionByName(ranked)
