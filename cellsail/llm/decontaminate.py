"""Benchmark decontamination by a prefix-filtered set join.

A window of an item occurs in a document only if all its shingles do, so one
shingle of each window suffices to find it: the rarest, by counts over all
documents. Those prefix shingles are joined with the documents' shingles; the
place of the shingle in the window bounds where the window can start and whether
the rest of the document is long enough; what passes is compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cellsail.llm.textkit import ALNUM, LOWER, Block, Words, blocks, mix, windows, word_hashes, words

WINDOW, SHINGLE = 13, 3
#: Bytes of item texts of one block of the benchmark; each block is broadcast by itself, as arrays of some ten times its size.
BLOCK_TEXT_BYTES = 8 << 20
#: Windows whose shingles are compared at a time.
TURN = 50_000


@dataclass
class Items:
    """A block of items: their words joined by spaces, and the distinct windows of these."""

    text: bytes
    word: np.ndarray  # where each word begins in text
    shingles: dict[int, np.ndarray]  # hash of the shingle of each size at each word
    first: np.ndarray  # first word of each window
    length: np.ndarray  # its words
    at: np.ndarray  # where its items begin in ids
    ids: np.ndarray


@dataclass
class Windows:
    """Windows of a block that can occur, by their prefix shingle."""

    shingle: np.ndarray  # sorted; of each window
    offset: np.ndarray  # of the shingle in the window, in words
    length: np.ndarray  # of the window, in words
    start: np.ndarray  # its bytes in text
    end: np.ndarray
    at: np.ndarray  # its items in ids
    upto: np.ndarray
    text: bytes
    ids: np.ndarray


def _word_bytes(buf: np.ndarray, w: Words, i: int, n: int) -> bytes:
    return b" ".join(buf[s:e].tobytes() for s, e in zip(w.start[i : i + n], w.end[i : i + n]))


def _shingles(h: np.ndarray, w: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, hash) of the shingles of each size. A shingle has SHINGLE words, or those of a shorter window."""
    parts = [windows(h, w, k) for k in sizes]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def item_windows(names: list[str], texts: pa.Array, window: int = WINDOW) -> Items:
    """Distinct windows of the items, by two hashes; an item of fewer words, but some, is one window."""
    parts, n_words, n_bytes = [], 0, 0
    for b in blocks(texts):
        buf = LOWER[b.buf]
        w = words(b, buf, ALNUM)
        h = word_hashes(buf, w)
        first, doc, one = windows(h, w, window, whole_if_fewer=True)
        two = windows(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), w, window, whole_if_fewer=True)[2]
        short = []
        for s in range(1, SHINGLE + 1):
            own = np.zeros(len(h), np.uint64)
            place, _, value = windows(h, w, s)
            own[place] = value
            short.append(own)
        # the byte after each word stays, as a space
        keep = ALNUM[buf]
        text = np.where(keep, buf, 32).astype(np.uint8)
        keep[w.end] = True
        size = w.end - w.start + 1
        parts.append((text[keep].tobytes(), np.cumsum(size) - size + n_bytes, short, first + n_words, np.minimum(w.count[doc], window), doc + b.row, one, two))
        n_words, n_bytes = n_words + len(h), n_bytes + int(size.sum())
    if not parts:
        none = np.zeros(0, np.int64)
        return Items(b"", none, {s: none.astype(np.uint64) for s in range(1, SHINGLE + 1)}, none, none, none, none)
    text = b"".join(p[0] for p in parts)
    word, first, length, item, one, two = (np.concatenate([p[i] for p in parts]) for i in (1, 3, 4, 5, 6, 7))
    shingles = {s: np.concatenate([p[2][s - 1] for p in parts]) for s in range(1, SHINGLE + 1)}
    code = {name: i for i, name in enumerate(dict.fromkeys(names))}
    item = np.array([code[n] for n in names], dtype=np.int64)[item]
    by = np.lexsort((item, two, one))
    one, two, item = one[by], two[by], item[by]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    own = new | np.append(True, item[1:] != item[:-1])[: len(one)]
    at = np.append(np.cumsum(own) - own, own.sum())[np.append(np.flatnonzero(new), len(one))]
    return Items(text, word, shingles, first[by][new], length[by][new], at, np.array(list(code), dtype=object)[item[own]])


def _wanted(items: Items) -> np.ndarray:
    """The shingles of all windows, sorted."""
    n, found = items.length, [np.zeros(0, np.uint64)]
    for k in np.unique(n).tolist():
        s = min(SHINGLE, k)
        first = items.first[n == k]
        for j in range(k - s + 1):
            found.append(np.unique(items.shingles[s][first + j]))
    return np.unique(np.concatenate(found))


def _count_shingles(docs: DataFrame, text_col: str, wanted: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each wanted shingle occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        counts = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                buf = LOWER[b.buf]
                w = words(b, buf, ALNUM)
                _, _, shingle = _shingles(word_hashes(buf, w), w, sizes)
                _, which = lookup.find(shingle)
                counts += np.bincount(which, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["which", "n"])

    rows = docs.select(text_col).mapInArrow(work, "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(wanted), dtype=np.int64)
    counts[rows["which"].to_numpy()] = rows["n"].to_numpy()
    return counts


class _Lookup:
    """Positions of values that are in a sorted array of 64-bit hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = 8
        while (1 << bits) < 16 * len(keys) and bits < 24:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, first places in keys) of the values found."""
        at = np.flatnonzero(self.maybe[values >> self.shift])
        k = np.searchsorted(self.keys, values[at])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == values[at] if len(self.keys) else np.zeros(len(at), dtype=bool)
        return at[good], k[good]


def _prefixes(items: Items, wanted: np.ndarray, counts: np.ndarray) -> Windows:
    """Each window by its rarest shingle; windows with one that no document has go."""
    n = len(items.first)
    value, offset, seen = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, dtype=bool)
    for k in np.unique(items.length).tolist():
        s = min(SHINGLE, k)
        rows = np.flatnonzero(items.length == k)
        for i in range(0, len(rows), TURN):
            own = rows[i : i + TURN]
            x = items.shingles[s][items.first[own][:, None] + np.arange(k - s + 1)]
            often = counts[np.searchsorted(wanted, x)]
            least = often.min(axis=1)
            place = np.where(often == least[:, None], x, np.iinfo(np.uint64).max).argmin(axis=1)
            value[own], offset[own], seen[own] = x[np.arange(len(own)), place], place, least > 0
    use = np.flatnonzero(seen)
    use = use[np.argsort(value[use], kind="stable")]
    start, after = items.word[items.first[use]], items.first[use] + items.length[use]
    end = np.append(items.word, len(items.text))[after] - 1
    return Windows(value[use], offset[use], items.length[use], start, end, items.at[use], items.at[use + 1], items.text, items.ids)


def _hits(block: Block, table: Windows, lookup: _Lookup, upto: np.ndarray) -> tuple[Words, list[tuple[int, int, int]]]:
    """Words of a block and (first word, text, window) of each occurrence."""
    buf = LOWER[block.buf]
    w = words(block, buf, ALNUM)
    first, doc, shingle = _shingles(word_hashes(buf, w), w, sorted({min(SHINGLE, k) for k in np.unique(table.length).tolist()}))
    at, key = lookup.find(shingle)
    n = upto[key + 1] - upto[key]
    place = np.repeat(at, n)
    which = np.repeat(upto[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[place] - table.offset[which]
    d = doc[place]
    # positional and length bounds: the whole window lies in the text
    fits = (start >= w.first[d]) & (start + table.length[which] <= w.first[d] + w.count[d])
    out = []
    for s, x, k in zip(start[fits].tolist(), d[fits].tolist(), which[fits].tolist()):
        if _word_bytes(buf, w, s, int(table.length[k])) == table.text[table.start[k] : table.end[k]]:
            out.append((s, x, k))
    return w, out


def find_windows(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_TEXT_BYTES) -> DataFrame:
    """carry columns, n_words, n_hit, n_items, items_sha256 and contaminated of each row.

    The benchmark is the stated query set: it is taken in blocks of block_bytes of
    text, each broadcast by itself, and every document meets every block in one
    pass. Items with a null id or without words are left out; rows of one item id
    are one item. A null or empty text has no words. Repeated rows get equal results,
    an empty table none; an empty benchmark hits nothing; texts of any length are
    taken whole. Carried columns may not have the names of the results.
    """
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    names = [f"carried_{i}" for i in range(len(carry))]  # whatever the columns are called
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(text_col).alias("_text"))
    plain = own.select(*names).schema.fields
    inner = StructType([*plain, StructField("_text", StringType()), StructField("_hits", ArrayType(LongType())), StructField("_items", ArrayType(StringType()))])
    schema = StructType([*plain, *(StructField(n, LongType()) for n in ("n_words", "n_hit", "n_items")), StructField("items_sha256", StringType())])
    state = own.select(*names, "_text", F.array().cast("array<bigint>").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    for i in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        got = part.toArrow()
        found = item_windows(got["item"].to_pylist(), got["t"].combine_chunks(), window)
        wanted = _wanted(found)
        table = _prefixes(found, wanted, _count_shingles(docs, text_col, wanted, sorted({min(SHINGLE, int(k)) for k in np.unique(found.length)})))
        search = _search(spark.sparkContext.broadcast(table), inner)
        # the last search and the summary are one step of the same worker
        state = state.mapInArrow(search, inner) if i < n_blocks - 1 else state.mapInArrow(_then(search, _summary(schema)), schema)
    out = state.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.withColumnsRenamed(dict(zip(names, carry)))


def _then(first, second):
    return lambda batches: second(first(batches))


def _search(shared, schema: StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        unique, first = np.unique(table.shingle, return_index=True)
        upto = np.append(first, len(table.shingle))
        lookup = _Lookup(unique)
        for batch in batches:
            n = batch.num_columns
            hits, ids = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            for b in blocks(batch.column(n - 3)):
                w, found = _hits(b, table, lookup, upto)
                for start, d, k in found:
                    # word positions in the text, and the window's length
                    hits[b.row + d] += [start - int(w.first[d]), int(table.length[k])]
                    ids[b.row + d] = sorted({*ids[b.row + d], *table.ids[table.at[k] : table.upto[k]]})
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(hits, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], schema.fieldNames())

    return work


def _summary(schema: StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            n_words = np.concatenate([np.zeros(0, np.int64), *(words(b, LOWER[b.buf], ALNUM).count for b in blocks(batch.column(n - 3)))])
            n_hit = np.zeros(batch.num_rows, dtype=np.int64)
            for i, h in enumerate(batch.column(n - 2).to_pylist()):
                if h:
                    cover = np.zeros(int(n_words[i]) + 1, dtype=np.int64)
                    np.add.at(cover, h[0::2], 1)
                    np.add.at(cover, np.array(h[0::2]) + np.array(h[1::2]), -1)
                    n_hit[i] = int((np.cumsum(cover) > 0).sum())
            ids = batch.column(n - 1).to_pylist()
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in ids], pa.int64()), pa.array(digest)], schema.fieldNames())

    return work
