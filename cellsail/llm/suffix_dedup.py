"""Suffix-array dedup: removes every byte of a long string that occurred earlier.

A string is a window of LENGTH bytes; it is marked if the same bytes also start
earlier in the corpus. Which windows are equal is decided by suffix arrays.

1. Each window has an anchor, the k-gram of least hash in it, which depends on
   nothing else (winnowing, Schleimer et al., 2003). Runs of windows with one
   anchor are pieces of text. Equal windows have equal anchors, so pieces whose
   anchor no other piece has are done.
2. The other pieces meet by anchor as texts, a megabyte or so of whole anchors at a
   time. Their suffix array is built by two-stage sorting (Itoh and Tanaka, 1999):
   suffixes smaller than their successors are sorted directly, the rest is induced
   by scanning the buckets, and adjacent common prefixes tell which windows are equal.
3. Anchors of more than HOT_PIECES pieces are dealt out by window, so that no task
   gets all of one. Of a window that a task has several times only the first goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsail.llm.sieve import maybe, sieve
from cellsail.llm.store import materialize
from cellsail.llm.textkit import Block, U, blocks, mix, prefix_hash, span_hash

LENGTH, GRAM = 100, 20
#: Pieces that a task holds before it passes them on.
TASK_PIECES = 500_000
#: Anchors with more pieces are dealt out by window instead.
HOT_PIECES = 4096
#: Hot windows that a task holds before it passes them on.
TASK_WINDOWS = 100_000
#: Bytes of one suffix array: that of whole anchors ends when it has so many.
ARRAY_BYTES = 1 << 20
#: Bytes of a long text of which pieces are found at a time.
SLICE_BYTES = 1 << 20
_PLACE = 24  # bits
_COUNT = 10  # bits of a piece's number of windows, below its place


def pieces(block: Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, hash of the anchor) of each piece of a block."""
    n = len(block.buf)
    long_ = np.flatnonzero(block.end - block.start >= length)
    if len(long_) == 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    sums = prefix_hash(block.buf)
    at = np.arange(n - gram + 1)
    h = span_hash(sums, at, at + gram)
    low = U((1 << _PLACE) - 1)
    # the least hash wins, and of equal ones the last
    v = (h & ~low) | (low - (at.astype(U) & low))
    w = length - gram + 1
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(U).max, dtype=U)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(v) - w + 1
    least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    count = block.end[long_] - block.start[long_] - length + 1
    s = np.repeat(block.start[long_], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(long_, count)
    value = least[s]
    head = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(s)))
    lo, doc = s[first], doc[first]
    anchor = lo + ((((low - (value[first] & low)).astype(np.int64)) - lo) & int(low))
    return doc, lo - block.start[doc], size, h[anchor]


def _later(group: np.ndarray, k: np.ndarray, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows start later than the first of their group, and which are that first one again."""
    by = np.lexsort((at, u, k, group))
    g, place = group[by], [x[by] for x in (k, u, at)]
    head = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else np.zeros(0, np.int64)
    same = np.logical_and.reduce([x == x[first] for x in place])
    later, again = np.zeros(len(g), dtype=bool), np.zeros(len(g), dtype=bool)
    later[by], again[by] = ~same, same & ~head
    return later, again


def _merge(k: np.ndarray, u: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows with those that touch joined."""
    by = np.lexsort((lo, u, k))
    k, u, lo, n = k[by], u[by], lo[by], n[by]
    if len(k) == 0:
        return k, u, lo, n
    head = np.append(True, (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (lo[1:] != lo[:-1] + n[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(k)) - 1
    return k[first], u[first], lo[first], lo[last] + n[last] - lo[first]


def _slices(block: Block, length: int) -> Iterator[tuple[int, Block]]:
    """A block as it is, or a long text in slices that share no window, each with its first byte."""
    if block.n != 1 or len(block.buf) <= 2 * SLICE_BYTES:
        yield 0, block
        return
    end = int(block.end[0])
    for at in range(0, end - length + 1, SLICE_BYTES):
        part = block.buf[at : min(end, at + SLICE_BYTES + length - 1)]
        yield at, Block(block.row, part, np.array([0]), np.array([len(part)]))


def _find_pieces(length: int):
    """(a, fp, k, u, p): the first piece of each anchor of a task, by anchor (a), with the anchor as fp too if there are others.

    Those have a hash of anchor and place as a, so that however common an anchor
    is, no task gets all of its pieces. p is the first window and the number of windows.
    """

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        fp, k, u, p = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(fp)
        fp, k, u, p = fp[by], k[by], u[by], p[by]
        head = np.append(True, fp[1:] != fp[:-1])
        alone = head & np.append(head[1:], True)
        a = np.where(head, fp, mix(fp ^ mix(k.view(U) ^ (p.view(U) << U(20)))))
        for i in range(0, len(fp), 50_000):
            at = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(fp[at].view(np.int64), mask=alone[at]), *(pa.array(x[at]) for x in (k, u, p))], ["a", "fp", "k", "u", "p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            k, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2)):
                for at, b in _slices(block, length):
                    doc, lo, n, fp = pieces(b, length)
                    held.append((fp, k[b.row + doc], u[b.row + doc], (lo + at) << _COUNT | n))
                    count += len(doc)
                    if count > TASK_PIECES:
                        yield from flush(held)
                        held, count = [], 0
        if held:
            yield from flush(held)

    return work


class Ranks:
    """Ranks of the 8 and of the 24 bytes at each place of a text, in order of the bytes; past its end come zeros."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text) + depth + 128
        padded = np.zeros(n + 8, dtype=np.uint8)
        padded[: len(text)] = text
        word = np.zeros(n, dtype=U)
        for i in range(8):
            word |= padded[i : i + n].astype(U) << U(56 - 8 * i)
        self.of8 = _dense(word)
        longer = self.of8[:-16].astype(U) << U(42)
        longer |= self.of8[8:-8].astype(U) << U(21)
        longer |= self.of8[16:]
        self.of24 = _dense(longer)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), dtype=np.uint32)
    out[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.uint32)
    return out


def suffix_array(text: np.ndarray, depth: int = LENGTH, ranks: Ranks | None = None) -> np.ndarray:
    """Starts of the suffixes of text, of less than 2 MB, in order of their first depth bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    r = ranks or Ranks(text, depth)
    # smaller than the successor: the next other byte is larger; the end counts as smallest
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1).astype(np.int32)
    end = np.repeat(change, np.diff(np.append(-1, change)))
    after = np.append(text, 0)[end + 1]
    order = np.flatnonzero((after > text) & (end < n - 1)).astype(np.int32)
    key = r.of24[order].astype(U) << U(42) | r.of24[order + 24].astype(U) << U(21) | r.of24[order + 48]
    by = np.argsort(key)
    order, key = order[by], key[by]
    tied = np.append(False, key[1:] == key[:-1]) if len(order) else np.zeros(0, dtype=bool)
    for at in range(72, depth, 32):
        if not tied.any():
            break
        member = tied.copy()
        member[:-1] |= tied[1:]
        slot = np.flatnonzero(member)
        group = np.cumsum(~tied[slot])
        start = order[slot]
        key = group.astype(U) << U(42) | r.of24[start + at].astype(U) << U(21) | r.of8[start + at + 24]
        by = np.argsort(key)
        order[slot] = start[by]
        key = key[by]
        tied[slot] = np.append(False, key[1:] == key[:-1])
    bucket_end = np.cumsum(np.bincount(text[order], minlength=256))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[n - 1])].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        scanned = []
        turn = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
        while len(turn):
            scanned.append(turn)
            before = turn[turn > 0] - 1
            turn = before[text[before] == c]
        scanned.append(order[bucket_end[c - 1] if c else 0 : bucket_end[c]])
        row = np.concatenate(scanned)
        if len(row) == 0:
            continue
        out.append(row)
        before = row[row > 0] - 1
        to = text[before]
        before, to = before[to > c], to[to > c]
        by = np.argsort(to, kind="stable")
        for part in np.split(before[by], np.flatnonzero(np.diff(to[by])) + 1) if len(before) else ():
            waiting[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(ranks: Ranks, starts: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it: most, or below that a lower bound, in steps of 24 bytes."""
    out = np.zeros(len(starts), dtype=np.int32)
    same = np.append(False, np.ones(max(0, len(starts) - 1), dtype=bool))[: len(starts)]
    for at in [*range(0, most - 23, 24), *range(most - most % 24, most, 8)]:
        # the last step may go back a little, but not on
        step, width = (ranks.of24, 24) if at + 24 <= most and at % 24 == 0 else (ranks.of8, 8)
        at = min(at, most - width)
        value = step[starts + at]
        same[1:] &= value[1:] == value[:-1]
        out[same] = at + width
    return out


class _Held:
    """Pieces of whole keys for one suffix array, each text once with all its places."""

    def __init__(self):
        self.k, self.u, self.lo, self.which = [], [], [], []
        self.texts: list[bytes] = []
        self.own: dict[bytes, int] = {}  # texts of the last key
        self.size = 0

    def add(self, k: int, u: int, lo: int, text: bytes) -> None:
        at = self.own.get(text)
        if at is None:
            at = self.own[text] = len(self.texts)
            self.texts.append(text)
            self.size += len(text) + 1
        self.k.append(k)
        self.u.append(u)
        self.lo.append(lo)
        self.which.append(at)

    def marks(self, length: int, more: bool = False) -> tuple[tuple[np.ndarray, ...], "_Held"]:
        """(k, u, first window, windows) that start earlier among these, and if there is more of the last key, its others, each once."""
        k, u, lo, which = (np.array(x, dtype=np.int64) for x in (self.k, self.u, self.lo, self.which))
        by = np.lexsort((lo, u, k, which))
        k, u, lo, which = k[by], u[by], lo[by], which[by]
        head = np.append(True, which[1:] != which[:-1])
        size = np.array([len(t) for t in self.texts], dtype=np.int32)
        text = np.frombuffer(b"\xff".join(self.texts) + b"\xff", dtype=np.uint8)
        start = np.cumsum(size + 1, dtype=np.int32) - size - 1
        ranks = Ranks(text, length)
        sa = suffix_array(text, length, ranks)
        p = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)[sa]
        window = sa + length <= (start + size)[p]
        sa, p = sa[window], p[window]
        same = common_prefixes(ranks, sa, length) == length
        group = np.cumsum(~same, dtype=np.int32)
        # each text's first place, for its windows; at its other places all that the array has are late
        k1, u1, lo1 = k[head], u[head], lo[head]
        again = same.copy()
        again[:-1] |= same[1:]
        some = np.flatnonzero(again)
        of, at = p[some], lo1[p[some]] + sa[some] - start[p[some]]
        late = _later(group[some], k1[of], u1[of], at)[0]
        one = np.ones(int(late.sum()), np.int64)
        windows = np.bincount(p, minlength=len(size))[which]
        first = np.flatnonzero(head)[which]
        other = (windows > 0) & ((k != k[first]) | (u != u[first]) | (lo != lo[first]))
        found = _merge(*(np.concatenate(x) for x in zip((k1[of[late]], u1[of[late]], at[late], one), (k[other], u[other], lo[other], windows[other]))))
        rest = _Held()
        if more:
            ours = np.flatnonzero(np.delete(p, some[late]) >= min(self.own.values()))
            for i, j in zip(*(np.delete(x, some[late])[ours].tolist() for x in (sa, p))):
                i -= int(start[j])
                rest.add(int(k1[j]), int(u1[j]), int(lo1[j]) + i, self.texts[j][i : i + length])
        return found, rest


def _mark_windows(length: int):
    """Rows (key, k, u, lo, n, piece) sorted by key, a suffix array for each megabyte or so of whole keys; rows without a piece are marks.

    A key that alone has more goes through several arrays, and the first of equal windows from one to the next.
    """

    def batch_of(marks) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in marks], ["k", "u", "lo", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Held(), None
        for batch in batches:
            mark = pa.compute.is_null(batch.column(5))
            marks = batch.filter(mark)
            if marks.num_rows:
                yield batch_of([marks.column(i).to_numpy() for i in range(1, 5)])
            rows = batch.filter(pa.compute.invert(mark))
            for key, k, u, lo, piece in zip(*(rows.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                if key != last:
                    if held.size > ARRAY_BYTES or len(held.k) > TASK_WINDOWS:
                        yield batch_of(held.marks(length)[0])
                        held = _Held()
                    last, held.own = key, {}
                held.add(k, u, lo, piece)
                if held.size > ARRAY_BYTES * 7 // 4 or len(held.k) > 4 * TASK_WINDOWS:  # below what ranks can tell apart
                    found, held = held.marks(length, more=True)
                    yield batch_of(found)
        if held.texts:
            yield batch_of(held.marks(length)[0])

    return work


def _cut_pieces(length: int):
    """Rows (k, u, text, anchors, places, hot) as (key, k, u, lo, n, bytes); hot ones window by window, of equal ones the first."""

    def batch_of(rows: list) -> pa.RecordBatch:
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 6, types)], ["key", "k", "u", "lo", "n", "piece"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first: dict[bytes, tuple[int, int, int]] = {}

        def hot() -> None:
            for window, place in first.items():
                out.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big", signed=True), *place, 1, window))
            first.clear()

        for batch in batches:
            ks, us = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode()
                for fp, p, is_hot in zip(*(batch.column(c)[i].as_py() for c in (3, 4, 5))):
                    lo, n = p >> _COUNT, p & ((1 << _COUNT) - 1)
                    if not is_hot:
                        out.append((fp, ks[i], us[i], lo, n, text[lo : lo + length + n - 1]))
                        continue
                    for at in range(lo, lo + n):
                        window, place = text[at : at + length], (ks[i], us[i], at)
                        before = first.get(window, place)
                        first[window] = min(before, place)
                        if before != place:
                            late = max(before, place)
                            out.append((hash(late), *late, 1, None))
                if len(first) > TASK_WINDOWS:
                    hot()
                if len(out) > 20_000:
                    yield batch_of(out)
                    out.clear()
        hot()
        yield batch_of(out)

    return work


def _remove(length: int, texts_too: bool, schema_names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, spans, digest, left = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = (batch.column(2)[i].as_py() or "").encode()
                first, count = batch.column(3)[i].as_py() or [], batch.column(4)[i].as_py() or []
                runs: list[list[int]] = []
                for lo, n in sorted(zip(first, count)):
                    end = lo + n - 1 + length
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([lo, end])
                at, parts = 0, []
                for lo, end in runs:
                    parts.append(raw[at:lo])
                    at = end
                rest = b"".join([*parts, raw[at:]])
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(len(runs))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(left, pa.binary())] * texts_too, schema_names)

    return work


def _with(named: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """named joined with rows by (k, u). Only texts that may have a row are shuffled."""
    bits = sieve(rows.select(F.xxhash64("k", "u").alias("h")), "h")
    flagged = named.withColumn("maybe", maybe(bits, F.xxhash64("k", "u")))
    rows = rows.withColumnsRenamed({"k": "k2", "u": "u2"})
    found = flagged.filter("maybe").join(rows.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & (F.col("u") == F.col("u2")), how)
    if how == "left":
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
        found = found.unionByName(flagged.filter("NOT maybe").select("*", *none))
    return found.drop("maybe", "k2", "u2")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    A byte goes if a window of length bytes covers it that also starts earlier: at
    a smaller id, or earlier in the same document. Null texts are empty. A null id
    counts as the least. Ids are whole numbers, or text that casts to them. Rows
    with one id and one text are one document and get equal results; texts that
    share an id are ordered by their hashes. An empty table gives no rows, columns
    of other names are not looked at, and a text may have up to 2 GB.
    """
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(text_col).alias("text"))
    shared_ids = bool(named.groupBy("k").count().filter("count > 1").limit(1).count())
    named = named.withColumn("u", F.coalesce(F.xxhash64("text"), F.lit(0)) if shared_ids else F.lit(0).cast("long")).select("k", "u", "text")
    found = named.filter(F.octet_length("text") >= length).mapInArrow(_find_pieces(length), "a long, fp long, k long, u long, p long")
    several = (F.count("*").over(Window.partitionBy("a")) > 1) | F.col("fp").isNotNull()
    found = materialize(found.withColumn("several", several).filter("several").select(F.coalesce("fp", "a").alias("fp"), "k", "u", "p"), "suffix-pieces")
    hot = materialize(found.groupBy("fp").agg((F.count("*") > HOT_PIECES).alias("hot")).filter("hot").withColumnRenamed("fp", "hot_fp"), "suffix-hot")
    found = found.join(hot, found["fp"] == hot["hot_fp"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = found.groupBy("k", "u").agg(F.collect_list(F.struct("fp", "p", "hot")).alias("x")).select("k", "u", "x.fp", "x.p", "x.hot")
    wanted = materialize(wanted, "suffix-wanted")
    cut = _with(named.dropDuplicates(["k", "u"]) if shared_ids else named, wanted, "inner").select("k", "u", "text", "fp", "p", "hot")
    cut = cut.mapInArrow(_cut_pieces(length), "key long, k long, u long, lo long, n long, piece binary")
    marks = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_mark_windows(length), "k long, u long, lo long, n long")
    marks = materialize(marks, "suffix-marks")
    spans = marks.groupBy("k", "u").agg(F.collect_list(F.struct("lo", "n")).alias("x")).select("k", "u", "x.lo", "x.n")
    out = _with(named, spans, "left").select("k", "u", "text", "lo", "n")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
    types = ["long", "long", "long", "long", "string", *["binary"] * with_bytes]
    out = out.mapInArrow(_remove(length, with_bytes, names), ", ".join(f"`{a}` {b}" for a, b in zip(names, types)))
    return out.withColumn(id_col, F.when(F.col(id_col) != -(1 << 63), F.col(id_col)))
