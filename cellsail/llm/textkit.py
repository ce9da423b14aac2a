"""Words, windows and n-grams of Arrow string batches, in numpy.

Texts are handled in blocks of about a megabyte of UTF-8, so the arrays of one
task stay small whatever the batch size; a longer text is a block of its own.
Every text is followed by one newline in its block, so that no word, line or
n-gram spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: A-Z to a-z, byte by byte.
LOWER = _lower
#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def unused(name: str, taken: list[str]) -> str:
    """name, longer if a column has it: Spark compares names without case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash gets the hash of any slice of values."""
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum((values.astype(U) + U(1)) * _power("up", _BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, equal for equal slices wherever they are."""
    down = _power("down", _INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Texts [row, row + n) of a batch: bytes, and where each text starts and ends."""

    row: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text of each of ascending byte positions."""
        return np.repeat(np.arange(self.n), np.diff(np.append(np.searchsorted(positions, self.start), len(positions))))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total = np.cumsum(size)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + limit, "right")))
        part = pc.binary_join_element_wise(texts.slice(row, stop - row), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        part = pa.concat_arrays([part]) if part.offset else part
        off = np.frombuffer(part.buffers()[1], dtype=np.int64)[: len(part) + 1]
        buf = np.frombuffer(part.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        yield Block(row, buf, off[:-1], off[1:] - 1)
        row = stop


@dataclass
class Words:
    """Byte ranges of the words of a block, the text of each, and each text's word range."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray


def words(block: Block, buf: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.insert(edge, 0, 0)
    start, end = edge[0::2], edge[1::2]  # the newline after each text ends its last word
    first = np.searchsorted(start, block.start)
    count = np.diff(np.append(first, len(start)))
    return Words(start, end, np.repeat(np.arange(block.n), count), first, count)


def word_hashes(buf: np.ndarray, w: Words) -> np.ndarray:
    return span_hash(prefix_hash(buf), w.start, w.end)


def windows(hashes: np.ndarray, w: Words, k: int, whole_if_fewer: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text: (first word, text, hash).

    whole_if_fewer: a text of fewer words, but not none, is one window.
    """
    sums = prefix_hash(hashes)
    last = w.first + w.count
    at = np.arange(len(hashes))
    full = at + k <= np.repeat(last, w.count)
    start, end = at[full], at[full] + k
    if whole_if_fewer:
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        start = np.concatenate([start, w.first[short]])
        end = np.concatenate([end, last[short]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, w.doc[start], span_hash(sums, start, end)


def unique_in_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) in ascending order."""
    order = np.lexsort((h, doc)) if len(h) and doc[-1] >= (1 << 20) else np.argsort((doc.astype(U) << U(44)) | (h >> U(20)))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def byte_grams(buf: np.ndarray, n: int, end: np.ndarray) -> np.ndarray:
    """Hashes of the n bytes from each position, n at most 8; the last n - 1 of each text, whose newline is at end, are cut short."""
    key = buf.astype(U)
    for i in range(1, n):
        later = buf[i:].astype(U)
        later[in_last(end, i, len(later))] = 0
        key[: len(later)] |= later << U(8 * i)
    return mix(key * U(31) + U(n))


def in_last(end: np.ndarray, n: int, size: int) -> np.ndarray:
    """The last n positions up to each end, those of 0 to size - 1. Of a shorter text they reach into the end of the one before."""
    at = (end[:, None] - np.arange(n)).ravel()
    return at[(at >= 0) & (at < size)]


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, A-Z and the capital letters of Latin-1 lower-cased, and each text's first position."""
    chars = np.frombuffer(block.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).copy()
    upper = ((chars >= 65) & (chars <= 90)) | ((chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7))
    chars[upper] += 32
    begins = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
    return chars, begins[block.start]


def char_grams(block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n code points from each one, n at most 3, of texts in lower case as by code_points; each text's first and how many it has.

    Those at the end of a text are cut short after its newline.
    """
    chars, first = code_points(block)
    end = np.append(first[1:], len(chars)) - 1
    key = chars.astype(U)
    for i in range(1, n):
        later = chars[i:].astype(U) << U(21 * i)
        later[in_last(end, i, len(later))] = 0
        key[: len(later)] |= later
    return mix(key * U(31) + U(n)), first, end + 1 - first


def sums_by_doc(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each text's slice of values, 0 for an empty one."""
    out = np.zeros(len(first), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    has = count > 0
    if has.any():
        # slices follow one another and the empty ones are left out, so that each sum ends where the next begins
        ends = first[has] + count[has]
        total = np.add.reduceat(np.append(values[: ends[-1]], values.dtype.type(0)), first[has])
        out[has] = total
    return out
