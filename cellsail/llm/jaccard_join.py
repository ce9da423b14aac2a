"""N-gram Jaccard join: partitioned universe, pigeonhole signatures, exact verification.

Sets of shingles fall into bands of sizes. A band cuts the universe of hashes into
segments, some more than the differences that it allows, so that linked sets have
several segments in common. Costs over the whole corpus decide which segments of a
band are indexed once, with their one-deletion neighbourhood too, or not at all
(Deng et al., 2015, and Arasu et al., 2006). Of its segments each set indexes a
subset: it leaves out its lightest, of few or no tokens, as many as there are to
spare. Those are the ones that unlike sets share.

Nodes are distinct sets, so exact copies never meet as pairs. The sets of one
signature are compared with the one of them that has most signatures in common with
others, their lead. Two of its other sets can link outside its component only if
they differ from the lead in one same token at least. So where a comparison leaves
a large signature in several components, the differences from its lead are the
signatures of the next turn: small ones are compared in pairs, larger ones have a
lead again. All comparisons are of sets that share a signature.

Comparisons are first of images of the sets, which have half of each token: images
differ in no more tokens than their sets, so what they leave apart is apart. What
they leave together is compared exactly. Before sets are compared in pairs, sketches
tell most of those apart that share a difference and no more: bits that a token
turns over, so that sets differ in as many tokens as their sketches in bits, at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.llm.components import components, labelled, merged
from cellsail.llm.sieve import maybe, passes, sieve
from cellsail.llm.store import materialize
from cellsail.llm.textkit import LOWER, NOT_SPACE, Block, U, blocks, mix, unique_in_doc, windows, word_hashes, words

#: Sizes of a band grow by this ratio, or by 1 / similarity if that is more.
BAND_RATIO = 1.5
#: Segments to spare, as a share of those needed.
SPARE = 0.3
#: Tokens of a segment, on average, from which on its one-deletion neighbourhood is considered: of fewer tokens, unlike sets share it.
LEAST_FOR_DELETION = 7
#: One signature in so many is counted for the costs of segments, of all documents.
COST_SHARE = 64
#: Signatures that a task holds before it passes them on.
TASK_SIGNATURES = 1_000_000
#: Sets that one task compares with one lead, and tokens of them that it holds.
CHUNK, CHUNK_TOKENS = 256, 2_000_000
#: Sets of a large lead that stand for all of them when tokens are put in order.
SAMPLE = 32
#: Groups with so many pairs between components for each of their sets are compared in pairs; beyond that they have a lead.
#: Each turn allows GROWTH times as many, so that turns come to an end.
PAIRS, GROWTH = 16, 4
#: Words of 64 bits of a sketch, and their columns. Sets that may differ in more tokens than half of its bits pass.
WORDS = 16
SKETCH = [f"s{i}_" for i in range(WORDS)]


@dataclass
class Scheme:
    """How a band's segments are indexed: value 0, 1 or 2 of each, and the values before it in order of cost."""

    n: int
    value: np.ndarray
    before: np.ndarray


class Bands:
    """Bands of set sizes for 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = Fraction(percent, 100)
        self.slack = (1 - self.least) / (1 + self.least)
        self.ratio = max(BAND_RATIO, float(1 / self.least))
        self.starts = [1]

    def _reach(self, size: int) -> None:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(np.ceil(self.starts[-1] * self.ratio))))

    def of(self, size: int) -> int:
        self._reach(size)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def difference(self, a: int, b: int) -> int:
        """The most tokens in which linked sets of sizes a and b differ."""
        return int(self.slack * (a + b))

    def largest(self, size: int) -> int:
        return int(size / self.least)

    def farthest(self, size: int) -> int:
        """The most tokens in which a set of this size differs from any linked set."""
        return self.difference(size, self.largest(size))

    def _needed(self, band: int) -> int:
        while len(self.starts) < band + 2:
            self._reach(self.starts[-1])
        return self.difference(self.starts[band + 1] - 1, self.starts[band + 1] - 1) + 1

    def spare(self, band: int) -> int:
        return int(self._needed(band) * SPARE)

    def segments(self, band: int) -> int:
        return self._needed(band) + self.spare(band)

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, values needed) for the bands in which a set of this size meets others.

        Linked sets that can differ in nothing are one set, and need no band.
        """
        own, far = self.of(size), self.largest(size)
        self._reach(far)
        end = self.starts[own + 1] - 1
        out = [(own, self.difference(size, min(far, end)) + 1)]
        if far > end:
            out.append((own + 1, self.difference(size, far) + 1))
        return [x for x in out if x[1] > 1]


def doc_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sizes of the sets, and ids of the sets."""
    buf = LOWER[block.buf]
    w = words(block, buf, NOT_SPACE)
    _, doc, h = windows(word_hashes(buf, w), w, k, whole_if_fewer=True)
    doc, h = unique_in_doc(doc, h)
    size = np.bincount(doc, minlength=block.n)
    sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    end = np.cumsum(size)
    return doc, h, size, mix((sums[end] - sums[end - size]) ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))


def signatures(size: np.ndarray, h: np.ndarray, bands: Bands, schemes: dict[int, Scheme] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, segment, key) of every indexed signature of sets with these sizes and sorted hashes.

    Of a role's segments of value 1, the lightest go, as many as the band has to
    spare: those of fewest tokens, and of equally many those of least key. Linked
    sets have values of more than that in common, and both rank a segment that
    they have in common alike among these, so both index the heaviest one.
    """
    first = np.cumsum(size) - size
    roles: dict[int, list[tuple[int, int]]] = {int(n): bands.roles(int(n)) for n in np.unique(size) if n}
    rows = [(i, b, need) for i, n in enumerate(size.tolist()) if n for b, need in roles[n]]
    if not rows:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    which, band, need = (np.array(x, dtype=np.int64) for x in zip(*rows))
    names, band_at = np.unique(band, return_inverse=True)
    m_of, spare_of = (np.array([f(int(b)) for b in names]) for f in (bands.segments, bands.spare))
    m, spare = m_of[band_at], spare_of[band_at]
    # tokens of each role, in order of hash and so of segment, since segments are ranges of hashes
    n_tokens = size[which]
    role = np.repeat(np.arange(len(which)), n_tokens)
    token = h[np.repeat(first[which], n_tokens) + np.arange(len(role)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)]
    segment = (((token >> U(32)) * m[role].astype(U)) >> U(32)).astype(np.int64)
    base = np.cumsum(m) - m
    cell = base[role] + segment
    mixed = mix(token + U(0x632BE59BD9B4E019))
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    total = np.zeros(int(m.sum()), dtype=U)
    total[cell[edge]] = np.add.reduceat(mixed, edge)
    weight = np.bincount(cell, minlength=len(total))
    # keys know their band and segment, so that equal tokens elsewhere do not meet
    seg_of = np.arange(len(total)) - np.repeat(base, m)
    role_of = np.repeat(np.arange(len(which)), m)
    salt = mix(band[role_of].astype(U) * U(0x100000001B3) + seg_of.astype(U) + U(0xABCDEF))
    if schemes is None:
        value, before = np.ones(len(total), np.int64), seg_of
    else:
        table = [schemes.get(int(b)) or _plain(int(n)) for b, n in zip(names, m_of)]
        at = (np.cumsum(m_of) - m_of)[band_at][role_of] + seg_of
        value, before = np.concatenate([t.value for t in table])[at], np.concatenate([t.before for t in table])[at]
    use = (value > 0) & (before < (need + spare)[role_of])
    key = mix(total + salt)
    once = np.flatnonzero(use & (value == 1))
    once = once[np.argsort(key[once], kind="stable")]
    once = once[np.argsort(role_of[once] * (int(weight.max()) + 1) + weight[once], kind="stable")]
    rank = np.arange(len(once)) - np.searchsorted(role_of[once], np.arange(len(which)))[role_of[once]]
    use[once[rank < spare[role_of[once]]]] = False
    out = [(which[role_of[use]], band[role_of[use]], seg_of[use], key[use])]
    twice = use & (value == 2)
    if twice.any():
        one = twice[cell]
        c = cell[one]
        out.append((which[role_of[c]], band[role_of[c]], seg_of[c], mix(total[c] - mixed[one] + salt[c])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _plain(n: int) -> Scheme:
    return Scheme(n, np.ones(n, np.int64), np.arange(n))


def allocate(n: int, collisions: np.ndarray, sets: float, mean_size: float) -> Scheme:
    """Values of n segments that sum to n, cheap by the collisions that single values would make.

    A costly segment is left out and a cheap one gets its one-deletion
    neighbourhood instead, as long as that lowers the cost: the pairs that meet
    and the signatures written. Segments of very few tokens have none.
    """
    value = np.ones(n, dtype=np.int64)
    cost = collisions + sets
    order = np.argsort(cost, kind="stable")
    width = mean_size / n + 1
    cheap, dear = 0, n - 1
    while cheap < dear and width > LEAST_FOR_DELETION:
        i, j = order[cheap], order[dear]
        if cost[j] + cost[i] <= sets * width + collisions[i] * width:
            break
        value[i], value[j] = 2, 0
        cheap, dear = cheap + 1, dear - 1
    before = np.zeros(n, dtype=np.int64)
    before[order] = np.cumsum(value[order]) - value[order]
    return Scheme(n, value, before)


def _first_pass(k: int, bands: Bands, schema: list[str]):
    """Sizes and set ids of documents, and a share of the signatures for the costs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                _, h, size, sid = doc_sets(b, k)
                rest = batch.slice(b.row, b.n).columns[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.n, np.int32)), *rest, pa.array(size.astype(np.int64)), pa.array(sid.view(np.int64)), *(pa.nulls(b.n, pa.int64()) for _ in range(3))], schema)
                which, band, seg, key = signatures(size, h, bands, None)
                some = key % U(COST_SHARE) == 0
                n = int(some.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *(pa.nulls(n, c.type) for c in rest), pa.array(size[which[some]].astype(np.int64)), pa.array(sid[which[some]].view(np.int64)), pa.array(band[some]), pa.array(seg[some]), pa.array(key[some].view(np.int64))], schema)

    return work


def _schemes(sample: DataFrame, bands: Bands) -> dict[int, Scheme]:
    """Schemes of bands from the costs of their segments; one row a segment reaches the driver."""
    met = sample.select("band", "segment", "key", "sid").distinct().groupBy("band", "segment", "key").agg(F.count("*").alias("n"))
    met = met.groupBy("band", "segment").agg((F.sum(F.col("n") * (F.col("n") - 1) / 2) * COST_SHARE).alias("pairs"), (F.sum("n") * COST_SHARE).alias("sets"))
    costs: dict[int, list] = {}
    for r in met.collect():  # as many segments as the largest set has differences, for each band
        costs.setdefault(r["band"], []).append(r)
    out = {}
    for band, rs in costs.items():
        n = bands.segments(band)
        pairs = np.zeros(n)
        pairs[[r["segment"] for r in rs]] = [r["pairs"] for r in rs]
        out[band] = allocate(n, pairs, float(np.mean([r["sets"] for r in rs])), 0.8 * bands.starts[band + 1])
    return out


def _index(k: int, bands: Bands, schemes):
    """(a, b, c): signatures of the sets of a task.

    A signature has one row (signature, a set of it, null), or the signature once
    more as c if the task has other sets of it. The others' rows carry it as c, and
    a hash of both as a, so that however common a signature is, no task gets all.
    """

    def flush(sigs: list, sids: list) -> Iterator[pa.RecordBatch]:
        sig, sid = np.concatenate([np.zeros(0, U), *sigs]), np.concatenate([np.zeros(0, U), *sids])
        if len(sig) == 0:
            return
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1]))
        sig, sid = sig[new], sid[new]
        head = np.append(True, sig[1:] != sig[:-1])
        n = np.diff(np.append(np.flatnonzero(head), len(sig)))
        alone = np.repeat(n == 1, n)
        key = np.where(head, sig, mix(sig ^ mix(sid)))
        yield from _slices([key.view(np.int64), sid.view(np.int64), sig.view(np.int64)], ["a", "b", "c"], alone)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sids, held = [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                _, h, size, sid = doc_sets(b, k)
                fresh = np.array([x not in seen and not seen.add(x) for x in sid.tolist()], dtype=bool)
                h, size, sid = h[np.repeat(fresh, size)], size[fresh], sid[fresh]
                which, _, _, key = signatures(size, h, bands, schemes.value)
                sigs.append(key)
                sids.append(sid[which])
                held += len(key)
                if held > TASK_SIGNATURES:
                    yield from flush(sigs, sids)
                    sigs, sids, held = [], [], 0
                    seen.clear()
        yield from flush(sigs, sids)

    return work


def _slices(columns: list[np.ndarray], names: list[str], last_null: np.ndarray | None = None, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), rows):
        at = slice(i, i + rows)
        arrays = [pa.array(x[at]) for x in columns]
        if last_null is not None:
            arrays[-1] = pa.array(columns[-1][at], mask=last_null[at])
        yield pa.RecordBatch.from_arrays(arrays, names)


def _members(index: DataFrame) -> DataFrame:
    """(g, a): the sets of each signature that several have."""
    w = Window.partitionBy("a")
    rows = index.select("a", "b", "c", F.min("b").over(w).alias("low"), F.max("b").over(w).alias("high"))
    return rows.filter("low < high OR c IS NOT NULL").select(F.coalesce("c", "a").alias("g"), F.col("b").alias("a")).distinct()


def _leads(members: DataFrame) -> DataFrame:
    """(a, b, several) from members (g, a): sets and the lead of a group of theirs, and whether such a group has more than these two."""
    ranked = members.join(members.groupBy("a").agg(F.count("*").alias("rank")), "a")
    lead = ranked.groupBy("g").agg(F.max(F.struct("rank", "a")).alias("x"), F.count("*").alias("n")).select("g", F.col("x.a").alias("b"), (F.col("n") > 2).alias("several"))
    return members.join(lead, "g").filter("a <> b").groupBy("a", "b").agg(F.max("several").alias("several"))


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The sketches of n sets with tokens h: a bit is set if an odd number of tokens falls on it."""
    bits = np.bincount(doc * (64 * WORDS) + (h & U(64 * WORDS - 1)).astype(np.int64), minlength=n * 64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(n, WORDS)


def _sketches_near(percent: int) -> Column:
    """Whether sets of sizes size and size2 may link, by their sketches."""
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"{SKETCH[0]}2"))))
    return bits * (100 + percent) <= (F.col("size") + F.col("size2")) * (100 - percent)


def _sets(texts: DataFrame, active: DataFrame, k: int, exact: bool) -> DataFrame:
    """(sid, n, tokens) of each active set, tokens of 8 bytes, or of the 4 of its image, which has a sketch too.

    Texts whose set is not active go before the shuffle, but for some that a sieve lets pass.
    """
    bits = sieve(active, "sid")
    extra = [] if exact else SKETCH

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                _, h, size, sid = doc_sets(b, k)
                end, sid = np.cumsum(size), sid.view(np.int64)
                at = [i for i in np.flatnonzero((size > 0) & passes(bits.value, sid)) if sid[i] not in seen and not seen.add(sid[i])]
                own = [h[end[i] - size[i] : end[i]] for i in at]
                sketch = [] if exact else [pa.array(x) for x in sketches(np.repeat(np.arange(len(at)), size[at]), np.concatenate([h[:0], *own]), len(at)).T]
                tokens = pa.array([(x if exact else np.unique(x.astype(np.uint32))).tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(size[at].astype(np.int64)), tokens, *sketch], ["sid", "n", "tokens", *extra])
                if len(seen) > TASK_SIGNATURES:
                    seen.clear()

    return texts.mapInArrow(work, ", ".join(["sid long, n long, tokens binary", *(f"{c} long" for c in extra)])).join(active, "sid", "left_semi").dropDuplicates(["sid"])


def _named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of sets those that pairs name and the few that a sieve lets pass besides, so that the others are not shuffled."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    return sets.filter(maybe(sieve(ends, "sid"), F.col("sid")))


class _Chunk:
    """Sets that one task compares with a lead: those that may link, and the differences by which they meet again."""

    def __init__(self, key: tuple[int, int], lead: np.ndarray, size: int, bands: Bands, split: bool):
        self.key, self.lead, self.size, self.bands = key, lead, size, bands
        self.held: list[tuple[int, np.ndarray, int]] = []
        self.counted: list[np.ndarray] = []
        self.tokens, self.own = 0, not split
        self.order: tuple[np.ndarray, np.ndarray] | None = None
        self.links: list[int] = []
        self.out: list[tuple[np.ndarray, ...]] = []

    def differ(self, tokens: np.ndarray) -> np.ndarray:
        return np.setxor1d(tokens, self.lead, assume_unique=True)

    def sample(self, tokens: np.ndarray) -> None:
        if self.tokens <= CHUNK_TOKENS:
            self._count(self.differ(tokens))

    def _count(self, differ: np.ndarray) -> None:
        self.counted.append(differ)
        self.tokens += len(differ)

    def add(self, member: int, tokens: np.ndarray, size: int, several: bool) -> None:
        differ = self.differ(tokens)
        if len(differ) <= self.bands.difference(size, self.size):
            self.links.append(member)
        if not several:
            return
        if self.order is None and self.own and self.tokens <= CHUNK_TOKENS:
            self._count(differ)
            self.held.append((member, differ, size))
            return
        self._rank()
        self._differences(member, differ, size)

    def _rank(self) -> None:
        """Puts tokens in order, the rarest first, and passes the sets held."""
        if self.order is None:
            self.order = np.unique(np.concatenate([*self.counted, np.zeros(0, np.uint32)]), return_counts=True)
            held, self.held, self.counted = self.held, [], []
            for x in held:
                self._differences(*x)

    def _differences(self, member: int, differ: np.ndarray, size: int) -> None:
        """Tokens in order with the most differences that a set which meets this one there first may have.

        Images so near to the lead's that another's may differ from this in all that
        both differ from the lead meet by a token of their own.
        """
        token, count = self.order
        n, far = len(differ), self.bands.farthest(size)
        at = np.minimum(np.searchsorted(token, differ), max(len(token) - 1, 0))
        often = np.where(token[at] == differ, count[at], 0) if len(token) else np.zeros(n, np.int64)
        place = np.lexsort((differ, often))[: far + 1]
        found, most = differ[place].astype(np.int64), n + far - 2 * np.arange(len(place))
        if n <= far:
            found, most = np.append(found, -1), np.append(most, far - n)
        self.out.append((found, np.full(len(found), member), np.full(len(found), n), most))

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, set, differences, most) of what may meet."""
        whole = self.own and self.order is None
        self._rank()
        if not self.out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        token, member, n, most = (np.concatenate(x) for x in zip(*self.out))
        if whole and len(token):  # all sets of the lead are here, so what fits nothing here fits nothing
            _, at = np.unique(token, return_inverse=True)
            low, high = np.full(at.max() + 1, 1 << 62), np.zeros(at.max() + 1, np.int64)
            np.minimum.at(low, at, n)
            np.maximum.at(high, at, most)
            fits = (most >= low[at]) & (n <= high[at])
            fits &= np.bincount(at[fits], minlength=len(low))[at] > 1
            token, member, n, most = token[fits], member[fits], n[fits], most[fits]
        return token, member, n, most


def _compare(percent: int, exact: bool):
    """Rows (lead, salt, part, set, several, size, tokens), sorted, as (0, set, lead) that may link and differences (1, group, set, n, most).

    part 0 is the lead, which is several if its sets are in several tasks, 1 a set
    that stands for others, 2 a set to compare. exact: tokens are whole, and what
    may link links.
    """
    bands = Bands(percent)
    names = ["kind", "x", "y", "n", "most"]

    def emit(c: _Chunk) -> Iterator[pa.RecordBatch]:
        links = np.array(c.links, dtype=np.int64)
        yield from _slices([np.zeros(len(links), np.int32), links, np.full(len(links), c.key[0]), links, links], names)
        token, member, n, most = c.close()
        group = mix(token.view(U) ^ mix(np.array([c.key[0]], np.int64).view(U)))
        yield from _slices([np.ones(len(token), np.int32), group.view(np.int64), member, n, most], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for batch in batches:
            lead, salt, part, member = (batch.column(i).to_numpy() for i in range(4))
            several, size, tokens = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(), batch.column(6)
            for i in range(batch.num_rows):
                mine = np.frombuffer(tokens[i].as_buffer(), dtype=U if exact else np.uint32)
                if part[i] == 0:
                    if c is not None:
                        yield from emit(c)
                    c = _Chunk((int(lead[i]), int(salt[i])), mine.copy(), int(size[i]), bands, bool(several[i]))
                elif part[i] == 1:
                    c.sample(mine)
                else:
                    c.add(int(member[i]), mine, int(size[i]), bool(several[i]))
        if c is not None:
            yield from emit(c)

    return work


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """pairs (a, b, several) of sets and their leads, compared. A lead's sets go to tasks of about CHUNK, each with the lead."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    own = pairs.join(many, "b")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")
    rows = own.select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("salt"), F.lit(2).alias("part"), F.col("a").alias("sid"), "several")
    if not exact:
        some = own.filter("parts > 1 AND several").filter(F.pmod(F.xxhash64("a", F.lit(1)), F.col("parts") * (CHUNK // SAMPLE)) == 0)
        rows = rows.unionByName(some.select("b", salts, F.lit(1).alias("part"), F.col("a").alias("sid"), "several"))
    rows = rows.unionByName(many.select("b", salts, F.lit(0).alias("part"), F.col("b").alias("sid"), (F.col("parts") > 1).alias("several")))
    rows = rows.join(sets, "sid").select("b", "salt", "part", "sid", "several", "n", "tokens")
    # by ranges, so that tasks get about as many rows each, whatever the leads; a part of a lead's sets is in one
    rows = rows.repartitionByRange("b", "salt").sortWithinPartitions("b", "salt", "part", "sid")
    return rows.mapInArrow(_compare(percent, exact), "kind int, x long, y long, n long, most long")


def _next_pairs(found: DataFrame, parts: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame | None:
    """Pairs (a, b, several) that may link two components, from differences (group, set, n, most)."""
    rows = found.filter("kind = 1").select(F.col("x").alias("g"), F.col("y").alias("a"), "n", "most")
    # most tokens are those of one set: they go before anything is joined with their rows
    shared = rows.groupBy("g").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.count("*").alias("k")).filter("k > 1")
    rows = rows.join(shared, "g").filter("most >= low AND n <= high").select("g", "a", "n", "most")
    rows = materialize(_fitting(labelled(rows, parts, "a", "c")), "jaccard-differences")
    if rows.isEmpty():
        return None
    size = rows.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("square"))
    is_few = (F.col("size") * F.col("size") - F.col("square")) / 2 <= PAIRS * GROWTH**turn * F.col("size")
    rows = materialize(rows.join(size.select("g", is_few.alias("few")), "g"), "jaccard-groups")
    few = rows.filter("few").join(sets.select(F.col("sid").alias("a"), F.col("n").alias("size"), *SKETCH), "a")
    few = materialize(few, "jaccard-few")
    other = few.select("g", *[F.col(c).alias(f"{c}2") for c in ("a", "c", "n", "most", "size", *SKETCH)])
    near = few.join(other, "g").filter("a > a2 AND c <> c2 AND n <= most2 AND n2 <= most").filter(_sketches_near(percent))
    pairs = near.select("a", F.col("a2").alias("b"), F.lit(False).alias("several"))
    large = rows.filter("NOT few").select("g", "a")
    if not large.isEmpty():
        pairs = pairs.unionByName(_leads(large))
    pairs = pairs.groupBy("a", "b").agg(F.max("several").alias("several"))
    pairs = materialize(pairs, "jaccard-pairs")
    return None if pairs.isEmpty() else pairs


def _fitting(rows: DataFrame) -> DataFrame:
    """Rows of groups whose sets are of several components, and that may fit one of them."""
    bounds = rows.groupBy("g").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("g", "low", "high")
    return rows.join(bounds, "g").filter("most >= low AND n <= high").drop("low", "high")


def jaccard_components(docs: DataFrame, carry: list[str], k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """carry columns, n_shingles, set_id, component_id and component_set of each row.

    A text's set has its distinct shingles of k words [^\\x20\\x09-\\x0D]+, A-Z
    lower-cased; a text with fewer words, but some, has the sequence of all of them.
    Texts link when 100 * intersection >= percent * union. component_id is the
    least id that links reach; ids are whole numbers, or text that casts to them.

    Empty and null texts have set size 0, link with nothing, and are their own
    component; a null id counts only if all are null. component_set names the
    component by one of its sets, since ids may be shared or null; it is null for
    empty texts. Repeated rows get equal results, an empty table gives no rows, a
    text of any length is one set, and other columns may have any name. Ties of
    leads change the work only. Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, inner)], F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = ["kind", *inner, "id", "n", "sid", "band", "segment", "key"]
    ddl = ", ".join(["kind int", *(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, inner)), "id long, n long, sid long, band long, segment long, key long"])
    first = materialize(rows.mapInArrow(_first_pass(k, bands, kept), ddl), "jaccard-sets")
    nodes = first.filter("kind = 0").select(*inner, "id", "n", "sid")
    shared = spark.sparkContext.broadcast(_schemes(first.filter("kind = 1"), bands))

    index = rows.select("text").mapInArrow(_index(k, bands, shared), "a long, b long, c long")
    members = materialize(_members(index), "jaccard-members")
    pairs = materialize(_leads(members), "jaccard-pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    sets = materialize(_sets(rows.select("text"), ends, k, False), "jaccard-images")

    parts, turn = None, 0
    while pairs is not None:
        found = materialize(_compared(pairs, sets if turn == 0 else _named(sets, pairs), percent), "jaccard-found")
        near = found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(False).alias("several"))
        links = near.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not near.isEmpty():
            ends = near.select(F.col("a").alias("sid")).unionByName(near.select(F.col("b").alias("sid")))
            links = _compared(near, _sets(rows.select("text"), ends, k, True), percent, exact=True)
            links = materialize(links.select(F.col("x").alias("u"), F.col("y").alias("v")), "jaccard-links")
        parts = merged(parts, links) if parts is not None else materialize(components(links), "jaccard-components")
        pairs = _next_pairs(found, parts, sets, percent, turn)
        turn += 1

    comp = labelled(nodes.filter("n > 0").groupBy("sid").agg(F.min("id").alias("id")), parts, "sid", "c")
    roots = comp.groupBy("c").agg(F.min("id").alias("root"))
    by_set = comp.join(roots, "c").select(F.col("sid").alias("s"), "root", "c")
    out = nodes.join(by_set, (nodes["sid"] == by_set["s"]) & (nodes["n"] > 0), "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, inner)], F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), _root().alias("component_id"), F.col("c").alias("component_set"))


def _root() -> Column:
    return F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
