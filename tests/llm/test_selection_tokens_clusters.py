import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsail.llm import centroids, radix, resample, token_counts

VOCABULARY = "word_bpe_49k.json"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def runs(t, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def draw(docs, target, longest, buckets, percent, least, seed):
    """Rows as resample gives them, one document after another."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in runs(text, longest)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for place, (i, text) in enumerate(docs):
        w, f = runs(text, longest)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), place])
    can = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for n, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in rows]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéßZ9") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -", "\n", "\x00"]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10000, 10, 20), (3, 64, 35, 0), (2, 1000, 100, 5)])
def test_resample(spark, longest, buckets, percent, least):
    texts = [None, "", "  ", "x" * 200 + " " + "é" * 90, *corpus(longest, 120)]
    texts += texts[10:30]
    docs = [(None if i % 17 == 0 else i % 110 - 3, t) for i, t in enumerate(texts)]
    target = [*corpus(longest, 9), None, ""]
    rows = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, _row int, score_ string").coalesce(1)
    got = resample.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, longest, buckets, carry=["_row", "score_"])
    assert got.columns == ["doc_id", "_row", "score_", "n_features", "weight", "score", "rank"]
    found = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=key)
    assert found == sorted(draw(docs, target, longest, buckets, percent, least, "2024"), key=key)


def test_resample_ends(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert sorted(r["rank"] for r in resample.resample(some, none, percent=67).collect() if r["rank"]) == [1, 2]
    assert [r["rank"] for r in resample.resample(some, none, percent=10).collect()] == [None] * 4
    long = spark.createDataFrame([(1, "wörd " * 400_000)], "doc_id long, text string")
    assert resample.resample(long, some, percent=100).first()["n_features"] == 400_000
    with pytest.raises(ValueError):
        resample.resample(some.withColumn("rank", F.lit(1)), some, carry=["rank"])


@pytest.mark.parametrize("seed", range(3))
def test_radix_selection(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, -1, 0, 5, rng.randrange(-3, 3)]), rng.randrange(-(1 << 40), 1 << 40) if seed else 7) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long")
    for k in (1, 2, 150, 299, 300):
        want = sorted(rows)[k - 1]
        bound = radix.kth(df, ["a", "b"], k)
        assert tuple(bound) == want
        assert df.filter(radix.up_to(["a", "b"], bound)).count() == sum(r <= want for r in rows)


def test_crc32_of_spans():
    buf = np.frombuffer(random.Random(1).randbytes(4000), dtype=np.uint8)
    start = np.array([0, 5, 5, 100, 7, 300, 900, 2000])
    end = start + np.array([0, 1, 64, 65, 63, 500, 2, 2000])
    assert resample.crc32_spans(buf, start, end).tolist() == [zlib.crc32(buf[i:j].tobytes()) for i, j in zip(start, end)]
    assert resample.crc32_spans(buf, start[:0], end[:0]).tolist() == []


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return token_counts.load(public.path(VOCABULARY))


def library(vocabulary, texts):
    return [len(e.ids) for e in token_counts._library(vocabulary.file).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(seed, n):
    """Contractions, blanks, marks, scripts, special strings and random code points, in any order."""
    rng = random.Random(seed)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'LL", "''", "'", " ", "\n", "\x0b", "\x1c", "\x85", " ", "　", "aa", "zzzz", "THE", "é", "é", "́", "Σ", "ΑΣ", "İ", "ß", "中文", "ｱ", "🎉", "👩‍👧", "²", "Ⅷ", "٣", "12", "_-", "\x00", "ﬁ", "﻿", "𝒳", "ᾼ", "K", "각", "가", "͸", "Ᲊ"]
    return ["".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.randrange(0x3000)) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_tokens_of_the_library(spark, vocabulary, monkeypatch):
    texts = [None, "", " ", "a" * 3000, "don't we'll <|endoftext|>x's's", *odd_texts(1, 2000), *corpus(3, 100)]
    texts += texts[:20]
    rows = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _text string")
    got = token_counts.count_tokens(rows.withColumn("at", F.monotonically_increasing_id()), vocabulary, ["at", "doc_id", "_text"], limit=40).orderBy("at").collect()
    want = library(vocabulary, texts)
    assert [r["n_tokens"] for r in got] == want
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in got] == [n > 40 for n in want]
    assert token_counts.count_tokens(rows.limit(0), vocabulary, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(rows.withColumn("n_tokens", F.lit(1)), vocabulary, ["n_tokens"])


def test_whole_tokens_are_proven(vocabulary):
    assert len(vocabulary.whole) > 30_000
    assert library(vocabulary, vocabulary.whole) == [1] * len(vocabulary.whole)


def test_long_texts_by_slices(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 50)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    texts = [" ".join(odd_texts(i, 30)) for i in range(20)] + ["x" * 500 + " y", "<|endoftext|>" * 20]
    counter = token_counts.Counter(vocabulary)
    assert [counter.count(t) for t in texts] == library(vocabulary, texts)


def lloyd(rows, dims, k, rounds, seed, scale):
    """As cluster gives it, one vector after another in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, to) in zip(kept, at) if to == j]
            c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    at = assign()
    in_cluster = [sum(d for d, j in at if j == n) for n in range(len(c))]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, j, fits(d), fits(in_cluster[j]), fits(sum(in_cluster)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)]


@pytest.mark.parametrize(("dims", "k", "scale", "spread"), [(3, 4, 1024, 1.0), (64, 8, 1024, 0.2), (2, 3, 1, 4e14), (5, 50, 16, 1e-9)])
def test_lloyd(spark, dims, k, scale, spread):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.3) * spread for _ in range(dims)]) for i in range(90)]
    bad = [(200, None), (201, []), (202, [1.0] * (dims - 1)), (203, [None] + [1.0] * (dims - 1)), (204, [float("nan")] + [0.0] * (dims - 1)), (205, [float("inf")] + [0.0] * (dims - 1))]
    rows += [*rows[:10], *[(i, rows[3][1]) for i in (300, 301, None, None)], *bad]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int")
    got = sorted((tuple(r) for r in centroids.cluster(df, dims=dims, k=k, rounds=6, scale=scale).collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert got == sorted(lloyd(rows, dims, k, 6, "3", scale), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_lloyd_ends(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = centroids.cluster(none)
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    one = spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id long, embedding array<float>")
    assert [(r["cluster"], r["distance"]) for r in centroids.cluster(one, dims=2).collect()] == [(0, 0)] * 3
    with pytest.raises(Exception, match="reaches"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()
