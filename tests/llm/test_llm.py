import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellsail.llm import components, decontaminate, jaccard_join, language_id, mixing, quality_nbsvm, quality_rules, secret_scan, suffix_dedup, textkit, toxicity, url_filter

WORD = r"[^\x20\x09-\x0D]+"


def texts_of(seed, n=60, vocabulary=300):
    """Texts with exact copies, copies of copies with edits, shared passages, empty and null ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", " \n", "one", "one two", "One two"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 or len(out) < 12:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))
            t = t + "\n" + passage if rng.random() < 0.3 else t
        elif kind < 0.5:
            t = rng.choice(out)
        else:
            w = (rng.choice(out[6:]) or "x").split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        out.append(t)
    return out


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", *[0] * len(more)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + "".join(f", {k} {v}" for k, v in more.items()))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_jaccard_components(spark, k, percent):
    texts = texts_of(k, 150)
    sets = []
    for t in texts:
        w = re.findall(WORD, lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, texts, n="int", sid="int"), ["doc_id"], k, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [3, 4])
def test_links_found_later_join_components(spark, seed):
    rng = random.Random(seed)
    turns = [[(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (30, 12, 0, 20)]
    root = {}
    for a, b in (x for t in turns for x in t if x[0] != x[1]):
        ra, rb = root.get(a, a), root.get(b, b)
        root |= {a: ra, b: rb}
        root = {x: min(ra, rb) if r in (ra, rb) else r for x, r in root.items()}
    frames = [spark.createDataFrame(t, "u long, v long") for t in turns]
    parts = components.components(frames[0])
    for f in frames[1:]:
        parts = components.merged(parts, f)
    got = parts.collect()
    assert len(got) == len(root) and {r["node"]: r["component"] for r in got} == root


def test_bands_and_allocation():
    bands = jaccard_join.Bands(90)
    for n in range(1, 400):
        for m in range(n, bands.largest(n) + 1):
            assert bands.difference(n, m) == 0 or {b for b, _ in bands.roles(n)} & {b for b, _ in bands.roles(m)}
    known = len(bands.starts)
    for _ in range(3000):
        assert bands.segments(4) == bands.segments(4)
    assert len(bands.starts) == max(known, 6)
    s = jaccard_join.allocate(6, np.array([0, 0, 0, 0, 1e9, 0.0]), 10.0, 60.0)
    assert s.value.sum() == 6 and s.value[4] == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng, bands = np.random.default_rng(percent), jaccard_join.Bands(percent)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, 1 + max(1, len(a) // 8)) :], rng.integers(0, 1 << 63, rng.integers(0, 1 + max(1, len(a) // 8)), dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        linked = inter and 100 * inter >= percent * (len(a) + len(b) - inter)
        schemes = {}
        for x in range(20):
            value = rng.permutation([2, 0] * (bands.segments(x) // 3) + [1] * (bands.segments(x) - bands.segments(x) // 3 * 2))
            schemes[x] = jaccard_join.Scheme(len(value), value, np.cumsum(value) - value)
        for s in (None, schemes):
            own = [set(jaccard_join.signatures(np.array([len(x)]), x, bands, s)[3].tolist()) for x in (a, b)]
            assert not linked or np.array_equal(a, b) or own[0] & own[1]


def test_near_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 40)
    monkeypatch.setattr(jaccard_join, "PAIRS", 1)
    rng = random.Random(5)
    base = ["w%d" % i for i in range(70)]
    texts = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 5])):
            w[rng.randrange(70)] = rng.choice(["x", "y%d" % rng.randrange(9), "z%d" % i])
        texts.append(" ".join(w))
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in map(str.split, texts)]
    root = list(range(len(sets)))
    while True:
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 90 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, texts), ["doc_id"], 3, 90).collect()}
    assert got == dict(enumerate(root))


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(7)
    for n in (0, 1, 40, 900):
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)])) for _ in "ab")
        two = jaccard_join.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        apart = sum(int(x).bit_count() for x in (two[0] ^ two[1]).view(np.uint64))
        assert 0 < apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_sets_that_share_differences_only_are_few_pairs(spark, monkeypatch):
    """Near copies of one text, most too far apart to link, that share their edits: all links are found and few pairs compared in later turns."""
    kept, pairs = jaccard_join.materialize, []

    def counted(df, name):
        out = kept(df, name)
        if name == "jaccard-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    rng = random.Random(11)
    base = ["w%d" % i for i in range(150)]
    texts = [" ".join(f"{w}x{rng.randrange(3)}" if rng.random() < edits else w for w in base) for edits in [0.01, 0.02, 0.04, 0.06] for _ in range(40)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    root = list(range(len(sets)))
    while True:
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, texts), ["doc_id"], 5, 80).collect()}
    assert got == dict(enumerate(root)) and 20 < len(set(root)) < 140
    assert len(pairs) > 1 and sum(pairs[1:]) < len(texts), pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    texts = [*texts_of(seed, 60), "a" * 450, "ab" * 200, "a" * 99]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, dtype=bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s : s + 100] = True
            seen.add(raw[s : s + 100])
        c = cover[:-1]
        kept = bytes(b for b, x in zip(raw, c) if not x)
        expected[i] = (len(raw), int(c.sum()), int((c & ~np.append(False, c[:-1])).sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs_of(spark, texts, k="int", lo="int")).collect()}
    assert got == expected


def test_suffix_dedup_hot_anchors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 1)
    texts = texts_of(5, 40)
    a = {tuple(r) for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    monkeypatch.undo()
    assert a == {tuple(r) for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    twice = docs_of(spark, texts).union(docs_of(spark, texts))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(twice).collect())) == sorted([*a, *a])


def test_suffix_dedup_comes_from_arrays(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "TASK_WINDOWS", 30)
    texts = [*texts_of(8, 40), None, "", "line of a licence that very many texts have, word for word, again and again, and that is long enough"] * 3
    rows = [(0, i, 0, (t or "").encode()) for i, t in enumerate(texts) if len((t or "").encode()) >= 100]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array([i for _, i, _, _ in rows]), pa.array([0] * len(rows)), pa.array([0] * len(rows)), pa.array([1] * len(rows)), pa.array([r[3] for r in rows], pa.binary())], list("abcdef"))
    got = [(k, lo + j) for out in suffix_dedup._mark_windows(100)(iter([batch])) for k, _, lo, n in zip(*(out.column(c).to_pylist() for c in range(4))) for j in range(n)]
    seen, want = set(), []
    for _, i, _, raw in rows:
        for s in range(len(raw) - 99):
            want += [(i, s)] * (raw[s : s + 100] in seen)
            seen.add(raw[s : s + 100])
    assert sorted(got) == sorted(want)


def test_suffix_dedup_of_one_long_text_and_of_none(spark):
    rng = np.random.default_rng(3)
    part = rng.integers(97, 122, 3_000_000, dtype=np.uint8).tobytes().decode()
    text = part + "z" + part[1_000_000:2_500_000]
    got = {r["doc_id"]: tuple(r) for r in suffix_dedup.remove_repeats(docs_of(spark, [text, "short"])).collect()}
    assert got[0] == (0, 4_500_001, 1_500_000, 1, hashlib.sha256((part + "z").encode()).hexdigest())
    assert suffix_dedup.remove_repeats(docs_of(spark, ["x"]).limit(0)).collect() == []


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(60):
        x = rng.integers(97, 98 + rng.integers(1, 5), rng.integers(1, 300)).astype(np.uint8)
        x = np.tile(x[: max(1, len(x) // 4)], 4) if t % 3 == 0 else x
        sa, raw = suffix_dedup.suffix_array(x), x.tobytes()
        assert sorted(sa) == list(range(len(x)))
        parts = [raw[i : i + 100] for i in sa]
        assert parts == sorted(parts)


def test_decontaminate(spark):
    texts = texts_of(3, 60)
    items = [(i, " ".join((t or "").split(" ")[:20]).upper()) for i, t in enumerate(texts[::4])] + [(99, "one"), (98, "one two"), (97, None), (96, "!!"), (None, "one"), (99, "one")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for i, t in items:
        w = pattern.findall(lower(t or ""))
        k = min(13, len(w))
        for j in range(len(w) - k + 1) if w and i is not None else ():
            found.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    expected = {}
    for i, t in enumerate(texts):
        w, hit, ids = pattern.findall(lower(t or "")), set(), set()
        for k in {len(x) for x in found}:
            for j in range(len(w) - k + 1):
                if own := found.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= own
        expected[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 200):
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.find_windows(docs_of(spark, texts), bench, ["doc_id"], block_bytes=size).collect()}
        assert got == expected
    clash = docs_of(spark, texts, _text="int", _hits="int", _items="int", carried_0="int")
    carried = decontaminate.find_windows(clash, bench, ["_hits", "doc_id", "_text", "text", "_items", "carried_0"])
    assert carried.columns[:6] == ["_hits", "doc_id", "_text", "text", "_items", "carried_0"]
    assert {r["doc_id"]: tuple(r)[6:] for r in carried.collect()} == expected
    none = decontaminate.find_windows(docs_of(spark, texts), bench.limit(0), ["doc_id", "text"]).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)


def test_base_rules(spark):
    texts = [*texts_of(7, 40), "x y z " * 20, "a\nb\na\n \na", "#$ <>|* %&" * 3]
    model = quality_rules.QualityModel(np.zeros(quality_rules.N_FEATURES), 0.0, 40.0)
    rows = quality_rules.apply_rules(docs_of(spark, texts, n_words="int"), model, ["doc_id"]).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)}
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert tuple(r[c] for c in quality_rules.BASE) == base
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r["kept"] == (not r["base_failed"])


def test_classifiers_learn_and_take_any_text(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(25, 60))]
        bad = i % 5 == 0
        if bad:
            w = [x + "###" for x in w[:-1]] + ["scum"]
        rows.append((i, " ".join(w), "en", "s", int(not bad), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text", "lang", "source"), df.select("doc_id", "quality", "toxic")
    odd = docs.union(spark.createDataFrame([(None, None, None, None), (900, "", None, None), (901, "é" * 200_000, None, None)], docs.schema))
    usable = F.col("doc_id") % 4 != 0
    truth = {r[0]: r[5] for r in rows}
    for scored, flip in ((toxicity.score(odd, toxicity.fit(odd, labels, usable), ["doc_id"]), 1), (quality_nbsvm.score(odd, quality_nbsvm.fit(odd, labels, usable), ["doc_id"]), 0)):
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
        assert np.mean([(got[i] >= 0.5) == (truth[i] == flip) for i in truth if i % 4 == 0]) > 0.95
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(odd, quality_rules.fit(odd, labels), ["doc_id"]).collect()}
    assert np.mean([kept[i] == (truth[i] == 0) for i in truth]) > 0.95
    empty = labels.limit(0)
    assert toxicity.score(docs, toxicity.fit(docs, empty, usable), ["doc_id"]).filter("score >= 0.5").count() == 0
    assert quality_nbsvm.score(docs, quality_nbsvm.fit(docs.limit(0), empty, usable), ["doc_id"]).count() == 400


def test_language_id(spark):
    rows = [(i, ("the and of thing" if i % 2 else "der und ist nicht") + f" {i}", "en" if i % 2 else "de") for i in range(100)] + [(100, "12 34", "en"), (101, None, "de"), (102, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs, F.col("doc_id") % 3 != 0), ["doc_id"]).collect()}
    assert all(got[i] == rows[i][2] for i in range(100)) and got[100] == got[101] == "und" and got[102] == "en"
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs, F.lit(False)), ["doc_id"]).collect()} == {"und"}


def test_mixing(spark):
    texts = [None, "", *[" ".join(["w"] * (1 + i * 7 % 90)) for i in range(300)]]
    docs = spark.createDataFrame([(i if i != 5 else None, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), ["doc_id", "source"]).collect()), key=str)
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        own = by.setdefault(r["source"], [0, r["target"], 0])
        own[0] += r["taken"]
        own[2] += r["size"]
    assert abs(sum(v[1] for v in by.values()) - total) < 1e-6
    assert all(abs(v[0] - v[1]) <= 100 and v[1] <= 3 * v[2] + 1e-9 for v in by.values())
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0


def test_mixing_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, "source").collect()}
    assert got["a"] == 30 and got[None] == 15 and got["c"] == 300 and abs(got["b"] - 770) < 1e-9


def test_url_filter(spark):
    urls = [None, "no scheme", "http://", "https://WWW.Example.COM/en/7?x", "http://a.com/en/7", "http://com/en/", "http://x.org/es/1#f", "http://x.org?/es/", "http://f.io/x.com/en/9", "ftp://free-bets.io", "http://ok.io/casino"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, ["page_id"]).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/7", "example.com/en/7", "allow") and got[4] == ("a.com", "/en/7", "com/en/", "block") and got[5][2] == "com/en/"
    assert got[6][2:] == ("org/es/", "block") and got[7] == ("x.org", "", None, "allow") and got[8][2] is None
    assert got[9][3] == "block" and got[10][3] == "allow"


def test_globs_against_regex():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    def regex(g):
        return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g)), re.S)

    for a, part in zip(url_filter.compile_all(globs), [globs]):
        got = url_filter.matches(a, [t.encode() for t in texts])
        assert got.tolist() == [[bool(regex(g).fullmatch(t)) for g in part] for t in texts]


def test_secret_scan(spark):
    key = "Zx9" + "aB3kQ7mN2pL8" * 2
    texts = [None, "", 'é Password = "abcdef12" x', "token=token:abcdef", "AKIA" + "A1" * 8 + " AKIA123", "0123456789abcdef01234567" * 2, f"see {key} here", "token=password=xyzabc"]
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, texts, kind="int"), ["doc_id", "text"]).select("*", secret_scan.as_text(F.col("all_spans")).alias("s"), secret_scan.redact(F.col("text"), F.col("all_spans")).alias("clean")).collect()}
    assert [rows[i]["s"] for i in range(2)] == ["", ""]
    assert rows[2]["s"] == "assign:2:22" and rows[2]["clean"] == 'é [SECRET]" x'
    assert rows[3]["s"] == "" and rows[4]["s"] == "access:0:20" and rows[5]["s"] == "hex:0:48"
    assert rows[6]["s"] == f"generic:4:{4 + len(key)}" and rows[7]["s"] == "assign:0:21"
    shared = docs_of(spark, [f"see {key} here"] * 3)
    assert {r["s"] for r in secret_scan.scan(shared, ["doc_id"]).select(secret_scan.as_text(F.col("all_spans")).alias("s")).collect()} == {""}


def test_words_of_blocks():
    texts = texts_of(11, 50)
    for b in textkit.blocks(pa.array(texts), limit=300):
        w = textkit.words(b, b.buf, textkit.NOT_SPACE)
        for i in range(b.n):
            s = slice(w.first[i], w.first[i] + w.count[i])
            assert [bytes(b.buf[x:y]).decode() for x, y in zip(w.start[s], w.end[s])] == re.findall(WORD, texts[b.row + i] or "")


def test_verdicts_go_by_owners_and_repositories(spark):
    one, two, many = ("Zx9" + c + "aB3kQ7mN2pL8" * 2 for c in "abc")
    rows = [(i, f"see {one} here", "s0") for i in range(11)] + [(20, f"see {two} here", "s1"), (21, f"see {two} here", "s2"), (22, f"see {two} here", "s2")]
    rows += [(30 + i, f"see {many} here", f"s{i}") for i in range(3)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"])
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", secret_scan.as_text(F.col("all_spans")).alias("s")).collect()}
    assert {got[i] for i in range(11)} == {""} and {got[30 + i] for i in range(3)} == {""}
    assert {got[20], got[21], got[22]} == {f"generic:4:{4 + len(two)}"}


def test_hundreds_of_globs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    globs = [("block" if rng.random() < 0.5 else "allow", rng.choice([f"*{word()}**", f"**/{word()}/?{word()}**", f"{word()}.{word()}/**", f"*.{word()}/*{word()}"])) for _ in range(400)]
    urls = [f"http://{word()}.{word()}/{word()}/{word()}" for _ in range(200)] + ["http://u:p@A.b.:80/%61b?q=%63", "http://a.b", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*globs, ("block", None)], "verdict string, glob string")
    rules = url_filter.load_globs(table)
    assert len(rules) == 400
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, ["page_id"], host_rules=[], glob_rules=rules).collect()}
    regex = [(v, re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g)), re.S)) for v, g in rules]
    seen = [*(u[7:] for u in urls[:200]), "a.b/ab?q=c", "a.b/", "/"]
    for i, u in enumerate(seen):
        assert got[i] == next((v for v, x in regex if x.fullmatch(u)), "allow")


def test_rounding_keeps_each_expectation():
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(1, 900, 14))[::-1].astype(float)
    p = rng.uniform(0.05, 0.95, 14)
    total, n = np.zeros(14), 4000
    for _ in range(n):
        out, q = mixing.round_fractions(size, p, rng.random(14))
        assert (out < 0).sum() <= 1 and abs((np.where(out < 0, q, out) * size).sum() - (p * size).sum()) < 1e-6
        total += np.where(out < 0, q, out)
    assert np.abs(total / n - p).max() < 5 * 0.5 / n**0.5
    assert mixing.round_fractions(size[:0], p[:0], p[:0])[0].size == 0
