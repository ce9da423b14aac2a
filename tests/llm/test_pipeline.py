import random
from collections import Counter

import corpus_pipeline


def test_near_duplicates_with_null_shared_and_repeated_ids(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(None, "", "s"), (None, "", "s"), (None, " \n", "s"), (None, None, "s"), (None, None, "s"), (7, "", "s"), (7, "", "s"), (7, "", "t")]
    ids = [None, None, 1, 2, 3, 5, 5, 8, 9]
    for _ in range(60):
        text = [word() for _ in range(rng.randint(30, 60))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            near = list(text)
            if rng.random() < 0.5:
                near[-1] = word()
            rows.append((rng.choice(ids), " ".join(near), rng.choice("st")))
            rows += [rows[-1]] * rng.choice([0, 0, 2])
    rows += [(5, "only one word here A", "s"), (5, "near to doc three " * 9, "s"), (3, "near to doc three " * 9, "s")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    groups = {}
    for row, s, r in zip(rows, sets, root):
        groups.setdefault(("empty", row) if not s else r, []).append(row)
    assert sum(got.values()) == sum(len(v) if isinstance(k, tuple) else 1 for k, v in groups.items())
    for k, members in groups.items():
        kept = {row: got[row] for row in set(members) if row in got}
        if isinstance(k, tuple):
            assert kept == Counter(members)
        else:
            least = min((row[0] is None, row[0] or 0) for row in members)
            assert sum(kept.values()) == 1 and [(row[0] is None, row[0] or 0) for row in kept] == [least]


def test_stages_take_odd_rows_and_any_column_names(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i1", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, "x"), ("i2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["score", "_text", "n_words", "_hits", "base", "all_spans", "gone", "contaminated", "key1", "size", "taken", "text2"]
    texts = [None, "", " \n", "a", "word " * 200_000, "password = hunter22 and more", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "vile words " * 9]
    rows = [(i if i != 3 else None, t, None if i == 2 else "s", len(t or ""), *[f"{c}{i}" for c in extra]) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "mixing":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r["score"] == f"score{r['score'][5:]}" and r["contaminated"][12:] == r["score"][5:] for r in got)
        kept = Counter(r["score"] for r in got)
        if name == "near_duplicates":
            assert kept["score5"] == 1 and kept["score0"] == 2 and len(kept) == 8
        elif name == "decontamination":
            assert kept["score6"] == 0 and kept["score5"] == 3 and len(kept) == 7
        elif name == "secrets":
            assert len(got) == len(rows) and {r["text"] for r in got if r["score"] == "score5"} == {"[SECRET] and more"}
            assert {r["n_chars"] for r in got if r["score"] == "score5"} == {17} and [r["text"] for r in got if r["score"] == "score0"] == [None, None]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
