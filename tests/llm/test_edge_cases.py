import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellsail.llm import language_id, quality_nbsvm, quality_rules, textkit, toxicity, url_filter

LONG = "Das Wörterbuch zählt Wörter. " * 60_000
TEXTS = [None, "", " \n\t", "1234 ... 5", "a", "the cat sat on the mat", "the cat sat on the mat", "der Hund läuft über die Straße", LONG, "the cat sat on the mat"]


def rows_of(spark, texts=TEXTS):
    """With columns named like those that operators make for themselves."""
    return spark.createDataFrame([(i, t, "x", 0.5, 7) for i, t in enumerate(texts)], "doc_id long, text string, _text string, y double, band int")


CARRY = ["doc_id", "_text", "y", "band"]


def trained(spark):
    good = [(i, " ".join(f"clean{(i * k) % 17}" for k in range(1, 40)), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"junk{(i * k) % 13} $$$" for k in range(1, 40)), "de") for i in range(60)]
    # ids that are repeated, and labels that contradict each other
    docs = spark.createDataFrame([*good, *bad, *good[:5], (500, None, "en"), (None, "no id", "en"), (501, "x", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*[(i, 1, 0) for i, *_ in good], *[(i, 0, 1) for i, *_ in bad], (0, 1, 0), (7, 0, 1), (500, 1, 1), (None, 1, 1), (501, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def scorers(spark):
    docs, labels = trained(spark)
    everyone = F.lit(True)
    return {
        "language": (lambda d, m=language_id.fit(docs, everyone): language_id.predict(d, m, CARRY), ["lang_pred", "score"]),
        "rules": (lambda d, m=quality_rules.fit(docs, labels): quality_rules.apply_rules(d, m, CARRY), [*quality_rules.BASE, "base_failed", "kept", "probability"]),
        "quality": (lambda d, m=quality_nbsvm.fit(docs, labels, everyone): quality_nbsvm.score(d, m, CARRY), ["score"]),
        "toxicity": (lambda d, m=toxicity.fit(docs, labels, everyone): toxicity.score(d, m, CARRY), ["score"]),
    }


def test_scorers_take_any_row(spark):
    for name, (score, results) in scorers(spark).items():
        out = score(rows_of(spark))
        assert out.columns == [*CARRY, *results], name
        found = {r["doc_id"]: tuple(r)[len(CARRY) :] for r in out.collect()}
        assert set(found) == set(range(len(TEXTS))), name
        assert found[5] == found[6] == found[9], name
        assert found[0] == found[1], name  # null as empty
        assert all(0 <= r[results[-1]] <= 1 for r in out.collect()), name
        assert {r["_text"] for r in out.collect()} == {"x"}, name
        assert score(rows_of(spark).limit(0)).collect() == [], name
        alone = score(rows_of(spark, [LONG])).first()
        assert tuple(alone)[len(CARRY) :] == pytest.approx(found[8]) if name != "language" else alone["lang_pred"] == found[8][0], name


def test_models_of_nothing(spark):
    none, labels = rows_of(spark).limit(0).withColumn("lang", F.lit("x")), trained(spark)[1].limit(0)
    everyone = F.lit(True)
    text = rows_of(spark, ["some words here", None])
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(text, language_id.fit(none, everyone), ["doc_id"]).collect()} == {("und", 0.0)}
    assert {r["kept"] for r in quality_rules.apply_rules(rows_of(spark, ["word%d " % i * 1 for i in range(1)] + [" ".join(map(str, range(30)))]), quality_rules.fit(none, labels), ["doc_id"]).filter("NOT base_failed").collect()} == {True}
    assert {round(r["score"], 3) for r in quality_nbsvm.score(text, quality_nbsvm.fit(none, labels, everyone), ["doc_id"]).collect()} == {0.5}
    assert all(r["score"] < 0.01 for r in toxicity.score(text, toxicity.fit(none, labels, everyone), ["doc_id"]).collect())


def test_equal_posteriors_go_to_the_first_language(spark):
    model = language_id.LanguageModel(["aa", "bb", "cc"], np.zeros((3, 256), np.float32), np.log([0.2, 0.4, 0.4]))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(rows_of(spark, ["some text", "", "12"]), model, ["doc_id"]).collect()}
    assert got == {0: ("bb", 0.4), 1: ("und", 0.0), 2: ("und", 0.0)}


def test_posterior_by_hand(spark):
    rng = np.random.default_rng(2)
    bits = 10
    model = language_id.LanguageModel(["a", "b", "c", "d"], np.log(rng.dirichlet(np.ones(1 << bits), 4)).astype(np.float32), np.log([0.1, 0.2, 0.3, 0.4]))
    texts = ["ein Satz", "two words", "ß", "x" * 500, "héé llo"]
    got = {r["doc_id"]: r for r in language_id.predict(rows_of(spark, texts), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        (block,) = textkit.blocks(pa.array([t]))
        grams, *_ = language_id._buckets(block, bits)
        sums = [model.log_prior[k] + sum(float(model.log_prob[k][g]) for n in grams for g in n.tolist()) for k in range(4)]
        posterior = np.exp(np.array(sums) - max(sums))
        posterior /= posterior.sum()
        assert got[i]["lang_pred"] == model.langs[int(np.argmax(sums))] and got[i]["score"] == pytest.approx(posterior.max(), abs=1e-6)


def test_a_probability_at_the_threshold_is_kept(spark):
    text = " ".join(f"w{i}" for i in range(30))
    model = quality_rules.QualityModel(np.zeros(quality_rules.N_FEATURES), 1.0, 0.0)  # one half for every text
    keep = lambda at: quality_rules.apply_rules(rows_of(spark, [text]), model, ["doc_id"], at).first()["kept"]
    assert keep(0.5) and not keep(0.5000001)


def test_hinge_model_is_the_optimum():
    rng = np.random.default_rng(6)
    n, size = 40, 8
    dense = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.6)
    y, cost = np.where(dense @ rng.normal(size=size) + rng.normal(size=n) > 0, 1.0, -1.0), rng.uniform(0.2, 2.0, n)
    at = np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))])
    row, col = np.nonzero(dense)
    w = quality_nbsvm.dual_coordinate_descent(at, col, dense[row, col], y, cost, size)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()
    best = loss(w)
    # the loss is convex: what no small step lowers is its minimum
    assert all(loss(w + rng.normal(size=size) * s) > best - 0.02 * abs(best) for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(200))


def test_urls_of_any_kind(spark):
    long = "https://a.example.com/en/" + "x" * 300_000
    urls = [None, "", "no scheme", "https://", "https://example.com/en/7", "https://example.com/en/7", "HTTP://WWW.Example.COM/en/70?q#f", long]
    pages = spark.createDataFrame([(i, u, "q", "r") for i, u in enumerate(urls)], "page_id long, url string, query string, bare_ string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, ["page_id", "bare_"]).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(4)] == [("", "", None)] * 4
    assert got[4]["rule"] == got[5]["rule"] == got[6]["rule"] == "example.com/en/7" and got[4]["verdict"] == "allow"
    assert got[7]["rule"] == "com/en/" and len(got[7]["path"]) == 4 + 300_000
    assert url_filter.judge(pages.limit(0), ["page_id"]).collect() == []
    rules = [("block", "net", "/a"), ("allow", "com", "/a"), ("block", "com", "/a")]
    tied = url_filter.judge(spark.createDataFrame([(1, "http://x.com/a/b")], "page_id long, url string"), ["page_id"], host_rules=rules, glob_rules=[]).first()
    assert tied["verdict"] == "allow"  # of equally long ones the first
