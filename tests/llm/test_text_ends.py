import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cellsail.llm import language_id, quality_nbsvm, quality_rules, textkit, toxicity


def _language(b):
    grams, first, _ = language_id._buckets(b, 15)
    last = np.append(first[1:], len(grams[0]))
    return [[g[i:j].tolist() for g in grams] for i, j in zip(first, last)]


def _rows(features):
    def of(b):
        doc, *rest = features(b)
        return [[x[doc == i].tolist() for x in rest] for i in range(b.n)]

    return of


_rng = np.random.default_rng(1)
_toxic = toxicity.ToxicityModel(_rng.normal(size=toxicity.N_FEATURES), 0.0)
_nbsvm = quality_nbsvm.NbSvmModel(_rng.normal(size=quality_nbsvm.N_FEATURES), _rng.normal(size=quality_nbsvm.N_FEATURES), 1.0, 0.0)
_rules = quality_rules.QualityModel(_rng.normal(size=quality_rules.N_FEATURES), 1.0, 0.0)


def _probability(texts):
    """Of quality rules, by the function that its tasks run."""
    docs = SimpleNamespace()
    schema = SimpleNamespace(names=["doc_id"])
    schema.add = lambda name, _: schema.names.append(name) or schema
    docs.schema = schema
    docs.select = lambda *_: docs
    docs.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m)))
    docs.mapInArrow = lambda work, _: work
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    return [p for out in quality_rules.apply_rules(docs, _rules, ["doc_id"])([batch]) for p in out.column("probability").to_pylist()]


def _in(part):
    return lambda texts: [x for b in textkit.blocks(pa.array(texts, pa.string()), limit=200) for x in part(b)]


@pytest.mark.parametrize(
    "score",
    [_in(_language), _in(_rows(toxicity._features)), _in(lambda b: toxicity._margins(b, _toxic).tolist()), _in(_rows(quality_nbsvm._features)), _in(lambda b: quality_nbsvm._margins(b, _nbsvm).tolist()), _in(_rows(quality_rules._features)), _probability],
)
def test_a_text_scores_the_same_alone_and_in_any_order(score):
    rng = random.Random(4)
    texts = ["", "a", "é", "ab", "", "ß ß", "abc\n", " ", None, *["".join(rng.choice("abcé #\n") for _ in range(rng.randint(1, 30))) for _ in range(60)]]
    alone = [score([t])[0] for t in texts]
    order = rng.sample(range(len(texts)), len(texts))
    for at in (range(len(texts)), order):
        for got, i in zip(score([texts[i] for i in at]), at, strict=True):
            if isinstance(got, float):
                assert got == pytest.approx(alone[i], abs=1e-9)
            else:
                assert got == alone[i]
