"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of a bounded, stratified sample of labelled rows make a matrix of log
probabilities (languages x buckets). The matrix is broadcast, and batches of
texts are scored against it in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsail.llm.textkit import Block, U, blocks, code_points, in_last, mix

BUCKET_BITS = 15
#: Orders of the n-grams.
ORDERS = (1, 2, 3)
#: Training rows of each language, in expectation.
MAX_ROWS_PER_LANG = 3000
#: The broadcast matrix may have so many cells; with more languages, use fewer buckets.
MAX_CELLS = 1 << 26


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # float32, languages x buckets
    log_prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _buckets(block: Block, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-gram at each code point, one array for each order; first position of each text; its letters.

    The n-grams at the end of a text are cut short after its newline.
    """
    chars, first = code_points(block)
    end = np.append(first[1:], len(chars)) - 1
    key = np.zeros(len(chars), dtype=U)
    out = []
    for n in range(1, max(ORDERS) + 1):
        part = chars[n - 1 :].astype(U)
        longer = key[: len(part)] * U(0x200003) + part + U(1)
        short = in_last(end, n - 1, len(part))
        longer[short] = key[short]
        key[: len(part)] = longer
        if n in ORDERS:
            out.append((mix(key + U(n)) >> U(64 - bits)).astype(np.int32))
    return out, first, _letters()[chars]


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first)  # every text has its newline, so no slice is empty


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows_per_lang: int = MAX_ROWS_PER_LANG, bits: int = BUCKET_BITS) -> LanguageModel:
    """Learn from usable rows with a language and a text.

    The sample is max_rows_per_lang rows of each language in expectation, picked
    by a hash of the id; rows that share an id are picked together, and repeated
    rows count as often as they occur. Only the counts of each task reach the driver.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << bits), np.float32), np.zeros(0))
    while len(langs) << bits > MAX_CELLS and bits > 8:
        bits -= 1
    if len(langs) << bits > MAX_CELLS:
        raise ValueError(f"{len(langs)} languages are too many for a broadcast matrix")
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, max_rows_per_lang / n)) for k, n in sizes.items()], f"`{lang_col}` string, share double")
    sample = rows.select(id_col, text_col, lang_col).join(F.broadcast(shares), lang_col).filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 30)) < (F.col("share") * (1 << 30)).cast("long"))
    names = pa.array(langs)
    n_buckets = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), n_buckets), dtype=np.int64)
        for batch in batches:
            code = pa.compute.index_in(batch.column(1), names).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(0)):
                grams, first, _ = _buckets(b, bits)
                length = np.diff(np.append(first, len(grams[0])))
                of = np.repeat(code[b.row : b.row + b.n].astype(np.int64), length) << bits
                for g in grams:
                    counts += np.bincount(of + g, minlength=counts.size).reshape(counts.shape)
        for i in np.flatnonzero(counts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([counts[i].tobytes()], pa.binary())], ["code", "counts"])

    total = np.zeros((len(langs), n_buckets))
    # few tasks, so that the driver gets few count rows however many splits the scan has
    for r in sample.select(text_col, lang_col).repartition(8).mapInArrow(count, "code int, counts binary").toLocalIterator():
        total[r["code"]] += np.frombuffer(r["counts"], dtype=np.int64)
    prob = (total + 0.1) / (total + 0.1).sum(axis=1, keepdims=True)
    prior = np.array([sizes[x] for x in langs], dtype=float)
    return LanguageModel(langs, np.log(prob).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry columns, lang_pred and score, the posterior probability of lang_pred.

    `und` with score 0 for a text that is null or has no letter, or if the model
    has no language. Equal posteriors go to the first language by name. Repeated
    rows get equal results, an empty table none; texts of any length are taken
    whole. Carried columns may have any names but those of the results.
    """
    kept = docs.select(*carry, text_col)
    schema = kept.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits = int(m.log_prob.shape[1]).bit_length() - 1
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                grams, first, letter = _buckets(b, bits)
                some = _by_text(letter.astype(np.int64), first) > 0
                name, best = np.full(b.n, "und", dtype=object), np.zeros(b.n)
                if m.langs:
                    score = np.empty((len(m.langs), b.n))
                    for i, row in enumerate(m.log_prob):
                        score[i] = m.log_prior[i] + sum(_by_text(row[g].astype(np.float64), first) for g in grams)
                    top = score.max(axis=0)
                    post = 1.0 / np.exp(score - top).sum(axis=0)
                    name = np.where(some, np.array(m.langs, dtype=object)[score.argmax(axis=0)], "und")
                    best = np.where(some, post, 0.0)
                rest = batch.slice(b.row, b.n)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(name, pa.string()), pa.array(best)], [*carry, "lang_pred", "score"])

    return kept.mapInArrow(work, schema)
