"""From documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.

In all stages: a null or empty text is scored, counted and redacted as an empty
one, and is kept by every filter that has no other reason to drop it. Texts of any
length are taken whole. Rows that are equal in all columns get equal decisions; only
the near-duplicate stage leaves one of them. An empty table gives an empty result.
Columns beyond those of documents are carried along, whatever their names; the
stages' own columns are named apart from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsail.llm import decontaminate, jaccard_join, mixing, secret_scan, toxicity
from cellsail.llm.queries import table
from cellsail.llm.sieve import maybe, sieve
from cellsail.llm.store import materialize, small_batches
from cellsail.llm.training import remainder


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with names that no operator uses: text, doc_id and source stay, others are numbered."""
    small_batches(docs.sparkSession)
    own = {"text", "doc_id", "source"}
    names = [c if c in own else f"carried_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; a tie at 0.5 goes. A null id learns from no label."""
    ours, names = _apart(docs)
    model = toxicity.fit(ours, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(ours, model, names).filter("score < 0.5").select(names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of Jaccard 0.8 on five-word shingles join, one with the least id stays; null ids come last.

    Ids may be null or shared: components go by their sets, and rows by two hashes
    of all their columns, alike at every run; of rows with one id the one of least
    hashes stays. Texts without words all stay.
    """
    ours, names = _apart(docs)
    values = [x for c in names for x in (F.col(c).isNull(), F.col(c))]
    keyed = ours.select("*", *[F.xxhash64(F.lit(k), *values).alias(k) for k in ("key1", "key2")])
    key = ["key1", "key2"]
    found = jaccard_join.jaccard_components(keyed, ["doc_id", *key], k=5, percent=80).filter("n_shingles > 0")
    found = materialize(found.select("component_set", "doc_id", *key), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *key)
    first = found.groupBy("component_set").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    ours_is_first = (F.col("first.key1") == F.col("key1")) & (F.col("first.key2") == F.col("key2"))
    judged = found.join(first.drop("n"), "component_set").groupBy(*key).agg(F.max(~ours_is_first).alias("gone"), F.count("*").alias("n"))
    judged = materialize(judged.filter("gone OR n > 1").select(*key, "gone"), "near-judged")
    # what a sieve of the rows judged keeps out goes past the join, so that few texts are shuffled
    judged_one = maybe(sieve(judged, "key1"), F.col("key1"))
    kept = keyed.filter(~judged_one).unionByName(keyed.filter(judged_one).join(judged, key, "left_anti"))
    equal = judged.filter("NOT gone").select(*key)
    if not equal.isEmpty():  # rows alike in all columns: one of them
        kept = kept.unionByName(keyed.join(equal, key, "left_semi").dropDuplicates(key))
    return kept.select(names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go; without words, or without items, none."""
    ours, names = _apart(docs)
    found = decontaminate.find_windows(ours, table(spark, sf_dir, "benchmark"), names)
    return found.filter(~F.col("contaminated")).select(names).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by a mark; n_chars follows the text. A null text stays null."""
    ours, names = _apart(docs)
    found = secret_scan.scan(ours, names)
    has = F.size("all_spans") > 0
    out = found.withColumn("text", F.when(has, secret_scan.redact(F.col("text"), F.col("all_spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = names[docs.columns.index("n_chars")]
        out = out.withColumn(size, F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)))
    return out.select(names).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each document; none from a text without words."""
    return mixing.mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("mixing", mix_sources)]

#: Learned scores and random draws are in the result, so SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
