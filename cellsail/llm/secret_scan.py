"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in every text. Hashes of the candidate values are
counted over the whole corpus by distinct repositories and owners. A value of many
owners, or in many repositories of one, is an example that was copied; one of few
of both that looks like a key is a live credential, and generic tokens of that sort
are added to the spans of the fixed patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.llm.store import materialize

#: Fixed values. kind: (pattern, group of the value, least length of the value), in the order of kinds.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "generic": (r"[A-Za-z0-9_+/-]{24,}", 0, 24),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
#: A live credential has so many owners and is in so many of their repositories at most; a value of more of either is an example.
LIVE_OWNERS, LIVE_REPOS = 2, 10
#: A live credential has so many distinct characters at least, and none of these words.
MIN_DISTINCT = 10
PLACEHOLDERS = "(?i)example|sample|changeme|placeholder|dummy|xxxx"


def _found(kind: str, text: Column) -> tuple[Column, Column, Column]:
    """Lengths of the pieces between matches, lengths of the matches, and their values.

    A match's place follows from these lengths: leftmost matches that do not
    overlap, in code points.
    """
    pattern, group, _ = PATTERNS[kind]
    has = text.rlike(pattern)
    size = lambda xs: F.transform(xs, F.length)
    none = F.array().cast("array<int>")
    return (
        F.when(has, size(F.split(text, pattern, -1))).otherwise(none),
        F.when(has, size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(none),
        F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>")),
    )


def _numbered(order: int):
    return lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value"))


def looks_live(value: Column) -> Column:
    letters = F.size(F.array_distinct(F.split(value, "")))
    return (letters >= MIN_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDERS)


def scan(docs: DataFrame, carry: list[str], text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """carry columns, base and all_spans of each row.

    Both are arrays of (start, order, end, kind, value, owners, repos, verdict) by
    start and then kind, in code points, end exclusive; verdict is live, example or
    unclear. base has the fixed patterns' matches. all_spans has also the generic
    tokens that are live and overlap none of these. A null text has no spans, a null
    owner or repository is one of its own, and a repository is one for each owner.
    Repeated rows get equal results and count once; an empty table gives no rows;
    spans of a text of any length are found whole, and equal starts go by kind.
    """
    inner = [f"c{i}" for i in range(len(carry))]
    cols = []
    for k in KINDS:
        between, size, value = _found(k, F.col(text_col))
        cols += [between.alias(f"{k}_between"), size.alias(f"{k}_size"), value.alias(f"{k}_value")]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, inner)], F.col(owner_col).cast("string").alias("owner"), F.xxhash64(F.col(repo_col)).alias("repo"), *cols)
    # the written ids stay what they are when a task runs again
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(f"{k}_size") > 0)
    rows = materialize(rows.withColumns({"rid": F.monotonically_increasing_id(), "some": some}), "secret-candidates")
    matches = F.concat(*[
        F.transform(F.arrays_zip(F.slice(f"{k}_between", 1, F.size(f"{k}_size")).alias("gap"), F.col(f"{k}_size").alias("size"), F.col(f"{k}_value").alias("value")), _numbered(n))
        for n, k in enumerate(KINDS)
    ])
    flat = rows.select("rid", "owner", "repo", F.explode(matches).alias("m")).select("rid", "owner", "repo", "m.*")
    upto = Window.partitionBy("rid", "order").orderBy("i")
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS]), F.col("order") + 1)
    flat = flat.filter(F.length("value") >= least).filter((F.col("order") < len(BASE)) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")))
    flat = materialize(flat.withColumn("hash", F.xxhash64("value")).select("rid", "owner", "repo", "order", "start", "end", "value", "hash"), "secret-matches")
    # three steps, each with partial sums before its shuffle: no value, however common, meets in one task
    pairs = flat.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    verdict = F.when((F.col("owners") > LIVE_OWNERS) | (F.col("repos") > LIVE_REPOS), "example").when(looks_live(F.col("value")), "live").otherwise("unclear")
    span = F.struct("start", "order", "end", kind.alias("kind"), "value", "owners", "repos", verdict.alias("verdict"))
    spans = flat.join(owned, "hash").groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # rows without a candidate, most of all, are not shuffled with their texts
    found = rows.filter("some").select("rid", *inner).join(spans, "rid", "left").drop("rid")
    out = found.unionByName(rows.filter("NOT some").select(*inner, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    added = F.filter("spans", lambda s: (s["order"] < len(BASE)) | ((s["verdict"] == "live") & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    null_safe = lambda x: F.coalesce(x, F.array().cast(spans.schema["spans"].dataType))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, inner)], null_safe(base).alias("base"), null_safe(added).alias("all_spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each run of touching or overlapping spans replaced by mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        fresh = s["start"].cast("long") > acc["at"]
        first = (acc["at"] == 0) & (s["start"] == 0)
        gap = F.when(fresh | first, F.concat(text.substr((acc["at"] + 1).cast("int"), (s["start"].cast("long") - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"].cast("long")).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
