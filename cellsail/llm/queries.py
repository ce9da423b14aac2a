"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsail.llm import centroids, decontaminate, jaccard_join, language_id, mixing, quality_nbsvm, quality_rules, resample, secret_scan, suffix_dedup, token_counts, toxicity, url_filter
from cellsail.llm.store import small_batches
from cellsail.llm.training import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, value: int):
    return F.coalesce(remainder(F.col("doc_id"), modulus) == value, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_rules.apply_rules(docs, quality_rules.fit(docs, labels), ["doc_id"])
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    return language_id.predict(docs.withColumn("held_out", _held_out(4, 2)), model, ["doc_id", "held_out"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"), secret_scan.as_text(F.col("all_spans")).alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def _scored(df: DataFrame, at: float) -> DataFrame:
    return df.withColumn("predicted", (F.col("score") >= at).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return _scored(toxicity.score(docs.withColumn("held_out", _held_out(5, 0)), model, ["doc_id", "held_out"]), 0.5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), ["page_id"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), ["doc_id"], k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_nbsvm.fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return _scored(quality_nbsvm.score(docs.withColumn("held_out", _held_out(5, 0)), model, ["doc_id", "held_out"]), 0.3)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_language_id, op4_secret_scan, op5_decontaminate, op6_mixing, op7_toxicity, op8_url_filter, op9_jaccard_join, op10_quality_nbsvm, op11_importance_resampling, op12_token_counts, op13_centroid_clusters)}


_OP8 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/es/') THEN 'org/es/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule WHEN 'example.com/en/7' THEN 'allow' ELSE 'block' END
  WHEN contains(bare, 'cheap-pills') OR contains(bare, 'adult-x') OR contains(bare, 'free-bets') OR contains(bare, 'casino') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS bare FROM r)
"""


_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
p(o, kind, re, grp, least) AS (VALUES (0, 'assign', '{_ASSIGN}', 2, 6), (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{{24,}}', 0, 24), (3, 'generic', '[A-Za-z0-9_+/-]{{24,}}', 0, 24)),
a AS (SELECT rid, doc_id, source, 0 AS o, regexp_split_to_array(text, '{_ASSIGN}') AS gaps, regexp_extract_all(text, '{_ASSIGN}', 0) AS hits, regexp_extract_all(text, '{_ASSIGN}', 2) AS vals FROM d
  UNION ALL SELECT rid, doc_id, source, 1, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL SELECT rid, doc_id, source, 2, regexp_split_to_array(text, '[0-9a-f]{{24,}}'), regexp_extract_all(text, '[0-9a-f]{{24,}}', 0), regexp_extract_all(text, '[0-9a-f]{{24,}}', 0) FROM d
  UNION ALL SELECT rid, doc_id, source, 3, regexp_split_to_array(text, '[A-Za-z0-9_+/-]{{24,}}'), regexp_extract_all(text, '[A-Za-z0-9_+/-]{{24,}}', 0), regexp_extract_all(text, '[A-Za-z0-9_+/-]{{24,}}', 0) FROM d),
m AS (SELECT rid, doc_id, source, o, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM a WHERE len(hits) > 0),
f AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, o ORDER BY i) AS e FROM m),
s AS (SELECT f.*, e - length(hit) AS b, p.kind FROM f JOIN p USING (o) WHERE length(val) >= p.least
  AND (o < 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')))),
w AS (SELECT val, count(DISTINCT coalesce(source, '<null>')) AS owners, count(DISTINCT coalesce(source, '<null>') || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '<null>')) AS repos FROM s GROUP BY val),
j AS (SELECT s.*, owners <= 2 AND repos <= 10 AND len(list_distinct(string_split(val, ''))) >= 10 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND NOT regexp_matches(val, '(?i)example|sample|changeme|placeholder|dummy|xxxx') AS live FROM s JOIN w USING (val)),
k AS (SELECT * FROM j WHERE o < 3 OR (live AND NOT EXISTS (SELECT 1 FROM j AS x WHERE x.rid = j.rid AND x.o < 3 AND x.b < j.e AND j.b < x.e))),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = rf"""
WITH w AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, w, least(len(w), 13) AS k FROM w WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
own AS (SELECT rid, k, j, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
m AS (SELECT rid, j, own.k, item FROM own JOIN windows ON own.k = windows.k AND own.s = windows.s),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
_OP9 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.rid = x JOIN n AS b ON b.rid = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT rid, rid AS r FROM d UNION SELECT c.rid, e.y FROM c JOIN e ON e.x = c.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n USING (rid) JOIN (SELECT c.rid, min(o.doc_id) AS component_id FROM c JOIN d AS o ON o.rid = c.r GROUP BY 1) AS r USING (rid)
"""


_OP11 = rf"""
WITH poly AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM poly),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS MATERIALIZED (SELECT rid, unnest(w) AS word FROM d),
g AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
h AS MATERIALIZED (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION SELECT word FROM g)),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
  lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM h CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) CROSS JOIN n),
m AS (SELECT rid, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (word) JOIN gain USING (bucket) GROUP BY 1),
u AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(sha256(concat('2024:', doc_id)), i, 1)) - 1 AS BIGINT))), lambda a, y: a * 16 + y) AS h FROM d LEFT JOIN m USING (rid)),
v AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM u),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, count(*) OVER () AS can FROM v WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * can // 100 THEN place END AS rank FROM v LEFT JOIN r USING (rid)
"""


def _op13(rounds: int) -> str:
    """One assignment and one update for each round."""
    assign = """a{i} AS MATERIALIZED (SELECT rid, vec_id, v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(kept.v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := c)) AS m FROM kept CROSS JOIN c{i} GROUP BY ALL)"""
    update = """s{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS w FROM (SELECT m.c AS c, place, sum(v[place]) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS place) GROUP BY ALL) GROUP BY c),
c{j} AS MATERIALIZED (SELECT c, CAST(coalesce(s{i}.w, c{i}.w) AS BIGINT[]) AS w FROM c{i} LEFT JOIN s{i} USING (c))"""
    steps = [assign.format(i=rounds)]
    for i in reversed(range(rounds)):
        steps = [assign.format(i=i), update.format(i=i, j=i + 1), *steps]
    return (
        """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS w FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT 8)),
"""
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m.c
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": _OP4, "op5_decontaminate": _OP5, "op8_url_filter": _OP8, "op9_jaccard_join": _OP9, "op11_importance_resampling": _OP11, "op13_centroid_clusters": _op13(10)}
