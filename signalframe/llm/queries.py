"""The registered queries of the training-data operators, with their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, fingerprints, forced, langid, lm, mixing, periods, quality, resample, secrets, topk, urls
from .bpe import doc_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(secrets.BASE))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def _sql_spans(rule: secrets.Rule, number: int) -> str:
    """Spans of one rule by the gaps between its matches; l: running lengths of gaps and matches."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, list_transform(list_filter(list_zip(range(1, len(hit) + 1), hit, kept), lambda z: length(z[3]) >= {rule.least}),
        lambda z: {{'s': CAST(list_sum(list_transform(gap[:z[1]], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[:z[1] - 1], lambda h: length(h))), 0) AS BIGINT), 'k': {number},
            'e': CAST(list_sum(list_transform(gap[:z[1]], lambda g: length(g))) + list_sum(list_transform(hit[:z[1]], lambda h: length(h))) AS BIGINT)}}) AS found
    FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS gap, regexp_extract_all(t, {pattern}) AS hit, regexp_extract_all(t, {pattern}, {rule.group}) AS kept FROM texts)"""


def _op1_sql() -> str:
    parts = " UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(secrets.RULES))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    text = f"list_transform(list_sort(%s), lambda s: {kinds}[s.k + 1] || ':' || s.s || ':' || s.e)"
    base = text % f"list_filter(found, lambda s: s.k < {len(secrets.BASE)})"
    counts = ", ".join(f"CAST(len(list_filter(found, lambda s: s.k = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS ({parts}),
whole AS (SELECT doc_id, flatten(list(found)) AS found FROM parts GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({text % 'found'}, ',') AS spans FROM whole"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_and_group(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: documents that `labels` lists, with their language as domain."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, language_labels(spark, sf_dir), mixing.TARGETS)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, doc_hash() % 4 != 2)
    return langid.identify(docs, model).select("doc_id", (doc_hash() % 4 == 2).alias("held_out"), "lang_pred", "score")


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of pages whose path ends in the id of a document labelled toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    host, path = urls.host_and_path(F.col("url"))
    named = pages.select(urls.canonical(host, path).alias("url")).withColumn("doc_id", F.regexp_extract("url", r"/([0-9]{1,18})$", 1).try_cast("long"))
    return named.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id").select("url")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir))


OP7_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT *, host || regexp_replace(path, '(\\.html|/)$', '') AS u FROM part),
listed AS (SELECT DISTINCT u FROM named WHERE host <> '' AND TRY_CAST(nullif(regexp_extract(u, '/([0-9]{1,18})$', 1), '') AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, u IN (SELECT u FROM listed) AS listed,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN u IN (SELECT u FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH fit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM fit q JOIN fit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), doc_hash() % 10 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs, labels, doc_hash() % 5 != 0)
    return scored.select("doc_id", (doc_hash() % 5 == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"], digests=True)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its table, which follows from the polynomial; words are hashed once each.
OP12_SQL = """
WITH RECURSIVE step(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
raw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aim AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM raw) GROUP BY ALL),
theirs AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM aim) GROUP BY ALL),
names AS (SELECT word FROM own UNION SELECT word FROM theirs),
bytes AS (SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)) AS b FROM names),
hashed AS (SELECT word, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS BIGINT) AS bucket FROM bytes, crc),
s AS (SELECT bucket, CAST(sum(c) AS BIGINT) AS s FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(c) AS BIGINT) AS t FROM theirs JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(sum(c * g) AS BIGINT) AS weight FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM raw LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank FROM placed"""


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), keep=["doc_id"], order=periods.repeated_order, digests=True)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_fingerprints": op2_fingerprints,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_url_filter": op7_url_filter,
    "op8_top_k": op8_top_k,
    "op9_lm": op9_lm,
    "op10_quality": op10_quality,
    "op11_forced_bpe": op11_forced_bpe,
    "op12_resample": op12_resample,
    "op13_periods": op13_periods,
}
ORACLES = {"op1_secrets": _op1_sql(), "op7_url_filter": OP7_SQL, "op8_top_k": OP8_SQL, "op12_resample": OP12_SQL}
