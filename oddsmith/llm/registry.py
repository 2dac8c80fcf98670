"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import decontaminate, jaccard, langid, licenses, linededup, mixing, repeats, substrings, toxicity, warc
from oddsmith.llm.common import id_hash_bucket, table, text_hash

#: Target shares of output characters; all other sources share REST.
SHARES = {"src0": 0.15, "src1": 0.10, "src2": 0.02, "src3": 0.08}
REST = 0.65
MIN_SITES, MIN_CHARS = 10, 20


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), SHARES, REST)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notice_ids", F.array_join("notice_ids", ","))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents"), min_sites=MIN_SITES, min_chars=MIN_CHARS)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = id_hash_bucket("doc_id", 3) == 1
    known = docs.where(~out).select("doc_id", *text_hash(F.col("text"), 5)).join(labels.select("doc_id", "toxic"), "doc_id")
    model = toxicity.train(docs.where(~out), "text", "toxic", hashed=known, seed=5)
    scored = toxicity.score(docs, F.struct("doc_id"), F.col("text"), model).select("key.doc_id", "score")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(spark, warc.write(table(spark, sf_dir, "pages")))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repeats.score(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return scored.withColumnRenamed("key", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = id_hash_bucket("doc_id", 5) == 0
    model = langid.train(docs.where(~out), "text", "lang")
    found = langid.predict(docs, F.col("doc_id"), F.col("text"), model).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=3, pct=90)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_substring_dedup, op4_line_dedup, op5_toxicity, op6_warc, op7_decontaminate, op8_quality_rules, op9_language_id, op10_ngram_jaccard)}

_shares = ", ".join(f"('{k}', {v})" for k, v in SHARES.items())
_sql_line = r"trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))"
for _a, _b in licenses.EQUIVALENT:
    _sql_line = f"replace({_sql_line}, '{_a}', '{_b}')"
_digests = ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{licenses.canonical(v)}')" for k, v in licenses.KNOWN.items())

ORACLE_SQL = {
    "op1_mix_sources": f"""
WITH shares(source, share) AS (VALUES {_shares}),
d AS (SELECT doc_id, text, lang, documents.source, n_chars, shares.source AS kind, coalesce(share, {REST}) AS share FROM documents LEFT JOIN shares USING (source)),
sizes AS (SELECT kind, any_value(share) AS share, sum(length(text)) AS size FROM d GROUP BY kind),
means AS (SELECT kind, share / (SELECT sum(share) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS mean FROM sizes),
rates AS (SELECT kind, greatest(1, ceil(mean / {mixing.MOST_MEAN}))::BIGINT AS draws, mean / greatest(1, ceil(mean / {mixing.MOST_MEAN})) AS m FROM means),
cdf AS (SELECT kind, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY kind ORDER BY k) AS c FROM rates, range(0, 90) t(k)),
draw AS (SELECT doc_id, d.kind, ('0x' || substr(md5('1:' || doc_id || ':' || j), 1, 13))::BIGINT / pow(2, 52) AS u FROM d JOIN rates ON d.kind IS NOT DISTINCT FROM rates.kind, LATERAL (SELECT unnest(range(1, draws + 1)) AS j)),
copies AS (SELECT doc_id, count(*) AS n FROM draw JOIN cdf ON draw.kind IS NOT DISTINCT FROM cdf.kind AND c <= u GROUP BY doc_id),
out AS (SELECT d.doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS copy FROM d JOIN copies USING (doc_id))
SELECT *, md5('1:order:' || doc_id || ':' || copy) AS shuffle_key FROM out""",
    "op2_license_scan": f"""
WITH known(name, body) AS (VALUES {_digests}),
k AS (SELECT min(name) AS name, sha256(body) AS digest FROM known GROUP BY body),
n AS (SELECT doc_id, list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: {_sql_line}) AS lines FROM documents),
c AS (SELECT doc_id, list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, '{licenses.COPYRIGHT}')) AS lines FROM n),
hits AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS ids FROM (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(lines) AS line FROM c) JOIN k ON sha256(line) = digest) GROUP BY doc_id)
SELECT c.doc_id, sha256(array_to_string(lines, ' ')) AS canonical_sha256, k.name AS license_id, coalesce(ids, '') AS notice_ids
FROM c LEFT JOIN k ON sha256(array_to_string(lines, ' ')) = digest LEFT JOIN hits USING (doc_id)""",
    "op4_line_dedup": f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
boiler AS (SELECT trim(raw) AS line, min(doc_id) AS first_id FROM lines WHERE length(trim(raw)) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT doc_id, raw, pos, line IS NOT NULL AND doc_id <> first_id AS gone FROM lines LEFT JOIN boiler ON trim(raw) = line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS body FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(body) END AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100""",
}
