"""The operators applied to whole tables, with the parameters they would have in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, packing, ppm, quality, simhash, suffix_dedup, tiff, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that its id gives, against a dated list made from every 50th page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    captures = pages.withColumn("fetched_at", day(F.col("page_id") % 366))
    host, path = url_filter.host_of(F.col("url")), F.substring_index(url_filter.path_of(F.col("url")), "?", 1)
    n = F.floor(F.col("page_id") / 50)
    kind = F.element_at(F.array(*map(F.lit, ("host", "domain", "prefix", "url"))), (n % 4 + 1).cast("int"))
    key = F.when(kind == "host", host).when(kind == "domain", F.regexp_replace(host, r"^(m|blog)\.", "")).when(kind == "prefix", F.concat(host, F.regexp_extract(path, "^(/[^/]*)", 1))).otherwise(F.concat(host, url_filter.path_of(F.col("url"))))
    listed = pages.where(F.col("page_id") % 50 == 0).select(kind.alias("kind"), key.alias("key"), F.when(n % 5 == 4, "allow").otherwise("block").alias("verdict"), (F.col("page_id") * 7 % 300).alias("added"), "page_id")
    added = listed.select("kind", "key", "verdict", F.lit("add").alias("action"), day(F.col("added")).alias("effective_at"))
    removed = listed.where(F.col("page_id") % 100 == 0).select("kind", "key", "verdict", F.lit("remove").alias("action"), day(F.col("added") + 45).alias("effective_at"))
    return url_filter.evaluate(captures, added.union(removed)).select("page_id", "fetched_at", "url_verdict", "url_rule_kind", "url_rule_key")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.format_conversations(rows.union(extra)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.held_out_scores(table(spark, sf_dir, "documents"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(tiff.stored(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_packing, op3_chat_format, op4_suffix_dedup, op5_simhash, op6_toxicity, op7_decontamination, op8_quality, op9_ppm, op10_tiff)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched_at,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)', 1)), '\.$', ''), '^www\.', '') AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^#]*)', 2) AS rest
  FROM pages
), urls AS (
  SELECT page_id, fetched_at, host, CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS path FROM parts
), listed AS (
  SELECT page_id, page_id * 7 % 300 AS added, CASE WHEN (page_id // 50) % 5 = 4 THEN 'allow' ELSE 'block' END AS verdict,
    ['host', 'domain', 'prefix', 'url'][CAST((page_id // 50) % 4 + 1 AS INTEGER)] AS kind, host, path
  FROM urls WHERE page_id % 50 = 0
), keyed AS (
  SELECT *, CASE kind WHEN 'host' THEN host WHEN 'domain' THEN regexp_replace(host, '^(m|blog)\.', '')
    WHEN 'prefix' THEN host || regexp_extract(split_part(path, '?', 1), '^(/[^/]*)', 1) ELSE host || path END AS key FROM listed
), entries AS (
  SELECT kind, key, verdict, 1 AS is_add, TIMESTAMP '2024-01-01' + to_days(CAST(added AS INTEGER)) AS day FROM keyed
  UNION ALL
  SELECT kind, key, verdict, 0, TIMESTAMP '2024-01-01' + to_days(CAST(added + 45 AS INTEGER)) FROM keyed WHERE page_id % 100 = 0
), days AS (
  SELECT kind, key, verdict, day, max(is_add) AS is_on FROM entries GROUP BY ALL
), changes AS (
  SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY kind, key, verdict ORDER BY day), 0) AS was FROM days) WHERE is_on <> was
), rules AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, key, verdict ORDER BY day) AS valid_to FROM changes) WHERE is_on = 1
), met AS (
  SELECT u.page_id, r.kind, r.key, r.verdict, CASE r.kind WHEN 'domain' THEN 1 WHEN 'host' THEN 2 WHEN 'prefix' THEN 3 ELSE 4 END AS rank
  FROM urls u JOIN rules r ON r.day <= u.fetched_at AND (r.valid_to IS NULL OR u.fetched_at < r.valid_to) AND u.host <> '' AND CASE r.kind
    WHEN 'domain' THEN u.host = r.key OR ends_with(u.host, '.' || r.key)
    WHEN 'host' THEN u.host = r.key
    WHEN 'prefix' THEN u.host || split_part(u.path, '?', 1) = r.key OR starts_with(u.host || split_part(u.path, '?', 1), r.key || '/')
    ELSE u.host || u.path = r.key END
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, length(key) DESC, verdict = 'allow' DESC, kind DESC, key DESC) AS n FROM met) WHERE n = 1
)
SELECT u.page_id, u.fetched_at, coalesce(b.verdict, 'allow') AS url_verdict, b.kind AS url_rule_kind, b.key AS url_rule_key
FROM urls u LEFT JOIN best b USING (page_id)
"""

OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous,
    length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + chars + CASE WHEN previous IS NOT DISTINCT FROM role THEN 0 ELSE 15 + length(role) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM sized)
), places AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= size)
), met AS (
  SELECT doc_id, k, p.size, item_id FROM places p JOIN windows x ON p.words = x.words AND p.size = x.size
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op3_chat_format": OP3_SQL, "op7_decontamination": OP7_SQL}
