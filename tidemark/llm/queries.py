"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cws, decontaminate, hard_negatives, language, packing, pii, secret_scan, sharding, simhash, substrings, token_counts, toxicity, whitening
from tidemark.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_fingerprints(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=1024)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.find(docs, secret_scan.train(docs))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, with all four kinds of evidence."""
    model = language.train(documents(spark, sf_dir))
    pages = language.page_evidence(documents(spark, sf_dir, "pages"))
    found = language.identify(pages, model, "page_id", declared="declared", host="host", suffix="suffix")
    return found.withColumnRenamed("doc_id", "page_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), limit=512)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(documents(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


NUMBERED = (op1_simhash, op2_sharding, op3_fingerprints, op4_packing, op5_pii, op6_decontamination, op7_secrets, op8_language, op9_toxicity, op10_substrings, op11_token_counts, op12_hard_negatives, op13_whitening)
QUERIES = {f.__name__: f for f in (*NUMBERED, page_language)}

ORACLE_SQL = {
    "op12_hard_negatives": """
WITH longest AS (SELECT max(len(embedding)) AS d FROM embeddings),
whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings, longest WHERE label IS NOT NULL AND len(embedding) = d AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = d),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM whole a JOIN whole b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (SELECT ar, anchor_id, br, other, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, other, br) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.s DESC, n.other, n.br)::INTEGER AS rank, n.other AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON p.ar = n.ar AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
""",
    "op2_sharding": r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
bytes AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS shuffled
  FROM documents),
sums AS (
  SELECT doc_id, source, size, shuffled,
         xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes, crc_table),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction
  FROM sums),
mixed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, shuffled, doc_id, text_crc32, size, source) - 1 AS position, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position * 40 // total)::INTEGER AS shard,
       (position - ((position * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM mixed
""",
    "op10_substrings": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 34), ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)),
recurring AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM windows JOIN recurring USING (w))),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM placed ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
""",
    "op6_decontamination": r"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark WHERE text IS NOT NULL),
widths AS (SELECT DISTINCT least(len(words), 5) AS w FROM texts WHERE kind = 'item' AND len(words) > 0),
shingled AS (
  SELECT kind, id, unnest(list_transform(range(1, len(words) - w + 2), lambda i: w || ':' || array_to_string(list_slice(words, i, i + w - 1), ' '))) AS shingle
  FROM texts, widths WHERE len(words) >= w AND (kind = 'doc' OR w = least(len(words), 5))),
items AS (SELECT DISTINCT id AS item_id, shingle FROM shingled WHERE kind = 'item'),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
docs AS (SELECT DISTINCT id AS doc_id, shingle FROM shingled WHERE kind = 'doc'),
held AS (SELECT doc_id, item_id, count(*) AS n FROM docs JOIN items USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, held.n::DOUBLE / sizes.n AS containment FROM held JOIN sizes USING (item_id) WHERE held.n::DOUBLE / sizes.n >= 0.8
""",
}
