"""Queries and SQL of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import ann, bpe, decontaminate, jaccard, licenses, pii, quality, suffix_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_t(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return bpe.encode_documents(_t(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


#: The contract of op5 fixes shingles of three words and nine tenths.
OP5_SETTINGS = jaccard.Settings(shingle=3, num=90, den=100)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(_t(spark, sf_dir, "documents"), OP5_SETTINGS).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_of_own(_t(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_t(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_t(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc, op2_licenses, op3_decontaminate, op4_bpe, op5_jaccard, op6_quality, op7_ann, op8_suffix_dedup, op9_pii, op10_toxicity)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""

_WORDS3 = f"regexp_extract_all({_LOWER}, '{decontaminate.WORD}')"
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS3} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS3} AS w FROM benchmark WHERE len({_WORDS3}) > 0),
     iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda x: array_to_string(w[x:x + least(10, len(w)) - 1], ' '))) AS win FROM i),
     lens AS (SELECT DISTINCT l FROM iw),
     dw AS (SELECT rid, l, unnest(range(1, len(w) - l + 2)) AS p, unnest(list_transform(range(1, len(w) - l + 2), lambda x: array_to_string(w[x:x + l - 1], ' '))) AS win FROM d, lens WHERE len(w) >= l),
     hit AS (SELECT DISTINCT rid, p, l, item_id FROM dw JOIN iw USING (l, win)),
     cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM hit) GROUP BY rid),
     it AS (SELECT rid, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     e AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda x: array_to_string(w[x:x + 2], ' ')) END) AS s FROM d),
     u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM e),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
     s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
SELECT e.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.c AS component_id FROM e JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON e.doc_id = c.a
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
     g AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS s FROM (SELECT doc_id, hx, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
     m AS (SELECT s, min(doc_id) AS f FROM g GROUP BY s),
     h AS (SELECT doc_id, p FROM g JOIN m USING (s) WHERE f < doc_id),
     b AS (SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM h),
     r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
     s AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM r GROUP BY doc_id, run),
     t AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM s),
     k AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last FROM t GROUP BY doc_id),
     x AS (SELECT t.doc_id, string_agg(substr(hx, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_licenses": licenses.oracle(), "op3_decontaminate": OP3, "op5_jaccard": OP5, "op8_suffix_dedup": OP8}
