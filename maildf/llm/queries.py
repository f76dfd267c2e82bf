"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, jaccard, langid, licences, mixing, neighbours, packing, separators, substrings, warc
from .common import Query, Scratch, table_of


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return packing.pack(table_of(spark, sf_dir, "documents"), s)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return separators.count_tokens(table_of(spark, sf_dir, "documents"), s.path("flat"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return neighbours.search(table_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, s)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return substrings.digests(table_of(spark, sf_dir, "documents"), s)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return exact.dedup(table_of(spark, sf_dir, "documents"), s).drop("uid")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    out = mixing.mix_sources(table_of(spark, sf_dir, "documents"), s)
    return out.select("doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    path = s.path("warc")
    warc.write(table_of(spark, sf_dir, "pages"), path, s)
    return warc.read(spark, path).drop("payload", "url")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    return jaccard.join(table_of(spark, sf_dir, "documents"), s)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table_of(spark, sf_dir, "documents"))


#: Every window of words as a row: for small tables only.
OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS j FROM (SELECT doc_id, i, unnest(range(0, 35)) AS d FROM r)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

OP7 = r"""
WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
terms AS (SELECT source, rate, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM rates, range(0, 400) AS r(j) WHERE j <= rate + 12 * sqrt(rate) + 30),
cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms),
u AS (SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c < u.u) AS k FROM u)
SELECT doc_id, text, lang, source, n_chars, c.copy::INTEGER AS copy, md5('mix:order:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || c.copy) AS mix_key
FROM k, LATERAL (SELECT unnest(range(1, k.k + 1)) AS copy) AS c
"""


OP8 = r"""
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
m AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest,
             max(page_id) OVER (PARTITION BY raw) AS last FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


def queries() -> dict[str, Query]:
    return {"op1_packing": op1_packing, "op2_separator_scan": op2_separator_scan, "op3_language_id": op3_language_id, "op4_permutation_index": op4_permutation_index, "op5_substring_dedup": op5_substring_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_mixing": op7_mixing, "op8_warc": op8_warc, "op9_jaccard_join": op9_jaccard_join, "op10_licence_scan": op10_licence_scan}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5, "op6_exact_dedup": OP6, "op7_mixing": OP7, "op8_warc": OP8, "op10_licence_scan": licences.oracle()}
