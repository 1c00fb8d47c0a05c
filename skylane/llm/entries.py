"""Queries of this subpackage's operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, digest_sql, language, lm_scores, merkle, near_dups, packing, pii, pivot_search, quality, sentence_pieces, toxicity, url_blocks, vector_codes
from .common import id_remainder, shared_dir, table

#: The contract's rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: 64 * x.cast("double"))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float("inf"), F.floor(x).cast("double")))
    return pivot_search.top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 20 == 0, k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", id_remainder("doc_id", 5) == 0)


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op5_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    bitplanes.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return bitplanes.read_documents(spark, path)


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(id_remainder("doc_id", 3) != 1))
    return language.predict(docs, model).withColumn("held_out", id_remainder("doc_id", 3) == 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_blocks.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=F.when(id_remainder("doc_id", 3) == 0, lower))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuning = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 7), F.lit(16)) == 0
    scores = lm_scores.score(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2, tuning)
    return scores.withColumn("held_out", id_remainder("doc_id", 7) == 2)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13_lm_scores that SQL can express."""
    return op13_lm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that SQL can express."""
    return op4_pii(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_quality that SQL can express."""
    return op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_exact_top_k, op3_toxicity, op4_pii, op5_bit_planes, op6_sentence_pieces, op7_language, op8_quality, op9_near_duplicates, op10_url_blocks, op11_vector_codes, op12_merkle_manifest, op13_lm_scores, pii_base, quality_base, lm_base)
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
c AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.y, c.c FROM c JOIN l ON l.x = c.d)
SELECT n.doc_id, n.n AS n_shingles, min(c.c) AS component_id, n.doc_id = min(c.c) AS kept FROM n JOIN c ON c.d = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_url_blocks": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest, url FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
      string_split(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '') AS node FROM h),
o AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM r),
b AS (SELECT DISTINCT node FROM o WHERE own = 'block')
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN contains(url, '://') AND node IN (SELECT node FROM b) THEN 'block' END, 'allow') AS verdict FROM o""",
    "op11_vector_codes": digest_sql.vector_codes(),
    "op12_merkle_manifest": digest_sql.merkle(),
    "lm_base": digest_sql.base_scores(),
    "pii_base": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(ord, kind, pat) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT doc_id, ord, kind, regexp_extract_all(t, pat) AS m, regexp_split_to_array(t, pat) AS p FROM t, k),
s AS (SELECT doc_id, ord, kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {'m': m[i], 's': coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)})) AS x FROM m),
d AS (SELECT *, regexp_replace(x.m, '[^0-9]', '', 'g') AS g FROM s),
f AS (SELECT doc_id, ord, kind, CAST(x.s AS BIGINT) AS b, CAST(x.s + len(x.m) AS BIGINT) AS e FROM d WHERE CASE kind WHEN 'email' THEN TRUE
  WHEN 'ip' THEN len(list_filter(string_split(x.m, '.'), lambda o: len(ltrim(o, '0')) > 3 OR TRY_CAST(o AS HUGEINT) > 255)) = 0
  WHEN 'card' THEN len(g) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, len(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(g, len(g) - i, 1) AS INT) ELSE 2 * CAST(substr(g, len(g) - i, 1) AS INT) - CASE WHEN substr(g, len(g) - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE len(g) BETWEEN 8 AND 15 END)
SELECT t.doc_id, count(b) FILTER (kind = 'email') AS n_email, count(b) FILTER (kind = 'ip') AS n_ip, count(b) FILTER (kind = 'card') AS n_card, count(b) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY ord, b), '')) AS base_sha256 FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id""",
    "quality_base": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t WHERE len(w) > 4),
r AS (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM r GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
a AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a""",
}
