"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard, kdtree, language, licenses, media, mixing, secrets, substrings, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level BPE and decoded again."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near-duplicates."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat, exactly or nearly, in other documents."""
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the piece vocabulary."""
    return token_counts.count_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return licenses.summarize(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold != 2))
    return language.predict(docs.withColumn("held_out", fold == 2), model, keep=["doc_id", "held_out"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to shares by the square root of their sources' sizes."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as WAV samples with a fingerprint: its time-coded hashes, and a digest of them."""
    return media.media_columns(_table(spark, sf_dir, "documents"), with_hashes=True)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return kdtree.search(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with counts of live-looking and copied ones."""
    return secrets.summarize(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {"op1_bpe": op1_bpe, "op2_jaccard": op2_jaccard, "op3_substrings": op3_substrings, "op4_token_counts": op4_token_counts, "op5_licenses": op5_licenses, "op6_language": op6_language, "op7_mixing": op7_mixing, "op8_media": op8_media, "op9_topk": op9_topk, "op10_secrets": op10_secrets}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_mixing"] = """
WITH sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
means AS (SELECT source, (SELECT sum(n) / sum(pow(n, 0.5)) FROM sizes) * pow(n, 0.5) / n AS mean FROM sizes),
terms AS (SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM means, range(0, 400) AS r(k)),
drawn AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS key, concat('0x', substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.key, max(d.u) AS u, count(*) FILTER (WHERE t.cdf <= d.u) AS copies FROM (SELECT DISTINCT doc_id, key, u, source FROM drawn) d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, g.i::INTEGER AS copy_no, md5('7:order:' || d.key || ':' || g.i) AS mix_key
FROM drawn d JOIN counted c ON d.doc_id IS NOT DISTINCT FROM c.doc_id, LATERAL (SELECT unnest(generate_series(1, c.copies)) AS i) g
"""

ORACLE_SQL["op9_topk"] = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def _spans_sql(kind: int, pattern: str) -> str:
    """DuckDB list of a pattern's matches as (start, kind, end, value): lengths of the matches and of what splitting leaves."""
    p = "'" + pattern.replace("'", "''") + "'"
    found, between = f"regexp_extract_all(t, {p})", f"string_split_regex(t, {p})"
    before = f"(list_sum(list_transform(list_slice({between}, 1, i), lambda b: length(b))) + coalesce(list_sum(list_transform(list_slice({found}, 1, i - 1), lambda m: length(m))), 0))"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'start': {before}::BIGINT, 'kind': {kind}, 'end': ({before} + length({found}[i]))::BIGINT, 'value': {found}[i]}})"


_ASSIGN = "'" + secrets.ASSIGN.replace("'", "''") + "'"
_JOINED = "array_to_string(list_transform({0}, lambda x: ['assign','access','hex','bare'][x.kind + 1] || ':' || x.start || ':' || x.end), ',')"
_VALUE = f"CASE WHEN x.kind = 0 THEN regexp_extract(x.value, {_ASSIGN}, 2) ELSE x.value END"

ORACLE_SQL["op10_secrets"] = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, lang, CASE WHEN regexp_matches(t, {_ASSIGN}) THEN {_spans_sql(0, secrets.ASSIGN)} ELSE [] END AS a, CASE WHEN contains(t, 'AKIA') THEN {_spans_sql(1, secrets.ACCESS)} ELSE [] END AS k,
 CASE WHEN regexp_matches(t, '{secrets.HEX}') THEN {_spans_sql(2, secrets.HEX)} ELSE [] END AS h, CASE WHEN regexp_matches(t, '{secrets.BARE}') THEN {_spans_sql(3, secrets.BARE)} ELSE [] END AS r FROM d),
b AS (SELECT doc_id, source, lang, list_sort(list_concat(list_filter(a, lambda x: length(regexp_extract(x.value, {_ASSIGN}, 2)) >= 12), list_concat(list_filter(k, lambda x: length(x.value) >= 18), h))) AS base, r FROM m),
c AS (SELECT doc_id, source, lang, base, list_filter(r, lambda x: regexp_matches(x.value, '[a-z]') AND regexp_matches(x.value, '[A-Z]') AND regexp_matches(x.value, '[0-9]') AND len(list_filter(base, lambda y: y.start < x.end AND x.start < y.end)) = 0) AS bare FROM b),
v AS (SELECT DISTINCT source, concat_ws('/', source, lang) AS repo, unnest(list_transform(list_concat(base, bare), lambda x: {_VALUE})) AS value FROM c),
w AS (SELECT coalesce(list(value), []) AS copied FROM (SELECT value FROM v GROUP BY value HAVING count(DISTINCT source) >= {secrets.COPIED_FROM} OR count(DISTINCT (source, repo)) >= {secrets.COPIED_REPOS})),
e AS (SELECT doc_id, base, list_sort(list_concat(base, list_filter(bare, lambda x: NOT list_contains(copied, {_VALUE})))) AS every, copied FROM c, w)
SELECT doc_id, len(list_filter(base, lambda x: x.kind = 0)) AS n_assign, len(list_filter(base, lambda x: x.kind = 1)) AS n_access, len(list_filter(base, lambda x: x.kind = 2)) AS n_hex,
 sha256({_JOINED.format("base")}) AS base_sha256, {_JOINED.format("every")} AS spans, len(list_filter(every, lambda x: NOT list_contains(copied, {_VALUE}))) AS n_live, len(list_filter(every, lambda x: list_contains(copied, {_VALUE}))) AS n_copied FROM e
"""
