"""The queries of this package and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations, collocations_sql
from .divergence import divergence, divergence_sql
from .exact_dedup import exact_dedup
from .language import identify
from .license_scan import license_scan, license_sql
from .media import media_columns
from .mixing import mix, mixing_sql
from .packing import pack
from .quality import resample
from .simhash import simhash_neardup
from .substring_dedup import repeated_spans
from .toxicity import toxicity
from .warc import capture_history


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup(_table(spark, sf_dir, "documents"), shingle=3, max_diff=3)


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents")).drop("rid")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(_table(spark, sf_dir, "pages"), min_bytes=0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), size=4096)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_license": op2_license,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_media": op9_media,
    "op10_packing": op10_packing,
    "op11_language": op11_language,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

#: Twenty bits, five hexadecimal digits, are four signs of base 32.
_SIGNS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * g + 1}, 5))::INT >> {5 * (3 - i)} & 31) + 1, 1)" for g in range(8) for i in range(4))
_WARC_SQL = rf"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h, coalesce(url, '') AS url FROM pages),
    k AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) AS query, max(page_id) OVER (PARTITION BY x) AS last FROM p)
    SELECT page_id, strlen(x) AS payload_bytes, {_SIGNS} AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to,
           lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query) AS url_key,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
    FROM k"""

SQL: dict[str, str] = {
    "op2_license": license_sql(),
    "op7_warc": _WARC_SQL,
    "op8_mixing": mixing_sql(),
    "op12_collocations": collocations_sql(),
    "op13_divergence": divergence_sql(),
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm, length(coalesce(text, '')) AS n FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256,
               n AS n_chars
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
}
