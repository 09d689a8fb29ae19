"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontam import matches
from .dialogue import repaired_damage
from .divergence import SQL as DIVERGENCE
from .divergence import source_divergence
from .html import main_text
from .jaccard import ngram_jaccard_join
from .language import language
from .licenses import license_scan
from .pieces import piece_codec
from .pii import KINDS, personal_data, written
from .sharding import stratified_interleave
from .toxicity import toxicity
from .warc import read_packages, write_packages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "terms")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(_table(spark, sf_dir, "pages"))
    return read_packages(spark, packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = license_scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.select(F.col("id").alias("doc_id"), "path", "license", "how", F.round("score", 9).alias("score"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_interleave(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_damage(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_pii, op3_warc, op4_toxicity, op5_html_extraction, op6_decontamination, op7_ann, op8_license_scan, op9_sentencepiece, op10_sharding, op11_source_divergence, op12_language_id, op13_conversation_repair)}
ORACLES: dict[str, str] = {
    "op11_source_divergence": DIVERGENCE,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN strlen(h) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q""",
}
