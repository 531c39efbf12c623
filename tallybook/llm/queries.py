"""The registered query of each operator, and SQL to check those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    bitsliced,
    decontam,
    html_text,
    jaccard,
    langid,
    line_dedup,
    oracle,
    packing,
    periodic,
    secret_scan,
    sharding,
    spelling,
    token_files,
    url_rules,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_passages(docs, _table(spark, sf_dir, "benchmark"), drop=("text",))
    return decontam.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score")


def size_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_top_k_search": top_k_search,
    "op2_benchmark_decontamination": decontamination,
    "op3_language_id": language_id,
    "op4_sharding": size_sharding,
    "op5_html_extraction": html_extraction,
    "op6_url_filter": url_filter,
    "op7_line_dedup": repeated_lines,
    "op8_packing": sequence_packing,
    "op9_ngram_jaccard_join": jaccard_join,
    "op10_secret_scan": secrets,
    "op11_token_id_files": token_id_files,
    "op12_periodic_runs": periodic_runs,
    "op13_spelling_variants": spelling_variants,
}

ORACLE_SQL = oracle.SQL
