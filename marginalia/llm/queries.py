"""The opN queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.hmm_lm import score_texts
from marginalia.llm.line_dedup import line_digest
from marginalia.llm.merkle import manifest
from marginalia.llm.mixing import mix
from marginalia.llm.ngram_join import join_components
from marginalia.llm.order_minhash import fingerprints
from marginalia.llm.packing import pack
from marginalia.llm.pq_codes import encode
from marginalia.llm.suffix_dedup import dedup_digest
from marginalia.llm.template_html import extract
from marginalia.llm.toxicity import toxicity
from marginalia.llm.url_cascade import Rule, judge_urls
from marginalia.llm.weak_quality import quality

URL_RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(_read(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(_read(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_read(spark, sf_dir, "documents")).drop("source", "place")


def op13_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_read(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_weak_quality": op4_weak_quality,
    "op5_hidden_markov": op5_hidden_markov,
    "op6_entropy_balancing": op6_entropy_balancing,
    "op7_ngram_join": op7_ngram_join,
    "op8_order_minhash": op8_order_minhash,
    "op9_url_cascade": op9_url_cascade,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ball_tree_codes": op13_ball_tree_codes,
}
