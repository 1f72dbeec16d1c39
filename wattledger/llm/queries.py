"""The registered queries of the corpus operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.llm import checks
from wattledger.llm.alignment import alignment_report
from wattledger.llm.common import ship_package, table
from wattledger.llm.decontamination import contamination_report
from wattledger.llm.hard_negatives import hard_negatives, relabelled
from wattledger.llm.packing import pack
from wattledger.llm.private_data import private_report
from wattledger.llm.quality import score_quality
from wattledger.llm.revisits import captures_report, revisit_report
from wattledger.llm.risk_rules import rules_report
from wattledger.llm.secrets import secret_report
from wattledger.llm.simhash import near_duplicates
from wattledger.llm.toxicity import score_toxicity
from wattledger.llm.url_filter import judge_urls
from wattledger.llm.vector_search import top_products


def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_revisit_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures_report(table(spark, sf_dir, "pages"))


def op2_revisit_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit_report(table(spark, sf_dir, "pages"))


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_report(table(spark, sf_dir, "documents"))


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file as it is installed on every machine; it is not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.filter("vec_id % 100 = 0"))


def op10_private_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_report(table(spark, sf_dir, "documents"))


def op11_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return rules_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return alignment_report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_toxicity_nnpu, op2_revisit_captures, op2_revisit_asof_join, op3_quality_trees, op4_secret_guess_cost, op5_benchmark_containment,
    op6_url_token_rules, op7_packing_least_squares, op8_simhash_trie, op9_vector_approximation, op10_private_weak_labels,
    op11_risk_controlled_rules, op12_token_alignment, op13_hard_negatives)}
CHECKS = {
    "op2_revisit_captures": checks.CAPTURES, "op2_revisit_asof_join": checks.REVISITS,
    "op5_benchmark_containment": checks.CONTAMINATION, "op6_url_token_rules": checks.URLS, "op9_vector_approximation": checks.TOP_PRODUCTS,
    "op13_hard_negatives": checks.HARD_NEGATIVES,
}
