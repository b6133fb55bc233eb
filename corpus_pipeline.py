"""From raw documents to an ordered training mix: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``, calls one operator of ``kgweave.llm`` and returns a
DataFrame, which is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm import decontaminate, language, linededup, mixing, simhash
from kgweave.llm.tables import Scratch, documents

# Cosines of unrelated vectors scatter by this much around 0: a text below it is like no learned language.
LEAST_SCORE = language.DIMENSIONS ** -0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts, and texts that are like no learned language go."""
    judged = language.identify(docs.withColumn("_given", F.struct(*docs.columns)))
    kept = judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("_given.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that are mostly such copies; ``n_chars`` follows the text."""
    cleaned = linededup.drop_copied(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per time a document comes up in training, in training order."""
    return mixing.training_order(mixing.curriculum(docs, keep=docs.columns))


STAGES = [
    ("op2_language", identify_language),
    ("op8_linededup", dedup_lines),
    ("op5_simhash", dedup_near),
    ("op4_decontaminate", decontaminate_benchmark),
    ("op3_mixing", mix_sources),
]
# Language profiles, the trie join and the groups it makes are not SQL; tests compare the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
