"""Queries over the corpus, and their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import encoding, mixing, subjects


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(_table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights")).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights")).shares


#: What the sources of the test tables are, and how much of each domain each language should be.
DOMAINS = {"forge_alpha": "hosted", "mono_mirror": "hosted", "tinyrepo": "hosted", "ghost_feed": "hosted", "patch_mail": "mail", "archive_dump": "collected", "classroom": "collected", "handheld": "collected"}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "*": 0.05}


def _short(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    """Half as many tokens again as the listed sources hold: some run short at that, and what
    they lack goes to other sources of their domain and language, then to other languages
    and domains."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_weights"), epochs=1.5, domains=DOMAINS, languages=LANGUAGES)


def p7_short_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir).documents


def p7_short_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(spark, sf_dir).tree


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = subjects.fit_subjects(docs, _table(spark, sf_dir, "subject_labels"), _table(spark, sf_dir, "subjects"))
    return subjects.assign_subjects(docs, model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir)


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject and source; the composition to be measured."""
    docs = _table(spark, sf_dir, "documents")
    model = subjects.fit_subjects(docs, _table(spark, sf_dir, "subject_labels"), _table(spark, sf_dir, "subjects"))
    return subjects.assign_subjects(docs, model, "source").groupBy("subject", "source").agg(F.count("*").alias("documents"))


QUERIES = {
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_short_mix": p7_short_mix,
    "p7_short_tree": p7_short_tree,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

SQL: dict[str, str] = {}
