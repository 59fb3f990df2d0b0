"""The pN_ queries of the problems on texts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.common import table
from strataline.llm import contamination, mixing, reading


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    docs = table(spark, sf_dir, "documents")
    return contamination.leaks(docs, table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture with the source they count for and their repeats."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at least 40 words at reading level 4."""
    graded = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return graded.filter("n_words >= 40 and reading_level = 4").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p8_found, p9_selection, p9_shares, p10_found, p10_levels)}
ORACLE: dict[str, str] = {}
