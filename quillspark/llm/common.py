"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import load, spread


def has_text(col: str = "text") -> Column:
    """True where the text is not only white space (Unicode white space included)."""
    return F.coalesce(F.col(col).rlike(r"(?U)\S"), F.lit(False))


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, text) of every delivered attempt that has text.

    Deliveries repeat with the same text, so per-file operators map over all of them and take distinct results: that
    moves a few result rows instead of shuffling every text to find the repeats.
    """
    return spread(load(spark, sf_dir, "extracted_content").select("file_id", "text")).filter(has_text() & F.col("file_id").isNotNull())
