"""Queries of the general training-data operators that belong to the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.timestamps import normalise_dates
from quillspark.session import load

# Zones that the estimate tries for a site that names none.
ZONE_CANDIDATES = ["UTC", "Europe/London", "Europe/Berlin", "America/New_York", "America/Chicago", "America/Los_Angeles", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_dates(load(spark, sf_dir, "document_metadata"), load(spark, sf_dir, "intake_sites"), ZONE_CANDIDATES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found}
