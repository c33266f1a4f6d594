"""Errors and attempts: classes of errors, retries, and the statistics of attempts and operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (class, seconds to wait, worth a retry, words of the message), first match first.
ERROR_CLASSES = (
    ("recoverable_permission", 2.0, True, ("permission denied", "errno 13")),
    ("file_locked", 1.5, True, ("file is being used", "errno 32", "temporarily locked", "file locked")),
    ("sync_conflict", 3.0, True, ("onedrive", "dropbox", "sync", "cloud", "conflicted copy")),
    ("network_issue", 5.0, True, ("network", "timeout", "connection", "unreachable")),
    ("unsupported_format", 0.0, False, ("unsupported", "invalid format", "corrupted", "not a valid")),
    ("organization_ml_unavailable", 0.0, False, ("spacy", "sentence", "transformers", "sklearn", "nltk", "model", "no module named")),
    ("organization_config_error", 1.0, True, ("configuration", "invalid config", "missing config", "preferences")),
    ("organization_insufficient_data", 0.0, False, ("no documents", "empty content", "insufficient data", "no valid documents")),
    ("organization_classifier_error", 2.0, True, ("classification", "categorization", "clustering", "similarity")),
    ("organization_folder_error", 1.0, True, ("mkdir", "folder", "directory", "makedirs", "cannot create")),
)
# Words of messages after which a request is sent again.
RETRY_WORDS = (
    "connection", "network", "timeout", "unreachable", "dns", "socket", "ssl", "certificate",
    "rate limit", "rate_limit", "too many requests", "429", "quota", "throttle",
    "500", "502", "503", "504", "server error", "internal error", "service unavailable", "bad gateway",
    "temporarily unavailable", "try again", "service busy", "model loading", "warming up",
)
SEVERITY = ((0, "NONE"), (2, "LOW"), (5, "MEDIUM"))


def error_class(message: Column) -> Column:
    """(error_type, wait_seconds, retry) of an error message; null messages count as empty, unknown ones are permanent."""
    low = F.lower(F.coalesce(message, F.lit("")))
    kind, wait, retry = F.lit("permanent_error"), F.lit(0.0), F.lit(False)
    for name, seconds, again, words in reversed(ERROR_CLASSES):
        hit = low.rlike("|".join(words))
        kind, wait, retry = F.when(hit, name).otherwise(kind), F.when(hit, seconds).otherwise(wait), F.when(hit, again).otherwise(retry)
    return F.struct(kind.alias("error_type"), wait.alias("wait_seconds"), retry.alias("retry"))


def worth_a_retry(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(RETRY_WORDS))


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Exponential back-off without jitter: base * factor ^ (attempt - 1), at most so much."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def retry_statistics(attempts: DataFrame) -> DataFrame:
    """One row on attempts (file_id, content_id, message, success): retries, recoverable and permanent errors, shares.

    One aggregation a file, partial before its shuffle, then one row; a file with very many attempts is no larger a row.
    """
    error = F.when(F.col("message").isNotNull(), error_class(F.col("message"))["retry"])
    a = attempts.select("file_id", "content_id", F.col("success").cast("int").alias("ok"), error.alias("again"))
    per = a.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ok").alias("good"),
        F.min_by("ok", "content_id").alias("first"),
        F.count_if(F.col("again")).alias("recoverable"),
        F.count_if(~F.col("again")).alias("permanent"),
    )
    t = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_attempts"),
        F.coalesce(F.sum(F.col("good") - F.col("first")), F.lit(0)).alias("successful_retries"),
        F.coalesce(F.sum(F.col("n") - 1 - (F.col("good") - F.col("first"))), F.lit(0)).alias("failed_retries"),
        F.count_if(F.col("recoverable") > 0).alias("files_with_recoverable_issues"),
        F.coalesce(F.sum("permanent"), F.lit(0)).alias("permanent_errors"),
        F.coalesce(F.sum("recoverable"), F.lit(0)).alias("recoverable_errors"),
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("good") > 0).alias("succeeded"),
    )
    share = F.when(F.col("files") > 0, F.round(100.0 * F.col("succeeded") / F.col("files"), 6)).otherwise(0.0)
    return t.withColumn("success_rate", share)


def operation_statistics(operations: DataFrame) -> DataFrame:
    """(operation, total, failed, success_rate) of (operation, ok); the rate of no operations would be 100."""
    t = operations.groupBy("operation").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    return t.withColumn("success_rate", F.round(100.0 * (F.col("total") - F.col("failed")) / F.col("total"), 6))


def availability(services: DataFrame) -> DataFrame:
    """One row on (service, available): how many services there are, how many answer, and the share; repeated rows count once."""
    one = services.groupBy("service").agg(F.max("available").alias("up"))
    t = one.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("up")).alias("available"))
    return t.withColumn("availability_rate", F.when(F.col("total") > 0, F.round(F.col("available") / F.col("total"), 6)).otherwise(0.0))


def calls_in_sources(sources: DataFrame, names: tuple[str, ...] = ("Console",)) -> DataFrame:
    """(path, line, kind) of every call of the named classes in Python sources (path, source); broken sources give no row.

    Parsing needs Python, so it runs over Arrow batches, a source a row. kind: 'direct' for Name(), 'module' for x.Name().
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for b in batches:
            rows = []
            for path, source in zip(b.path, b.source):
                try:
                    nodes = list(ast.walk(ast.parse(source or "")))
                except (SyntaxError, ValueError):
                    continue
                for x in nodes:
                    if isinstance(x, ast.Call):
                        f = x.func
                        if isinstance(f, ast.Name) and f.id in names:
                            rows.append((path, x.lineno, "direct"))
                        elif isinstance(f, ast.Attribute) and f.attr in names:
                            rows.append((path, x.lineno, "module"))
            yield pd.DataFrame(rows, columns=["path", "line", "kind"])

    return sources.select("path", "source").mapInPandas(run, "path string, line bigint, kind string")


def call_report(calls: DataFrame) -> DataFrame:
    """One row on calls_in_sources(): total, files, direct and module calls, and how serious that is."""
    t = calls.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("path").alias("files"), F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "module").alias("module"))
    level = F.lit("HIGH")
    for most, name in reversed(SEVERITY):
        level = F.when(F.col("total") <= most, name).otherwise(level)
    return t.withColumn("severity", level)
