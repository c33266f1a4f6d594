"""Optional streaming intake: files that land in a folder are profiled and classified as they come.

This goes beyond what the operators need on tables; the same column functions run unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import classify


def landing(spark: SparkSession, folder: str, schema: str = "doc_id bigint, file_name string, content string, arrived timestamp") -> DataFrame:
    """JSON-lines documents of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)


def classified_stream(docs: DataFrame) -> DataFrame:
    """doc_id, arrival, category and confidence of each arriving document; stateless."""
    low = docs.select("doc_id", "arrived", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    scores = low.select("doc_id", "arrived", *[classify.category_score(F.col("low"), c).alias(c) for c in classify.RULES])
    return scores.select("doc_id", "arrived", classify.best_category().alias("b")).select("doc_id", "arrived", "b.category", "b.confidence")


def counts_by_window(classified: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Documents by category and tumbling window of arrival; later than the watermark they are dropped, repeats counted once."""
    once = classified.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id"])
    return once.groupBy(F.window("arrived", window), "category").agg(F.count(F.lit(1)).alias("n"))


def run_once(result: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes the next run resume after it."""
    return result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
