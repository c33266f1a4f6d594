"""History of sessions and corrections: metrics, trends, patterns and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions with repeated rows counted once."""
    return sessions.dropDuplicates(["session_id"])


def session_categories(sessions: DataFrame) -> DataFrame:
    """(session_id, category): one row for each category a session created."""
    return session_rows(sessions).select("session_id", F.explode("categories_created").alias("category")).distinct()


def recent_average(sessions: DataFrame, days: int = 30, default: float = 0.5) -> DataFrame:
    """Mean quality of the sessions in the days up to the last one; the default where there are none."""
    last = sessions.agg(F.max("session_time").alias("last"))
    near = session_rows(sessions).crossJoin(F.broadcast(last)).filter(F.col("session_time") >= F.col("last") - F.expr(f"INTERVAL {days} DAYS"))  # one row
    return near.agg(F.round(F.coalesce(F.avg("quality_score"), F.lit(default)), 6).alias("recent_quality"), F.count(F.lit(1)).alias("sessions"))


def learning_metrics(sessions: DataFrame, corrections: DataFrame, recent: int = 10, before: int = 20) -> DataFrame:
    """One row: sessions, mean quality, trend of the latest against those before, corrections.

    The latest rows come from an ordered limit, which keeps recent + before rows a task, not from a window over all rows.
    """
    s = session_rows(sessions)
    latest = s.select("session_id", "session_time", "quality_score").orderBy(F.desc("session_time"), "session_id").limit(recent + before)
    ranked = latest.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("session_time"), "session_id")))  # at most recent + before rows
    trend = ranked.agg((F.avg(F.when(F.col("r") <= recent, F.col("quality_score"))) - F.avg(F.when(F.col("r") > recent, F.col("quality_score")))).alias("t"))
    whole = s.agg(F.count(F.lit(1)).alias("total_sessions"), F.avg("quality_score").alias("a"))
    fixes = corrections.agg(F.count_distinct("correction_id").alias("user_corrections"))
    return whole.crossJoin(trend).crossJoin(fixes).select("total_sessions", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("average_quality_score"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("improvement_trend"), "user_corrections")  # one row each


def paged(sessions: DataFrame, limit: int, offset: int) -> DataFrame:
    return session_rows(sessions).select("session_id", "session_time", "quality_score").orderBy(F.desc("session_time"), "session_id").offset(offset).limit(limit)


def successful_patterns(results: DataFrame, least: float = 0.8) -> DataFrame:
    """(method, category, files) of classifications at or above a confidence."""
    return results.filter(F.col("confidence") >= least).groupBy("method", "category").agg(F.count_distinct("file_id").alias("files"), F.round(F.max("confidence"), 6).alias("best"))


def top_patterns(results: DataFrame, k: int = 100) -> DataFrame:
    """The k surest results of each method: a top-k per group.

    Ranking happens among each task's own k best first, so a method that holds most rows is never sorted in one task.
    """
    order = [F.desc("confidence"), F.desc("classified_at"), "result_id"]
    rows = results.dropDuplicates(["result_id"]).select("method", "result_id", "file_id", "confidence", "classified_at").filter("confidence is not null")
    part = rows.withColumn("salt", F.pmod(F.xxhash64("result_id"), F.lit(64)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("method", "salt").orderBy(*order))).filter(F.col("r") <= k)
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("method").orderBy(*order))).filter(F.col("r") <= k)
    return last.select("method", "result_id", "file_id", "confidence", F.col("r").cast("bigint").alias("position"))


def correction_flow(corrections: DataFrame) -> DataFrame:
    """(from_category, to_category, n) of distinct corrections; null names are kept as 'none'."""
    c = corrections.dropDuplicates(["correction_id"])
    return c.groupBy(F.coalesce("from_category", F.lit("none")).alias("from_category"), F.coalesce("to_category", F.lit("none")).alias("to_category")).agg(F.count(F.lit(1)).alias("n"))


def correction_keywords(corrections: DataFrame) -> DataFrame:
    """Traits of corrected file names: words over two letters, a digit, a date."""
    name = F.lower("file_name")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit("[a-z]{3,}"), F.lit(0))))
    return corrections.dropDuplicates(["correction_id"]).select("correction_id", F.array_join(words, ",").alias("keywords"), name.rlike(r"\d").alias("has_digit"), name.rlike(r"\d{4}[-_]\d{2}").alias("has_date"))


def reorganise(sessions: DataFrame, margin: float = 0.15) -> DataFrame:
    """Whether each structure's mean quality beats the one over all sessions by the margin."""
    s = session_rows(sessions)
    whole = s.agg(F.avg("quality_score").alias("overall"))
    per = s.groupBy("structure_type").agg(F.count(F.lit(1)).alias("n"), F.avg("quality_score").alias("mean"))
    both = per.crossJoin(F.broadcast(whole))  # one row
    gain = (F.col("mean") - F.col("overall")) / F.col("overall")
    return both.select("structure_type", "n", F.round(gain, 6).alias("gain"), F.coalesce(gain >= margin, F.lit(False)).alias("recommended"))


def learned_patterns(corrections: DataFrame) -> DataFrame:
    """(pattern_type, category, n): corrections strengthen the category they lead to and weaken the one they leave.

    Repeated rows of a correction count once, null categories not at all.
    """
    c = corrections.dropDuplicates(["correction_id"])
    both = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pattern_type"), F.col(v).alias("category")) for k, v in (("category_strengthening", "to_category"), ("category_weakening", "from_category"))])).alias("p")).select("p.*")
    return both.filter("category is not null").groupBy("pattern_type", "category").agg(F.count(F.lit(1)).alias("n"))


def pattern_success(results: DataFrame, corrections: DataFrame, least: float = 0.8, kept: int = 100) -> DataFrame:
    """(outcome, pattern_type, n): how many patterns of each type succeed or fail; of sure results at most the kept ones count."""
    sure = results.filter(F.col("confidence") >= least).agg(F.least(F.count_distinct("result_id"), F.lit(kept)).alias("n")).select(F.lit("successful").alias("outcome"), F.lit("high_confidence_rules").alias("pattern_type"), F.col("n").cast("bigint").alias("n"))
    weak = learned_patterns(corrections).filter("pattern_type = 'category_weakening'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("failed").alias("outcome"), F.lit("category_weakening").alias("pattern_type"), "n")
    wrong = results.filter("category is null").agg(F.count_distinct("result_id").alias("n")).select(F.lit("failed").alias("outcome"), F.lit("failed_classifications").alias("pattern_type"), "n")
    return sure.unionByName(weak).unionByName(wrong)


# The tables of the history and their columns.
HISTORY_TABLES = {
    "organization_history": "session_id string, session_time timestamp, documents_processed bigint, success_rate double, structure_type string, quality_score double, metadata string",
    "category_history": "session_id string, category string, document_count bigint, average_confidence double",
    "user_corrections": "file_name string, from_category string, to_category string, session_id string, correction_time timestamp",
}


def ensure_history(spark: SparkSession, folder: str) -> DataFrame:
    """(table, position, column, type) of the history tables under a folder, made where they are missing; safe to repeat."""
    for name, columns in HISTORY_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{folder.rstrip('/')}/{name}'")
    rows = [(name, i, c.split()[0], c.split()[1]) for name in HISTORY_TABLES for i, c in enumerate(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(name).schema)]
    return spark.createDataFrame(rows, "table string, position bigint, column string, type string")
