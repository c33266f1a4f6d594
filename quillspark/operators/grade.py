"""Grades of extracted text and the choice of the best attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = ("failed", "poor", "fair", "good", "excellent")


def rank(grade: Column) -> Column:
    """0 for failed up to 4 for excellent; null for other values."""
    out = F.lit(None).cast("int")
    for i, g in enumerate(GRADES):
        out = F.when(grade == g, i).otherwise(out)
    return out


def grade_of(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), position + 1)


def measures(text: Column) -> dict[str, Column]:
    """What the grades look at; null counts as empty. Counts come from one search or a difference of lengths, never from lists."""
    t = F.coalesce(text, F.lit(""))

    def occurrences(mark: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))

    return {
        "n": F.length(t),
        "stripped": F.length(F.trim(t)),
        "words": F.regexp_count(t, F.lit(r"\S+")),
        "long_words": F.regexp_count(t, F.lit(r"\S{3,}")),
        "letter_words": F.regexp_count(t, F.lit(r"(?<!\S)\p{L}{3,}(?!\S)")),
        "lines": F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")),
        "broken": occurrences("\ufffd"),
        "breaks": occurrences("\n"),
        "odd": F.length(F.regexp_replace(t, r"[\p{L}\p{N} \n\t.,!?]+", "")),
        "marks": F.length(F.regexp_replace(t, "[^.!?]+", "")),
        "stop": F.contains(t, F.lit(".")),
    }


def text_grade_of(m: dict[str, Column]) -> Column:
    n = m["n"]
    poor = sum(((m[k] > n * 0.01 if k == "broken" else m[k] > n * 0.1).cast("int") for k in ("broken", "breaks", "odd")), (m["words"] < n * 0.1).cast("int"))
    sized = n.between(50, 50000) & (m["long_words"] > 10)
    return (
        F.when((m["stripped"] < 10) | (m["words"] < 20), "failed")
        .when(poor >= 2, "poor")
        .when(poor == 1, "fair")
        .when(m["stop"] & sized, "excellent")
        .when(sized, "good")
        .otherwise("fair")
    )


def text_grade(text: Column) -> Column:
    """Grade of extracted text; null counts as empty."""
    return text_grade_of(measures(text))


def after_recognition(grade: Column) -> Column:
    """Recognised characters lower the two best grades by one."""
    return F.when(grade == "excellent", "good").when(grade == "good", "fair").otherwise(grade)


def image_grade_of(m: dict[str, Column]) -> Column:
    return F.when(m["stripped"] < 5, "failed").when(m["lines"] < 2, "poor").when(m["letter_words"] < 5, "poor").when(m["letter_words"] < 15, "fair").otherwise("good")


def image_grade(text: Column) -> Column:
    return image_grade_of(measures(text))


def promoted(text: Column, grade: Column) -> Column:
    """One grade better after enhancement, at most excellent; failed under 10 characters."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 10, "failed").otherwise(grade_of(F.least(rank(grade) + 1, F.lit(4))))


def direct_grade_of(m: dict[str, Column]) -> Column:
    n, w, marks = m["n"], m["words"], m["marks"]
    return (
        F.when(m["stripped"] < 10, "failed")
        .when((w >= 50) & (marks >= 3) & (n >= 200), "excellent")
        .when((w >= 20) & (marks >= 1) & (n >= 100), "good")
        .when((w >= 10) & (n >= 50), "fair")
        .otherwise("poor")
    )


def grades(df: DataFrame) -> DataFrame:
    """All grades of each text; the measures are columns of a projection below, computed once a text."""
    m = measures(F.col("content"))
    base = df.select("doc_id", "content", *[c.alias(f"m_{k}") for k, c in m.items()])
    m = {k: F.col(f"m_{k}") for k in m}
    graded = base.select("doc_id", "content", text_grade_of(m).alias("text_grade"), image_grade_of(m).alias("image_grade"), direct_grade_of(m).alias("direct_grade"))
    return graded.select("doc_id", "text_grade", after_recognition(F.col("text_grade")).alias("recognised_grade"), "image_grade", promoted(F.col("content"), F.col("text_grade")).alias("promoted_grade"), "direct_grade")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """(file_id, content_id, quality) of each file's best attempt by rank of quality, then the smallest content_id.

    max_by keeps one candidate a task and key, so a file with many attempts is reduced before the shuffle.
    """
    ranked = attempts.select("file_id", "content_id", "quality", F.coalesce(rank(F.col("quality")), F.lit(-1)).alias("r"))
    key = F.struct(F.col("r"), -F.col("content_id"))
    return ranked.groupBy("file_id").agg(F.max_by("content_id", key).alias("content_id"), F.max_by("quality", key).alias("quality"))
