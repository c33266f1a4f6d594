"""Cleaning, structuring and extractive summarising of extracted text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_LENGTH = 2000
# Words that mark an important sentence.
KEY_WORDS = "date amount total invoice contract agreement summary conclusion purpose objective".split()
# What a recogniser writes for a lone character.
LONE_CHARACTERS = ((r"\bl\b", "I"), (r"\b0\b", "O"), (r"\brn\b", "m"), (r"\bvv\b", "w"))


def compose(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it, so an Arrow batch function."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string")(text)


def plain_punctuation(text: Column) -> Column:
    """Dashes to '-', ellipsis to '...', zero-width spaces removed."""
    return F.regexp_replace(F.replace(F.translate(text, "–—", "--"), F.lit("…"), F.lit("...")), "​", "")


def normalise_unicode(text: Column) -> Column:
    return plain_punctuation(compose(text))


def without_artifacts(text: Column) -> Column:
    """Page numbers and headings dropped line by line, white space collapsed, runs of 5+ equal characters cut to two.

    The line steps come before white space is collapsed, else a text that begins with a page number would vanish whole.
    """
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda x: F.trim(x)),
        lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$") & ~F.lower(x).isin("confidential", "page", "draft") & ~F.lower(x).rlike(r"^page \d+"),
    )
    out = F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", " ")), "\n"), r"(.)\1{4,}", "$1$1")
    for p, r in LONE_CHARACTERS:
        out = F.regexp_replace(out, p, r)
    return F.trim(out)


def structured(text: Column) -> Column:
    """Each paragraph on one line that ends with a mark."""

    def one(p: Column) -> Column:
        line = F.array_join(F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
        return F.when((line == "") | line.rlike("[.!?:]$"), line).otherwise(F.concat(line, F.lit(".")))

    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), one), lambda p: p != ""), "\n\n")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def sentence_score(s: Column) -> Column:
    n, low = F.length(s), F.lower(s)
    key = F.lit(0)
    for w in KEY_WORDS:
        key = key + F.contains(low, F.lit(w)).cast("int")
    capital = F.substring(s, 1, 1).rlike(r"^\p{Lu}") & (s != F.upper(s))
    return F.when(n.between(30, 200), 1.0).when((n > 200) & (n <= 400), 0.7).otherwise(0.0) + key * 0.5 + F.when(s.rlike(r"\d"), 0.3).otherwise(0.0) + F.when(capital, 0.2).otherwise(0.0)


def scored_sentences(text: Column) -> Column:
    """Sentences with score and position, best first, ties in order of the text."""
    all_of = F.transform(sentences(text), lambda s, i: F.struct((-F.round(sentence_score(s), 6)).alias("minus"), i.alias("pos"), s.alias("s")))
    return F.array_sort(all_of)


def summary(text: Column, limit: int = SUMMARY_LENGTH) -> Column:
    """Texts up to the limit as they are; else the best sentences that fit, until nine tenths are full.

    A fold with the length so far as state: a sentence that does not fit is skipped, so a running sum would be wrong.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        n = F.length(x["s"])
        fits = (acc["used"] < limit * 0.9) & (acc["used"] + n <= limit)
        return F.struct(F.when(fits, acc["used"] + n).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], x["s"])).otherwise(acc["kept"]).alias("kept"))

    chosen = F.aggregate(scored_sentences(text), start, take, lambda acc: F.array_join(acc["kept"], " "))
    return F.when(F.length(text) > limit, chosen).otherwise(text)


def enhanced(text: Column, grade: Column) -> Column:
    """Failed texts as they are, poor and fair ones cleaned and structured, long ones summarised."""
    t = F.coalesce(text, F.lit(""))
    cleaned = F.when(grade.isin("poor", "fair"), structured(without_artifacts(normalise_unicode(t)))).otherwise(t)
    return F.when(grade == "failed", t).otherwise(summary(cleaned))


def wrapped(text: Column, kind: Column, method: Column) -> Column:
    """Text for a model: a heading with the kind of file and a closing line with the method, where known."""
    head = F.when(kind != "", F.concat(F.lit("["), F.upper(kind), F.lit(" DOCUMENT]\n"))).otherwise("")
    tail = F.when(method != "", F.concat(F.lit("\n[Extracted via: "), method, F.lit("]"))).otherwise("")
    return F.concat(F.coalesce(head, F.lit("")), F.coalesce(text, F.lit("")), F.coalesce(tail, F.lit("")))


def summaries(df: DataFrame, limit: int = SUMMARY_LENGTH) -> DataFrame:
    t = F.coalesce("content", F.lit(""))
    return df.select("doc_id", F.size(sentences(t)).cast("bigint").alias("n_sentences"), summary(t, limit).alias("summary"))
