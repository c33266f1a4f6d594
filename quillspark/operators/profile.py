"""Metadata profiling of documents: counts, structure, entities, readability, language guess and kind of document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns for dates, numbers and money, with the group that a search returns.
DATE_PATTERNS = (
    (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0),
    (r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", 0),
    (r"\b\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\b", 1),
    (r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", 1),
)
NUMBER_PATTERNS = ((r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", 0), (r"\b\d+\.\d{2}\b", 0), (r"\b\d{4,}\b", 0))
CURRENCY_FLAGS = (r"\$\d+", r"USD\s*\d+", r"€\d+", r"£\d+", r"\d+\.\d{2}\s*(USD|EUR|GBP|CAD|AUD)")
CURRENCY_PATTERNS = (
    (r"\$\d+(?:\.\d{2})?", 0),
    (r"USD\s*\d+(?:\.\d{2})?", 0),
    (r"€\d+(?:\.\d{2})?", 0),
    (r"£\d+(?:\.\d{2})?", 0),
    (r"\d+\.\d{2}\s*(?:USD|EUR|GBP|CAD|AUD)", 0),
)
# Marker substrings of the language guess; ties go to the earlier language.
LANGUAGE_MARKERS = {
    "en": "the and or but in on at to for of with by",
    "es": "el la de en y que es se no te lo por",
    "fr": "le de et à un il être et en avoir que pour",
    "de": "der die und in den von zu das mit sich des auf",
}
MIME_TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".tiff": "image/tiff", ".txt": "text/plain", ".md": "text/markdown"}
MAX_ENTITIES = 10


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot, '' if there is none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def mime_type(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), extension(name))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def paragraph_count(text: Column) -> Column:
    """Parts between blank lines that are not blank themselves."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: p.rlike(r"\S"))).cast("bigint")


def content_counts(df: DataFrame, text: str = "content") -> DataFrame:
    """Length, words, lines and paragraphs; all 0 for null and empty texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        "doc_id",
        F.length(t).cast("bigint").alias("content_length"),
        F.size(words(t)).cast("bigint").alias("word_count"),
        line_count(t).alias("line_count"),
        paragraph_count(t).alias("paragraph_count"),
    )


def any_match(text: Column, patterns) -> Column:
    """Whether one of the patterns occurs, whatever the case: one search for the alternatives."""
    return F.lower(text).rlike("|".join(p.lower() for p in patterns))


def has_headers(text: Column) -> Column:
    """A stripped non-blank line under 50 characters whose next one is longer."""
    start = F.struct(F.lit(-1).alias("before"), F.lit(False).alias("hit"))

    def step(acc: Column, line: Column) -> Column:
        n = F.length(F.trim(line))
        hit = acc["hit"] | (acc["before"].between(0, 49) & (n > acc["before"]))
        return F.when(n == 0, acc).otherwise(F.struct(n.alias("before"), hit.alias("hit")))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["hit"])


def structure_flags(df: DataFrame, text: str = "content") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        "doc_id",
        has_headers(t).alias("has_headers"),
        t.rlike(r"\d+").alias("has_numbers"),
        any_match(t, [p for p, _ in DATE_PATTERNS]).alias("has_dates"),
        any_match(t, CURRENCY_FLAGS).alias("has_currency"),
    )


def found(text: Column, patterns, fold: bool = True) -> Column:
    """Sorted distinct matches of all patterns, the first MAX_ENTITIES of them."""
    lists = [F.regexp_extract_all(text, F.lit(("(?iu)" if fold else "") + p), F.lit(g)) for p, g in patterns]
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.array(*lists)))), 1, MAX_ENTITIES)


def entities(df: DataFrame, text: str = "content") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        "doc_id",
        found(t, DATE_PATTERNS).alias("dates_found"),
        found(t, NUMBER_PATTERNS, fold=False).alias("numbers_found"),
        found(t, CURRENCY_PATTERNS).alias("currency_found"),
    )


def readability_of(words_: Column, letters: Column, marks: Column, empty: Column) -> Column:
    """readability() from counts: words, their characters in all, sentence marks, and whether the text is null or empty."""
    score = 100 - (words_ / marks) * 1.5 - F.when(words_ > 0, letters / words_).otherwise(0.0) * 5
    return F.when(empty, None).when(marks == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def readability(text: Column) -> Column:
    """clamp(100 - 1.5 words/sentences - 5 mean word length); null for null and empty, 0 without a sentence mark."""
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    marks = F.length(F.regexp_replace(text, "[^.!?]+", ""))
    return readability_of(F.regexp_count(text, F.lit(r"\S+")), letters, marks, text.isNull() | (text == ""))


def marker_count(low: Column, lang: str) -> Column:
    out = F.lit(0)
    for w in LANGUAGE_MARKERS[lang].split():
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def language_of(counts: dict[str, Column]) -> Column:
    best = F.greatest(*counts.values())
    out = F.lit("unknown")
    for lang, n in reversed(counts.items()):
        out = F.when(n == best, lang).otherwise(out)
    return F.when(best >= 3, out).otherwise("unknown")


def language_guess(text: Column) -> Column:
    """Language with most marker substrings if at least 3, else 'unknown'; null under 50 characters."""
    ranked = [F.struct(marker_count(F.lower(text), lang).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, lang in enumerate(LANGUAGE_MARKERS)]
    best = F.array_max(F.array(*ranked))
    return F.when(text.isNull() | (F.length(F.trim(text)) < 50), None).when(best["n"] >= 3, best["lang"]).otherwise("unknown")


def comprehensive(df: DataFrame) -> DataFrame:
    """All profile columns of a document; the error row (quality 'failed', counts 0) where there is no content.

    Steps are columns of a projection below, so that lower-casing, word and marker counts are computed once a text.
    """
    t = F.coalesce(F.col("content"), F.lit(""))
    base = df.select(
        "doc_id", "file_name", "file_size", "content", t.alias("t"), F.lower(t).alias("low"),
        F.regexp_count(t, F.lit(r"\S+")).alias("n_words"), F.length(F.regexp_replace(t, r"\s+", "")).alias("letters"), F.length(F.regexp_replace(t, "[^.!?]+", "")).alias("marks"),
    )
    base = base.select("*", *[marker_count(F.col("low"), lang).alias(f"m_{lang}") for lang in LANGUAGE_MARKERS])
    t, low = F.col("t"), F.col("low")

    def search(patterns) -> Column:
        return low.rlike("|".join(p.lower() for p in patterns))

    base = base.select("*", search([p for p, _ in DATE_PATTERNS]).alias("dated"), search(CURRENCY_FLAGS).alias("paid"))
    # what one search for the alternatives does not find is not searched for pattern by pattern
    money = F.col("paid") | low.rlike("|".join(p.lower() for p, _ in CURRENCY_PATTERNS))
    found_ = [F.when(some, F.array_join(found(t, p, fold), "|")).otherwise("").alias(n) for n, some, p, fold in (("dates_found", F.col("dated"), DATE_PATTERNS, True), ("numbers_found", t.rlike(r"\d"), NUMBER_PATTERNS, False), ("currency_found", money, CURRENCY_PATTERNS, True))]
    return base.select(
        "doc_id",
        "file_name",
        "file_size",
        extension(F.col("file_name")).alias("file_extension"),
        mime_type(F.col("file_name")).alias("mime_type"),
        F.length(t).cast("bigint").alias("content_length"),
        F.col("n_words").cast("bigint").alias("word_count"),
        line_count(t).alias("line_count"),
        paragraph_count(t).alias("paragraph_count"),
        has_headers(t).alias("has_headers"),
        F.col("dated").alias("has_dates"),
        F.col("paid").alias("has_currency"),
        t.rlike(r"\d").alias("has_numbers"),
        F.round(readability_of(F.col("n_words"), F.col("letters"), F.col("marks"), t == ""), 6).alias("readability_score"),
        F.when(F.length(F.trim(t)) < 50, None).otherwise(language_of({k: F.col(f"m_{k}") for k in LANGUAGE_MARKERS})).alias("language"),
        *found_,
        F.when(F.col("content").isNull(), "failed").alias("error_quality"),
    )


# Words of a file name that speak for a kind of document, in order of precedence, with their weights.
NAME_WORDS = {
    "financial": (0.4, "invoice bill statement receipt"),
    "legal": (0.5, "contract agreement terms conditions legal law clause"),
    "personal": (0.6, "personal private medical health family"),
    "technical": (0.5, "manual guide documentation spec technical api"),
}


def document_type(df: DataFrame) -> DataFrame:
    """Additive scores by kind from a comprehensive() profile; the best from 0.5 on, ties to the first."""
    name = F.lower("file_name")

    def speaks(kind: str) -> Column:
        weight, listed = NAME_WORDS[kind]
        return F.when(name.rlike("|".join(listed.split())), weight).otherwise(0.0)

    def plus(flag: Column, weight: float) -> Column:
        return F.when(flag, weight).otherwise(0.0)

    scores = {
        "financial": plus(F.col("has_currency"), 0.4) + plus(F.col("has_numbers"), 0.2) + speaks("financial"),
        "legal": speaks("legal") + plus(F.col("word_count") > 500, 0.2) + plus(F.col("has_dates"), 0.2),
        "personal": speaks("personal") + plus(F.col("file_size") < 1024 * 1024, 0.2),
        "technical": speaks("technical") + plus(F.col("word_count") > 1000, 0.2) + plus(F.col("has_headers"), 0.2),
    }
    best = F.array_max(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))
    return df.select("doc_id", F.when(best["s"] >= 0.5, best["k"]).otherwise("unknown").alias("primary_type"), best["s"].alias("confidence"))
