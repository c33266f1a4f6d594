"""What the text of a document says of itself: dates, amounts, structure, fiscal hints, entity groups and a short summary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.profile import CURRENCY_PATTERNS, DATE_PATTERNS, found

# Forms of dates, amounts and fiscal years in a text, in the order in which they are searched.
NUMERIC_DATE = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
YEAR_FIRST_DATE = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"
MONTH_DAY_DATE = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2},?\s+\d{4}\b"
DAY_MONTH_DATE = r"\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{4}\b"
AMOUNTS = (r"\$[\d,]+\.?\d*", r"[\d,]+\.\d{2}\s*(?:USD|dollars?)", r"amount[:\s]+\$?[\d,]+\.?\d*")
FISCAL_YEARS = (r"fy[\s-]?(\d{2,4})", r"fiscal\s+year\s+(\d{2,4})", r"(\d{4})[\s-]?(?:\d{2,4})\s+fiscal")
FISCAL_WORDS = ("fiscal year", "fy", "budget year", "financial year", "tax year")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_WORDS = {w: i + 1 for i, m in enumerate(MONTHS) for w in (m, m[:3], *(("sept",) if m == "september" else ()))}
PIVOT = 75  # two-digit years up to it are 20xx, later ones 19xx
MAX_DATES, MAX_AMOUNTS, MAX_GROUP = 10, 5, 5


def real_day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is no such day."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def part(raw: Column, pattern: str) -> Column:
    return F.regexp_extract(raw, pattern, 1).try_cast("int")


def numeric_date(raw: Column) -> Column:
    """Month first, the other order where that is no month."""
    a, b, y = part(raw, r"^(\d+)"), part(raw, r"^\d+[-/](\d+)"), part(raw, r"(\d+)$")
    digits = F.length(F.regexp_extract(raw, r"(\d+)$", 1))
    year = F.when(digits == 4, y).when((digits == 2) & (y <= PIVOT), y + 2000).when(digits == 2, y + 1900)
    return real_day(year, F.when(a <= 12, a).otherwise(b), F.when(a <= 12, b).otherwise(a))


def year_first_date(raw: Column) -> Column:
    y, m, d = part(raw, r"^(\d+)"), part(raw, r"^\d+[-/](\d+)"), part(raw, r"(\d+)$")
    return real_day(y, F.when(m <= 12, m).otherwise(d), F.when(m <= 12, d).otherwise(m))


def named_date(raw: Column) -> Column:
    """A day with the name of its month, in either order; a word that only begins like a month is none."""
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTH_WORDS.items() for x in kv]), F.lower(F.regexp_extract(raw, r"([A-Za-z]\w*)", 1)))
    day = F.when(raw.rlike(r"^\d"), part(raw, r"^(\d{1,2})\s")).otherwise(part(raw, r"\s(\d{1,2}),?\s+\d{4}$"))
    return real_day(part(raw, r"(\d{4})$"), month, day)


def dates_in(text: Column) -> Column:
    """The first MAX_DATES different days written in a text, in the order of the forms and places; impossible ones drop out."""
    forms = ((NUMERIC_DATE, numeric_date), (YEAR_FIRST_DATE, year_first_date), (MONTH_DAY_DATE, named_date), (DAY_MONTH_DATE, named_date))
    every = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), parse) for p, parse in forms])
    return F.slice(F.array_distinct(F.filter(every, lambda d: d.isNotNull())), 1, MAX_DATES)


def top_amounts(text: Column) -> Column:
    """The MAX_AMOUNTS largest amounts of money."""
    raw = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?iu)" + p), F.lit(0)) for p in AMOUNTS]))
    numbers = F.filter(F.transform(raw, lambda a: F.regexp_replace(a, "[^0-9.]", "").try_cast("double")), lambda v: v.isNotNull())
    return F.slice(F.reverse(F.array_sort(numbers)), 1, MAX_AMOUNTS)


def fiscal_year(text: Column) -> Column:
    """What the first form of a fiscal year that occurs says, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(FISCAL_YEARS):
        y = F.regexp_extract(text, "(?iu)" + p, 1)
        out = F.when(y != "", y).otherwise(out)
    return out


def extractor(df: DataFrame) -> DataFrame:
    """(doc_id, dates, years, top amounts in cents, structure flags, fiscal hints); null and empty texts give empty lists."""
    t = F.coalesce(F.col("content"), F.lit(""))
    base = df.select("doc_id", t.alias("t"), F.lower(t).alias("low"), dates_in(t).alias("dates"))
    t, low = F.col("t"), F.col("low")
    return base.select(
        "doc_id",
        F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"),
        F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("dates", lambda d: F.year(d)))), lambda y: y.cast("string")), ",").alias("detected_years"),
        F.array_join(F.transform(top_amounts(t), lambda v: (v * 100).cast("bigint").cast("string")), "|").alias("top_amounts_cents"),
        t.rlike(r"(?m)^[A-Z][A-Z\s]+$").alias("has_headers"),
        t.rlike(r"(?m)^\s*\d+\.").alias("has_numbered_items"),
        t.rlike(r"(?m)^\s*[•\-*]").alias("has_bullet_points"),
        fiscal_year(t).alias("fiscal_year_pattern"),
        F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?iu)q[1-4]\s+\d{4}"), F.lit(0)), lambda q: F.upper(q)), ",").alias("quarters"),
        F.array_join(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in FISCAL_WORDS])), ",").alias("fiscal_keywords"),
    )


def entity_groups(df: DataFrame) -> DataFrame:
    """(doc_id, dates, money, organizations, persons, locations): at most MAX_GROUP of each, sorted.

    Without a language model the last three groups stay empty, as they do where the model is missing.
    """
    t = F.coalesce(F.col("content"), F.lit(""))
    few = [F.array_join(F.slice(found(t, p), 1, MAX_GROUP), "|").alias(n) for n, p in (("dates", DATE_PATTERNS), ("money", CURRENCY_PATTERNS))]
    return df.select("doc_id", *few, *[F.lit("").alias(n) for n in ("organizations", "persons", "locations")])


def short_summary(df: DataFrame) -> DataFrame:
    """(doc_id, summary): name, first 500 characters and three entities of each kind, the text that is embedded."""
    t = F.coalesce(F.col("content"), F.lit(""))
    base = df.select("doc_id", "file_name", F.substring(t, 1, 500).alias("head"), *[F.slice(found(t, p), 1, 3).alias(n) for n, p in (("dates", DATE_PATTERNS), ("money", CURRENCY_PATTERNS))])
    kinds = [F.when(F.size(n) > 0, F.concat(F.lit(f"{n}: "), F.array_join(n, ", "))) for n in ("dates", "money")]
    return base.select("doc_id", F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.when(F.col("head") != "", F.col("head")), *kinds).alias("summary"))


def within_tokens(df: DataFrame, most: int, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """(doc_id, text, n_tokens): each text cut to the longest prefix found by bisection that has at most so many tokens.

    Texts within the limit, null and empty ones come back unchanged. The tokenizer is a public vocabulary file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(tokenizer)

        def size(text: str) -> int:
            return len(known.encode(text, add_special_tokens=False).ids)

        for b in batches:
            out, counts = [], []
            for text in b.column("text").to_pylist():
                n = size(text or "")
                if n > most:
                    low, high = 0, len(text)
                    while high - low > 1:
                        mid = (low + high) // 2
                        low, high = (mid, high) if size(text[:mid]) <= most else (low, mid)
                    text = text[:low]
                    n = size(text)
                out.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_tokens"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, text string, n_tokens bigint")


def hashed_embedding(df: DataFrame, dimensions: int = 64) -> DataFrame:
    """(doc_id, embedding): words hashed into dimensions, scaled to length 1; the stand-in where no sentence model is installed.

    Null and empty texts give the zero vector.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("words")).withColumn("words", F.filter("words", lambda w: w != ""))
    hashed = Normalizer(inputCol="raw", outputCol="unit").transform(HashingTF(numFeatures=dimensions, inputCol="words", outputCol="raw").transform(words))
    return hashed.select("doc_id", vector_to_array("unit").alias("embedding"))


def unescape(names: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no such function."""
    import html

    return names.map(lambda x: None if x is None else html.unescape(x))


def to_ascii(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; Spark has no Unicode normalisation."""
    import unicodedata

    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def typed_name(name: Column) -> Column:
    """A name typed by a user: entities resolved, dangerous and control characters out, at most 255 long, never empty."""
    s = F.regexp_replace(F.regexp_replace(F.pandas_udf(unescape, "string")(name), r'[<>:"|?*\\/]', "_"), "[\\x00-\\x1f\\x7f-\\x9f]", "")
    ext = F.regexp_extract(s, r"[^.](\.[^.]*)$", 1)
    s = F.when(F.length(s) > 255, F.concat(s.substr(F.lit(1), 255 - F.length(ext)), ext)).otherwise(s)
    return F.when(name.isNull() | (name == ""), "unnamed_file").when(F.trim(s) == "", "sanitized_filename").otherwise(s)


def plain_name(name: Column, stamp: str = "") -> Column:
    """Letters, digits and underscores of the ASCII form, at most 160; a stamped name where nothing is left."""
    s = F.regexp_replace(F.pandas_udf(to_ascii, "string")(name), "[^a-zA-Z0-9_]", "")
    return F.when(name.isNull() | ~name.rlike(r"\S"), "empty_file_" + stamp).when(s == "", "invalid_name_" + stamp).otherwise(F.substring(s, 1, 160))
