"""The pN_ queries: each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import file_texts
from quillspark.session import load, spread


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import quality_findings

    return quality_findings(file_texts(spark, sf_dir), load(spark, sf_dir, "document_metadata"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.scans import scan_faults

    return scan_faults(file_texts(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.scans import repaired_texts

    return repaired_texts(file_texts(spark, sf_dir)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.neardup import near_duplicates

    return near_duplicates(file_texts(spark, sf_dir), load(spark, sf_dir, "document_metadata"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.neardup import near_duplicate_links

    return near_duplicate_links(file_texts(spark, sf_dir), load(spark, sf_dir, "document_metadata")).select("file_id", "links")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.language import language_findings

    return language_findings(file_texts(spark, sf_dir), load(spark, sf_dir, "document_metadata"), load(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_languages(spark, sf_dir).select("file_id", "seg_no", "lang")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import find_entities

    return find_entities(file_texts(spark, sf_dir))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import redact

    return redact(file_texts(spark, sf_dir)).distinct()


def p7_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.subjects import subject_findings

    return subject_findings(file_texts(spark, sf_dir), load(spark, sf_dir, "classification_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_subjects(spark, sf_dir).select("file_id", "subject").distinct()


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import text_stats

    ratios = ("mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share")
    return text_stats(file_texts(spark, sf_dir)).select("file_id", "words", "lines", "marks", *[F.round(c, 6).alias(c) for c in ratios]).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.tokenizer import encode_table

    return encode_table(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix

    return mix(spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source")), load(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix

    return mix(spread(load(spark, sf_dir, "documents").select("doc_id", "text", "source")), load(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.levels import reading_levels

    english = spread(load(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text"))
    return reading_levels(english, load(spark, sf_dir, "reading_samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_stats": p1_stats,
        "p3_found": p3_found,
        "p3_repaired": p3_repaired,
        "p4_found": p4_found,
        "p4_links": p4_links,
        "p5_found": p5_found,
        "p5_languages": p5_languages,
        "p6_found": p6_found,
        "p6_redacted": p6_redacted,
        "p7_found": p7_found,
        "p7_subjects": p7_subjects,
        "p8_ids": p8_ids,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
    }
