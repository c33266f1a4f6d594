"""The queries of the document operators, by the operator's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import corpus
from quillspark.operators import classify, clean, grade, history, planning, profile, security, temporal, vectors
from quillspark.session import load
from quillspark.sources import files as source

Query = Callable[[SparkSession, str], DataFrame]


def text():
    return F.coalesce(F.col("content"), F.lit(""))


def joined(column, separator: str = "|"):
    return F.array_join(column, separator)


def on_corpus(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: build(corpus(spark, d))


def results(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "classification_results").dropDuplicates(["result_id"])


def files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_metadata").dropDuplicates(["file_id"])


def dated(spark: SparkSession, d: str) -> DataFrame:
    """(category, dt) of every classified file, the category without case and outer blanks."""
    r = results(spark, d).select("file_id", F.lower(F.trim("category")).alias("category"))
    return r.join(files(spark, d).select("file_id", F.to_date("modification_date").alias("dt")), "file_id").select("category", "dt")


def entities(c: DataFrame) -> DataFrame:
    e = profile.entities(c)
    return e.select("doc_id", *[joined(F.col(k)).alias(k) for k in ("dates_found", "numbers_found", "currency_found")])


def type_of(c: DataFrame) -> DataFrame:
    return profile.document_type(profile.comprehensive(c))


def display(c: DataFrame) -> DataFrame:
    p = profile.comprehensive(c)
    return p.select("doc_id", "file_name", F.round(F.col("content_length") / 1024, 6).alias("size_kb"), "word_count", F.coalesce("language", F.lit("unknown")).alias("language"), (F.col("has_dates") | F.col("has_currency") | F.col("has_numbers")).alias("has_important_data"))


def cleaned(c: DataFrame) -> DataFrame:
    return c.select("doc_id", clean.without_artifacts(text()).alias("cleaned"))


def enhanced(c: DataFrame) -> DataFrame:
    g = c.withColumn("grade", grade.text_grade(F.col("content")))
    return g.select("doc_id", "grade", clean.enhanced(F.col("content"), F.col("grade")).alias("enhanced"))


def sentence_scores(c: DataFrame) -> DataFrame:
    s = c.select("doc_id", F.explode(clean.scored_sentences(text())).alias("x"))
    return s.select("doc_id", F.col("x.pos").cast("bigint").alias("pos"), F.round(-F.col("x.minus"), 6).alias("score"))


def factor_input(c: DataFrame) -> DataFrame:
    k = classify.classified(c, ("content", "file_name"))
    dated, paid = (profile.any_match(text(), [p for p, *_ in found]) for found in (profile.DATE_PATTERNS, profile.CURRENCY_PATTERNS))
    return k.select("doc_id", "content", "file_name", "confidence", dated.alias("has_dates"), text().rlike(r"\$[\d,]+\.?\d*").alias("has_amounts"), (dated | paid).alias("has_entities"))


def uncertain(c: DataFrame) -> DataFrame:
    return classify.uncertainty(classify.factors(factor_input(c)))


def uncertain_rows(c: DataFrame) -> DataFrame:
    names = ["confidence", *classify.FACTOR_WEIGHTS, "uncertainty_score"]
    return uncertain(c).select("doc_id", *[F.round(n, 6).alias(n) for n in names], "certain")


def structs(c: DataFrame, build) -> DataFrame:
    return c.select("doc_id", build(F.col("content")).alias("r")).select("doc_id", "r.status", F.md5(F.coalesce("r.text", F.lit("-"))).alias("digest"))


def moves(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("file_id", "file_name", F.coalesce("file_extension", F.lit("none")).alias("file_extension"))
    return planning.without_collisions(f.select("file_id", F.concat(F.lit("by_type/"), F.regexp_replace("file_extension", r"\.", "")).alias("folder"), F.col("file_name").alias("name")))


def known_categories(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "subject_areas").select(F.col("subject").alias("category"))


def queries() -> dict[str, Query]:
    return {
        "T01_file_metadata": on_corpus(lambda c: c.select("doc_id", "file_name", "file_size", F.to_date("modified").alias("modified"), profile.extension(F.col("file_name")).alias("file_extension"), profile.mime_type(F.col("file_name")).alias("mime_type"))),
        "T02_content_counts": on_corpus(profile.content_counts),
        "T03_T04_structure_flags": on_corpus(profile.structure_flags),
        "T05_L01_U03_entities": on_corpus(entities),
        "T06_readability": on_corpus(lambda c: c.select("doc_id", F.round(profile.readability(F.col("content")), 6).alias("readability_score"))),
        "T07_L09_language_guess": on_corpus(lambda c: c.select("doc_id", profile.language_guess(F.col("content")).alias("language"))),
        "T08_comprehensive": on_corpus(profile.comprehensive),
        "T10_document_type": on_corpus(type_of),
        "T11_document_summary": on_corpus(display),
        "T12_T13_T14_T24_T25_grades": on_corpus(grade.grades),
        "T15_best_attempt": lambda s, d: grade.best_attempt(load(s, d, "extracted_content").dropDuplicates(["content_id"])),
        "T16_normalise_unicode": lambda s, d: load(s, d, "documents").select("doc_id", F.md5(clean.normalise_unicode(F.coalesce("text", F.lit("")))).alias("digest")),
        "T17_without_artifacts": on_corpus(cleaned),
        "T18_structured": on_corpus(lambda c: c.select("doc_id", clean.structured(text()).alias("structured"))),
        "T19_T20_L05_sentence_scores": on_corpus(sentence_scores),
        "T21_T22_W08_summary": on_corpus(clean.summaries),
        "T23_enhanced": on_corpus(enhanced),
        "T26_model_wrapper": on_corpus(lambda c: c.select("doc_id", clean.wrapped(F.col("content"), F.replace(profile.extension(F.col("file_name")), F.lit("."), F.lit("")), F.lit("text_file")).alias("wrapped"))),
        "T28_chosen_name": on_corpus(lambda c: c.select("doc_id", security.chosen_name(F.col("file_name")).alias("name"))),
        "T30_safe_name": on_corpus(lambda c: c.select("doc_id", security.safe_name(F.col("file_name")).alias("name"))),
        "T32_U06_checked_name": on_corpus(lambda c: c.select("doc_id", security.checked_name(F.col("file_name")).alias("name"))),
        "T33_model_input": on_corpus(lambda c: structs(c, security.model_input)),
        "T34_script_check": on_corpus(lambda c: structs(c, security.script_check)),
        "T35_without_dangers": on_corpus(lambda c: c.select("doc_id", security.without_dangers(F.col("content")).alias("content"))),
        "T36_S25_clean_log": on_corpus(lambda c: c.select("doc_id", security.clean_log(F.col("content")).alias("line")).select("doc_id", "line")),
        "S25_log_statistics": on_corpus(lambda c: c.select(F.col("content").alias("old"), security.clean_log(F.col("content")).alias("new")).agg(F.count("old").alias("lines"), F.count_if(F.col("old") != F.col("new")).alias("changed"))),
        "T43_broad_category": on_corpus(lambda c: c.select("doc_id", classify.broad_category(F.col("content")).alias("category"))),
        "T54_path_verdict": on_corpus(lambda c: c.select("doc_id", security.path_verdict(F.col("file_name")).alias("verdict"))),
        "T56_S10_threats": on_corpus(security.threats),
        "C01_C02_rule_scores": on_corpus(lambda c: classify.rule_scores(c).select("doc_id", *[F.round(k, 9).alias(k) for k in classify.RULES])),
        "C04_C06_C07_classified": on_corpus(lambda c: classify.classified(c).withColumn("confidence", F.round("confidence", 9))),
        "C08_C09_C10_C11_refined": on_corpus(lambda c: classify.refined(c).withColumn("confidence", F.round("confidence", 9))),
        "C14_C15_C16_uncertainty": on_corpus(uncertain_rows),
        "G18_uncertainty_summary": on_corpus(lambda c: classify.uncertainty_summary(uncertain(c)).select("factor", F.round("avg_score", 6).alias("avg_score"), F.round("max_score", 6).alias("max_score"), "documents_affected")),
        "G19_threshold_sweep": on_corpus(lambda c: classify.threshold_sweep(classify.classified(c))),
        "G03_G04_quality": lambda s, d: classify.quality(results(s, d).select(F.coalesce("category", F.lit("none")).alias("category"), "confidence", "method")),
        "G02_G05_G07_methods": lambda s, d: results(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("medium")),
        "G01_processing_summary": lambda s, d: planning.processing_summary(load(s, d, "extracted_content").dropDuplicates(["content_id"])),
        "G09_X01_distribution": lambda s, d: temporal.distribution(dated(s, d)),
        "G10_L07_X05_peaks": lambda s, d: temporal.peaks(dated(s, d)),
        "G11_X06_seasonal": lambda s, d: temporal.seasonal(dated(s, d)),
        "G12_overall_season": lambda s, d: temporal.overall_season(dated(s, d)),
        "G13_G14_fiscal_inference": lambda s, d: temporal.fiscal_inference(dated(s, d)),
        "G15_X02_X03_fiscal_structure": lambda s, d: temporal.fiscal_structure(dated(s, d), "financial"),
        "G17_W03_cycles": lambda s, d: temporal.cycles(dated(s, d), ("finance", "law", "sport", "money & tax")),
        "W01_density": lambda s, d: temporal.density(dated(s, d)),
        "W02_workflows": lambda s, d: temporal.workflows(dated(s, d)),
        "X04_X08_span": lambda s, d: temporal.span(dated(s, d)).select("earliest", "latest", "n", "span_days", F.round("span_years", 6).alias("span_years"), "time_granularity"),
        "G20_recent_average": lambda s, d: history.recent_average(load(s, d, "organization_sessions")),
        "G21_W04_learning_metrics": lambda s, d: history.learning_metrics(load(s, d, "organization_sessions"), load(s, d, "user_corrections")),
        "G23_successful_patterns": lambda s, d: history.successful_patterns(results(s, d)),
        "L06_top_patterns": lambda s, d: history.top_patterns(results(s, d)),
        "L10_paged_sessions": lambda s, d: history.paged(load(s, d, "organization_sessions"), 10, 5),
        "S12_J11_session_categories": lambda s, d: history.session_categories(load(s, d, "organization_sessions")),
        "S14_correction_flow": lambda s, d: history.correction_flow(load(s, d, "user_corrections")),
        "T44_correction_keywords": lambda s, d: history.correction_keywords(load(s, d, "user_corrections")),
        "P07_reorganise": lambda s, d: history.reorganise(load(s, d, "organization_sessions")),
        "J01_matched_paths": lambda s, d: planning.matched_paths(results(s, d), files(s, d)),
        "J02_T09_with_default": lambda s, d: planning.with_default(files(s, d), load(s, d, "extracted_content")),
        "J03_J04_overridden": lambda s, d: planning.overridden(results(s, d).select("file_id", "category").groupBy("file_id").agg(F.max("category").alias("category")), results(s, d).filter("confidence >= 0.8").groupBy("file_id").agg(F.upper(F.max("category")).alias("category"))),
        "J05_S15_unprocessed": lambda s, d: planning.unprocessed(files(s, d).select("file_id"), load(s, d, "extracted_content").filter(F.col("text").rlike(r"\S"))),
        "J06_U01_new_categories": lambda s, d: planning.new_categories(results(s, d), known_categories(s, d)),
        "W05_collisions": moves,
        "W07_last_write": lambda s, d: planning.latest(load(s, d, "extracted_content").select("content_id", "ingested_at", "quality"), "content_id", "ingested_at", "quality"),
        "K07_G08_preview": lambda s, d: planning.preview(results(s, d)),
        "K03_G24_structure": lambda s, d: planning.structure(results(s, d)),
        "T55_K06_folder_checks": lambda s, d: planning.folder_checks(corpus(s, d).select(F.col("file_name").alias("name")).distinct()),
        "S23_S24_folder_statistics": lambda s, d: planning.folder_statistics(files(s, d)),
        "G25_U05_distinct_categories": lambda s, d: results(s, d).select(F.lower(F.trim("category")).alias("category")).filter("category is not null").distinct(),
        "G31_centroids": lambda s, d: vectors.centroids(load(s, d, "embeddings"), "label").select("label", F.col("i").cast("bigint").alias("i"), F.round("mean", 6).alias("mean")),
        "M04_M05_J10_nearest_reference": lambda s, d: vectors.nearest_reference(load(s, d, "embeddings"), "label"),
        "P01_file_validity": lambda s, d: files(s, d).select("file_id", F.coalesce((F.col("file_size") > 0) & (F.col("file_size") <= source.MAX_BYTES) & F.lower("file_extension").isin(*source.SUFFIXES), F.lit(False)).alias("valid")),
        "P02_scanned": lambda s, d: files(s, d).select("file_id", (F.coalesce("content_length", F.lit(0)) < F.coalesce("paragraph_count", F.lit(1)) * source.CHARS_PER_PAGE).alias("scanned")),
        "X10_time_fallback": lambda s, d: files(s, d).select("file_id", F.concat(F.lit("documents_"), F.coalesce(F.year("modification_date").cast("string"), F.lit("undated"))).alias("category"), F.lit(0.9).alias("confidence")),
        "M07_reference_categories": lambda s, d: results(s, d).filter("confidence >= 0.7 and category is not null").groupBy("category").agg(F.count_distinct("file_id").alias("files")),
        "U02_U04_merged_categories": lambda s, d: results(s, d).select("category").unionByName(load(s, d, "user_corrections").select(F.col("to_category").alias("category"))).unionByName(known_categories(s, d)).filter("category is not null").distinct(),
        "G06_method_share": lambda s, d: results(s, d).agg(F.count_if(F.col("method") == "ml_enhanced").alias("enhanced"), F.round(F.avg((F.col("method") == "ml_enhanced").cast("double")), 6).alias("rate")),
        "T37_clean_settings": on_corpus(lambda c: c.select("doc_id", security.clean_settings(F.create_map(F.lit("MY_API_KEY"), "file_name", F.lit("home"), F.col("template").cast("string"))).alias("m")).select("doc_id", F.element_at("m", "MY_API_KEY").alias("key"), F.element_at("m", "home").alias("home"))),
        "T42_token_allowance": on_corpus(lambda c: c.select("doc_id", F.greatest(F.ceil(F.ceil(F.length(text()) / 2.7) * 1.3), F.lit(20)).cast("bigint").alias("tokens"))),
        "S09_placeholder": on_corpus(lambda c: c.select("doc_id", source.placeholder(F.col("file_name"), F.length(text())).alias("text"))),
        "C13_fallback": on_corpus(lambda c: c.select("doc_id", F.when(F.col("content").isNull(), "uncategorized").alias("category"), F.when(F.col("content").isNull(), 0.1).alias("confidence"))),
        "M02_M03_clusters": lambda s, d: vectors.clusters(load(s, d, "embeddings")),
    }
