"""The queries of extraction, settings, failures, planning and advice, by the operator's name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.corpus import corpus
from quillspark.operators import classify, clean, extract, failures, grade, history, planning, profile, security, settings, temporal, vectors
from quillspark.plans.reference import Query, dated, files, on_corpus, results
from quillspark.session import load, shared_dir
from quillspark.sources import files as source

# Messages that occur where files are read, by the number of a rendered row.
MESSAGES = (
    "[Errno 13] Permission denied: x", "The file is being used by another process", "OneDrive sync pending", "Connection reset", "Unsupported image", "No module named fitz",
    "Invalid config value", "No documents given", "Clustering gave up", "Cannot create folder", "HTTP 503 Service Unavailable", "rate limit reached", "something else",
)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, message, attempt): a message an order, null for some."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    text = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("doc_id") % len(MESSAGES) + 1).cast("int"))
    return o.select("doc_id", F.when(F.col("doc_id") % 17 != 0, text).alias("message"), (F.col("doc_id") % 9 + 1).alias("attempt"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with repeated rows counted once."""
    return load(spark, d, "extracted_content").select("file_id", "content_id", "text", "error_message", "quality", "extraction_method", "file_type").dropDuplicates(["content_id"])


def layers(spark: SparkSession, d: str) -> DataFrame:
    """(name, cli, env, file, default): a setting a customer, each layer set for some."""
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(
        F.concat(F.lit("setting_"), k.cast("string"), F.when(k % 11 == 0, "_api_key").otherwise("")).alias("name"),
        F.when(k % 5 == 0, F.col("c_mktsegment")).alias("cli"), F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("Yes")).alias("env"),
        F.when(k % 2 == 0, F.col("c_name")).alias("file"), F.when(k % 7 != 0, F.lit("off")).alias("default"),
    )


def resolved_layers(spark: SparkSession, d: str) -> DataFrame:
    r = settings.resolved(layers(spark, d))
    return r.select("name", "value", "origin", settings.flag(F.col("value"), F.lit(True)).alias("flag"))


def preferences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = load(spark, d, "part").select(k, (k % 13 / 10.0).alias("ml_threshold"), F.when(k % 4 != 0, k % 70).alias("max_categories"), (1.2 - k % 15 / 10.0).alias("quality_threshold"), F.when(k % 3 == 0, "time_first").when(k % 3 == 1, "by_mood").alias("structure_type"))
    return p.select("p_partkey", settings.preference_errors(p).alias("errors"))


def configurations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = load(spark, d, "part").select(k, F.when(k % 6 != 0, F.col("p_name")).alias("input_dir"), F.when(k % 5 != 0, F.lit("out")).otherwise(" ").alias("output_dir"), F.when(k % 7 != 0, F.lit("openai")).alias("provider"), F.when(k % 3 != 0, F.lit("key")).alias("api_key"), (k % 5).alias("ml_level"), F.when(k % 8 != 0, F.lit("eng")).otherwise("").alias("ocr_language"))
    return c.select("p_partkey", settings.configuration_errors(k % 4 != 0).alias("errors"))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a = load(spark, d, "part").select(
        k, (k % 2 == 0).alias("organize"), (k % 3 == 0).alias("no_organize"), (k % 5 < 2).alias("quiet"), (k % 7 < 2).alias("verbose"), F.when(k % 4 != 0, "process").otherwise("list").alias("command"),
        F.when(k % 2 == 1, F.lit("k")).alias("api_key"), (k % 6 == 0).alias("enable"), (k % 9 == 0).alias("disable"), F.when(k % 10 < 5, k % 4).alias("dependency_parts"),
    )
    return a.select("p_partkey", settings.argument_conflicts().alias("errors"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    level = settings.nearest_level((k % 5).cast("int"), {1: k % 2 == 0, 2: k % 3 == 0, 3: k % 7 != 0})
    return load(spark, d, "part").select("p_partkey", level.cast("bigint").alias("level"))


def model_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 4 == 0, "big-model").when(k % 4 == 1, "model").when(k % 4 == 2, "known-name").otherwise("other-model:tag"), F.when(k % 5 == 0, "-latest").when(k % 5 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit("b"))).when(k % 5 == 2, "-instruct").otherwise(""))
    p = load(spark, d, "part").select("p_partkey", name.alias("n"))
    served = settings.served_name(F.col("n"), {"known-name": "served/known"})
    return p.select("p_partkey", served.alias("served"), settings.internal_name(served).alias("internal"))


def keys_found(c: DataFrame) -> DataFrame:
    """The first thing in a text that looks like a key, with its family, what is wrong with it, and how it may be shown."""
    key = F.regexp_extract(F.coalesce("content", F.lit("")), r"(sk-[A-Za-z0-9_-]+|AIza[A-Za-z0-9_-]+|token|[a-z]{8,})", 1)
    k = c.select("doc_id", key.alias("k"))
    return k.select("doc_id", settings.key_family(F.col("k")).alias("family"), settings.key_verdict(F.col("k")).alias("verdict"), settings.masked_key(F.col("k")).alias("shown"))


def provider_filter(c: DataFrame) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    unsafe = F.lower(text).rlike("ignore previous|forget all|system:|assistant:")
    return c.select("doc_id", F.md5(F.when(unsafe, "[Content contains potentially unsafe patterns - using safe fallback]").otherwise(text)).alias("digest"))


def typed_names(c: DataFrame) -> DataFrame:
    name = F.when(F.col("template") != 7, F.concat(F.lit("R&amp;D &lt;"), "file_name"))
    return c.select("doc_id", extract.typed_name(name).alias("name"))


def retry_rows(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    said = F.replace(F.replace("error_message", F.lit("time limit"), F.lit("timeout")), F.lit("file is locked"), F.lit("file locked"))
    return failures.retry_statistics(a.select("file_id", "content_id", said.alias("message"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("success")))


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    """Rendered Python sources, some of them broken."""
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, F.lit("x = Console()\n")).when(k % 3 == 1, F.lit("import rich\ny = rich.Console(width=1)\nprint('Console()')\n")).otherwise("def f(:\n")
    return load(spark, d, "customer").select(F.concat(F.lit("src/"), k.cast("string"), F.lit(".py")).alias("path"), F.repeat(line, (k % 4).cast("int")).alias("source"))


def planned(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "subject_areas").select(F.col("subject").alias("category"))
    return planning.operations(results(spark, d), "organized", known)


def checked_operations(spark: SparkSession, d: str) -> DataFrame:
    """Planned moves with their error: files that are not listed with a size cannot be moved."""
    p = planned(spark, d)
    there = files(spark, d).filter("file_size > 0 and modification_date is not null").select(F.col("file_path").alias("source"), F.lit(True).alias("source_exists")).distinct()
    both = p.join(there, "source", "left").withColumn("type", F.when(F.col("category") == "other", "shred").otherwise(F.col("type")))
    return both.select("type", "source", "target", planning.operation_error().alias("error"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    """(name): the folders a listing shows, with those of the recorded categories."""
    listed = files(spark, d).select(F.explode(F.split("file_path", "/")).alias("name")).filter("name not like '%.%'")
    return listed.unionByName(load(spark, d, "organization_sessions").select(F.explode("categories_created").alias("name"))).distinct()


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "tiny", 100, 2_000), (2, "small", 1_500, 20_000), (3, "medium", 20_001, 200_000), (4, "large", 250_000, 2_000_000)], "ord int, name string, low bigint, high bigint")


def dated_with_quality(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select("file_id", "confidence")
    return files(spark, d).select("file_id", F.to_date("modification_date").alias("dt")).join(r, "file_id").select("dt", F.col("confidence").alias("quality"))


def fiscal_hints(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    hints = c.select(extract.fiscal_year(F.coalesce("content", F.lit(""))).alias("hint")).filter("hint is not null")
    return temporal.fiscal_inference(c.select(F.lit("all").alias("category"), F.to_date("modified").alias("dt")), hints)


def profiled_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the profile of its text, of empty content where it has none."""
    text = attempts(spark, d).filter(F.col("text").rlike(r"\S")).groupBy("file_id").agg(F.max("text").alias("content"))
    f = files(spark, d).select("file_id", "file_name", "file_size").join(text, "file_id", "left")
    return profile.comprehensive(f.withColumnRenamed("file_id", "doc_id").withColumn("content", F.coalesce("content", F.lit("")))).withColumnRenamed("doc_id", "file_id")


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole way of an attempt: grade, enhancement, model-ready text, and whether it is ready."""
    a = attempts(spark, d).withColumn("grade", F.when(F.col("text").rlike(r"\S"), grade.text_grade(F.col("text"))).otherwise("failed"))
    ready = a.select("content_id", "file_id", "grade", F.col("extraction_method").isin("ocr", "ocr_extraction").alias("recognised"), F.when(F.col("grade") != "failed", clean.enhanced(F.col("text"), F.col("grade"))).otherwise("").alias("ai_content"))
    n = F.length(F.trim("ai_content"))
    return ready.select("content_id", "file_id", "grade", (F.col("grade") != "failed").alias("success"), F.coalesce(n > F.when(F.col("recognised"), 5).otherwise(10), F.lit(False)).alias("ready_for_ai"), F.md5("ai_content").alias("digest"))


def chosen(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return source.chosen_attempts(a.select("file_id", "content_id", "extraction_method", "quality", F.length(F.trim("text")).alias("chars"), F.lit(1).alias("pages")))


def refiner_results(spark: SparkSession, d: str) -> DataFrame:
    base = results(spark, d).groupBy(F.col("file_id").alias("doc_id")).agg(F.max(F.struct("confidence", "category")).alias("r")).select("doc_id", "r.category", "r.confidence")
    fixes = load(spark, d, "user_corrections").filter("to_category is not null").dropDuplicates(["correction_id"])
    named = files(spark, d).groupBy("file_name").agg(F.min("file_id").alias("doc_id"))
    return classify.disambiguated(base, fixes.join(named, "file_name").select("doc_id", F.col("to_category").alias("category"), F.lit(1.0).alias("confidence")))


def own_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def appended_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session rows written in two appends; a session delivered twice is written once."""
    s = history.session_rows(load(spark, d, "organization_sessions")).select("session_id", "documents_processed", "structure_type")
    early = F.col("documents_processed") < 60
    return source.append_and_read([s.filter(early), s.filter(~early)], own_path(spark, "sessions"))


def rendered_folder(spark: SparkSession, d: str) -> str:
    """A folder of one small file a nation, some hidden, some of kinds that are not processed, some in a folder below."""
    folder = own_path(spark, "intake")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in load(spark, d, "nation").select("n_nationkey", F.repeat(F.concat("n_name", F.lit(" is one of many nations. ")), F.col("n_nationkey").cast("int")).alias("text")).collect():  # 25 rows by nature
        name = ("sub/{}.txt", "{}.MD", "{}.gif", ".{}.txt", "{}.exe")[r.n_nationkey % 5].format(r.n_nationkey)
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.write(bytearray(r.text.encode()))
        out.close()
    return folder


def discovered(spark: SparkSession, d: str) -> DataFrame:
    """(name, length) of the files of a folder that are processed, on its first level."""
    found = source.valid(source.discover(spark, rendered_folder(spark, d), recursive=False))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """What the readers make of a folder and the folders below it."""
    out = source.extract(source.discover(spark, rendered_folder(spark, d)))
    return out.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "file_type", "text", "extraction_method", "quality")


def moved(spark: SparkSession, d: str) -> DataFrame:
    """(name, copies, contents): the files of a local folder after they were moved to two names each, without overwriting."""
    folder = own_path(spark, "moves").removeprefix("file:")
    if "://" in folder:
        raise ValueError("files are moved on disks, and the shared folder is none")
    rows = load(spark, d, "nation").select("n_nationkey").collect()  # 25 rows by nature
    for r in rows:
        source.write_atomically(f"{folder}/from/{r.n_nationkey}.txt", str(r.n_nationkey))
    plan = spark.createDataFrame([("move", f"{folder}/from/{r.n_nationkey}.txt", f"{folder}/to/{r.n_nationkey % 7}.txt") for r in rows] + [("move", f"{folder}/from/none", f"{folder}/to/none")], "type string, source string, target string")
    done = source.run_operations(plan)
    kept = done.filter("error is null").select(F.regexp_extract("target", "([^/_]*?)(_[0-9]+)?[.]txt$", 1).alias("name"), F.regexp_extract("source", "([0-9]+)[.]txt$", 1).cast("int").alias("c"), "target")
    return kept.groupBy("name").agg(F.count_distinct("target").alias("copies"), F.sum("c").alias("contents"))


def queries() -> dict[str, Query]:
    return {
        "T46_T47_T48_T49_L03_L04_W06_X07_extractor": on_corpus(extract.extractor),
        "T45_L02_entity_groups": on_corpus(extract.entity_groups),
        "T50_short_summary": on_corpus(extract.short_summary),
        "T41_within_tokens": lambda s, d: extract.within_tokens(load(s, d, "documents").select("doc_id", "text"), 100).select("doc_id", F.length("text").cast("bigint").alias("chars"), "n_tokens"),
        "T29_plain_name": lambda s, d: files(s, d).select("file_id", extract.plain_name(F.regexp_replace("file_name", "e", "é"), "0").alias("name")),
        "T31_typed_name": on_corpus(typed_names),
        "T38_provider_filter": on_corpus(provider_filter),
        "T39_T40_keys": on_corpus(keys_found),
        "T51_model_names": model_names,
        "T52_error_classes": lambda s, d: messages(s, d).select("doc_id", failures.error_class(F.col("message")).alias("c")).select("doc_id", "c.error_type", "c.wait_seconds", "c.retry"),
        "T53_retries": lambda s, d: messages(s, d).select("doc_id", failures.worth_a_retry(F.col("message")).alias("retry"), failures.retry_delay(F.col("attempt"), most=50.0).alias("delay")),
        "T09_profiled_files": profiled_files,
        "T27_pipeline": pipeline,
        "S05_S06_S07_chosen_reader": chosen,
        "S01_S02_discovered": discovered,
        "S01_S03_S04_extracted": extracted,
        "S21_S22_moved": moved,
        "S08_base64": lambda s, d: load(s, d, "documents").select("doc_id", source.one_line_base64(F.encode("text", "UTF-8")).alias("image_data")),
        "S26_old_files": lambda s, d: source.older_than(files(s, d).filter("file_name like '%.txt'").select(F.col("file_path").alias("path"), F.col("modification_date").alias("modificationTime")), 365, F.to_timestamp(F.lit("2020-01-01"))),
        "S16_S19_settings": resolved_layers,
        "S17_export_lines": lambda s, d: settings.export_lines(resolved_layers(s, d)),
        "S18_without_secrets": lambda s, d: settings.without_secrets(resolved_layers(s, d)),
        "S13_history_tables": lambda s, d: history.ensure_history(s, shared_dir(s) + "/history"),
        "S12_appended_sessions": appended_sessions,
        "S11_state": lambda s, d: source.state_written(history.learned_patterns(load(s, d, "user_corrections")), own_path(s, "state")),
        "S15_kept_progress": lambda s, d: planning.kept_progress(load(s, d, "user_corrections"), files(s, d), "file_name"),
        "S14_G22_learned_patterns": lambda s, d: history.learned_patterns(load(s, d, "user_corrections")),
        "G22_pattern_success": lambda s, d: history.pattern_success(results(s, d), load(s, d, "user_corrections")),
        "S20_P09_tally": lambda s, d: planning.tally(checked_operations(s, d)),
        "P09_operation_errors": lambda s, d: checked_operations(s, d).filter("error is not null"),
        "S28_log_lines": lambda s, d: source.log_lines(corpus(s, d).select(F.col("content").alias("message")), F.to_timestamp(F.lit("2024-05-06 07:08:09"))).select(F.md5("line").alias("digest")),
        "S27_G30_call_report": lambda s, d: failures.call_report(failures.calls_in_sources(sources_of(s, d))),
        "G27_retry_statistics": retry_rows,
        "G28_operation_statistics": lambda s, d: failures.operation_statistics(attempts(s, d).select(F.coalesce("file_type", F.lit("none")).alias("operation"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("ok"))),
        "G29_availability": lambda s, d: failures.availability(attempts(s, d).select(F.coalesce("extraction_method", F.lit("none")).alias("service"), (F.coalesce("quality", F.lit("")) == "excellent").alias("available"))),
        "C03_classify": on_corpus(classify.classify),
        "C12_disambiguated": refiner_results,
        "L08_L11_ranked_categories": on_corpus(classify.ranked),
        "L11_alternatives": on_corpus(lambda c: classify.ranked(c, 2, 3)),
        "J12_rule_table": on_corpus(classify.by_rule_table),
        "J07_zipped": lambda s, d: planning.zipped(files(s, d), "dates_found", "numbers_found"),
        "J08_with_counterpart": lambda s, d: planning.with_counterpart(files(s, d).select("file_id", "file_name"), load(s, d, "user_corrections"), "file_name"),
        "J09_in_range": lambda s, d: planning.in_range(files(s, d).select("file_id", "file_size"), "file_size", tiers(s)),
        "J13_lookup": lambda s, d: results(s, d).select("result_id", F.coalesce(F.element_at(F.create_map(F.lit("rule_based"), F.lit(1), F.lit("ml_enhanced"), F.lit(2)), F.coalesce("method", F.lit(""))), F.lit(0)).cast("bigint").alias("step")),
        "P04_preference_errors": preferences,
        "P05_configuration_errors": configurations,
        "P06_argument_conflicts": conflicts,
        "P08_nearest_level": levels,
        "K01_G26_X11_P03_folder_pattern": lambda s, d: planning.folder_pattern(folders(s, d)),
        "K02_chosen_structure": lambda s, d: planning.chosen_structure(folders(s, d), results(s, d)),
        "K04_K05_operations": planned,
        "K08_by_kind": lambda s, d: planning.by_kind(files(s, d)),
        "G16_temporal_confidence": lambda s, d: temporal.temporal_confidence(dated_with_quality(s, d)),
        "G14_fiscal_hints": fiscal_hints,
        "X09_advice": lambda s, d: temporal.advice(dated(s, d)),
        "M06_cluster_categories": on_corpus(lambda c: vectors.cluster_categories(c.withColumn("cluster_key", F.col("doc_id") % 50), "cluster_key")),
        "M01_hashed_embedding": lambda s, d: extract.hashed_embedding(load(s, d, "documents").select("doc_id", "text")).select("doc_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("length"), F.size("embedding").alias("dimensions")),
    }
