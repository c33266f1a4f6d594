"""Edge cases of the document operators: nulls, empty and long texts, ties, repeated rows, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, clean, grade, history, planning, profile, security, temporal, vectors

DOC = "doc_id bigint, file_name string, content string, file_size bigint, extra string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}.pdf", t, 10 * i, "x") for i, t in enumerate(texts)], DOC)


def one(df, column):
    return [r[column] for r in df.orderBy("doc_id").collect()]


LONG = "Invoice total amount is 5. " * 20_000


def test_profile_edges(spark):
    c = docs(spark, None, "", "  ", "one two\n\nthree. four!", LONG, "Jan 5, 2020\nand on 05/06/2020 we paid $12.50")
    counts = profile.content_counts(c).orderBy("doc_id").collect()
    assert [r.word_count for r in counts] == [0, 0, 0, 4, 100_000, 9]
    assert counts[3].paragraph_count == 2 and counts[3].line_count == 3
    assert one(c.select("doc_id", profile.readability(F.col("content")).alias("r")), "r")[:2] == [None, None]
    e = profile.entities(c).orderBy("doc_id").collect()
    assert e[5].dates_found == ["05/06/2020"] and e[5].currency_found == ["$12.50"] and e[0].dates_found == []
    assert profile.comprehensive(c).count() == 6
    assert profile.comprehensive(c.limit(0)).count() == 0


@pytest.mark.parametrize("name,ext", [("a.PDF", ".pdf"), (".hidden", ""), ("x.tar.gz", ".gz"), ("noext", ""), ("d.ir/file", "")])
def test_extension(spark, name, ext):
    assert spark.createDataFrame([(name,)], "n string").select(profile.extension(F.col("n")).alias("e")).first().e == ext


def test_language_ties_go_to_the_first(spark):
    c = docs(spark, None, "short", "zzz " * 20, "the and or but in on at to for of with by " * 3)
    assert one(c.select("doc_id", profile.language_guess(F.col("content")).alias("l")), "l") == [None, None, "unknown", "en"]


def test_grades(spark):
    word = "readable words stand here. "
    c = docs(spark, None, "tiny", word * 10, "#*+ " * 60, "a\n" * 40)
    assert one(grade.grades(c), "text_grade") == ["failed", "failed", "excellent", "fair", "fair"]
    assert one(grade.grades(c), "promoted_grade")[2] == "excellent"


def test_best_attempt_ties_and_nulls(spark):
    a = spark.createDataFrame([(1, 10, "poor"), (1, 11, "good"), (1, 12, "good"), (2, 13, None), (2, 14, "failed"), (3, 15, None)], "file_id bigint, content_id bigint, quality string")
    assert {r.file_id: r.content_id for r in grade.best_attempt(a).collect()} == {1: 11, 2: 14, 3: 15}


def test_artifacts_keep_a_text_that_starts_with_a_page_number(spark):
    c = docs(spark, "page 3\nThe real text is here\n12\nconfidential\nwoooooow l 0", "", "é" * 9)
    assert one(c.select("doc_id", clean.without_artifacts(F.col("content")).alias("t")), "t") == ["The real text is here\nwoow I O", "", "éé"]


def test_summary_skips_what_does_not_fit(spark):
    big, small = "An amount " + "x" * 95, "The total date is 5 and more text here"
    text = f"{big}. {small}. {big}. {small}b. "
    s = docs(spark, text, "short text", None).select("doc_id", clean.summary(F.col("content"), 150).alias("s"))
    out = one(s, "s")
    assert out[1] == "short text" and out[2] is None
    assert big not in out[0] or len(out[0]) <= 151
    assert small in out[0]


def test_unicode(spark):
    c = docs(spark, "é – … a​b", None)
    assert one(c.select("doc_id", clean.normalise_unicode(F.col("content")).alias("t")), "t") == ["é - ... ab", None]


def test_spread_only_reshuffles_small_inputs(spark):
    from quillspark.session import spread

    cores = spark.sparkContext.defaultParallelism
    small, large = spark.range(100).coalesce(1), spark.range(0, 100, 1, cores + 3)
    assert spread(small).rdd.getNumPartitions() == cores and spread(large).rdd.getNumPartitions() == cores + 3
    assert sorted(r.id for r in spread(small).collect()) == list(range(100)) and spread(spark.range(0)).count() == 0


def test_names(spark):
    d = spark.createDataFrame([(0, "'ab'"), (1, None), (2, "x" * 300), (3, "word_" * 60), (4, "my script run"), (5, "***")], "doc_id bigint, n string")
    out = one(d.select("doc_id", security.chosen_name(F.col("n")).alias("n")), "n")
    assert out[0] == "document_ab" and out[1] == "unnamed_document" and len(out[2]) == 160 and out[3].endswith("word") and len(out[3]) <= 160
    assert "script" not in out[4] or "run" not in out[4]
    assert out[5] == "document_"


def test_chosen_name_computes_each_step_once(spark):
    d = spark.createDataFrame([(0, "Python JavaScript run"), (1, "-" * 161), (2, "a" * 12 + "-_" * 80), (3, ""), (4, "`'x'`")], "doc_id bigint, n string")
    chosen = d.select("doc_id", security.chosen_name(F.col("n")).alias("n"))
    assert one(chosen, "n") == ["content_javascript_run", "document", "a" * 12, "unnamed_document", "document_x"]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9_-]") == 1


def test_log_secrets_in_order(spark):
    d = docs(spark, "sk-ant-" + "q" * 60, "AIza" + "z" * 40, None, "plain")
    assert one(d.select("doc_id", security.clean_log(F.col("content")).alias("t")), "t") == ["sk-ant***", "AIza***", None, "plain"]


def test_threat_levels(spark):
    d = docs(spark, "/Launch", "/JS", "/URI", "/URI /AA /XFA", "", None)
    assert one(security.threats(d), "threat_level") == ["high", "medium", "low", "medium", "safe", "low"]


def test_settings(spark):
    m = spark.createDataFrame([({"my_api_key": "1", "home": "2"},)], "m map<string,string>").select(security.clean_settings(F.col("m")).alias("m")).first().m
    assert m == {"my_api_key": "[REDACTED]", "home": "2"}


def test_classification_ties_go_to_the_first_category(spark):
    c = docs(spark, None, "", "nothing here", "legal")
    out = classify.classified(c).orderBy("doc_id").collect()
    assert [r.category for r in out][:3] == ["other"] * 3
    assert out[3].category == "contracts" and out[3].confidence_level == "very_low"


@pytest.mark.parametrize("n,threshold", [(5, 40), (9, 50), (15, 55), (25, 60)])
def test_quality_threshold_by_size(spark, n, threshold):
    c = spark.createDataFrame([(f"c{i % 3}", 0.9, "rule_based") for i in range(n)], "category string, confidence double, method string")
    q = classify.quality(c).first()
    assert q.threshold_used == threshold and q.quality_score == 100.0 and q.valid


def test_quality_of_nothing(spark):
    q = classify.quality(spark.createDataFrame([], "category string, confidence double, method string")).first()
    assert q.total_documents == 0 and q.overall_score == 0.0 and not q.valid


def dated(spark, *days, category="reports"):
    return spark.createDataFrame([(category, d) for d in days], "category string, dt date")


def test_rhythms(spark):
    monthly = dated(spark, *[dt.date(2020, m, 1) for m in range(1, 13)])
    assert temporal.workflows(monthly).first().workflow_type == "monthly"
    assert temporal.density(monthly).first().pattern_type == "regular"
    same = dated(spark, *[dt.date(2020, 1, 1)] * 5)
    r = temporal.workflows(same).first()
    assert r.average_interval_days == 0.0 and r.document_frequency == 5 and r.interval_consistency == 0.0
    assert temporal.workflows(dated(spark, dt.date(2020, 1, 1))).count() == 0
    assert temporal.workflows(dated(spark, None, None)).count() == 0


def test_fiscal(spark):
    d = dated(spark, dt.date(2020, 3, 31), dt.date(2020, 4, 1))
    out = {(r.fiscal_year, r.fiscal_quarter) for r in temporal.fiscal_structure(d, "financial").collect()}
    assert out == {(2019, "FQ4"), (2020, "FQ1")}
    assert temporal.fiscal_inference(dated(spark, None)).first().fiscal_type == "calendar"


def test_cycles(spark):
    d = dated(spark, *[dt.date(2020, m, 1) for m in (1, 4, 7, 10)])
    assert temporal.cycles(d, ("reports",)).first().cycle_type == "every_3_months"


def test_collisions_and_last_write(spark):
    m = spark.createDataFrame([(1, "a", "x.pdf"), (2, "a", "x.pdf"), (3, "b", "x.pdf"), (4, "a", "noext"), (5, "a", "noext")], "file_id bigint, folder string, name string")
    assert {r.file_id: r.target for r in planning.without_collisions(m).collect()} == {1: "a/x.pdf", 2: "a/x_1.pdf", 3: "b/x.pdf", 4: "a/noext", 5: "a/noext_1"}
    w = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (2, None, "only")], "k bigint, at bigint, v string")
    assert {r.k: r.v for r in planning.latest(w, "k", "at", "v").collect()} == {1: "new", 2: "only"}


def test_learning_trend(spark):
    rows = [(f"s{i:02d}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), 10.0 if i >= 25 else 4.0) for i in range(35)]
    s = spark.createDataFrame(rows, "session_id string, session_time timestamp, quality_score double")
    s = s.unionByName(s)  # repeated rows count once
    c = spark.createDataFrame([(1,), (1,), (2,)], "correction_id bigint")
    m = history.learning_metrics(s, c).first()
    assert m.total_sessions == 35 and m.improvement_trend == 6.0 and m.user_corrections == 2
    empty = history.learning_metrics(s.limit(0), c.limit(0)).first()
    assert empty.total_sessions == 0 and empty.improvement_trend == 0.0


def test_top_patterns_of_a_hot_method(spark):
    r = spark.range(5000).select(F.col("id").alias("result_id"), F.col("id").alias("file_id"), F.lit("m").alias("method"), (F.col("id") / 5000).alias("confidence"), F.lit(None).cast("timestamp").alias("classified_at"))
    out = [x.result_id for x in history.top_patterns(r, 5).orderBy("position").collect()]
    assert out == [4999, 4998, 4997, 4996, 4995]


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 1), (3, [1.0, 0.1], 0)], "vec_id bigint, embedding array<float>, label int")
    out = {r.vec_id: (r.nearest, r.confidence) for r in vectors.nearest_reference(v, "label").collect()}
    assert out[1][0] == 0 and out[2] == (1, 0.9)
