"""Temporal and fiscal analysis of dated, categorised documents: (category string, dt date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# First months of the fiscal years, in order of precedence, and what a peak quarter stands for.
FISCAL_STARTS = {"calendar": 1, "financial": 4, "academic": 9, "federal": 10}
SEASONS = {1: "year_end_reporting", 2: "mid_year_activity", 3: "summer_activity", 4: "year_end_closure"}
BUSINESS = ("invoices", "contracts", "reports", "correspondence")


def quarter_name(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"))


def fiscal_year(d: Column, start: int) -> Column:
    return F.when(F.month(d) >= start, F.year(d)).otherwise(F.year(d) - 1)


def fiscal_quarter(d: Column, start: int) -> Column:
    return F.concat(F.lit("FQ"), (F.floor(F.pmod(F.month(d) - start, F.lit(12)) / 3) + 1).cast("string"))


def distribution(dated: DataFrame) -> DataFrame:
    """(grain, period, n): counts by year, month and quarter in one pass with grouping sets."""
    parts = dated.filter("dt is not null").select(F.year("dt").alias("y"), F.month("dt").alias("m"), F.quarter("dt").alias("q"))
    sets = parts.groupingSets([["y"], ["m"], ["q"]], "y", "m", "q").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(
        F.when(F.col("y").isNotNull(), "year").when(F.col("m").isNotNull(), "month").otherwise("quarter").alias("grain"), F.coalesce("y", "m", "q").cast("bigint").alias("period"), "n"
    )


def span(dated: DataFrame) -> DataFrame:
    """One row: earliest, latest and span; nulls where there is no date."""
    t = dated.agg(F.min("dt").alias("earliest"), F.max("dt").alias("latest"), F.count("dt").alias("n"))
    days = F.datediff("latest", "earliest").cast("bigint")
    granularity = F.when((F.col("span_years") > 3) & (F.col("n") > 50), "year-quarter").when((F.col("span_years") > 5) & (F.col("n") > 100), "year-month").when((F.col("span_years") < 2) & (F.col("n") > 20), "quarter-month").otherwise("year")
    return t.withColumn("span_days", days).withColumn("span_years", F.col("span_days") / 365.25).withColumn("time_granularity", granularity)


def peaks(dated: DataFrame) -> DataFrame:
    """(grain, period, name, n) of the busiest month and quarter; ties to the earlier period."""
    d = distribution(dated).filter("grain <> 'year'")
    t = d.groupBy("grain").agg(F.min_by("period", F.struct(-F.col("n"), F.col("period"))).alias("period"), F.max("n").alias("n"))
    month = F.date_format(F.make_date(F.lit(2000), F.col("period").cast("int"), F.lit(1)), "MMMM")
    return t.select("grain", "period", F.when(F.col("grain") == "month", month).otherwise(F.concat(F.lit("Q"), F.col("period").cast("string"))).alias("name"), "n")


def seasonal(dated: DataFrame) -> DataFrame:
    """A row for each category with at least three dates: variation over its quarters, and the peak where it is strong."""
    per = dated.filter("dt is not null").groupBy("category", F.quarter("dt").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    t = per.groupBy("category").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("quarters"), (F.stddev_pop("n") / F.avg("n")).alias("cv"), F.min_by("q", F.struct(-F.col("n"), F.col("q"))).alias("peak"))
    strong = (F.col("quarters") >= 2) & (F.col("cv") > 0.5)
    season = F.element_at(F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv]), F.col("peak"))
    return t.filter("total >= 3").select("category", strong.alias("pattern_detected"), F.when(F.col("quarters") >= 2, F.round("cv", 6)).alias("pattern_strength"), F.when(strong, F.concat(F.lit("Q"), F.col("peak").cast("string"))).alias("peak_quarter"), F.when(strong, season).alias("seasonal_type"))


def overall_season(dated: DataFrame) -> DataFrame:
    per = dated.filter("dt is not null").groupBy(F.quarter("dt").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    t = per.agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count(F.lit(1)).alias("quarters"), (F.stddev_pop("n") / F.avg("n")).alias("cv"), F.min_by("q", F.struct(-F.col("n"), F.col("q"))).alias("peak"))
    return t.filter("total > 0").select(F.concat(F.lit("Q"), F.col("peak").cast("string")).alias("peak_quarter"), F.round(F.col("top") / F.col("total") * 100, 6).alias("peak_percentage"), F.when(F.col("quarters") < 2, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("cv")), 6)).alias("seasonal_strength"))


def fiscal_inference(dated: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row: scores of the fiscal years by month, the best (ties to the earlier), and a confidence.

    hints: a row for each text that names a fiscal year; they count against the dates in the confidence.
    """
    m = F.month("dt")
    t = dated.filter("dt is not null").agg(
        (F.count_if(m == 4) + F.count_if(m == 3)).cast("double").alias("financial"),
        (F.count_if(m == 9) * 1.5).cast("double").alias("academic"),
        (F.count_if(m == 9) + F.count_if(m == 10)).cast("double").alias("federal"),
        (F.count(F.lit(1)) / 12).alias("calendar"),
        F.count_distinct(m).alias("months"),
        F.count("dt").alias("dates"),
    )
    t = t.crossJoin(hints.agg(F.count(F.lit(1)).alias("hints")) if hints is not None else t.sparkSession.range(1).select(F.lit(0).alias("hints")))  # one row
    hinted = F.when(F.col("hints") > 0, F.col("hints") / (F.col("hints") + F.col("dates"))).otherwise(0.0)
    order = ("financial", "academic", "federal", "calendar")
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)]))["k"]
    return t.select(*[F.round(k, 6).alias(k) for k in order], F.when(F.col("months") == 0, "calendar").otherwise(best).alias("fiscal_type"), F.round(hinted * 0.7 + F.least(F.lit(1.0), F.col("months") / 12.0 * 2) * 0.3, 6).alias("confidence"))


def fiscal_structure(dated: DataFrame, fiscal_type: str) -> DataFrame:
    """(fiscal_year, fiscal_quarter, n) and what the whole recommends, for one kind of fiscal year."""
    start = FISCAL_STARTS[fiscal_type]
    d = dated.filter("dt is not null").groupBy(fiscal_year(F.col("dt"), start).cast("bigint").alias("fiscal_year"), fiscal_quarter(F.col("dt"), start).alias("fiscal_quarter")).agg(F.count(F.lit(1)).alias("n"))
    whole = d.groupBy("fiscal_year").agg(F.sum("n").alias("docs")).agg(F.count(F.lit(1)).alias("years"), F.avg("docs").alias("mean"))
    advice = F.when((F.col("years") > 3) & (F.col("mean") > 20), "fiscal_year_quarter").when(F.col("years") > 1, "fiscal_year_only").otherwise("fiscal_quarter_only")
    return d.crossJoin(F.broadcast(whole.select(advice.alias("structure_type"))))  # one row


def gaps(dated: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, mean, deviation, distinct) of the days between neighbouring dates of each group.

    Equal dates are counted first: a date seen k times gives k - 1 gaps of zero and one to the next date, so that the
    window sorts one row a date, however many documents a group has, and no group is larger than its number of days.
    """
    days = dated.filter("dt is not null").groupBy(*keys, "dt").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy("dt")
    steps = days.withColumn("gap", F.datediff(F.lead("dt").over(w), "dt").cast("double"))
    zero = F.col("k") - 1
    t = steps.groupBy(*keys).agg(
        F.sum("k").alias("dates"),
        (F.sum(zero) + F.count("gap")).alias("n"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("q"),
        (F.count_distinct("gap") + F.max((zero > 0).cast("int"))).alias("distinct"),
    )
    mean = F.col("s") / F.col("n")
    return t.filter("n > 0").select(*keys, "dates", "n", "distinct", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("deviation"))


def density(dated: DataFrame) -> DataFrame:
    """One row on the gaps between all dates: regular, periodic or irregular."""
    t = gaps(dated.withColumn("all", F.lit(1)), ("all",))
    kind = F.when(F.col("deviation") < F.col("mean") * 0.3, "regular").when(F.col("distinct") < F.col("n") * 0.5, "periodic").otherwise("irregular")
    return t.select(kind.alias("pattern_type"), F.round("mean", 6).alias("average_gap_days"), F.round("deviation", 4).alias("gap_variability"))


def workflows(dated: DataFrame) -> DataFrame:
    """A row for each category with at least two dates: rhythm of its documents."""
    t = gaps(dated, ("category",))
    regular = F.col("deviation") < F.col("mean") * 0.3
    kind = F.when(~regular, "irregular").when(F.col("mean").between(25, 35), "monthly").when(F.col("mean").between(85, 95), "quarterly").when(F.col("mean").between(350, 380), "yearly").otherwise("regular_custom")
    return t.select("category", kind.alias("workflow_type"), F.round("mean", 6).alias("average_interval_days"), F.when(F.col("mean") > 0, F.round(1 - F.col("deviation") / F.col("mean"), 4)).otherwise(0.0).alias("interval_consistency"), F.col("dates").alias("document_frequency"))


def cycles(dated: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """A row for each named category whose months show at most two intervals: kind of cycle and its two busiest months."""
    per = dated.filter("dt is not null").filter(F.col("category").isin(*categories)).groupBy("category", F.month("dt").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    months = F.array_sort(F.collect_list("m"))  # at most twelve
    t = per.groupBy("category").agg(F.sum("n").alias("total"), months.alias("ms"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "m"))), 1, 2).alias("top"))
    steps = F.transform(F.sequence(F.lit(1), F.size("ms") - 1), lambda i: F.element_at("ms", i + 1) - F.element_at("ms", i))
    t = t.filter((F.col("total") > 2) & (F.size("ms") >= 3)).withColumn("steps", F.array_distinct(steps)).filter(F.size("steps") <= 2)
    kind = F.when(F.size("steps") == 1, F.concat(F.lit("every_"), F.element_at("steps", 1).cast("string"), F.lit("_months"))).otherwise("variable_cycle")
    return t.select("category", kind.alias("cycle_type"), F.array_join(F.transform("top", lambda x: x["m"].cast("string")), ",").alias("peak_months"))


def temporal_confidence(dated: DataFrame) -> DataFrame:
    """One row: share of documents with a date, mean quality of the dates, strength of the monthly pattern, and their sum.

    dated: (dt, quality); a null quality counts 0.5. Zeros where there are no documents.
    """
    with_date = F.col("dt").isNotNull()
    t = dated.agg(F.count(F.lit(1)).alias("n"), F.count_if(with_date).alias("k"), F.avg(F.when(with_date, F.coalesce("quality", F.lit(0.5)))).alias("q"))
    months = dated.filter(with_date).groupBy(F.month("dt").alias("m")).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.stddev_pop("c") / F.avg("c"), F.lit(0.0)).alias("cv"))
    both = t.crossJoin(months)  # one row each
    coverage = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    quality = F.coalesce("q", F.lit(0.0))
    strength = F.when(F.col("k") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.col("cv") * 0.5))
    parts = {"date_coverage": coverage, "average_date_quality": quality, "pattern_strength": strength, "overall_confidence": coverage * 0.4 + quality * 0.3 + strength * 0.3}
    return both.select(*[F.round(c, 6).alias(k) for k, c in parts.items()])


def advice(dated: DataFrame) -> DataFrame:
    """(source, advice): what span, seasons, fiscal year and rhythms of the documents recommend; one row of doubt if nothing does."""
    s = span(dated).select(F.when(F.col("span_years") > 5, "Long time span detected - consider year-based primary organization").when(F.col("span_years") < 1, "Recent documents - consider month/quarter organization").alias("span"))
    shown = F.col("pattern_detected") & (F.col("pattern_strength") > 0.6)
    strong = seasonal(dated).agg(F.count(F.lit(1)).alias("seasons"), F.count_if(shown).alias("strong"), F.min(F.when(shown, F.col("category"))).alias("one"))
    f = fiscal_inference(dated).select("fiscal_type", "confidence")
    w = workflows(dated).agg(F.count(F.lit(1)).alias("rhythms"), F.count_if((F.col("workflow_type") != "irregular") & (F.col("interval_consistency") > 0.7)).alias("regular"))
    both = s.crossJoin(strong).crossJoin(f).crossJoin(w)  # one row each
    said = F.array_compact(F.array(
        F.when(F.col("span").isNotNull(), F.struct(F.lit("span").alias("source"), F.col("span").alias("advice"))),
        F.when(F.col("seasons") > 2, F.struct(F.lit("seasons").alias("source"), F.lit("Strong seasonal patterns - organize by business quarters within years").alias("advice"))),
        F.when(F.col("strong") >= 2, F.struct(F.lit("categories").alias("source"), F.lit("Multiple categories show strong seasonal patterns - consider quarterly organization").alias("advice"))),
        F.when(F.col("strong") == 1, F.struct(F.lit("categories").alias("source"), F.concat("one", F.lit(" shows seasonal pattern - organize by business quarters")).alias("advice"))),
        F.when((F.col("confidence") > 0.8) & (F.col("fiscal_type") != "calendar"), F.struct(F.lit("fiscal").alias("source"), F.concat(F.lit("Use "), "fiscal_type", F.lit(" fiscal year structure for better business alignment")).alias("advice"))),
        F.when(F.col("rhythms") > 3, F.struct(F.lit("workflows").alias("source"), F.lit("Multiple workflow patterns detected - consider category-first organization").alias("advice"))),
        F.when(F.col("regular") > 1, F.struct(F.lit("regular").alias("source"), F.lit("Multiple regular workflows detected - organize by workflow pattern").alias("advice"))),
    ))
    doubt = F.array(F.struct(F.lit("none").alias("source"), F.lit("Temporal patterns are weak - rely on rule-based and ML classification").alias("advice")))
    return both.select(F.explode(F.when(F.size(said) > 0, said).otherwise(doubt)).alias("r")).select("r.source", "r.advice")
