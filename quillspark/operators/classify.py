"""Rule classification, refinement steps, uncertainty and the quality of a classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small

# Per category the sets of patterns with the weight of the set, in order of precedence.
RULES = {
    "contracts": (
        (0.9, (r"service\s+agreement", r"terms\s+and\s+conditions", r"effective\s+date")),
        (0.8, ("agreement", "party", "shall")),
        (0.7, ("contract", "legal", "binding")),
        (0.8, ("whereas", "therefore", "executed")),
    ),
    "invoices": (
        (0.9, (r"invoice\s*#?\d+", r"amount\s+due", r"payment\s+terms")),
        (0.8, ("invoice", r"due\s+date", "total")),
        (0.7, ("billing", "charge", "remit")),
        (0.7, (r"\$[\d,]+\.\d{2}", r"net\s+\d+", "payable")),
    ),
    "reports": (
        (0.8, ("report", "analysis", "findings")),
        (0.8, ("quarterly", "annual", "summary")),
        (0.7, ("revenue", "expenses", "performance")),
        (0.8, (r"executive\s+summary", "conclusion", "recommendation")),
        (0.9, (r"q[1-4]\s+\d{4}", r"financial\s+report", "year.over.year")),
    ),
    "correspondence": (
        (0.8, (r"dear\s+\w+", "sincerely", "regards")),
        (0.7, ("meeting", "discussion", "follow.up")),
        (0.6, ("email", "message", "communication")),
        (0.6, (r"thank\s+you", "please", "update")),
        (0.7, ("colleagues", r"various\s+topics", r"meeting\s+notes")),
    ),
    "financial": (
        (0.9, (r"balance\s+sheet", r"income\s+statement", r"cash\s+flow")),
        (0.8, ("budget", "forecast", "financial")),
        (0.7, ("profit", "loss", "revenue")),
        (0.8, ("assets", "liabilities", "equity")),
    ),
    "legal": (
        (0.9, (r"legal\s+document", "court", "jurisdiction")),
        (0.8, ("plaintiff", "defendant", "litigation")),
        (0.7, ("statute", "regulation", "compliance")),
        (0.7, ("hereby", "witness", "notarized")),
    ),
}
FLOOR = 0.3  # a category below it is not taken over by classify()
# Words by which an uncertain text gets a broad category, first list first.
BROAD = (
    ("financial_documents", "invoice bill payment amount"),
    ("legal_documents", "agreement contract terms legal"),
    ("technical_documents", "manual guide instructions procedure"),
    ("personal_documents", "personal private medical health"),
    ("communications", "email letter memo communication"),
)
# Words of a name that says nothing about its content.
GENERIC_NAMES = "document file untitled scan image photo new copy temp draft unknown".split()
FACTOR_WEIGHTS = {"mixed_signals": 0.3, "sparse_content": 0.2, "ambiguous_filename": 0.15, "missing_metadata": 0.1}


def occurs(low: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a lower-cased text; plain words need no regular expression."""
    return F.contains(low, F.lit(pattern)) if pattern.isalpha() else low.rlike(pattern)


def category_score(low: Column, category: str) -> Column:
    """Mean over the rule sets of the share of patterns that occur, times the weight of the set; summed in rule order."""
    total = F.lit(0.0)
    for weight, patterns in RULES[category]:
        hits = sum((occurs(low, p).cast("int") for p in patterns), F.lit(0))
        total = total + hits / F.lit(float(len(patterns))) * F.lit(weight)
    return total / F.lit(float(len(RULES[category])))


def rule_scores(df: DataFrame, keep: tuple[str, ...] = (), text: str = "content") -> DataFrame:
    """(doc_id, keep, a column a category); lower-casing is a projection of its own, so it happens once a text."""
    low = df.select("doc_id", *keep, F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    return low.select("doc_id", *keep, *[category_score(F.col("low"), c).alias(c) for c in RULES])


def best_category() -> Column:
    """(score, category) of the columns that rule_scores gives, ties to the earlier category; ('other', 0) without a hit."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("i"), F.lit(c).alias("category")) for i, c in enumerate(RULES)]))
    return F.struct(F.when(best["score"] > 0, best["category"]).otherwise("other").alias("category"), best["score"].alias("confidence"))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.2, "low").otherwise("very_low")


def others_with_score() -> Column:
    """How many categories besides the best one have a score at all."""
    return F.greatest(F.lit(0), sum(((F.col(c) > 0).cast("int") for c in RULES), F.lit(0)) - 1)


def classified(df: DataFrame, keep: tuple[str, ...] = (), alternatives: bool = False) -> DataFrame:
    """(doc_id, keep, category, confidence, level, method): the progressive classification; below 0.7 the refiner is named."""
    more = [others_with_score().alias("alternatives")] if alternatives else []
    best = rule_scores(df, keep).select("doc_id", *keep, *more, best_category().alias("b")).select("doc_id", *keep, *(["alternatives"] if alternatives else []), "b.category", "b.confidence")
    return best.withColumn("confidence_level", confidence_level(F.col("confidence"))).withColumn("method", F.when(F.col("confidence") >= 0.7, "rule_based").otherwise("ml_enhanced"))


def broad_category(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("miscellaneous_documents")
    for name, listed in reversed(BROAD):
        out = F.when(low.rlike("|".join(listed.split())), name).otherwise(out)
    return out


def classify(df: DataFrame) -> DataFrame:
    """(doc_id, category): the best category of name and content together, 'other' below FLOOR."""
    both = df.select("doc_id", F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.coalesce("content", F.lit(""))).alias("content"))
    best = rule_scores(both).select("doc_id", best_category().alias("b"))
    return best.select("doc_id", F.when(F.col("b.confidence") >= FLOOR, F.col("b.category")).otherwise("other").alias("category"))


def ranked(df: DataFrame, first: int = 1, last: int = 3) -> DataFrame:
    """(doc_id, place, category, score): the categories of each text from place first to last, by score, ties in rule order.

    There are as many categories as rule sets, so ranking sorts a small array within the row and needs no shuffle.
    """
    every = F.filter(F.array(*[F.struct((-F.col(c)).alias("minus"), F.lit(i).alias("i"), F.lit(c).alias("category")) for i, c in enumerate(RULES)]), lambda x: x["minus"] < 0)
    top = rule_scores(df).select("doc_id", F.posexplode(F.slice(F.array_sort(every), first, last - first + 1)).alias("pos", "x"))
    return top.select("doc_id", (F.col("pos") + first).cast("bigint").alias("place"), "x.category", F.round(-F.col("x.minus"), 9).alias("score"))


def refined(df: DataFrame) -> DataFrame:
    """Batch refinement: uncertain texts are told apart by kind, new patterns get a broad category, the rest a boost.

    Several other categories with a score make a text ambiguous; it keeps its rule result, since no refiner is installed.
    A text that gets a new category keeps the old one as alternative. The refinement runs only if at least ten texts are
    uncertain, a count over the narrow classification of the whole batch.
    """
    c = classified(df, ("content",), alternatives=True)
    gate = classified(df).agg((F.count_if(F.col("confidence") < 0.7) >= 10).alias("refine"))
    kind = F.when(F.length(F.coalesce("content", F.lit(""))) < 50, "insufficient").when(F.col("confidence") < 0.3, "new_pattern").when(F.col("alternatives") > 2, "ambiguous").otherwise("quality")
    both = c.crossJoin(F.broadcast(gate)).withColumn("uncertainty", F.when((F.col("confidence") < 0.7) & F.col("refine"), kind))  # one row
    return both.select(
        "doc_id",
        F.when(F.col("uncertainty") == "new_pattern", broad_category(F.col("content"))).otherwise(F.col("category")).alias("category"),
        F.when(F.col("uncertainty") == "new_pattern", 0.4).when(F.col("uncertainty") == "quality", F.least(F.lit(0.6), F.col("confidence") + 0.1)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("uncertainty") == "new_pattern", F.col("category")).alias("alternative"),
        F.coalesce("uncertainty", F.lit("certain")).alias("uncertainty"),
    )


def disambiguated(base: DataFrame, refiner: DataFrame) -> DataFrame:
    """Rule results, replaced by the refiner's where it has one for the same id; repeated results of the refiner count once."""
    better = refiner.groupBy("doc_id").agg(F.max_by(F.struct("category", "confidence"), F.struct("confidence", "category")).alias("r"))
    both = base.join(better, "doc_id", "left")
    return both.select("doc_id", F.coalesce("r.category", "category").alias("category"), F.coalesce("r.confidence", "confidence").alias("confidence"), F.col("r").isNotNull().alias("refined"))


def by_rule_table(df: DataFrame) -> DataFrame:
    """The scores as a join: texts against the table of all patterns, then two levels of aggregation; (doc_id, category, score).

    For rule tables that are data rather than code. The table is broadcast while its checked size allows it.
    """
    spark = df.sparkSession
    rows = [(c, i, len(sets), w, len(ps), p) for c, sets in RULES.items() for i, (w, ps) in enumerate(sets) for p in ps]
    table = spark.createDataFrame(rows, "category string, rule_set int, sets int, weight double, patterns int, pattern string")
    low = df.select("doc_id", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    hits = low.join(broadcast_if_small(table), F.expr("low RLIKE pattern")).groupBy("doc_id", "category", "rule_set").agg((F.count(F.lit(1)) / F.first("patterns") * F.first("weight")).alias("s"), F.first("sets").alias("sets"))
    return hits.groupBy("doc_id", "category").agg(F.round(F.sum("s") / F.first("sets"), 9).alias("score"))


def factors(df: DataFrame) -> DataFrame:
    """The four factors of uncertainty of a classified text. df: content, file_name, confidence, has_dates, has_amounts,
    has_entities. Without content there are no metadata at all, which counts 0.8.
    """
    text, name = F.coalesce("content", F.lit("")), F.lower(F.coalesce("file_name", F.lit("")))
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    total = F.length(text) + F.length(name)
    bare = F.replace(name, F.lit(".pdf"), F.lit(""))
    missing = F.when(F.col("content").isNull(), 0.8).otherwise(
        F.when(F.col("has_entities"), 0.0).otherwise(0.3)
        + F.when(F.col("has_dates"), 0.0).otherwise(0.2)
        + F.when(F.lower(text).rlike(r"invoice|payment|bill|\$") & ~F.col("has_amounts"), 0.3).otherwise(0.0)
        + F.when(n_words < 20, 0.2).otherwise(0.0)
    )
    return df.select(
        "doc_id",
        "confidence",
        F.when(F.col("confidence").between(0.4, 0.7), (0.7 - F.col("confidence")) / 0.3).otherwise(0.0).alias("mixed_signals"),
        F.when(total < 50, 0.8).when((total < 100) | (n_words < 10), 0.5).when(n_words < 20, 0.3).otherwise(0.0).alias("sparse_content"),
        F.when(name == "", 0.8).when(name.rlike("|".join(GENERIC_NAMES)), 0.6).when(bare.rlike(r"^[\d\-_.]+$"), 0.4).when(F.length(bare) < 5, 0.3).otherwise(0.0).alias("ambiguous_filename"),
        F.least(F.lit(1.0), missing).alias("missing_metadata"),
    )


def uncertainty(f: DataFrame, threshold: float = 0.7) -> DataFrame:
    score = 1.0 - F.col("confidence")
    for k, w in FACTOR_WEIGHTS.items():
        score = score + F.col(k) * w
    score = F.least(F.lit(1.0), score)
    return f.withColumn("uncertainty_score", score).withColumn("certain", F.col("confidence") >= threshold)


def uncertainty_summary(u: DataFrame) -> DataFrame:
    """One row a factor: mean, greatest value and texts affected among the uncertain ones."""
    pairs = ", ".join(f"'{k}', {k}" for k in FACTOR_WEIGHTS)
    long = u.filter(~F.col("certain")).select(F.expr(f"stack({len(FACTOR_WEIGHTS)}, {pairs}) AS (factor, value)"))
    return long.groupBy("factor").agg(F.avg("value").alias("avg_score"), F.max("value").alias("max_score"), F.count_if(F.col("value") > 0.1).alias("documents_affected"))


def threshold_sweep(c: DataFrame, thresholds=(0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """One row a threshold: certain and uncertain texts; one pass, counted conditionally."""
    counts = c.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("certain"), (F.col("n") - F.col(f"c{i}")).alias("uncertain")) for i, t in enumerate(thresholds)])).alias("r")
    return counts.select(rows).select("r.threshold", "r.certain", "r.uncertain")


def quality(c: DataFrame, min_category_size: int = 2, max_categories: int = 20) -> DataFrame:
    """One row on the quality of a classification: shares, balance, score, threshold by size, advice. Null-safe on no rows."""
    groups = c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("method") == "fallback").alias("fallback"))
    t = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"), F.coalesce(F.sum("high"), F.lit(0)).alias("high_confidence"), F.coalesce(F.sum("fallback"), F.lit(0)).alias("fallback_documents"), F.count(F.lit(1)).alias("total_categories"), F.count_if(F.col("n") < 2).alias("single"), F.count_if(F.col("n") < min_category_size).alias("under"))
    t = t.withColumn("small_categories", F.when(F.col("total_documents") <= 10, 0).otherwise(F.col("under")))
    t = t.withColumn("quality_score", F.when(F.col("total_documents") > 0, 100.0 * F.col("high_confidence") / F.col("total_documents")).otherwise(0.0))
    t = t.withColumn("balance_score", F.when(F.col("total_categories") > 0, F.greatest(F.lit(0.0), 100 - F.col("small_categories") / F.col("total_categories") * 100)).otherwise(0.0))
    t = t.withColumn("overall_score", (F.col("quality_score") + F.col("balance_score")) / 2)
    t = t.withColumn("threshold_used", F.when(F.col("total_documents") <= 5, 40).when(F.col("total_documents") <= 10, 50).when(F.col("total_documents") <= 20, 55).otherwise(60).cast("bigint"))
    advice = F.array_compact(F.array(
        F.when(F.col("overall_score") < 60, "below_threshold"),
        F.when(F.col("fallback_documents") > 0, "review_fallback"),
        F.when(F.col("single") > F.col("total_categories") * 0.3, "merge_small"),
        F.when(F.col("total_categories") > max_categories, "too_many_categories"),
    ))
    return t.select("total_documents", "high_confidence", "fallback_documents", "total_categories", "small_categories", F.round("quality_score", 6).alias("quality_score"), F.round("balance_score", 6).alias("balance_score"), F.round("overall_score", 6).alias("overall_score"), "threshold_used", (F.col("overall_score") >= F.col("threshold_used")).alias("valid"), F.when(F.size(advice) == 0, "good").otherwise(F.array_join(advice, ",")).alias("advice"))
