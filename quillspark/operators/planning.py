"""Folder planning without side effects: joins of results and files, structure, operations, collisions, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.profile import extension
from quillspark.operators.security import RESERVED


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """Last write wins: the row of each key that comes first in the order. max_by keeps one row a task and key."""
    columns = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(columns, F.struct(*order)).alias("row")).select("row.*")


def matched_paths(results: DataFrame, files: DataFrame) -> DataFrame:
    """Each result's file by path, else by name, else by original path or id, first match by file_id.

    The keys are unpivoted for an equi-join; of a key on many files only the first reaches the join.
    """
    named = [F.col("file_path"), F.col("file_name"), F.element_at("properties", "original_path") if "properties" in files.columns else F.lit(None).cast("string"), F.col("file_id").cast("string")]
    keys = files.select("file_id", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate(named)])).alias("k")).select(F.col("file_id").alias("matched_file_id"), "k.rank", "k.key")
    per_key = keys.filter("key is not null").groupBy("key").agg(F.min(F.struct("rank", "matched_file_id")).alias("first"))  # a name may be on many files
    return results.join(per_key, results.id == per_key.key, "left").select("result_id", "id", F.col("first.matched_file_id").alias("matched_file_id"))


def with_default(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Every file with the length of its text, 0 where it has none."""
    sizes = texts.groupBy("file_id").agg(F.max(F.length("text")).alias("n"))
    return files.join(sizes, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("text_length"))


def overridden(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Categories of base replaced by those of newer where there are any."""
    n = newer.select("file_id", F.col("category").alias("new"))
    return base.join(n, "file_id", "left").select("file_id", F.coalesce("new", "category").alias("category"))


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    return files.join(done.select("file_id").distinct(), "file_id", "left_anti")


def kept_progress(log: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """What a progress log keeps: its different entries that are still among the files; null entries go."""
    return log.select(key).filter(F.col(key).isNotNull()).distinct().join(files.select(key).distinct(), key, "left_semi")


def new_categories(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Categories not in the structure, compared without case and outer blanks."""
    fold = F.lower(F.trim("category")).alias("category")
    return wanted.select(fold).filter("category is not null").distinct().join(present.select(fold).distinct(), "category", "left_anti")


def operations(results: DataFrame, base: str, existing: DataFrame) -> DataFrame:
    """(type, source, target, category, confidence): a create_dir for each category without a folder, a move for each file.

    Of several results of a file the surest counts, ties to the greater category; files without a category stay.
    """
    path = F.concat_ws("/", F.lit(base), F.col("category"))
    best = results.filter("category is not null and id is not null").groupBy("id").agg(F.max(F.struct("confidence", "category")).alias("r")).select("id", "r.category", "r.confidence")
    create = best.select("category").distinct().join(existing.select("category").distinct(), "category", "left_anti")
    create = create.select(F.lit("create_dir").alias("type"), F.lit("").alias("source"), path.alias("target"), "category", F.lit(1.0).alias("confidence"))
    name = F.regexp_extract("id", "[^/]*$", 0)
    return create.unionByName(best.select(F.lit("move").alias("type"), F.col("id").alias("source"), F.concat(path, F.lit("/"), name).alias("target"), "category", "confidence"))


OPERATIONS = ("move", "copy", "create_dir")


def operation_error() -> Column:
    """Why an operation (type, source, target, source_exists) cannot be run, or null."""
    no_target = F.coalesce(F.col("target"), F.lit("")) == ""
    return (
        F.when(~F.coalesce(F.col("type"), F.lit("")).isin(*OPERATIONS), F.concat(F.lit("Invalid operation type: "), F.coalesce("type", F.lit("none"))))
        .when((F.col("type") == "create_dir") & no_target, "Target path required for directory creation")
        .when((F.col("type") != "create_dir") & ~F.coalesce("source_exists", F.lit(False)), "Source path does not exist")
        .when(no_target, "Target path cannot be empty")
    )


def tally(done: DataFrame) -> DataFrame:
    """One row on operations (type, error): how many, how many well, folders made and files moved, success share."""
    good = F.col("error").isNull()
    t = done.agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.count_if(good).alias("successful_operations"),
        F.count_if(~good).alias("failed_operations"),
        F.count_if(good & (F.col("type") == "create_dir")).alias("created_directories"),
        F.count_if(good & (F.col("type") == "move")).alias("moved_files"),
    )
    return t.withColumn("success_rate", F.when(F.col("total_operations") > 0, F.round(100.0 * F.col("successful_operations") / F.col("total_operations"), 6)).otherwise(100.0))


ID_RANGE = 1 << 16  # file ids ranked together by one window


def without_collisions(moves: DataFrame) -> DataFrame:
    """(file_id, target): equal names in a folder get _1, _2, ... in order of file_id, before the suffix.

    moves: (file_id, folder, name). The number of a copy passes over names that are there already. Ranks are counted
    within ranges of file ids and the ranges added up, so a name on very many files is not sorted in one task; only copies
    of a name of which numbered ones are there go through a running count, which streams. Null names give a null target.
    """
    stem, ext = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 2)
    part = moves.select("file_id", "folder", "name").withColumn("part", F.floor(F.col("file_id") / ID_RANGE))
    keys = ("folder", "name")
    sizes = part.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(Window.partitionBy(*keys).orderBy("part")) - F.col("k")).drop("k")
    ranked = part.join(before, [*keys, "part"]).withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("file_id")) - 1)
    # numbers already taken by a file whose own name is the stem with _number, each less the taken ones up to it
    whole = r"^(.+?)_([1-9]\d{0,8})(\.[^.]*)?$"
    taken = part.filter(F.col("name").rlike(whole)).select("folder", F.concat(F.regexp_extract("name", whole, 1), F.regexp_extract("name", whole, 3)).alias("name"), F.regexp_extract("name", whole, 2).cast("bigint").alias("number")).distinct()
    taken = taken.withColumn("n", F.col("number") - F.row_number().over(Window.partitionBy(*keys).orderBy("number")))
    marked = ranked.select("file_id", *keys, "n").join(taken.select(*keys, F.lit(True).alias("met")).distinct(), list(keys), "left")
    plain = F.col("met").isNull() | (F.col("n") == 0)
    # the k-th free number is k and as many more as taken numbers lie before it: a running count over both in order
    events = marked.filter(~plain).select(*keys, "file_id", "n", F.lit(0).alias("is_taken")).unionByName(taken.select(*keys, F.lit(None).cast("bigint").alias("file_id"), "n", F.lit(1).alias("is_taken")))
    passed = F.sum("is_taken").over(Window.partitionBy(*keys).orderBy("n", "is_taken").rowsBetween(Window.unboundedPreceding, 0))
    shifted = events.withColumn("number", F.col("n") + passed).filter("is_taken = 0").select("file_id", *keys, "number")
    named = marked.filter(plain).select("file_id", *keys, F.when(F.col("n") > 0, F.col("n")).alias("number")).unionByName(shifted)
    return named.select("file_id", F.concat(F.col("folder"), F.lit("/"), stem, F.when(F.col("number").isNotNull(), F.concat(F.lit("_"), F.col("number").cast("string"))).otherwise(""), ext).alias("target"))


def preview(results: DataFrame, shown: int = 3) -> DataFrame:
    """(category, n, examples): counts and the first few files of each category.

    Only the smallest ids are kept, by a salted top-k, never the list of all files of a category.
    """
    r = results.filter("category is not null").select("category", "file_id").distinct()
    counts = r.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category", "salt").orderBy("file_id")
    few = r.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(32))).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= shown)
    names = few.groupBy("category").agg(F.slice(F.array_sort(F.collect_list("file_id")), 1, shown).alias("ids"))  # at most 32 x shown
    return counts.join(names, "category").select("category", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("examples"))


def structure(results: DataFrame) -> DataFrame:
    """One row: share of sure results, kind of structure and granularity; category first from 60 % on."""
    t = results.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("confidence") >= 0.8).cast("double")), F.lit(0.0)).alias("strong"))
    return t.select("n", F.round("strong", 6).alias("strong_share"), F.when(F.col("strong") >= 0.6, "category_first").otherwise("time_first").alias("structure_type"), F.when(F.col("n") > 50, "month").otherwise("year").alias("granularity"))


def folder_checks(names: DataFrame) -> DataFrame:
    """(name, errors): what is wrong with a folder name, or ''."""
    n = F.col("name")
    errors = F.array_compact(F.array(
        F.when(n.isNull() | (F.trim(n) == ""), "empty"),
        F.when(F.length(n) > 255, "too_long"),
        F.when(n.rlike(r'[<>:"|?*]'), "illegal_character"),
        F.when(F.upper(n).isin(*RESERVED), "reserved"),
    ))
    return names.select("name", F.array_join(errors, ",").alias("errors"))


def folder_statistics(files: DataFrame) -> DataFrame:
    """(extension, files, bytes, folders, depth) of a listing of paths; null sizes count 0."""
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    return files.groupBy(F.coalesce("file_extension", F.lit("")).alias("extension")).agg(
        F.count_distinct("file_id").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count_distinct(folder).alias("folders"), F.max(depth).cast("bigint").alias("depth")
    )


# Words by which a folder name shows a category, of which two only when its kind is told, and forms of months and fiscal years.
CATEGORY_WORDS = ("financial", "legal", "personal", "business", "medical", "tax", "bills", "receipts", "contracts", "statements", "documents")
NOT_SURE_WORDS = ("tax", "documents")
YEAR_NAME = r"^(19|20)\d{2}$"
MONTH_NAME = r"\d{4}[-_]\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
FISCAL_NAMES = (("fy_july", r"fy.*july|july.*fy"), ("fy_april", r"fy.*april|april.*fy"), ("fy_september", r"fy.*sep|sep.*fy"))
MAX_CATEGORIES, LEAST_CONFIDENCE = 20, 0.3


def folder_pattern(folders: DataFrame) -> DataFrame:
    """One row on folder names (name): year-like and category-like ones, kind of structure, granularity, fiscal year,
    confidence, categories, and whether the structure is reasonable to extend. Repeated and hidden names do not count.
    """
    low = F.lower("name")
    one = folders.filter("name is not null and name <> '' and not startswith(name, '.')").select("name").distinct()
    sure = [w for w in CATEGORY_WORDS if w not in NOT_SURE_WORDS]
    t = one.agg(
        F.count(F.lit(1)).alias("folders"),
        F.count_if(F.col("name").rlike(YEAR_NAME)).alias("year_like"),
        F.count_if(low.rlike("|".join(CATEGORY_WORDS))).alias("category_like"),
        F.count_if(low.rlike("|".join(sure))).alias("sure"),
        F.count_if(low.rlike(MONTH_NAME)).alias("months"),
        *[F.count_if(low.rlike(p)).alias(k) for k, p in FISCAL_NAMES],
    )
    by_time = F.col("year_like") > F.col("category_like")
    shown = F.when(by_time, F.col("year_like")).otherwise(F.col("sure"))
    fiscal = F.lit("calendar")
    for k, _ in reversed(FISCAL_NAMES):
        fiscal = F.when(F.col(k) > 0, k).otherwise(fiscal)
    t = t.select(
        "folders", "year_like", "category_like",
        F.when(by_time, "time_first").otherwise("category_first").alias("structure_type"),
        F.when(F.col("months") > 0, "month").otherwise("year").alias("time_granularity"),
        fiscal.alias("fiscal_year_type"),
        F.when(F.col("folders") > 0, F.round(F.least(F.lit(1.0), shown / F.col("folders")), 6)).otherwise(0.0).alias("confidence"),
        F.when(by_time, 0).otherwise(F.col("folders") - F.col("year_like")).cast("bigint").alias("categories"),
    )
    return t.withColumn("reasonable", (F.col("folders") > 0) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("categories") <= MAX_CATEGORIES))


def chosen_structure(folders: DataFrame, results: DataFrame) -> DataFrame:
    """One row: a reasonable structure is extended by the categories it lacks, otherwise a new one is made from the results."""
    found = folder_pattern(folders)
    new = structure(results)
    wanted = results.select("category").filter("category is not null").distinct()
    named = wanted.agg(F.count(F.lit(1)).alias("wanted"))
    lacking = wanted.join(folders.select(F.col("name").alias("category")).filter("category is not null").distinct(), "category", "left_anti").agg(F.count(F.lit(1)).alias("lacking"))
    both = found.crossJoin(new.select(F.col("structure_type").alias("new_type"), F.col("granularity").alias("new_granularity"))).crossJoin(named).crossJoin(lacking)  # one row each
    extend = F.col("reasonable")
    return both.select(
        F.when(extend, "extend").otherwise("new").alias("decision"),
        F.when(extend, F.col("structure_type")).otherwise(F.col("new_type")).alias("structure_type"),
        F.when(extend, F.col("time_granularity")).otherwise(F.col("new_granularity")).alias("time_granularity"),
        F.when(extend, F.col("fiscal_year_type")).otherwise("calendar").alias("fiscal_year_type"),
        F.when(extend, F.col("categories") + F.col("lacking")).otherwise(F.col("wanted")).alias("categories"),
        F.when(extend, F.col("lacking")).otherwise(0).cast("bigint").alias("new_categories"),
    )


# Kinds of files by suffix.
KIND_SUFFIXES = {"documents": (".pdf", ".doc", ".docx", ".txt"), "images": (".png", ".jpg", ".jpeg", ".gif", ".bmp")}


def by_kind(files: DataFrame) -> DataFrame:
    """(file_id, kind): documents, images or other, by the suffix of the name."""
    out = F.lit("other")
    for kind, suffixes in KIND_SUFFIXES.items():
        out = F.when(extension(F.col("file_name")).isin(*suffixes), kind).otherwise(out)
    return files.select("file_id", out.alias("kind"))


def zipped(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(file_id, position, left, right): two lists side by side, as far as the shorter one goes; within the row, no join."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.slice(F.arrays_zip(left, right), F.lit(1), n)
    some = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select("file_id", F.posexplode(pairs).alias("pos", "p"))
    return some.select("file_id", (F.col("pos") + 1).cast("bigint").alias("position"), F.col(f"p.{left}").alias("left"), F.col(f"p.{right}").alias("right"))


def with_counterpart(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in the other table, once each however often it occurs."""
    return rows.join(others.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


MAX_TIERS = 10_000


def in_range(rows: DataFrame, value: str, tiers: DataFrame) -> DataFrame:
    """The rows with the name of the first tier (ord, name, low, high) that holds the value, low <= value <= high.

    Values below all tiers get the first, above all the last, null values and gaps null. Up to MAX_TIERS tiers travel to
    the rows as one checked, broadcast row; more are joined on the range and the first is taken by an aggregation.
    """
    few = tiers.limit(MAX_TIERS + 1).count() <= MAX_TIERS
    if few:
        one = tiers.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "low", "high"))).alias("tiers"))
        both = rows.crossJoin(F.broadcast(one))  # one row
        v, t = F.col(value), F.col("tiers")
        inside = F.filter(t, lambda x: (x["low"] <= v) & (v <= x["high"]))
        name = F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["name"]).when(v < F.array_min(F.transform(t, lambda x: x["low"])), F.get(t, F.lit(0))["name"]).when(v > F.array_max(F.transform(t, lambda x: x["high"])), F.element_at(t, -1)["name"])
        return both.withColumn("tier", F.when(F.size(t) > 0, name)).drop("tiers")
    ends = tiers.agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min_by("name", "ord").alias("first"), F.max_by("name", "ord").alias("last"))
    inside = rows.select(value).distinct().join(tiers, (F.col("low") <= F.col(value)) & (F.col(value) <= F.col("high"))).groupBy(value).agg(F.min_by("name", "ord").alias("tier"))
    both = rows.join(inside, value, "left").crossJoin(F.broadcast(ends))  # one row
    return both.withColumn("tier", F.coalesce("tier", F.when(F.col(value) < F.col("least"), F.col("first")).when(F.col(value) > F.col("most"), F.col("last")))).drop("least", "most", "first", "last")


def processing_summary(attempts: DataFrame) -> DataFrame:
    """(by, value, n, success_share) by quality, method and type, and the totals, from one scan with grouping sets."""
    ok = (F.coalesce("quality", F.lit("failed")) != "failed").cast("double")
    a = attempts.select(F.coalesce("quality", F.lit("none")).alias("quality"), F.coalesce("extraction_method", F.lit("none")).alias("method"), F.coalesce("file_type", F.lit("none")).alias("kind"), ok.alias("ok"))
    s = a.groupingSets([["quality"], ["method"], ["kind"], []], "quality", "method", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("success_share"))
    by = F.when(F.col("quality").isNotNull(), "quality").when(F.col("method").isNotNull(), "method").when(F.col("kind").isNotNull(), "kind").otherwise("total")
    return s.select(by.alias("by"), F.coalesce("quality", "method", "kind", F.lit("")).alias("value"), "n", "success_share")
