"""Settings as tables: precedence, flags, export, validation, names of models and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.security import SECRET_KEYS

# Spellings of true, kinds of structure, and marks of keys.
TRUE_WORDS = ("true", "1", "yes", "on")
STRUCTURES = ("time_first", "category_first", "flat_time", "flat_category")
PLACEHOLDER_KEYS = r"(?i)^(test|fake|dummy|placeholder)|^(sk-)?1{10,}|^(sk-)?0{10,}|^(password|secret|key|token)"
UNEXPORTED = ("created_at", "modified_at", "version", "feature_flags")


def resolved(layers: DataFrame, order: tuple[str, ...] = ("cli", "env", "file", "default")) -> DataFrame:
    """(name, value, origin): the value of the first layer that has one. layers: name and a column a layer; empty strings are none."""
    value = [F.nullif(F.col(c), F.lit("")) for c in order]
    origin = F.coalesce(*[F.when(v.isNotNull(), c) for v, c in zip(value, order)])
    return layers.select("name", F.coalesce(*value).alias("value"), F.coalesce(origin, F.lit("none")).alias("origin"))


def flag(value: Column, default: Column) -> Column:
    """A flag from its text, the default where there is none."""
    return F.when(value.isNull(), default).otherwise(F.lower(F.trim(value)).isin(*TRUE_WORDS))


def export_lines(settings: DataFrame, prefix: str = "QUILL") -> DataFrame:
    """(name, line): an export line for each set value, without values that only describe the settings."""
    s = settings.filter(F.col("value").isNotNull() & ~F.col("name").isin(*UNEXPORTED))
    return s.select("name", F.concat(F.lit(f"export {prefix}_"), F.upper("name"), F.lit("='"), F.col("value"), F.lit("'")).alias("line"))


def without_secrets(settings: DataFrame) -> DataFrame:
    """(name, value): what may be saved; values of names that hold a secret are null."""
    return settings.select("name", F.when(~F.upper("name").rlike("|".join(SECRET_KEYS)), F.col("value")).alias("value"))


def joined_errors(*errors: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*errors)), "; ")


def preference_errors(p: DataFrame) -> Column:
    """What is wrong with preferences (ml_threshold, max_categories, quality_threshold, structure_type); absent ones are right."""
    return joined_errors(
        F.when(~F.col("ml_threshold").between(0, 1), "ML threshold must be between 0.0 and 1.0"),
        F.when((F.col("max_categories") < 1) | (F.col("max_categories") > 50), "Max categories must be integer between 1 and 50"),
        F.when(~F.col("quality_threshold").between(0, 1), "Quality threshold must be between 0.0 and 1.0"),
        F.when(~F.col("structure_type").isin(*STRUCTURES), "Structure type must be one of: " + ", ".join(STRUCTURES)),
    )


def configuration_errors(known_paths: Column) -> Column:
    """What is wrong with a configuration (input_dir, output_dir, provider, api_key, ml_level, ocr_language)."""

    def missing(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    return joined_errors(
        F.when(missing("input_dir"), "Input directory is required").when(~known_paths, F.concat(F.lit("Input directory does not exist: "), F.col("input_dir"))),
        F.when(missing("output_dir"), "Output directory is required"),
        F.when(missing("provider"), "Provider is required").when(missing("api_key"), F.concat(F.lit("Key required for "), F.col("provider"))),
        F.when(~F.coalesce("ml_level", F.lit(0)).isin(1, 2, 3), "Level must be 1, 2, or 3"),
        F.when(missing("ocr_language"), "Language cannot be empty"),
    )


def argument_conflicts() -> Column:
    """What is wrong with arguments (organize, no_organize, quiet, verbose, command, api_key, enable, disable, dependency_parts)."""
    return joined_errors(
        F.when(F.col("organize") & F.col("no_organize"), "organize and no-organize"),
        F.when(F.col("quiet") & F.col("verbose"), "quiet and verbose"),
        F.when(F.col("quiet") & (F.col("command") == "process") & (F.coalesce("api_key", F.lit("")) == ""), "quiet without key"),
        F.when(F.col("enable") & F.col("disable"), "enable and disable"),
        F.when(F.col("dependency_parts").isNotNull() & (F.col("dependency_parts") != 2), "dependency needs name and path"),
    )


def nearest_level(requested: Column, available: dict[int, Column]) -> Column:
    """The available level nearest to the requested one, the lower of two as near; 1 where none is available."""
    near = F.array_min(F.array_compact(F.array(*[F.when(c, F.struct(F.abs(requested - k).alias("far"), F.lit(k).alias("level"))) for k, c in available.items()])))
    return F.coalesce(near["level"], F.lit(1))


def served_name(name: Column, known: dict[str, str] | None = None) -> Column:
    """The name under which a model is served: a known one, else with a colon before the size."""
    general = F.when(name.rlike(r"^.*-(?:\d[^-]*|latest)$"), F.regexp_replace(name, "-([^-]*)$", ":$1")).otherwise(name)
    if not known:
        return general
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name), general)


def internal_name(name: Column) -> Column:
    """The name with a hyphen for the first colon."""
    return F.regexp_replace(name, "^([^:]*):", "$1-")


def key_family(key: Column) -> Column:
    return (
        F.when(F.startswith(key, F.lit("sk-ant-")), "claude")
        .when(F.startswith(key, F.lit("sk-proj-")) | F.startswith(key, F.lit("sk-")) & (F.length(key) > 20), "openai")
        .when(F.startswith(key, F.lit("AIza")), "gemini")
        .when(key.rlike("^[A-Za-z0-9]{32}$"), "deepseek")
        .otherwise("unknown")
    )


def key_verdict(key: Column) -> Column:
    n = F.length(F.coalesce(key, F.lit("")))
    return F.when(n < 10, "too short").when(n > 512, "too long").when(key.rlike(PLACEHOLDER_KEYS), "placeholder").otherwise("ok")


def masked_key(key: Column) -> Column:
    """The first ten and last four characters with stars between; of short keys the first six."""
    n = F.length(key)
    long = F.concat(F.substring(key, 1, 10), F.repeat(F.lit("*"), n - 14), F.right(key, F.lit(4)))
    short = F.concat(F.substring(key, 1, 6), F.repeat(F.lit("*"), F.greatest(n - 6, F.lit(0))))
    return F.when(n >= 14, long).otherwise(short)
