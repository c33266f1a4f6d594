"""Problem 2: mixed timestamp formats and time zones, normalised to one unambiguous form.

What a value leaves open (zone, order of day and month) comes from the site where the file was taken in. A site without a
zone gets an estimate: its zone-less local times, in any written form, are aligned with the times at which the files were
last modified, under the offset history of every candidate zone (those of the other sites and a given list), and the history with the fewest violations (created after modified, or long
before) is chosen. The conversion itself runs over Arrow batches; see functions.datetimes.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.datetimes import normal_form
from quillspark.session import broadcast_if_small

MAX_GAP_HOURS = 24 * 3650
MAX_ZONES = 1000  # more names than the zone data base has


def normalise(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    known: dict[tuple, str | None] = {}
    out = []
    for key in zip(value, zone.where(zone.notna(), None), order.where(order.notna(), None)):
        if key not in known:
            known[key] = normal_form(*key)
        out.append(known[key])
    return pd.Series(out, dtype=object)


def local_times(value: pd.Series, order: pd.Series) -> pd.Series:
    """The wall-clock time of every value with a time of day that names no zone, in any written form; else null."""
    known: dict[tuple, str | None] = {}
    out = []
    for key in zip(value, order.where(order.notna(), None)):
        if key not in known:
            form = normal_form(key[0], "UTC", key[1]) if normal_form(key[0], None, key[1]) is None else None
            known[key] = form[:-1].replace("T", " ") if form and form.endswith("Z") else None
        out.append(known[key])
    return pd.Series(out, dtype=object)


def estimate_zones(files: DataFrame, sites: DataFrame, candidates: list[str]) -> DataFrame:
    """(site_id, estimated_zone) for the sites without a zone that have local times.

    Every zone-less time of creation_date is converted under each candidate's offset history; a violation is a creation
    after the modification. Fewest violations win, then the smallest mean gap, then the zone name. The candidates are a
    list of zone names, so the fan-out is bounded, and aggregation is partial before its shuffle.
    """
    zoneless = sites.filter(F.col("tz_name").isNull()).select("site_id", "date_order")
    parse = F.pandas_udf(local_times, "string").asNondeterministic()
    near = files.select("site_id", "creation_date", F.col("modification_date").cast("timestamp").alias("modified")).filter("creation_date is not null and modified is not null")
    seen = near.join(broadcast_if_small(zoneless, like=sites), "site_id").select("site_id", "modified", F.try_to_timestamp(parse("creation_date", "date_order")).alias("local")).filter("local is not null")
    seen = seen.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in candidates])))
    gap = (F.unix_micros("modified") - F.unix_micros(F.to_utc_timestamp("local", F.col("zone")))) / 3.6e9
    scored = seen.groupBy("site_id", "zone").agg(F.count_if(gap < 0).alias("violations"), F.avg(F.least(F.abs(gap), F.lit(float(MAX_GAP_HOURS)))).alias("gap"))
    return scored.groupBy("site_id").agg(F.min_by("zone", F.struct("violations", "gap", "zone")).alias("estimated_zone"))


def normalise_dates(files: DataFrame, sites: DataFrame, zone_candidates: list[str] | None = None) -> DataFrame:
    """(file_id, field_name, item_no, normal_form) of every value with a complete, possible date.

    files: file_id, creation_date, dates_found, modification_date, site_id; further columns are ignored. A file without
    a site keeps the values that leave nothing open. Null values and null arrays give no row, item_no of later elements
    still counts null elements, repeated rows count once, empty tables give an empty result.
    """
    named = sites.select("site_id", "tz_name", "date_order").dropDuplicates(["site_id"])
    own = [r.tz_name for r in named.select("tz_name").filter("tz_name is not null").distinct().limit(MAX_ZONES).collect()]
    candidates = sorted({"UTC", *own, *(zone_candidates or [])} & available_timezones())
    guess = estimate_zones(files, named, candidates)
    places = named.join(guess, "site_id", "left").select("site_id", F.coalesce("tz_name", "estimated_zone").alias("zone"), "date_order")
    one = F.array(F.struct(F.lit("creation_date").alias("field_name"), F.lit(0).cast("bigint").alias("item_no"), F.col("creation_date").alias("value")))
    many = F.transform(
        F.coalesce("dates_found", F.array().cast("array<string>")),
        lambda v, i: F.struct(F.lit("dates_found").alias("field_name"), (i + 1).cast("bigint").alias("item_no"), v.alias("value")),
    )
    items = files.select("file_id", "site_id", F.explode(F.concat(one, many)).alias("item")).filter("item.value is not null and file_id is not null")
    placed = items.join(broadcast_if_small(places, like=named), "site_id", "left")
    # not deterministic to the optimizer, else the filter on its result evaluates it a second time
    form = F.pandas_udf(normalise, "string").asNondeterministic()
    found = placed.select("file_id", "item.field_name", "item.item_no", form("item.value", "zone", "date_order").alias("normal_form"))
    return found.filter("normal_form is not null").distinct()
