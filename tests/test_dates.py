"""Problem 2: one unambiguous form."""

import pytest

from quillspark.functions.datetimes import normal_form
from quillspark.operators.timestamps import estimate_zones, normalise_dates

BERLIN, CHICAGO = "Europe/Berlin", "America/Chicago"
CASES = [
    ("2012-05-19T13:44:58-05:00", BERLIN, "DMY", "2012-05-19T18:44:58.000000Z"),
    ("1426232905", CHICAGO, "MDY", "2015-03-13T07:48:25.000000Z"),
    ("1395713573034", None, None, "2014-03-25T02:12:53.034000Z"),
    ("20171003", BERLIN, "DMY", "2017-10-03"),
    ("04/05/2020", BERLIN, "DMY", "2020-05-04"),
    ("04/05/2020", CHICAGO, "MDY", "2020-04-05"),
    ("25/10/2013", CHICAGO, "MDY", "2013-10-25"),
    ("05.31.19", BERLIN, "DMY", "2019-05-31"),
    ("31/02/2020", BERLIN, "DMY", None),
    ("1er octobre 2022", BERLIN, "DMY", "2022-10-01"),
    ("10 de março de 2011", BERLIN, "DMY", "2011-03-10"),
    ("15. März 2020", BERLIN, "DMY", "2020-03-15"),
    ("Jan 30, 2013 3:22 PM", CHICAGO, "MDY", "2013-01-30T21:22:00.000000Z"),
    ("Dec 1, 2013 12:05 AM", CHICAGO, "MDY", "2013-12-01T06:05:00.000000Z"),
    ("D:20200908041451+02'00'", CHICAGO, "MDY", "2020-09-08T02:14:51.000000Z"),
    ("D:20130407035151", BERLIN, "DMY", "2013-04-07T01:51:51.000000Z"),
    ("2017-07-24T02:18:06+03:00[Europe/Berlin]", CHICAGO, "MDY", "2017-07-23T23:18:06.000000Z"),
    ("Tue, 29 Jul 2025 21:03:43 +0530", BERLIN, "DMY", "2025-07-29T15:33:43.000000Z"),
    ("2018-11-04 01:36:34", CHICAGO, "MDY", "2018-11-04T06:36:34.000000Z"),  # occurs twice: the first
    ("2018-11-04 01:36:34 CST", CHICAGO, "MDY", "2018-11-04T07:36:34.000000Z"),  # the abbreviation decides
    ("2014-03-30 02:30:00", BERLIN, "DMY", "2014-03-30T01:30:00.000000Z"),  # skipped: forward by the gap
    ("2020-01-01T00:00:00.1234567Z", BERLIN, "DMY", "2020-01-01T00:00:00.123456Z"),
    ("2020-01-01 25:00:00", BERLIN, "DMY", None),
    ("2019-13-04T10:00:00Z", BERLIN, "DMY", None),
    ("9999999999999", None, None, "2286-11-20T17:46:39.999000Z"),
    ("10:30", BERLIN, "DMY", None),
    ("2021", BERLIN, "DMY", None),
    ("May", BERLIN, "DMY", None),
    ("next Friday", BERLIN, "DMY", None),
    ("", BERLIN, "DMY", None),
    (None, BERLIN, "DMY", None),
    ("2020-05-05 10:00", None, None, None),
]


@pytest.mark.parametrize("value,zone,order,want", CASES)
def test_normal_form(value, zone, order, want):
    assert normal_form(value, zone, order) == want


FILES = "file_id bigint, creation_date string, dates_found array<string>, modification_date timestamp, site_id bigint, zone string"


def test_items(spark):
    sites = spark.createDataFrame([(1, BERLIN, "DMY", "a")], "site_id bigint, tz_name string, date_order string, zone string")
    files = spark.createDataFrame([(1, "2020-06-01 12:00", ["bad", None, "03/04/2020"], None, 1, "clash"), (2, None, None, None, None, None), (3, "20200101", [], None, 99, None)], FILES)
    out = {(r.file_id, r.field_name, r.item_no): r.normal_form for r in normalise_dates(files.unionByName(files), sites).collect()}
    assert out == {(1, "creation_date", 0): "2020-06-01T10:00:00.000000Z", (1, "dates_found", 3): "2020-04-03", (3, "creation_date", 0): "2020-01-01"}
    assert normalise_dates(files.limit(0), sites.limit(0)).count() == 0


def test_missing_zone_is_estimated(spark):
    import datetime as dt

    # taken in at UTC+9: local creation lies 9 hours after the UTC instant, minutes before the modification
    rows = [(i, f"2020-01-{i:02d} 20:00:00", None, dt.datetime(2020, 1, i, 11, 30), 7, None) for i in range(1, 20)]
    files = spark.createDataFrame(rows, FILES)
    sites = spark.createDataFrame([(7, None, "DMY")], "site_id bigint, tz_name string, date_order string")
    zones = ["UTC", "Asia/Tokyo", CHICAGO, "Australia/Sydney"]
    assert estimate_zones(files, sites, zones).first().estimated_zone == "Asia/Tokyo"
    assert normalise_dates(files, sites, zones).filter("file_id = 5").first().normal_form == "2020-01-05T11:00:00.000000Z"
