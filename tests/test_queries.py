"""Every query with SQL gives the rows of its SQL, and more than one distinct row where that can be."""

import glob
import math
import os

import duckdb
import pytest

from quillspark.plans import oracle, reference, service, service_sql, training

ONE_ROW = {"S25_log_statistics", "G03_G04_quality", "G12_overall_season", "G13_G14_fiscal_inference", "W01_density", "X04_X08_span", "G20_recent_average", "G21_W04_learning_metrics", "K03_G24_structure", "K01_G26_X11_P03_folder_pattern", "K02_chosen_structure", "G06_method_share", "S20_P09_tally", "S27_G30_call_report", "G27_retry_statistics", "G29_availability", "G16_temporal_confidence", "G14_fiscal_hints"}
QUERIES = reference.queries() | service.queries()
SQL = oracle.oracle_sql() | service_sql.oracle_sql()
EMPTY_AT_THIS_SIZE = {"L10_paged_sessions", "J05_S15_unprocessed"}


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v).replace(" 00:00:00", "")


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    if name in EMPTY_AT_THIS_SIZE:
        return
    assert len(ours) > 0
    if name not in ONE_ROW:
        assert len(set(rows(ours))) > 1


def test_rows_only_queries_run(spark, data):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, data).count() > 0, name


def test_general_training_queries_run(spark, data):
    for name, q in training.queries().items():
        assert q(spark, data).count() > 0, name


def test_clusters_cover_all_rows(spark, data):
    c = reference.queries()["M02_M03_clusters"](spark, data).toPandas()
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert len(c) == n and c.k.nunique() == 1 and 2 <= c.k.iloc[0] <= 8 and c.cluster.nunique() == c.k.iloc[0]
