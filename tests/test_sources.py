"""File source and streaming intake on temporary folders."""

import json

from pyspark.sql import functions as F

from quillspark.sources import files as S
from quillspark.streaming import intake


def tree(path):
    (path / "sub").mkdir(parents=True)
    (path / "a.txt").write_text("Some words stand here. " * 30)
    (path / "sub" / "b.MD").write_text("short")
    (path / ".hidden.txt").write_text("x")
    (path / "c.pdf").write_bytes(b"%PDF")
    (path / "d.xyz").write_text("no")
    (path / "empty.txt").write_text("")
    return str(path)


def test_scan_and_extract(spark, tmp_path):
    found = S.discover(spark, tree(tmp_path / "in"))
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.txt", "b.MD", "c.pdf"}
    assert {r.path.rsplit("/", 1)[1] for r in S.discover(spark, str(tmp_path / "in"), recursive=False).collect()} == {"a.txt", "c.pdf"}
    ok = S.valid(found)

    def broken(path, content):
        raise ValueError("no reader")

    out = {r.path.rsplit("/", 1)[1]: r for r in S.extract(ok, {".pdf": broken}).collect()}
    assert out["a.txt"].quality == "excellent" and out["a.txt"].extraction_method == "text_file"
    assert out["b.MD"].quality == "failed" and out["c.pdf"].error_message == "no reader" and "empty.txt" not in out
    stats = {r.extension: (r.files, r.depth) for r in S.listing_statistics(ok, str(tmp_path / "in")).collect()}
    assert stats == {".txt": (1, 0), ".md": (1, 1), ".pdf": (1, 0)}
    assert S.decoded(S.as_base64(ok.filter("path like '%.pdf'")).first().image_data) == b"%PDF"
    assert S.older_than(ok, 1).count() == 0 and S.older_than(ok, 1, F.current_timestamp() + F.expr("INTERVAL 9 DAYS")).count() == 3


def test_small_pieces(spark):
    d = spark.createDataFrame([("n.pdf", 12, "abc", 1), ("m", 3, None, 2)], "name string, size bigint, text string, pages int")
    rows = d.select(S.placeholder(F.col("name"), F.col("size")).alias("p"), S.needs_recognition(F.col("text"), F.col("pages")).alias("r")).collect()
    assert rows[0].p == "Document: n.pdf, Size: 12 bytes" and all(r.r for r in rows)


def test_settings_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert S.read_settings(spark, path, {"mode": "a"}) == {"mode": "a"}
    S.write_settings(spark, {"mode": "b", "api_key": "k"}, path)
    assert S.read_settings(spark, path, {"mode": "a", "level": "1"}) == {"mode": "b", "level": "1"}


def test_history_appends(spark, tmp_path):
    path = str(tmp_path / "history")
    for _ in range(2):
        S.write_history(spark.createDataFrame([("s", 1)], "session string, n int"), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "land").mkdir()

    def put(name, *rows):
        lines = [json.dumps({"doc_id": i, "file_name": "f", "content": c, "arrived": a}) for i, c, a in rows]
        (tmp_path / "land" / name).write_text("\n".join(lines))

    def go():
        stream = intake.classified_stream(intake.landing(spark, str(tmp_path / "land")))
        q = intake.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
        return {r.doc_id: r.category for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("1.json", (1, "plaintiff and defendant", "2026-01-01T00:10:00"), (2, None, "2026-01-01T00:20:00"))
    assert go() == {1: "legal", 2: "other"}
    put("2.json", (3, "balance sheet", "2026-01-01T05:00:00"))
    assert go() == {1: "legal", 2: "other", 3: "financial"}
    counted = intake.counts_by_window(intake.classified_stream(intake.landing(spark, str(tmp_path / "land"))))
    q = intake.run_once(counted.select("category", "n"), str(tmp_path / "counts"), str(tmp_path / "check2"))
    q.awaitTermination(120)
    assert q.exception() is None
