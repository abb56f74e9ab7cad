"""File sources, sinks and saved progress."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, progress, shared


def test_cases(spark, tmp_path):
    at = tmp_path / "cases.jsonl"
    at.write_text("\n".join([json.dumps({"case_id": "a", "query": "q", "relevance": {"1": 3, "2": 0}}), "", json.dumps({"case_id": "b", "query": "r", "top_k": 5})]))
    cases = files.load_cases(spark, str(at))
    assert {r["case_id"]: r["top_k"] for r in cases.collect()} == {"a": 10, "b": 5}
    assert sorted(map(tuple, files.qrels(cases).collect())) == [("a", "1", 3), ("a", "2", 0)]
    at.write_text(json.dumps({"case_id": "a", "query": "q"}) + "\n" + json.dumps({"case_id": "a", "query": "r"}))
    with pytest.raises(ValueError, match="repeated"):
        files.load_cases(spark, str(at))


def test_json_csv(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"case_id": "a"}, {"case_id": "b"}]')
    assert files.scan_json(spark, str(tmp_path / "x.json"), files.CASE).count() == 2 and files.scan_json(spark, str(tmp_path / "none.json"), files.CASE).count() == 0
    (tmp_path / "d.csv").write_text("﻿draft_id,query,review_status\n1,a,query_drafted\n2, ,query_drafted\n3,b,open\n", encoding="utf-8")
    drafts = files.load_drafts(spark, str(tmp_path / "d.csv"))
    assert [r["draft_id"] for r in drafts.collect()] == ["1"]
    files.write_csv(drafts, f"{tmp_path}/out", ["query", "draft_id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["query", "draft_id"]
    with pytest.raises(Exception, match="exist"):
        files.write_csv(drafts, f"{tmp_path}/out", ["query"])


def test_progress(spark, tmp_path):
    at = f"file://{tmp_path}/p.json"
    assert progress.load(spark, at, "s") is None
    progress.save(spark, progress.Progress("s", "running"), at)
    progress.save(spark, progress.Progress("s", "failed", last_source_id=20, loaded_rows=2), at)
    found = progress.load(spark, at, "s")
    assert found.last_source_id == 20 and found.status == "failed" and found.updated_at
    with pytest.raises(ValueError, match="progress of s"):
        progress.load(spark, at, "t")
    with pytest.raises(ValueError):
        progress.Progress("s", "odd")
    for broken in ("{", '{"source": "s"}', '{"source": "s", "status": "running", "last_source_id": -1}', '{"source": "s", "status": "running", "version": 2}'):
        shared.write_text(spark, at, broken)
        with pytest.raises(ValueError):
            progress.load(spark, at, "s")
    progress.remove(spark, at)
    progress.remove(spark, at)
    assert progress.load(spark, at, "s") is None


def test_reports(spark, tmp_path):
    at, cases = f"file://{tmp_path}/r.json", spark.range(3)
    files.write_report(spark, at, {"k": 5}, cases.agg({"id": "sum"}), cases)
    assert files.read_report(spark, at) == {"configuration": {"k": 5}, "summary": [{"sum(id)": 3}], "cases": [{"id": 0}, {"id": 1}, {"id": 2}]}
    shared.write_text(spark, at, "{}")
    with pytest.raises(ValueError, match="no cases"):
        files.read_report(spark, at)
    with pytest.raises(FileNotFoundError):
        files.read_report(spark, at + "x")
    with pytest.raises(ValueError, match="at most"):
        files.write_report(spark, at, {}, cases, cases, most=2)


def test_marked_csv(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("求助", 1)], "a string, b int").coalesce(1), f"{tmp_path}/out", ["b", "a"], mark=True)
    text = next(tmp_path.glob("out/part-*")).read_bytes()
    assert text == "\ufeffb,a\n1,求助\n".encode()


def test_vectors_and_names(spark):
    got = spark.range(1).select(files.vector_text(F.array(F.lit(0.5), F.lit(-1.0)), 2).alias("v")).first().v
    assert got == "[0.500000000,-1.00000000]" or [float(x) for x in got.strip("[]").split(",")] == [0.5, -1.0]
    with pytest.raises(Exception, match="finite"):
        spark.range(1).select(files.vector_text(F.array(F.lit(0.5)), 2)).collect()
    assert files.safe_name("a.b_c") == "`a.b_c`"
    with pytest.raises(ValueError):
        files.safe_name("a; drop")


def test_profiles(spark):
    rows = spark.createDataFrame([("7", "25-34", None), (None, "18-24", ["x"]), ("u", None, ["y"])], "id string, age_bucket string, interests array<string>")
    got = sorted((r.user_id, r.age, r.interests) for r in files.scan_profiles(rows).collect())
    assert got == [("u", None, ["y"]), ("user_0007", 29, [])]
