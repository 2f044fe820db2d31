"""Landed logs and blobs: broken records, and what reaches the reader."""

import datetime as dt

from tessera.sources import inputs

R, U = inputs.RECORD, inputs.UNIT


def test_history_log(spark, tmp_path):
    for repo, records in {
        "a": [f"abcdef1{U}2024-01-02T03:04:05Z{U}me{U}Fix{U}Why\n\nSigned-off-by: me <m@x>\nand more", f"abcdef2{U}2024-01-03T03:04:05Z{U}me{U}Later{U}", f"abcdef3{U}2024-01-03T03:04:05Z{U}me{U}Tie{U}"],
        "b": [f"abc{U}2024-01-02T03:04:05Z{U}me{U}x{U}y", f"abcdef4{U}soon{U}me{U}x{U}y", "torn", f"\nabcdef5{U}2024-01-02T03:04:05Z{U}{U}{U}"],
    }.items():
        (tmp_path / f"log/repo={repo}").mkdir(parents=True)
        (tmp_path / f"log/repo={repo}/part.txt").write_text(R.join(records) + R + "\n")
    rows = inputs.history_log(spark, f"{tmp_path}/log", 2).collect()
    assert sorted((r.repo, r.sha, r.subject) for r in rows if not r.error) == [("a", "abcdef2", "Later"), ("a", "abcdef3", "Tie"), ("b", "abcdef5", "")]
    assert sorted((r.repo, r.error, r.sha) for r in rows if r.error) == [("b", "1 fields", None), ("b", "no commit id", None), ("b", "no date", None)]
    whole = {r.sha: r for r in inputs.history_log(spark, f"{tmp_path}/log").collect()}
    assert whole["abcdef1"].body == "Why\n\nand more" and whole["abcdef1"].committed_at == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_blobs_are_judged_by_size_before_they_are_read(spark, tmp_path):
    rows = [("r", "a", 3, b"abc"), ("r", "b", 5, b"x" * 5), ("r", "c", 2, b"\xff\xfe"), ("r", "d", 2, b"a\0"), ("r", "e", 1, None), ("r", "f", None, b"q"), ("r", "g", 0, b"")]
    spark.createDataFrame(rows, "repo string, path string, size long, content binary").write.parquet(f"{tmp_path}/tree")
    found = inputs.blobs(spark.read.parquet(f"{tmp_path}/tree"), 4)
    assert {r.path: (r.status, r.body) for r in found.collect()} == {"a": ("ok", "abc"), "b": ("too_large", None), "c": ("binary", None), "d": ("binary", None), "e": ("missing", None), "f": ("missing", None), "g": ("ok", "")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,4)" in plan and plan.count("content:binary") == 1  # the large ones' contents are not a column of their scan


def test_large_files_are_not_opened(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/small").write_bytes(b"ok")
    (tmp_path / "d/large").write_bytes(b"x" * 100)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/d").selectExpr("'r' AS repo", "regexp_extract(path, '[^/]*$', 0) AS path", "length", "content")
    found = inputs.blobs(files, 10, "length")
    assert {(r.path, r.status, r.body) for r in found.collect()} == {("small", "ok", "ok"), ("large", "too_large", None)}
    assert "LessThanOrEqual(length,10)" in found._jdf.queryExecution().executedPlan().toString()
