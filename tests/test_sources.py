"""Log files with rows that don't fit."""

from __future__ import annotations

from panemill.sources import logs


def test_csv_log(spark, tmp_path):
    (tmp_path / "r.csv").write_text("run,timestamp,process_count,total_cpu_pct,tree_rss_bytes,tree_cpu_seconds\na,1,2,3.5,4,5.0\nb,x,2,3.5,4,5.0\n")
    good, bad = logs.read_csv_log(spark, str(tmp_path / "r.csv"), logs.RESOURCES)
    assert [tuple(r) for r in good.collect()] == [("a", 1, 2, 3.5, 4, 5.0)]
    assert bad.collect()[0][0].startswith("b,x")


def test_json_log(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('{"timestamp": 5, "topic": "a/final", "published_bytes": 7}\nnot json\n')
    good, bad = logs.read_json_log(spark, str(tmp_path / "t.ndjson"))
    assert [(r["timestamp"], r["topic"], r["published_bytes"]) for r in good.collect()] == [(5, "a/final", 7)]
    assert bad.count() == 1
