"""Streams with keyed state, over several batches: disorder, duplicates, late rows, silent topics; state that doesn't stay."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from panemill.functions.time import WindowSpec
from panemill.streaming import stateful

PARTIAL = "plan string, producer string, start_ms long, end_ms long, count long, sum double, min double, max double, watermark long, arrival long"


def run(spark, rows, schema, n, make, name):
    """The table that a stream of n batches (the last column) gives, and its query's last progress."""
    table = spark.createDataFrame(rows, f"{schema}, batch int")
    stream = stateful.file_stream(spark, stateful.arrivals(table, "batch", n, name), schema)
    return stateful.run_counted(make(stream), name)


def test_pane_store_of_two_producers(spark):
    pane = lambda batch, arrival, who, at, mark, n=1: ("q", who, at, at + 10, n, float(n), float(at), float(at), mark, arrival, batch)
    rows = [
        pane(0, 1, "a", 0, 0), pane(0, 2, "b", 10, 0), pane(0, 3, "b", 0, 0),  # out of order
        pane(1, 4, "a", 10, 10), pane(1, 5, "a", 10, 10, 7),  # twice in one batch: the first counts
        pane(2, 6, "a", 0, 10, 9), pane(2, 7, "b", 0, 5), pane(2, 8, "b", 20, 4),  # twice across batches; 4 is behind 5
        pane(3, 9, "a", 20, 20), pane(3, 10, "b", 20, 20), pane(3, 11, "c", 20, 20),  # c is no producer; [0, 20) comes out here
        pane(4, 12, "b", 0, 30), pane(4, 13, "a", 30, 40), pane(4, 14, "b", 30, 60),  # 0 is gone, 30 isn't
        pane(5, 15, "a", 40, 60), ("q", "b", 40, 45, 1, 1.0, 1.0, 1.0, 70, 16, 5), ("other", "a", 0, 10, 1, 1.0, 1.0, 1.0, 90, 17, 5),
    ]
    out, _ = run(spark, rows, PARTIAL, 6, lambda s: stateful.pane_store(s, WindowSpec(20, 10), 10, ["a", "b"], ["plan"]), "two")
    got = out.collect()
    wins = {(r["win_start"], r["win_end"]): (r["panes"], r["count"], r["sum"], r["min"], r["max"], r["complete"]) for r in got if r["kind"] == "window"}
    assert wins == {
        (-10, 10): (2, 2, 2.0, 0.0, 0.0, False), (0, 20): (4, 4, 4.0, 0.0, 10.0, True), (10, 30): (4, 4, 4.0, 10.0, 20.0, True),
        (20, 40): (4, 4, 4.0, 20.0, 30.0, True), (30, 50): (3, 3, 3.0, 30.0, 40.0, False), (40, 60): (1, 1, 1.0, 40.0, 40.0, False),
    }
    dropped = sorted((r["kind"], r["producer"], r["win_start"]) for r in got if r["kind"] != "window")
    assert dropped == sorted([("duplicate", "a", 10), ("duplicate", "a", 0), ("duplicate", "b", 0), ("rejected", "b", 20), ("unknown", "c", 20), ("late", "b", 0), ("unknown", "b", 40)])


def test_pane_store_forgets_what_it_used(spark):
    rows = [("q", who, at, at + 10, 1, 1.0, 1.0, 1.0, at + 10, at * 2 + (who == "b"), at // 200) for at in range(0, 1200, 10) for who in "ab"]
    schema = PARTIAL
    table = spark.createDataFrame(rows, f"{schema}, batch int")
    stream = stateful.file_stream(spark, stateful.arrivals(table, "batch", 6, "forget"), schema)
    made = stateful.pane_store(stream, WindowSpec(10, 10), 10, ["a", "b"], ["plan"])
    stateful.rocksdb(spark)
    query = made.writeStream.format("noop").option("checkpointLocation", f"{stateful.shared_folder(spark, 'cp')}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 6 and stateful.state_rows(query) <= 3  # a watermark for each producer, and the next window


def test_pane_store_merges_what_states_support(spark):
    rows = [("q", "a", 0, 10, 2, None, None, 5.0, 10, 1, 0), ("q", "b", 0, 10, 0, None, None, None, 10, 2, 0), ("q", "a", 10, 20, 1, 3.0, 1.0, 2.0, 20, 3, 0), ("q", "b", 10, 20, 0, None, None, None, 20, 4, 0)]
    out, _ = run(spark, rows, PARTIAL, 1, lambda s: stateful.pane_store(s, WindowSpec(10, 10), 10, ["a", "b"], ["plan"]), "partial")
    assert {r["win_start"]: (r["count"], r["sum"], r["min"], r["max"]) for r in out.collect()} == {0: (2, None, None, 5.0), 10: (1, 3.0, 1.0, 2.0)}


def test_duplicates_within_and_across_batches(spark):
    rows = [(k, k * 10, 1.0 + k, b) for k, b in [(1, 0), (1, 0), (2, 0), (1, 1), (3, 1), (2, 2), (3, 3), (4, 4), (4, 4)]]
    table = spark.createDataFrame(rows, "id int, sec int, value double, batch int").withColumn("ts", F.timestamp_seconds("sec"))
    stream = stateful.file_stream(spark, stateful.arrivals(table, "batch", 5, "dup"), "id int, sec int, value double, ts timestamp")
    out, counts = stateful.run_counted(stateful.distinct_contributions(stream, ["id"], 3_600_000), "dup")
    assert counts == {"arrived": 9, "kept": 4}
    assert (out.count(), out.agg(F.sum("value")).first()[0]) == (4, 2.0 + 3.0 + 4.0 + 5.0)


def test_a_lagging_source_holds_windows_back(spark):
    fast = spark.createDataFrame([("f", k, 1.0, k // 20) for k in range(100)], "stream string, sec int, value double, batch int").withColumn("ts", F.timestamp_seconds("sec"))
    slow = spark.createDataFrame([("s", k, 1.0, k // 10) for k in range(50)], "stream string, sec int, value double, batch int").withColumn("ts", F.timestamp_seconds("sec"))
    schema = "stream string, sec int, value double, ts timestamp"
    sources = [(stateful.file_stream(spark, stateful.arrivals(rows, "batch", 5, "source"), schema), 5000) for rows in (fast, slow)]
    out, _ = stateful.run_counted(stateful.union_window_agg(sources, WindowSpec(10_000, 10_000), ["count"]), "lag")
    got = {(r["stream"], r["win_end"]): r["count"] for r in out.collect()}
    assert got == {(s, e): 10 for s in "fs" for e in (10_000, 20_000, 30_000, 40_000)}  # 49 - 5 = 44 s is the least watermark


def test_every_row_has_a_class(spark):
    rows = [(1, 100, 0), (2, 50, 0), (3, 99, 1), (4, 100, 1), (5, 40, 1), (6, 300, 2), (7, 10, 2), (8, 299, 3), (9, 120, 4)]
    stream = stateful.file_stream(spark, stateful.arrivals(spark.createDataFrame(rows, "event_id int, ms int, batch int"), "batch", 5, "late"), "event_id int, ms int")
    out = stateful.run_by_lateness(stream, WindowSpec(40, 20), 10, "late").collect()
    assert {r["event_id"]: (r["class"], r["watermark"]) for r in out} == {
        1: ("on_time", None), 2: ("on_time", None), 3: ("late", 100), 4: ("on_time", 100), 5: ("too_late", 100), 6: ("on_time", 100), 7: ("too_late", 100), 8: ("late", 300), 9: ("too_late", 300),
    }


def test_differences_between_windows(spark):
    at = [("x", 5, 0), ("y", 5, 0), ("x", 15, 1), ("y", 45, 2), ("x", 200, 3), ("z", 210, 4), ("z", 400, 5)]
    rows = spark.createDataFrame(at, "member string, sec int, batch int").withColumn("ts", F.timestamp_seconds("sec"))
    stream = stateful.file_stream(spark, stateful.arrivals(rows, "batch", 6, "diff"), "member string, sec int, ts timestamp")
    out, _ = stateful.run_counted(stateful.window_differences(stream, WindowSpec(20_000, 10_000), ["member"], 1000), "diff")
    got = sorted((r["member"], r["win_start"] // 1000, r["change"]) for r in out.collect())
    assert got == [("x", -10, "insert"), ("x", 20, "delete"), ("x", 190, "insert"), ("x", 210, "delete"), ("y", -10, "insert"), ("y", 10, "delete"), ("y", 30, "insert"), ("y", 50, "delete"), ("z", 200, "insert"), ("z", 220, "delete")]
    with pytest.raises(ValueError, match="multiple"):
        stateful.window_differences(stream, WindowSpec(25, 10), ["member"], 0)


def test_early_trigger_waits_for_topics_and_stops(spark):
    """Values come for two queries: one hears from both topics, the second of them late, the other from one only."""
    schema = "query string, topic string, value double"
    folder = f"{stateful.shared_folder(spark, 'early')}/in"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    put(("warm", "nothing", 0.0))
    stateful.rocksdb(spark)
    stream = stateful.file_stream(spark, folder, schema, 100)
    made = stateful.early_trigger(stream, WindowSpec(60_000, 2000), ["a", "b"], wait_ms=3000, most_ms=9000)
    out = stateful.shared_folder(spark, "early_out")
    query = made.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        put(("both", "a", 1.0), ("one", "a", 5.0), ("both", "b", 3.0), ("both", "c", 100.0), ("none", "c", 1.0))
        deadline = time.monotonic() + 60
        found = []
        while time.monotonic() < deadline and not {"both", "one"} <= {r["query"] for r in found}:
            time.sleep(0.5)
            if query.lastProgress and query.lastProgress["batchId"] > 1:
                found = spark.read.schema(made.schema).parquet(f"{out}/data").collect()
        first = {}
        for r in sorted(found, key=lambda r: r["win_end"]):
            first.setdefault(r["query"], r)
        assert (first["both"]["topics"], first["both"]["count"], first["both"]["sum"], first["both"]["avg"]) == (2, 2, 4.0, 2.0)
        assert (first["one"]["topics"], first["one"]["sum"]) == (1, 5.0) and first["one"]["waited_ms"] >= 3000 > first["both"]["waited_ms"]
        assert set(first) == {"both", "one"}
        while time.monotonic() < deadline and stateful.state_rows(query) > 0:
            time.sleep(0.5)
        assert stateful.state_rows(query) == 0  # silent keys are forgotten
    finally:
        query.stop()
    assert threading.active_count() < 500


def test_live_estimates_are_bounded(spark):
    schema = "topic string, start_ts timestamp, end_ts timestamp, value double"
    at = lambda c: F.timestamp_seconds(F.col(c))
    results = spark.range(60).select(F.lit("t").alias("topic"), at("id").alias("start_ts"), at("id").alias("_"), F.col("id").cast("double").alias("value"), F.floor(F.col("id") / 10).alias("batch"), "id")
    results = results.withColumn("start_ts", F.timestamp_seconds(F.col("id") * 10)).withColumn("end_ts", F.timestamp_seconds(F.col("id") * 10 + 20)).drop("_", "id").select("topic", "start_ts", "end_ts", "value", "batch")
    asked = spark.range(60).select(F.timestamp_seconds(F.col("id") * 10 + 5).alias("b_start_ts"), F.timestamp_seconds(F.col("id") * 10 + 15).alias("b_end_ts"), F.floor(F.col("id") / 10).alias("batch"))
    a = stateful.file_stream(spark, stateful.arrivals(results, "batch", 6, "r"), schema)
    b = stateful.file_stream(spark, stateful.arrivals(asked, "batch", 6, "t"), "b_start_ts timestamp, b_end_ts timestamp")
    stateful.rocksdb(spark)
    made = stateful.stream_overlap_avg(a, b, 20_000, 10_000, 1000)
    out, _ = stateful.run_counted(made, "live")
    got = {r["b_start"] // 1000: (r["avg"], r["results"]) for r in out.collect()}
    want = {}
    for k in range(60):
        lo, hi = 10 * k + 5, 10 * k + 15
        pairs = [(v, min(hi, 10 * v + 20) - max(lo, 10 * v)) for v in range(60) if 10 * v + 20 > lo and 10 * v < hi]
        want[lo] = (pytest.approx(sum(v * w for v, w in pairs) / sum(w for _, w in pairs)), len(pairs))
    assert len(got) >= 50 and all(want[k] == v for k, v in got.items())


def test_differences_are_an_aggregate_of_spark(spark, capsys):
    """No Python call for each pane and timer of a member."""
    rows = spark.createDataFrame([("x", 5, 0), ("x", 200, 1)], "member string, sec int, batch int").withColumn("ts", F.timestamp_seconds("sec"))
    stream = stateful.file_stream(spark, stateful.arrivals(rows, "batch", 2, "plan"), "member string, sec int, ts timestamp")
    stateful.window_differences(stream, WindowSpec(20_000, 10_000), ["member"], 1000).explain()
    said = capsys.readouterr().out
    assert "StateStoreSave" in said and "TransformWithState" not in said


def test_large_batches_come_in_several_files(spark):
    """Every trigger reads its own batch, whole, whatever the number of its files and rows; an empty batch too."""
    rows = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") < 3, 0).when(F.col("id") < 700, 1).otherwise(3).alias("batch"))
    stream = stateful.batch_stream(rows, "batch", 4, "files", most=100)
    from panemill.streaming.streams import run_ordered

    out = run_ordered(spark, stream, "in_files", ["n"]).groupBy("emission").agg(F.count("n").alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    assert sorted(map(tuple, out.collect())) == [(0, 3, 0, 2), (1, 697, 3, 699), (3, 300, 700, 999)]
