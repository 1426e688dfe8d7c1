"""Literal cases of the operators, and panes against direct windows over random specifications."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panemill.functions.tables import numbered, quantiles, small
from panemill.functions.time import WindowSpec, align_start, parse_iso_ms
from panemill.operators import approx, pane_table, panes, relational, windows
from panemill.plans import reuse
from panemill.reports import metrics, signature, traffic
from panemill.sources import logs, observations
from panemill.streaming import streams

SUB = "topic string, start_ms long, end_ms long, value double"
BOTH = "b_start long, b_end long"


def sub(spark, *rows):
    return spark.createDataFrame([("t", s, e, float(v)) for s, e, v in rows], SUB)


def target(spark, lo, hi):
    return spark.createDataFrame([(lo, hi)], BOTH)


def test_interval_mathematics(spark):
    assert approx.approx_overlap_avg(sub(spark, (0, 10, 10), (8, 20, 40)), target(spark, 5, 15), 7).first()["avg"] == pytest.approx(27.5)
    assert approx.approx_rate(sub(spark, (0, 10, 100), (5, 15, 50)), target(spark, 0, 15), 7).first()["sum"] == pytest.approx(150)
    assert approx.approx_rate(sub(spark, (0, 10, 2), (5, 15, 3)), target(spark, 0, 15), 4).first()["segment_count"] == pytest.approx(10)
    row = approx.approx_rate(sub(spark, (0, 10, 7), (5, 15, 3), (8, 12, 9)), target(spark, 6, 11), 100).first()
    assert (row["min"], row["max"]) == (3, 9)
    assert approx.approx_rate(sub(spark, (0, 10, 1), (20, 30, 2)), target(spark, 10, 20), 7).count() == 0


def test_sweep_over_results_that_overlap_thousands_of_times(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    start = rng.integers(0, 40_000, 20_000)
    end, value = start + rng.integers(1, 20_000, 20_000), rng.integers(-50, 50, 20_000).astype(float)
    rows = spark.createDataFrame(list(zip(["t"] * 20_000, start.tolist(), end.tolist(), value.tolist(), strict=True)), SUB).unionByName(spark.createDataFrame([("u", 5, 5, 1.0), ("u", 7, 9, None), ("w", 100, 110, 3.0)], SUB))
    asked = [(lo, lo + span) for lo, span in zip(rng.integers(-5000, 60_000, 40).tolist(), rng.choice([1, 7, 64, 1000, 30_000], 40).tolist(), strict=True)] + [(95, 105), (110, 120), (90, 100), (50, 50)]
    got = {(r["topic"], r["b_start"], r["b_end"]): (r["sum"], r["segment_count"]) for r in approx.approx_rate_sums(rows, spark.createDataFrame(asked, BOTH), 5000).collect()}
    want, bounds = {}, np.unique(np.concatenate([start, end]))
    for lo, hi in set(asked):
        held = (end > lo) & (start < hi)
        if lo < hi and held.any():
            s, e, v = start[held], end[held], value[held]
            cuts = np.concatenate([[lo], bounds[(bounds > lo) & (bounds < hi)]])
            segments = np.searchsorted(cuts, np.minimum(e, hi)) - np.searchsorted(cuts, np.maximum(s, lo))
            want["t", lo, hi] = ((v / (e - s) * (np.minimum(e, hi) - np.maximum(s, lo))).sum(), (v * segments).sum())
    assert {k for k in got if k[0] == "t"} == want.keys()
    assert all(got[k] == pytest.approx(w, rel=1e-9, abs=1e-6) for k, w in want.items())
    assert got["w", 95, 105] == (pytest.approx(1.5), 3.0) and ("w", 90, 100) not in got and ("w", 110, 120) not in got and not [k for k in got if k[0] == "u"]


def test_every_pair_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(approx, "is_small", lambda df: False)
    a, b = spark.range(20), spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert approx.all_pairs(a, b).distinct().count() == 60


def test_chunk_size():
    assert panes.chunk_size([WindowSpec(60, 30), WindowSpec(45, 15)]) == 15
    assert panes.chunk_size([]) == 1
    with pytest.raises(ValueError):
        WindowSpec(0, 1)


def test_gcd_column(spark):
    rows = spark.createDataFrame([([12, 18, 30],), ([],), ([7],), ([2**40, 2**35 * 3],)], "x array<bigint>")
    assert [r[0] for r in rows.select(reuse.gcd_column(F.col("x"))).collect()] == [6, 1, 7, 2**35]


def test_recomposition_of_complete_panes(spark):
    o = 1_000_000
    rows = [("s", o, o + 60_000, 480, -11034.7204), ("s", o + 60_000, o + 120_000, 482, -11086.002512)]
    states = spark.createDataFrame(rows, "stream string, start_ms long, end_ms long, count long, sum double").withColumn("min", F.lit(None).cast("double")).withColumn("max", F.lit(None).cast("double"))
    row = panes.recompose(states, WindowSpec(120_000, 60_000, o), 60_000, require_complete=True).first()
    assert row["count"] == 962
    assert row["sum"] == pytest.approx(-22120.722912)
    assert row["avg"] == pytest.approx(-22.99451446153846)


def test_panes_of_another_origin_feed_no_window(spark):
    o = 1_785_924_223_543
    rows = [(o + 60_000, o + 120_000, "a"), (o - 30_000, o + 30_000, "b"), (o, o + 50_000, "narrow")]
    states = spark.createDataFrame(rows, "start_ms long, end_ms long, k string")
    found = panes.chunks_to_windows(states, WindowSpec(120_000, 60_000, o), 60_000).collect()
    assert sorted((r["k"], r["win_start"] - o) for r in found) == [("a", 0), ("a", 60_000)]
    keys = spark.range(1).select(panes.expected_keys(F.lit(o), F.lit(o + 120_000), 60_000, o)).first()[0]
    assert keys == [f"{o}:{o}:{o + 60_000}", f"{o}:{o + 60_000}:{o + 120_000}"]
    assert panes.chunks_to_windows(states, WindowSpec(100_000, 60_000), 60_000).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 30), st.integers(1, 4), st.integers(-5, 5), st.lists(st.tuples(st.sampled_from("ab"), st.integers(-40, 90), st.integers(0, 9), st.one_of(st.none(), st.floats(-100, 100)), st.booleans()), max_size=25))
def test_running_aggregates_equal_copies(spark, r, s, o, rows):
    schema = "stream string, start_ms long, end_ms long, count long, sum double, min double, max double, range_ms long, step_ms long, origin_ms long"
    made = [(k if k == "a" else None, 50 * at, 50 * at + 50, n if n < 8 else None, v, v, None if odd else v, 50 * r, 50 * s, 50 * o) for k, at, n, v, odd in rows]
    states = spark.createDataFrame(made, schema)
    both = [
        {(x["stream"], x["win_start"], x["win_end"], x["panes"], x["count"], x["min"], x["max"], x["sum"] is None): x["sum"] for x in panes._recomposed(states, 50, ["stream"], copied).collect()}
        for copied in (True, False)
    ]
    assert both[0].keys() == both[1].keys()
    assert all(v is None or both[1][k] == pytest.approx(v, abs=1e-6) for k, v in both[0].items())


def test_wide_ranges_cost_no_copies(spark):
    states = spark.range(3000).select(F.lit("s").alias("stream"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 1000).alias("end_ms"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("sum"), F.col("id").cast("double").alias("min"), F.col("id").cast("double").alias("max"))
    spec = WindowSpec(259_200_000, 3_600_000)  # three days over panes of a second: 259,200 panes a window
    out = {r["win_start"]: (r["panes"], r["sum"], r["min"], r["max"]) for r in panes.recompose(states, spec, 1000).collect()}
    assert len(out) == 72 and set(out.values()) == {(3000, 3000.0, 0.0, 2999.0)}


def test_specifications_that_do_not_fit_are_named(spark):
    states = spark.createDataFrame([("s", 0, 10, 1, 1.0, 1.0, 1.0)], "stream string, start_ms long, end_ms long, count long, sum double, min double, max double")
    specs = spark.createDataFrame([("a", 20, 10, 0), ("b", 25, 10, 0), ("c", 20, 15, 0), ("d", 20, 10, 3)], "id string, range_ms long, step_ms long, origin_ms long")
    assert panes.unfit_specs(specs, 10) == {"b": "range", "c": "step", "d": "origin"}
    with pytest.raises(ValueError, match="'b': 'range'"):
        panes.derive_original(states, specs, 10)
    assert panes.derive_original(states, specs.where("id = 'a'"), 10).count() == 2
    assert panes.derive_original(states, specs.where("id = 'z'"), 10).count() == 0
    with pytest.raises(ValueError, match="step"):
        panes.recompose(states, WindowSpec(20, 15), 10)
    assert {(r["id"], r["win_start"]) for r in panes.derive_original(states, specs.where("id in ('a', 'd')").withColumn("origin_ms", F.lit(30)), 10).collect()} == {("a", -10), ("a", 0), ("d", -10), ("d", 0)}


def test_divisions_by_nothing_are_null(spark):
    obs = spark.createDataFrame([(1, "a", 5, 1.0), (2, "b", 5, 1.0), (3, "b", 5, 1.0), (4, "b", 1005, 1.0)], "event_id long, stream string, ms long, value double")
    assert [r["gap"] for r in metrics.inactivity(obs, ["stream"], 1, 10_000).collect()] == [1000]
    lag = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("b", 3, 5)], "k string, target_publish_time long, actual_publish_time long")
    assert {r["k"]: r["replay_speed"] for r in traffic.publish_lag(lag, ["k"]).collect()} == {"a": None, "b": pytest.approx(2 / 3)}
    samples = spark.createDataFrame([("a", 1000, 1.0), ("a", 1000, 2.0), ("a", 7_201_000, 3.0), ("b", 5, 1.0)], "k string, t long, c double")
    assert {r["k"]: r["mean_pct"] for r in traffic.counter_rate(samples, "t", "c", ["k"], 1).collect()} == {"a": pytest.approx(100 / 7200)}
    assert {r["k"]: (r["growth"], r["resets"]) for r in traffic.counter_delta(samples, "t", "c", ["k"]).collect()} == {"a": (2.0, 0), "b": (0.0, 0)}
    assert panes.weighted_merge(spark.createDataFrame([("a", 1.0, 0)], "k string, value double, count long"), ["k"]).first()["avg"] is None
    assert reuse.reuse_density(spark.createDataFrame([], "query_id string, consumer_id string, query_text string")).first()["reused_share"] is None
    assert {r["stream"]: r["mean_interval_ms"] for r in signature.window_stats(obs, 10_000).collect()} == {"a": None, "b": 500.0}
    assert approx.approx_pair(spark.createDataFrame([(1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0)], "v1 double, d1 double, v2 double, d2 double, vo double, dov double, dt double")).first()["avg"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 4), st.integers(1, 5), st.integers(1, 6), st.lists(st.tuples(st.integers(0, 3000), st.floats(-100, 100)), max_size=30))
def test_panes_equal_direct_windows(spark, pane, r, s, rows):
    pane *= 50
    spec = WindowSpec(pane * r, pane * s)
    obs = spark.createDataFrame([("x", ms, v) for ms, v in rows], "stream string, ms long, value double")
    direct = {(x["win_start"], x["count"]): x["sum"] for x in windows.exact_baseline(obs, spec).collect()}
    made = {(x["win_start"], x["count"]): x["sum"] for x in panes.recompose(panes.chunk_states(obs, pane), spec, pane).collect()}
    assert direct.keys() == made.keys()
    for k, v in direct.items():
        assert made[k] == pytest.approx(v, abs=1e-6)


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(0, 100), (50, 60), (200, 210)], "start_ms long, end_ms long")
    b = spark.createDataFrame([(0, 100), (99, 201), (210, 220)], BOTH)
    assert sorted(tuple(r) for r in relational.overlap_join(a, b, 10).collect()) == [(0, 100, 0, 100), (0, 100, 99, 201), (50, 60, 0, 100), (200, 210, 99, 201)]


def test_alias_conflict():
    with pytest.raises(ValueError):
        windows.agg_columns([("avg", "x"), ("sum", "x")])


def test_alignment_and_time(spark):
    row = spark.range(1).select(align_start(F.lit(1005), 100, 7), parse_iso_ms(F.lit("2024-01-01T00:00:00.500Z")), parse_iso_ms(F.lit("nonsense"))).first()
    assert tuple(row) == (907 + 0, 1_704_067_200_500, None)


def test_downsample_keeps_sparse_streams(spark):
    rows = [(1, "dense", 0, 1.0), (2, "dense", 400, 2.0), (3, "dense", 1100, 3.0), (4, "sparse", 0, 1.0), (5, "sparse", 1500, 2.0), (6, "sparse", 2500, 3.0)]
    obs = spark.createDataFrame(rows, "event_id long, stream string, ms long, value double")
    assert sorted(r["event_id"] for r in observations.downsample(obs, 1000).collect()) == [1, 3, 4, 5, 6]


def test_ntriples_lines(spark):
    text = '<urn:a> <urn:p> "x \\" y"^^<http://www.w3.org/2001/XMLSchema#string> . <urn:a> <urn:q> <urn:b> . junk'
    rows = observations.parse_ntriples(spark.createDataFrame([(text,), (None,), ("",)], "value string")).collect()
    assert [tuple(r) for r in rows] == [("urn:a", "urn:p", 'x " y', "string"), ("urn:a", "urn:q", "urn:b", "iri")]


def test_ntriples_terms(spark):
    cases = {
        "_:b0 <urn:b> <urn:c> .": [("_:b0", "urn:b", "urn:c", "iri")],
        '<urn:a> <urn:b> "x"@en .': [("urn:a", "urn:b", "x", "@en")],
        "# <urn:a> <urn:b> <urn:c> .": [],
        '  <urn:a>\t<urn:b>\t"a#b . <x>" . # "c" <d> .': [("urn:a", "urn:b", "a#b . <x>", "string")],
        '<urn:a> <urn:b> "\\t\\n\\\\u0041\\u0041\\U0001F600\\\\" .': [("urn:a", "urn:b", "\t\n\\u0041A😀\\", "string")],
        '<urn:a> <urn:b> "1"^^<urn:no-hash> .': [("urn:a", "urn:b", "1", "urn:no-hash")],
        '<urn:a> <urn:b> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .': [("urn:a", "urn:b", "1", "integer")],
        "<urn:a> <urn:b> _:x.y .": [("urn:a", "urn:b", "_:x.y", "blank")],
        '<urn:\\u00e9> <urn:b> "" .': [("urn:é", "urn:b", "", "string")],
        '<urn:a> <urn:b> "open .': [],
        "_:b <not an iri> <urn:c> .": [],
        '"literal" <urn:b> <urn:c> .': [],
        "": [],
    }
    lines = spark.createDataFrame([(k, line) for k, line in enumerate(cases)], "k int, value string")
    for k, (line, want) in enumerate(cases.items()):
        assert [tuple(r) for r in observations.parse_ntriples(lines.where(F.col("k") == k)).collect()] == want, line
    assert sorted(r["k"] for r in observations.rejected_ntriples(lines).collect()) == [9, 10, 11]
    odd = spark.createDataFrame([("_:s", "urn:p", 'q"\\\n\r', "@en-GB"), ("urn:s", "urn:p", "_:o", "blank"), ("urn:s", "urn:p", "1", "urn:t"), ("urn:s", "urn:p", "urn:o", "iri"), ("urn:s", "urn:p", "1.5", "double")], "s string, p string, o string, o_type string")
    assert sorted(map(tuple, observations.parse_ntriples(observations.to_ntriples(odd, one_line=False)).collect())) == sorted(map(tuple, odd.collect()))


def test_values_survive_as_triples(spark):
    values = [0.00001, 1.234567, 1e20, -0.0, 123456.789, 1e-300, None]
    obs = spark.createDataFrame([(k, "a", v) for k, v in enumerate(values)], "event_id long, stream string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r["subject"]: r["value"] for r in observations.pivot_observations(observations.parse_ntriples(observations.to_ntriples(observations.to_triples(obs), one_line=False))).collect()}
    assert got == {f"urn:obs:{k}": v for k, v in enumerate(values)}


def test_states_claim_only_what_was_watched(spark):
    rows = spark.createDataFrame([("s", 0, 10, 1, 1.0, 0, 20), ("s", 10, 20, 1, 1.0, 0, 15), ("s", 20, 30, 0, None, 25, 40)], "stream string, start_ms long, end_ms long, count long, sum double, coverage_origin long, input_watermark long").withColumns({"min": F.col("sum"), "max": F.col("sum")})
    said = lambda df: ['"temporally_complete":true' in r["payload"] for r in observations.to_result_json(df).collect()]
    assert said(rows) == [True, False, False] and said(rows.drop("coverage_origin")) == [False] * 3
    good, bad = panes.temporally_complete(rows.withColumn("claims_complete", F.col("start_ms") < 20))
    assert [r["start_ms"] for r in good.collect()] == [0] and [r["start_ms"] for r in bad.collect()] == [10]


def test_a_star_with_a_constant(spark):
    triples = spark.createDataFrame([("a", "p", "1"), ("a", "p", "2"), ("a", "q", "x"), ("b", "p", "2"), ("b", "q", "y"), ("c", "p", "1")], "s string, p string, o string")
    assert sorted(map(tuple, relational.star_join(triples, {"one": "p", "two": "q"}, having={"one": "1"}).collect())) == [("a", "1", "x")]
    assert relational.star_join(triples, {"one": "p", "two": "q"}, having={"one": "1", "two": "y"}).count() == 0


def test_overlaps_of_seconds_and_years(spark):
    import random

    rng = random.Random(12)
    of = lambda n: [(lo := rng.randint(-10**9, 10**9), lo + rng.choice([0, 1, 2, 3, 1000, 2**20, 2**20 + 1, 31_536_000_000])) for _ in range(n)]
    left, right = of(60), of(60)
    a = spark.createDataFrame([(k % 2, *x) for k, x in enumerate(left)], "k int, start_ms long, end_ms long")
    b = spark.createDataFrame([(k % 2, *x) for k, x in enumerate(right)], "k int, b_start long, b_end long")
    got = sorted((r["k"], r["start_ms"], r["end_ms"], r["b_start"], r["b_end"]) for r in relational.overlap_join_mixed(a, b, ["k"]).collect())
    want = sorted((k % 2, *x, *y) for k, x in enumerate(left) for j, y in enumerate(right) if k % 2 == j % 2 and x[0] < x[1] and y[0] < y[1] and x[1] > y[0] and x[0] < y[1])
    assert got == want and len(got) > 100
    assert relational.overlap_join_mixed(a.limit(0), b, ["k"]).count() == 0


def test_a_pane_table_grows_by_updates(spark, tmp_path):
    path = str(tmp_path / "table")
    day = 86_400_000
    make = lambda rows: spark.createDataFrame(rows, "stream string, ms long, value double")
    first, second = [("a", k * day // 7, float(k)) for k in range(20)], [("a", k * day // 7 + 5, 1.0) for k in range(15, 40)] + [("b", 3 * day, 2.0)]
    pane_table.add_panes(make(first), path, "1", day // 4)
    pane_table.add_panes(make(second), path, "2", day // 4)
    pane_table.add_panes(make(second), path, "2", day // 4)  # repeated: replaces itself
    whole = {(r["stream"], r["start_ms"]): (r["count"], r["sum"]) for r in panes.chunk_states(make(first + second), day // 4).collect()}
    assert {(r["stream"], r["start_ms"]): (r["count"], r["sum"]) for r in pane_table.read_panes(spark, path).collect()} == whole
    part = pane_table.read_panes(spark, path, lo_ms=day, hi_ms=2 * day)
    assert {(r["stream"], r["start_ms"]): (r["count"], r["sum"]) for r in part.collect()} == {k: v for k, v in whole.items() if day <= k[1] < 2 * day}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    shared = pane_table.share(part, str(tmp_path / "shared"))
    assert "shared" in shared._jdf.queryExecution().optimizedPlan().toString() or sorted(map(tuple, shared.collect())) == sorted(map(tuple, part.collect()))
    assert shared.inputFiles() and all("/shared/" in f for f in shared.inputFiles())


def test_a_stream_fills_a_pane_table(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([("a", k * 100 + j, 1.0) for j in range(10)], "stream string, ms long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, ms long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pane_table.stream_to_panes(stream, str(tmp_path / "table"), str(tmp_path / "cp"), 150).awaitTermination()
    assert {r["start_ms"]: r["count"] for r in pane_table.read_panes(spark, str(tmp_path / "table")).collect()} == {0: 20, 150: 10, 300: 20}


def test_lost_sinks_release_their_batch(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def broken(batch, number):
        raise RuntimeError("lost")

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    query = streams.fan_out(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), [broken], str(tmp_path / "cp"))
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_an_interval_trigger_takes_files_as_they_come(spark, tmp_path):
    import time

    put = lambda lo: spark.range(lo, lo + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0)
    seen: dict[int, list[int]] = {}
    sink = lambda batch, number: seen.__setitem__(number, sorted(r["id"] for r in batch.collect()))
    query = streams.fan_out(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), [sink], str(tmp_path / "cp"), processingTime="500 milliseconds")
    try:
        deadline = time.monotonic() + 40
        while time.monotonic() < deadline and len(seen) < 1:
            time.sleep(0.1)
        put(5)
        while time.monotonic() < deadline and len(seen) < 2:
            time.sleep(0.1)
    finally:
        query.stop()
    assert seen == {0: [0, 1, 2, 3, 4], 1: [5, 6, 7, 8, 9]}  # a batch without rows doesn't run


def test_lines_hold_a_subject_each(spark):
    obs = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "event_id long, stream string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    triples = observations.to_triples(obs)
    for lines in (observations.to_ntriples(triples), observations.to_lines(obs)):
        assert lines.count() == 2
        assert sorted(map(tuple, observations.parse_ntriples(lines).collect())) == sorted(map(tuple, triples.where("o is not null").collect()))
    assert observations.to_ntriples(triples, one_line=False).count() == 6


def test_result_messages_of_both_shapes(spark):
    rows = [('{"window":{"start":1,"end":2},"sum":3.0}',), ('{"window_start":1,"window_end":2,"resultValue":5}',), ("no json",), ('{"window_start":1}',), (None,)]
    good, bad = observations.parse_result_messages(spark.createDataFrame(rows, "payload string"))
    assert sorted(r["value"] for r in good.collect()) == [3.0, 5.0]
    assert bad.count() == 3


def test_reuse_classes(spark):
    window = "FROM NAMED WINDOW :w ON STREAM <s> [RANGE 60 STEP 30]"
    body = "WHERE { ?o :v ?v }"
    cases = {
        f"SELECT (AVG(?v) AS ?x) {window} {body}": "",
        f"SELECT (COUNT(*) AS ?x) {window} {body}": "",
        f"SELECT (SUM(?v) AS ?x) (MIN(?v) AS ?y) {window} {body}": "",
        f"SELECT (AVG(?v) AS ?x) {window} WHERE {{ ?o :v ?v FILTER(?v > 1) }}": "construct",
        f"SELECT DISTINCT (AVG(?v) AS ?x) {window} {body}": "construct",
        f"SELECT (AVG(?v)) {window} {body}": "aggregate",
        f"SELECT (AVG(?v) AS ?x) (SUM(?w) AS ?y) {window} {body}": "variables",
        f"SELECT (SUM(*) AS ?x) {window} {body}": "variables",
        f"SELECT (AVG(?v) AS ?x) {body}": "windows",
    }
    log = spark.createDataFrame([(str(k), "c", q) for k, q in enumerate(cases)], "query_id string, consumer_id string, query_text string")
    got = {r["query_text"]: r["reason"] for r in reuse.reuse_class(log).collect()}
    assert got == cases


def test_cadence(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 130, 205, 260, 301)], "k string, emitted_at long")
    assert sorted(r["emitted_at"] for r in streams.cadence_filter(rows, 100, 10, ["k"]).collect()) == [0, 100, 205, 301]


def test_empty_tables(spark):
    obs = spark.createDataFrame([], "event_id long, stream string, sensor long, ms long, value double")
    spec = WindowSpec(100, 50)
    assert windows.exact_baseline(obs, spec).count() == 0
    assert panes.recompose(panes.chunk_states(obs, 50), spec, 50).count() == 0
    assert observations.downsample(obs, 10).count() == 0
    assert metrics.series_profile(obs, ["stream"]).count() == 0


def test_nulls_are_left_out_of_aggregates(spark):
    obs = spark.createDataFrame([(1, "s", 10, None), (2, "s", 20, 4.0)], "event_id long, stream string, ms long, value double")
    row = windows.tumbling_agg(obs, 100, ["count", "count_all", "avg"]).first()
    assert (row["count"], row["count_all"], row["avg"]) == (1, 2, 4.0)


def test_streaming_cadence_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 130, 205, 260, 301)], "stream string, emitted_at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = streams.run_to_table(spark, streams.stream_cadence(stream, 100, 10, "stream"), "cadence")
    assert sorted(r["emitted_at"] for r in out.collect()) == [0, 100, 205, 301]


def test_fan_out(spark, tmp_path):
    rows = spark.range(10)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    sinks = [lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.where("id > 4").count()))]
    streams.fan_out(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), sinks, str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", 10), ("b", 5)]


def test_upserts_keep_the_latest_version(spark, tmp_path):
    for k, rows in enumerate([[(0, "a", 1.0), (10, "a", 3.0)], [(20, "a", 5.0), (15, "b", 1.0)]]):
        made = spark.createDataFrame(rows, "sec long, stream string, value double").withColumn("ts", F.timestamp_seconds("sec"))
        made.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("sec long, stream string, value double, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = streams.stream_window_agg(stream, WindowSpec(60_000, 60_000), ["count", "sum"], 60_000)
    out = {r["stream"]: r for r in streams.run_upserts(spark, rows, "upserts", ["stream", "win_start", "win_end"]).collect()}
    assert (out["a"]["count"], out["a"]["sum"], out["a"]["versions"]) == (3, 9.0, 2)
    assert (out["b"]["count"], out["b"]["versions"]) == (1, 1)


def test_early_windows_count_what_arrived(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)], "stream string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, value double").parquet(str(tmp_path / "in"))
    rows = streams.early_windows(stream, WindowSpec(3_600_000, 3_600_000), ["count"])
    out = streams.run_upserts(spark, rows, "early", ["stream", "win_start", "win_end"]).groupBy("stream").agg(F.sum("count").alias("n")).collect()
    assert {r["stream"]: r["n"] for r in out} == {"a": 3, "b": 1}


def test_a_quiet_stream_is_stopped(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    assert streams.stop_when_quiet(query, most_ms=1500) >= 1.4
    assert not query.isActive


def test_a_pane_without_a_sum_spoils_no_average(spark):
    rows = [("s", 0, 10, 10, 100.0, None, 1.0, 9.0), ("s", 10, 20, 10, None, None, 2.0, 8.0), ("e", 0, 10, 10, 100.0, None, 1.0, 9.0), ("e", 10, 20, 0, None, None, None, None), ("f", 0, 10, 10, float("nan"), 7.0, 1.0, 9.0)]
    states = spark.createDataFrame(rows, "stream string, start_ms long, end_ms long, count long, sum double, avg double, min double, max double")
    spec = WindowSpec(20, 20)
    out = {r["stream"]: (r["count"], r["sum"], r["avg"], r["min"]) for r in panes.recompose(states, spec, 10).collect()}
    assert out == {"s": (20, None, None, 1.0), "e": (10, 100.0, 10.0, 1.0), "f": (10, 70.0, 7.0, 1.0)}
    assert {r["stream"]: r["avg"] for r in panes.recompose_flat(states, ["stream"]).collect()} == {"s": None, "e": 10.0, "f": 7.0}
    specs = spark.createDataFrame([("q", 20, 20)], "id string, range_ms long, step_ms long")
    assert {r["stream"]: r["avg"] for r in panes.derive_original(states, specs, 10).collect()} == {"s": None, "e": 10.0, "f": 7.0}
    assert {(r["stream"], r["win_start"]): r["avg"] for r in panes.early_partial(states, WindowSpec(20, 10), 10).collect()}["s", 10] is None


def test_chunk_plan():
    assert panes.chunk_plan(WindowSpec(120, 60), [WindowSpec(60, 30), WindowSpec(45, 15)]) == panes.ChunkPlan(15, 60)
    assert panes.common_multiple([WindowSpec(1, 4), WindowSpec(1, 6)]) == 12
    assert panes.common_multiple([]) == 1


def test_star_join_gives_all_combinations(spark):
    triples = spark.createDataFrame([("a", "p", "1"), ("a", "p", "2"), ("a", "q", "x"), ("a", "q", "y"), ("b", "p", "1"), ("c", "z", "1")], "s string, p string, o string")
    assert sorted((r["s"], r["one"], r["two"]) for r in relational.star_join(triples, {"one": "p", "two": "q"}).collect()) == [("a", "1", "x"), ("a", "1", "y"), ("a", "2", "x"), ("a", "2", "y")]


def test_numbers_within_keys(spark):
    rows = [("hot", k % 50, k) for k in range(400)] + [("cold", 1, 1)]
    out = numbered(spark.createDataFrame(rows, "k string, x long, y long").repartition(7), ["k"], ["x", "y"], "place", "n").collect()
    assert [(r["x"], r["y"]) for r in sorted(out, key=lambda r: r["place"]) if r["k"] == "hot"] == sorted((x, y) for k, x, y in rows if k == "hot")
    assert sorted(r["place"] for r in out) == sorted([*range(1, 401), 1])
    assert {(r["k"], r["n"]) for r in out} == {("hot", 400), ("cold", 1)}
    with pytest.raises(ValueError):
        small(spark.range(20), 10)


def test_matching_falls_back_on_window_numbers(spark):
    whole = spark.createDataFrame([("a", 0, 10, 1)], "stream string, win_start long, win_end long, window_number long")
    bare = spark.createDataFrame([("a", 0, None, 1)], "stream string, win_start long, win_end long, window_number long")
    assert relational.matched_on(whole, whole, ["stream"]) == ["stream", "win_start", "win_end"]
    assert relational.matched_on(whole, bare, ["stream"]) == relational.matched_on(whole.drop("win_end"), whole, ["stream"]) == ["stream", "window_number"]


def test_equal_queries_share_a_hash(spark):
    layouts = [
        "PREFIX a: <urn:A> PREFIX b: <urn:b> REGISTER RStream <out> AS SELECT (AVG(?v) AS ?x) FROM NAMED WINDOW :w ON STREAM <urn:s> [RANGE 60 STEP 30] WHERE { WINDOW :w { ?o a:v ?v ; b:p :q } }",
        "PREFIX b: <urn:b>\nPREFIX a: <urn:A>\nREGISTER RStream <other> AS\nSELECT (AVG(?v) AS ?x)\nFROM NAMED WINDOW :w ON STREAM <urn:s> [RANGE 60 STEP 30]\nWHERE {\n  WINDOW :w { ?o a:v ?v ; b:p :q }\n}",
        "prefix A: <urn:A> prefix B: <urn:b> select ( AVG( ?v ) AS ?x ) from named window :w on stream <urn:s> [range 60 step 30] where{window :w{?o a:v ?v;b:p :q}}",
        "# a comment\nPREFIX a:<urn:A>\nPREFIX   b:   <urn:b> # another\nSELECT (AVG(?v) AS ?x) FROM NAMED WINDOW :w ON STREAM <urn:s> [ RANGE 60 STEP 30 ] WHERE { WINDOW :w { ?o a:v ?v ; b:p :q } } # end",
        "\tPREFIX a: <urn:A>\r\nPREFIX b: <urn:b>\r\nSELECT(AVG(?v)AS ?x)FROM NAMED WINDOW :w ON STREAM<urn:s>[RANGE 60 STEP 30]WHERE{WINDOW :w{?o a:v ?v;b:p :q}}\r\n",
        "PREFIX a: <urn:A> PREFIX b: <urn:b> Select (Avg(?v) As ?x) From Named Window :w On Stream <urn:s> [Range 60 Step 30] Where { Window :w { ?o a:v ?v ; b:p :q } }",
        "PREFIX b: <urn:b> SELECT (AVG(?v) AS ?x) FROM NAMED WINDOW :w ON STREAM <urn:s> [RANGE 60 STEP 30] PREFIX a: <urn:A> WHERE { WINDOW :w { ?o a:v ?v ; b:p :q } }",
        "PREFIX a: <urn:A> PREFIX b: <urn:b> register rstream <x> as   SELECT (AVG(?v)   AS ?x)   FROM NAMED WINDOW :w ON STREAM   < urn:s >   [RANGE 60 STEP 30] WHERE { WINDOW :w { ?o a:v ?v ; b:p :q } }",
        "PREFIX a: <urn:A> PREFIX b: <urn:b> SELECT (AVG (?v) AS ?x) FROM NAMED WINDOW :w ON STREAM <urn:s>[RANGE 60 STEP 30]WHERE { WINDOW :w {\n\t?o a:v ?v ;\n\tb:p :q\n} }",
        "  PREFIX a: <urn:A>\n\n  PREFIX b: <urn:b>\n\n  SELECT (AVG(?v) AS ?x)\n\n  FROM NAMED WINDOW :w ON STREAM <urn:s> [RANGE 60 STEP 30] WHERE { WINDOW :w { ?o a:v ?v ; b:p :q } }\n# bye",
    ]
    other = [layouts[0].replace("AVG", "SUM"), layouts[0].replace("60", "90"), layouts[0].replace("urn:A", "urn:a")]
    log = spark.createDataFrame([(str(k), "c", q) for k, q in enumerate(layouts + other)], "query_id string, consumer_id string, query_text string")
    hashes = {r["query_id"]: r["canonical_hash"] for r in reuse.canonical(log).collect()}
    assert len({hashes[str(k)] for k in range(10)}) == 1
    assert len(set(hashes.values())) == 4
    levels = {r["query_id"]: r["level"] for r in reuse.reuse_level(log).collect()}
    assert [levels[str(k)] for k in range(13)] == ["fresh"] + ["exact"] * 9 + ["fresh"] * 3


def test_window_sets_expand_prefixes(spark):
    one = "PREFIX s: <urn:streams/> SELECT (AVG(?v) AS ?x) FROM NAMED WINDOW s:w ON STREAM s:a [RANGE 60 STEP 30] FROM NAMED WINDOW <urn:streams/u> ON STREAM <urn:b> [RANGE 6 STEP 3]"
    two = "SELECT (SUM(?v) AS ?x) FROM NAMED WINDOW <urn:streams/u> ON STREAM <urn:b> [RANGE 6 STEP 3] FROM NAMED WINDOW <urn:streams/w> ON STREAM <urn:streams/a>[RANGE 60 STEP 30]"
    log = spark.createDataFrame([("1", "c", one), ("2", "c", two), ("3", "c", one.replace("60", "61")), ("4", "c", "no window"), ("5", "c", None)], "query_id string, consumer_id string, query_text string")
    sets = {r["query_id"]: r["window_set"] for r in reuse.window_sets(log).collect()}
    assert sets["1"] == sets["2"] == "urn:streams/u|urn:b|6|3\nurn:streams/w|urn:streams/a|60|30"
    assert sets["3"] != sets["1"] and sets["4"] is sets["5"] is None
    assert reuse.reuse_level(log).count() == 5


def test_message_kinds_and_subscribers(spark):
    rows = [("x/control", None, "fetching"), ("in/wearableX", None, "chunked"), ("in/smartphoneX", None, "other"), ("chunked/1", None, "chunked"), ("output/1", None, "chunked"), ("sub", None, "chunked"), ("sub", "reusable_result", "chunked"), ("x/control", None, "chunked")]
    out = traffic.classify(spark.createDataFrame([(*r, 10) for r in rows], "topic string, message_type string, approach string, published_bytes long")).collect()
    assert [r["message_type"] for r in out] == ["control", "raw_input_stream", "raw_input_stream", "chunk_result", "superquery_result", "unknown", "reusable_result", "control"]
    assert [r["delivered_bytes"] for r in out] == [10, 20, 10, 10, 10, 10, 0, 0]


def test_noise_does_not_depend_on_partitions(spark):
    obs = spark.createDataFrame([(k, float(k)) for k in range(100)], "event_id long, value double")
    a, b = (sorted(map(tuple, observations.add_noise(df, "value", [1.0, 2.0]).collect())) for df in (obs.coalesce(1), obs.repartition(7)))
    assert a == b and len(a) == 200
    spread = [v - k for k, v, s in a if s == 1.0]
    assert abs(sum(spread) / 100) < 0.4 and 0.7 < (sum(x * x for x in spread) / 100) ** 0.5 < 1.3


def test_standard_recommendations(spark):
    rows = [("a", 5.0, 1.0, 1.0, 10), ("b", 5.0, 1.0, 1.7, 10), ("c", 5.0, 1.0, 1.7, 200), ("d", 80.0, 3.0, 3.0, 200), ("e", 40.0, 3.0, 3.0, 200)]
    signatures = spark.createDataFrame([(s, 0, *r) for s, *r in rows], "stream string, win_start long, variance double, entropy double, spectral_entropy double, n long")
    got = {r["stream"]: (r["approach"], r["confidence"]) for r in signature.recommend(signatures, signature.standard_configs(spark)).collect()}
    assert got == {"a": ("approximation", 1.0), "c": ("chunked", 0.5), "d": ("fetching", 0.75)}


def test_latest_value_of_many_buckets(spark):
    rows = sub(spark, (0, 10, 1), (100, 110, 2))
    asked = spark.createDataFrame([(5, 8), (50, 60), (105, 120), (900, 905), (-50, -40)], BOTH)
    got = {r["b_start"]: (r["value"], r["source"]) for r in approx.latest_value(rows, asked, 7).collect()}
    assert got == {5: (1.0, "overlap"), 50: (1.0, "latest"), 105: (2.0, "overlap"), 900: (2.0, "latest"), -50: (None, "none")}


def test_exact_quantiles_of_hot_and_null_keys(spark):
    import random

    import numpy as np

    rng = random.Random(9)
    rows = [(None, float(rng.randint(0, 30)), rng.gauss(0, 1)) for _ in range(400)] + [("b", 5.0, None), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r["k"]: r.asDict() for r in quantiles(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, {"q0": 0.0, "q5": 0.5, "q95": 0.95, "q100": 1.0}).collect()}
    for k in (None, "b", "c"):
        for at, name in ((1, "x"), (2, "y")):
            own = [r[at] for r in rows if r[0] == k and r[at] is not None]
            for suffix, p in (("q0", 0), ("q5", 0.5), ("q95", 0.95), ("q100", 1)):
                assert got[k][f"{name}_{suffix}"] == (pytest.approx(np.quantile(own, p)) if own else None)
    assert set(got) == {None, "b", "c"}
    summary = {r["k"]: (r["x_n"], r["x_median"]) for r in metrics.summarize(df, ["x"], ["k"]).collect()}
    assert summary["d"] == (0, None) and summary["c"] == (2, 1.5)
    assert quantiles(df, [], {"x": F.col("x")}, {"q5": 0.5}).first()["x_q5"] == np.quantile([r[1] for r in rows if r[1] is not None], 0.5)


def test_bounded_percentiles(spark):
    rows = spark.range(1001).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("m"))
    row = metrics.summarize(rows, ["m"], ["k"], accuracy=10_000).first()
    assert abs(row["m_median"] - 500) <= 1 and abs(row["m_p95"] - 950) <= 1


def test_messages_for_a_broker(spark):
    rows = spark.createDataFrame([("t", 5)], "topic string, payload long")
    assert [tuple(r) for r in logs.to_topics(rows).collect()] == [("t", "5")]


def test_late_arrivals_in_any_number_of_parts(spark):
    import random

    rng, spec = random.Random(3), WindowSpec(40, 20)
    rows = [(k, (ms := rng.randint(0, 500)), ms + rng.randint(0, 200)) for k in range(300)]
    got = {r["event_id"]: r["class"] for r in streams.late_classes(spark.createDataFrame(rows, "event_id long, ms long, arrived long"), spec, 10).collect()}
    seen = None
    for k, ms, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want = "on_time" if seen is None or ms >= seen else "late" if ms - ms % 20 + 40 + 10 > seen else "too_late"
        assert got[k] == want
        seen = ms if seen is None else max(seen, ms)


def test_rounded_as_the_sql_rounds(spark):
    """Also beyond 2^53 units of the last place."""
    import duckdb

    from panemill.queries.registry import rounded

    values = [555605669 / 3, 2512022142.0 / 19, -1762147520 / 13.5, 0.123456785, 2.5e-8, -0.0, 1e305, float("inf"), None]
    want = duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 8)", [values]).fetchall()
    rows = spark.createDataFrame([(k, x, 7) for k, x in enumerate(values)], "k int, x double, n long")
    got = rounded(rows, "x", "n").orderBy("k").collect()
    assert [r.x for r in got] == [x for (x,) in want] and {r.n for r in got} == {7}


def test_terms_of_any_length(spark):
    """A long literal or IRI takes no stack for each of its characters; what stands after the quote is cut off rightly."""
    long = "ab\\\\ \\\"<c>@d" * 20_000
    rows = spark.createDataFrame([(f'<urn:{"x" * 100_000}> <urn:p> "{long}"^^ <urn:t> . _:b.c\t<urn:q>_:d.e ._:f<urn:r>"@x^^<y>"@en .',)], "value string")
    got = [tuple(r) for r in observations.parse_ntriples(rows).collect()]
    assert got == [("urn:" + "x" * 100_000, "urn:p", long.replace("\\\\", "\\").replace('\\"', '"'), "urn:t"), ("_:b.c", "urn:q", "_:d.e", "blank"), ("_:f", "urn:r", "@x^^<y>", "@en")]
    assert observations.rejected_ntriples(rows).count() == 0
