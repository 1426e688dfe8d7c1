"""Queries of reports: accuracy, latency, traffic, resources, series, signatures, query logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.time import WindowSpec
from panemill.operators import panes as P
from panemill.operators.approx import approx_overlap_avg
from panemill.operators.relational import set_difference
from panemill.operators.windows import first_windows, window_agg
from panemill.plans import reuse
from panemill.queries.core import _thin, THIN
from panemill.queries.registry import ANCHOR, HOUR, OBS, PANE, PANES, REC, SPEC, obs, query, rounded, sliding, states
from panemill.reports import metrics as M
from panemill.reports import signature as G
from panemill.reports import traffic as T

KEYS = ["stream", "win_start"]
DELAY = {"fetching": (800, 37, 500), "chunked": (230, 29, 150), "approximation": (270, 13, 200)}
SUBSPEC = WindowSpec(4 * HOUR, PANE)
_PARTS = " UNION ALL ".join(
    f"""SELECT '{a}' AS approach, stream, n AS window_number, win_start, win_end, round({a}, 8) AS value,
    {ANCHOR} AS registered_at, win_end + {base} + n * {k} % {m} AS emitted_at FROM numbered {'WHERE n % 11 <> 0' if a == 'approximation' else ''}"""
    for a, (base, k, m) in DELAY.items()
)
#: From raw rows, from panes, and from the averages of narrower windows weighted by their overlap.
RESULTS = f"""{REC}, raw AS (SELECT stream, win_start, avg(value) AS fetching FROM ({sliding('obs')}) GROUP BY ALL),
narrow AS (SELECT stream, win_start, win_end, avg(value) AS v FROM ({sliding('obs', 'ms', SUBSPEC.range_ms, SUBSPEC.step_ms)}) GROUP BY ALL),
near AS (SELECT r.stream, r.win_start, sum(v * (least(s.win_end, r.win_end) - greatest(s.win_start, r.win_start))) / sum(least(s.win_end, r.win_end) - greatest(s.win_start, r.win_start)) AS approximation
    FROM rec r JOIN narrow s ON s.stream = r.stream AND s.win_end > r.win_start AND s.win_start < r.win_end GROUP BY ALL),
numbered AS (SELECT rec.*, rec.avg AS chunked, fetching, approximation, (win_start - {ANCHOR}) // {PANE} + 1 AS n FROM rec JOIN raw USING (stream, win_start) JOIN near USING (stream, win_start) WHERE win_start >= {ANCHOR} AND panes = 3),
results AS ({_PARTS})"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of three approaches: value, registration and emission times of each window.

    fetching aggregates raw rows, chunked merges pane states, approximation weighs the averages of four-hour windows by their overlap.
    """
    panes = states(spark, sf_dir)
    rows = P.recompose(panes, SPEC, PANE, require_complete=True).where(F.col("win_start") >= ANCHOR).select("stream", "win_start", "win_end", F.col("avg").alias("chunked"))
    raw = window_agg(obs(spark, sf_dir), SPEC, [("avg", "fetching")]).drop("win_end")
    narrow = P.recompose(panes, SUBSPEC, PANE).select("stream", F.col("win_start").alias("start_ms"), F.col("win_end").alias("end_ms"), F.col("avg").alias("value"))
    asked = rows.select(F.col("win_start").alias("b_start"), F.col("win_end").alias("b_end")).distinct()
    near = approx_overlap_avg(narrow, asked, 6 * HOUR, ["stream"]).select("stream", F.col("b_start").alias("win_start"), F.col("avg").alias("approximation"))
    rows = rows.join(raw, KEYS).join(near, KEYS)
    n = ((F.col("win_start") - ANCHOR) / PANE).cast("long") + 1
    rows = rows.withColumn("window_number", n).withColumn("registered_at", F.lit(ANCHOR))
    parts = []
    for a, (base, k, m) in DELAY.items():
        part = F.struct(F.lit(a).alias("approach"), F.round(a, 8).alias("value"), (F.col("win_end") + base + n * k % m).alias("emitted_at"))
        parts.append(F.when(n % 11 != 0, part) if a == "approximation" else part)
    rows = rows.withColumn("part", F.explode(F.array_compact(F.array(*parts))))
    return rows.select("part.approach", "stream", "window_number", "win_start", "win_end", "part.value", "registered_at", "part.emitted_at")


def _of(spark: SparkSession, sf_dir: str, approach: str) -> DataFrame:
    return results(spark, sf_dir).where(F.col("approach") == approach)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _of(spark, sf_dir, "fetching").select(*KEYS, "window_number", F.col("value").alias("base"))
    return results(spark, sf_dir).where("approach <> 'fetching'").join(base, [*KEYS, "window_number"])


BASE = f"{RESULTS}, base AS (SELECT stream, win_start, window_number, value AS base FROM results WHERE approach = 'fetching'), pairs AS (SELECT r.*, base FROM results r JOIN base b USING (stream, win_start, window_number) WHERE approach <> 'fetching')"
ERR = "abs((value - base) / base) * 100"


# --- I: accuracy


@query(
    f"""WITH {RESULTS}, b AS (SELECT * FROM results WHERE approach = 'fetching' AND window_number BETWEEN 4 AND 200), c AS (SELECT * FROM results WHERE approach = 'approximation' AND window_number BETWEEN 10 AND 250),
    m AS (SELECT coalesce(b.stream, c.stream) AS stream, b.value AS base, c.value AS value FROM b FULL JOIN c ON b.stream = c.stream AND b.win_start = c.win_start)
    SELECT stream, count(*) FILTER (WHERE base IS NOT NULL AND value IS NOT NULL) AS matched, count(*) FILTER (WHERE value IS NULL) AS baseline_only, count(*) FILTER (WHERE base IS NULL) AS approach_only,
           round(avg(abs(value - base)), 8) AS mae, round(sqrt(avg((value - base) * (value - base))), 8) AS rmse, round(avg(CASE WHEN base <> 0 THEN abs(value - base) / abs(base) * 100 END), 8) AS mape,
           round(max(abs(value - base)), 8) AS max_error, count(*) FILTER (WHERE abs(value - base) <= 1e-12) AS exact FROM m GROUP BY stream"""
)
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _of(spark, sf_dir, "fetching").where("window_number between 4 and 200")
    other = _of(spark, sf_dir, "approximation").where("window_number between 10 and 250")
    return rounded(M.accuracy(base, other, KEYS, ["stream"]), "mae", "rmse", "mape", "max_error")


@query(
    f"""WITH {RESULTS}, b AS (SELECT stream, value, row_number() OVER (PARTITION BY stream ORDER BY win_start) AS place FROM results WHERE approach = 'fetching'),
    c AS (SELECT stream, value, row_number() OVER (PARTITION BY stream ORDER BY win_start) AS place FROM results WHERE approach = 'approximation')
    SELECT stream, count(*) AS compared, round(avg(CASE WHEN b.value = 0 THEN 0.0 ELSE abs((c.value - b.value) / b.value) * 100 END), 8) AS mape FROM b JOIN c USING (stream, place) GROUP BY stream"""
)
def accuracy_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.accuracy_positional(_of(spark, sf_dir, "fetching"), _of(spark, sf_dir, "approximation"), ["stream"], "win_start"), "mape")


@query(f"WITH {BASE} SELECT approach, stream, round(corr(base, value), 8) AS correlation FROM pairs GROUP BY ALL")
def result_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.correlation(_pairs(spark, sf_dir), ["approach", "stream"]), "correlation")


@query(
    f"""WITH {BASE}, a AS (SELECT approach, stream, avg(CASE WHEN base = 0 THEN CASE WHEN value = 0 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, 100 - {ERR}) END) AS accuracy, avg({ERR}) AS mape FROM pairs GROUP BY ALL)
    SELECT approach, stream, round(accuracy, 8) AS accuracy, CASE WHEN mape < 1 THEN 'good' WHEN mape < 5 THEN 'fair' ELSE 'poor' END AS grade FROM a"""
)
def percentage_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).groupBy("approach", "stream")
    rows = rows.agg(F.avg(M.percentage_accuracy(F.col("base"), F.col("value"))).alias("accuracy"), F.avg(F.abs(F.try_divide(F.col("value") - F.col("base"), "base")) * 100).alias("mape"))
    return rounded(rows, "accuracy").select("approach", "stream", "accuracy", M.grade(F.col("mape")).alias("grade"))


@query(f"WITH {BASE}, w AS (SELECT stream, win_start, arg_min(approach, (abs(value - base), approach)) AS winner FROM pairs GROUP BY ALL) SELECT stream, winner, count(*) AS wins FROM w GROUP BY ALL")
def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _pairs(spark, sf_dir).withColumn("error", F.abs(F.col("value") - F.col("base")))
    return M.winners(errors, ["win_start"], "stream")


@query(
    f"""WITH {BASE} SELECT approach, stream, CASE WHEN NOT window_number % 13 > 0 THEN 'not_comparable' WHEN abs(value - base) = 0 THEN 'exact' WHEN abs(value - base) <= 0.001 THEN 'numerically_equivalent' ELSE 'non_exact' END AS class, count(*) AS windows
    FROM pairs GROUP BY ALL"""
)
def equivalence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = M.equivalence(F.col("base"), F.col("value"), F.col("window_number") % 13 > 0)
    return _pairs(spark, sf_dir).groupBy("approach", "stream", kind.alias("class")).agg(F.count(F.lit(1)).alias("windows"))


@query(f"WITH {BASE} SELECT approach, stream, count(CASE WHEN base <> 0 THEN 1 END) AS n, count(*) FILTER (WHERE base = value) AS exact, round(avg({ERR}), 8) AS mean_pct, round(quantile_cont({ERR}, 0.5), 8) AS median_pct, round(max({ERR}), 8) AS max_pct FROM pairs GROUP BY ALL")
def relative_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.relative_error_summary(_pairs(spark, sf_dir), ["approach", "stream"]), "mean_pct", "median_pct", "max_pct")


@query(f"WITH {BASE} SELECT approach, stream, round(arg_min({ERR}, window_number), 8) AS first_error, round(avg({ERR}), 8) AS mean_error, round(min({ERR}), 8) AS least_error, round(max({ERR}), 8) AS greatest_error FROM pairs WHERE base <> 0 GROUP BY ALL")
def first_vs_average_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.first_vs_average_error(_pairs(spark, sf_dir), ["approach", "stream"], "window_number"), "first_error", "mean_error", "least_error", "greatest_error")


@query(
    f"""WITH {RESULTS}, f AS (SELECT stream, arg_min(win_start, (emitted_at, win_start)) AS win_start, arg_min(value, (emitted_at, win_start)) AS value FROM results WHERE approach = 'approximation' GROUP BY stream)
    SELECT f.stream, f.win_start, f.value, b.value AS base, round(abs((f.value - b.value) / b.value) * 100, 8) AS error_pct FROM f LEFT JOIN results b ON b.approach = 'fetching' AND b.stream = f.stream AND b.win_start = f.win_start"""
)
def first_emitted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.first_emitted_accuracy(_of(spark, sf_dir, "fetching"), _of(spark, sf_dir, "approximation"), ["stream"]), "error_pct")


# --- I: latency


@query(f"WITH {RESULTS} SELECT approach, stream, window_number, emitted_at - registered_at AS since_registration, emitted_at - (registered_at + {SPEC.range_ms} + (window_number - 1) * {PANE}) AS after_close FROM results")
def anchored_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.anchored_latency(results(spark, sf_dir), SPEC).select("approach", "stream", "window_number", "since_registration", "after_close")


RUNTIME = f"CASE WHEN window_number % 10 = 0 THEN NULL WHEN window_number % 10 = 1 THEN {ANCHOR} + 200000000 ELSE {ANCHOR} + 5 END"
EVENT = f"CASE WHEN window_number % 10 = 2 THEN NULL ELSE {ANCHOR} END"


@query(
    f"""WITH {RESULTS}, r AS (SELECT *, {RUNTIME} AS runtime_anchor, {EVENT} AS event_anchor FROM results), s AS (SELECT *, runtime_anchor + win_end - event_anchor AS mapped FROM r),
    t AS (SELECT *, CASE WHEN runtime_anchor IS NULL THEN 'runtime_anchor_missing' WHEN event_anchor IS NULL THEN 'event_time_missing' WHEN abs(emitted_at - mapped) > 86400000 THEN 'domain_mismatch' ELSE 'wall_clock_mapped' END AS domain_status FROM s)
    SELECT approach, stream, window_number, domain_status, CASE WHEN domain_status = 'wall_clock_mapped' THEN mapped END AS wall_close FROM t"""
)
def latency_domain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("runtime_anchor", F.expr(RUNTIME)).withColumn("event_anchor", F.expr(EVENT))
    return M.wall_clock_close(rows).select("approach", "stream", "window_number", "domain_status", "wall_close")


@query(
    f"""WITH {RESULTS}, need AS (SELECT stream, win_start, max(end_ms + start_ms // {PANE} * 17 % 120) AS ready_at FROM ({sliding('panes', 'start_ms')}) GROUP BY ALL)
    SELECT approach, stream, win_start, ready_at, emitted_at - ready_at AS ready_to_result, ready_at - win_end AS close_to_ready FROM results JOIN need USING (stream, win_start)"""
)
def ready_to_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = F.col("end_ms") + F.floor(F.col("start_ms") / PANE) * 17 % 120
    need = P.chunks_to_windows(states(spark, sf_dir), SPEC, PANE).withColumn("arrived_at", arrived)
    return M.ready_to_emit(need, results(spark, sf_dir), KEYS).select("approach", *KEYS, "ready_at", "ready_to_result", "close_to_ready")


STARTED = f"CASE WHEN window_number % 7 = 0 THEN NULL WHEN window_number % 7 = 1 THEN emitted_at + 5 ELSE {ANCHOR} + window_number * 11 END"


@query(
    f"""WITH {RESULTS}, r AS (SELECT *, {STARTED} AS first_data_at FROM results)
    SELECT approach, stream, window_number, CASE WHEN first_data_at IS NOT NULL AND emitted_at >= first_data_at THEN emitted_at - first_data_at ELSE emitted_at - registered_at END AS startup_ms,
           CASE WHEN first_data_at IS NULL THEN 'no_data_start' WHEN emitted_at >= first_data_at THEN 'data_start' ELSE 'data_after_result' END AS startup_basis FROM r"""
)
def startup_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("first_data_at", F.expr(STARTED))
    return M.startup_latency(rows).select("approach", "stream", "window_number", "startup_ms", "startup_basis")


LATENCY = "(emitted_at - win_end)"


@query(
    f"""WITH {RESULTS} SELECT approach, count(*) AS latency_n, round(avg{LATENCY}, 8) AS latency_mean, round(stddev_pop{LATENCY}, 8) AS latency_std, min{LATENCY} AS latency_min, max{LATENCY} AS latency_max,
    round(quantile_cont({LATENCY}, 0.5), 8) AS latency_median, round(quantile_cont({LATENCY}, 0.95), 8) AS latency_p95 FROM results GROUP BY approach"""
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("latency", F.expr(LATENCY))
    return rounded(M.summarize(rows, ["latency"], ["approach"]), "latency_mean", "latency_std", "latency_median", "latency_p95")


@query(
    f"""WITH {RESULTS}, r AS (SELECT approach, {LATENCY} AS latency, row_number() OVER (PARTITION BY approach ORDER BY {LATENCY}) - 1 AS place, count(*) OVER (PARTITION BY approach) AS n FROM results)
    SELECT approach, latency AS value FROM r WHERE place = least(floor(n * 0.9), n - 1)"""
)
def rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rank_percentile(results(spark, sf_dir).withColumn("latency", F.expr(LATENCY)), "latency", ["approach"], 0.9)


@query(f"WITH {RESULTS} SELECT approach, stream, count(*) AS iterations, round(avg(CASE WHEN {LATENCY} < 700 THEN 1.0 ELSE 0.0 END), 8) AS success_rate, round(avg{LATENCY}, 8) AS latency_mean, round(stddev_samp{LATENCY}, 8) AS latency_std, round(avg(value), 8) AS value_mean, round(stddev_samp(value), 8) AS value_std FROM results GROUP BY ALL")
def iteration_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("latency", F.expr(LATENCY))
    out = M.rollup(rows, ["approach", "stream"], ["latency", "value"], F.col("latency") < 700)
    return rounded(out, "success_rate", "latency_mean", "latency_std", "value_mean", "value_std")


for _kind, _sign, _arg in (("saving", "", "max"), ("overhead", "-", "min")):

    @query(
        f"""WITH {RESULTS}, l AS (SELECT *, {LATENCY} AS latency, emitted_at - registered_at AS age FROM results), p AS (
        SELECT a.approach, {_sign}(1 - a.latency / b.latency) AS x, {_sign}(1 - a.age / b.age) AS y FROM l a JOIN l b ON b.approach = 'fetching' AND a.stream = b.stream AND a.win_start = b.win_start WHERE a.approach <> 'fetching'),
        s AS (SELECT approach, avg(x) AS x, stddev_pop(x) AS xs, avg(y) AS y, stddev_pop(y) AS ys FROM p GROUP BY approach)
        SELECT approach, round(x, 8) AS latency_{_kind}, round(xs, 8) AS latency_spread, round(y, 8) AS age_{_kind}, round(ys, 8) AS age_spread, round((x + y) / 2, 8) AS score, approach = (SELECT arg_{_arg}(approach, x + y) FROM s) AS best FROM s""",
        name=f"{_kind}_ratio",
    )
    def _ratio(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        rows = results(spark, sf_dir).withColumn("latency", F.expr(LATENCY)).withColumn("age", F.col("emitted_at") - F.col("registered_at"))
        out = M.ratio_to(rows, "fetching", ["latency", "age"], KEYS, kind)
        return rounded(out, f"latency_{kind}", "latency_spread", f"age_{kind}", "age_spread", "score")


TIMES = f"r AS (SELECT *, {ANCHOR} + window_number * 11 AS first_data_at, win_end + window_number % 17 AS last_pane_at, win_end + 20 + window_number % 29 AS triggered_at FROM results)"


@query(
    f"""WITH {RESULTS}, {TIMES} SELECT approach, stream, window_number, emitted_at - (first_data_at + {SPEC.range_ms} + (window_number - 1) * {PANE}) AS after_data_close, triggered_at - last_pane_at AS interval_wait,
        emitted_at - triggered_at AS computation FROM r"""
)
def emission_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("window_number")
    rows = results(spark, sf_dir).withColumn("first_data_at", ANCHOR + n * 11).withColumn("last_pane_at", F.col("win_end") + n % 17).withColumn("triggered_at", F.col("win_end") + 20 + n % 29)
    return M.emission_latencies(rows, SPEC).select("approach", "stream", "window_number", "after_data_close", "interval_wait", "computation")


@query(f"WITH {RESULTS} SELECT approach, stream, window_number, round(exp(CASE WHEN window_number % 2 = 0 THEN 1 ELSE -1 END * 0.5 * window_number / 100), 8) AS expected FROM results")
def expected_case_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("window_number")
    return results(spark, sf_dir).select("approach", "stream", "window_number", F.round(M.expected_value(F.lit(0.5), n / 100, n % 2 == 0), 8).alias("expected"))


@query(f"WITH {RESULTS}, n AS (SELECT DISTINCT window_number FROM results), a AS (SELECT DISTINCT approach FROM results) SELECT approach, window_number FROM a, n EXCEPT SELECT approach, window_number FROM results")
def matrix_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matrix_missing(results(spark, sf_dir), "window_number", "approach").select("approach", "window_number")


@query(
    f"""WITH {RESULTS}, runs AS (SELECT approach, stream, count(*) AS windows, round(avg(value), 4) AS value, count(*) FILTER (WHERE window_number % 50 = 3 AND approach = 'chunked' AND stream = 'view') AS fallbacks FROM results GROUP BY ALL),
    j AS (SELECT r.*, b.windows AS bw, b.value AS bv FROM runs r JOIN runs b ON b.approach = 'fetching' AND b.stream = r.stream)
    SELECT approach, stream, concat_ws(';', CASE WHEN windows = 0 THEN 'no_windows' END, CASE WHEN windows < bw THEN 'missing_windows' END, CASE WHEN fallbacks > 0 THEN 'fallbacks' END, CASE WHEN abs(value - bv) > 0.05 THEN 'error' END) AS reasons FROM j"""
)
def run_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fell = (F.col("window_number") % 50 == 3) & (F.col("approach") == "chunked") & (F.col("stream") == "view")
    runs = results(spark, sf_dir).groupBy("approach", "stream").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("value"), 4).alias("value"), F.count_if(fell).alias("fallbacks"))
    return M.run_validity(runs, "fetching", ["stream"], 0.05).select("approach", "stream", "reasons")


@query(f"WITH {PANES}, c AS (SELECT win_start, count(*) AS consumed FROM ({sliding('panes', 'start_ms')}) GROUP BY ALL) SELECT win_start, consumed, CAST(15 AS BIGINT) AS expected, consumed = 15 AS complete FROM c")
def chunk_states_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.states_consumed(P.chunks_to_windows(states(spark, sf_dir), SPEC, PANE), SPEC.range_ms, PANE, 5)


# --- H, L: sets and series


@query(
    f"""WITH {THIN}, a AS (SELECT DISTINCT stream, (start_ms - {ANCHOR}) // {PANE} + 1 AS n FROM thin), e AS (SELECT stream, n FROM (SELECT DISTINCT stream FROM thin), (SELECT max(n) AS top FROM a), unnest(range(10, top + 11)) AS t(n))
    SELECT coalesce(a.stream, e.stream) AS stream, coalesce(a.n, e.n) AS n, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' ELSE 'matched' END AS status FROM a FULL JOIN e ON a.stream = e.stream AND a.n = e.n"""
)
def window_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are there against those expected: from the tenth to ten beyond the last."""
    actual = _thin(spark, sf_dir).select("stream", (((F.col("start_ms") - ANCHOR) / PANE).cast("long") + 1).alias("n"))
    top = actual.agg(F.max("n").alias("top"))
    expected = actual.select("stream").distinct().join(F.broadcast(top)).select("stream", F.explode(F.sequence(F.lit(10).cast("long"), F.col("top") + 10)).alias("n"))
    return set_difference(actual, expected, ["stream", "n"])


@query(f"WITH {RESULTS} SELECT stream, window_number, arg_max(approach, (emitted_at, approach)) AS approach, max(emitted_at) AS emitted_at FROM results GROUP BY ALL")
def latest_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select("stream", "window_number", "approach", "emitted_at")
    return M.latest_per(rows, ["stream", "window_number"], ["emitted_at", "approach"])


@query(f"WITH {RESULTS} SELECT approach, stream, window_number, emitted_at - lag(emitted_at) OVER (PARTITION BY approach, stream ORDER BY emitted_at) AS interval FROM results")
def result_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.result_intervals(results(spark, sf_dir), ["approach", "stream"], "emitted_at").select("approach", "stream", "window_number", "interval")


@query(
    f"""WITH {RESULTS}, i AS (SELECT approach, stream, emitted_at - lag(emitted_at) OVER (PARTITION BY approach, stream ORDER BY emitted_at) AS interval FROM results)
    SELECT approach, stream, count(interval) AS intervals, bool_and(abs(interval - {PANE}) <= 500) AS stable FROM i GROUP BY ALL"""
)
def stable_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stable_cadence(results(spark, sf_dir), ["approach", "stream"], "emitted_at", PANE, 500)


@query(f"WITH {RESULTS} SELECT approach, stream, min(window_number) AS window_number, arg_min(value, window_number) AS value FROM results WHERE window_number > 3 AND window_number % 4 = 0 GROUP BY ALL")
def first_complete_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("complete", F.col("window_number") > 3).withColumn("comparable", F.col("window_number") % 4 == 0)
    return M.first_complete(rows, ["approach", "stream"], "window_number")


@query(
    f"""WITH {RESULTS}, r AS (SELECT approach, stream, value, row_number() OVER (PARTITION BY approach, stream ORDER BY window_number) AS place, count(*) OVER (PARTITION BY approach, stream) AS n FROM results),
    t AS (SELECT approach, stream, avg(value) FILTER (WHERE place <= least(10, greatest(1, floor(n * 0.1)))) AS head, avg(value) FILTER (WHERE place > n - least(10, greatest(1, floor(n * 0.1)))) AS tail FROM r GROUP BY ALL)
    SELECT approach, stream, round(head, 8) AS head, round(tail, 8) AS tail, round((tail - head) / head * 100, 8) AS change_pct FROM t"""
)
def head_tail_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.head_tail_trend(results(spark, sf_dir), "value", ["window_number"], ["approach", "stream"]), "head", "tail", "change_pct")


@query(
    f"""WITH {OBS}, r AS (SELECT stream, sensor, ms, value, row_number() OVER (PARTITION BY stream, sensor ORDER BY ms, event_id) AS place, count(*) OVER (PARTITION BY stream, sensor) AS n FROM obs),
    p AS (SELECT stream, sensor, max(value) FILTER (WHERE place = 1) AS start_value, max(value) FILTER (WHERE place = n) AS end_value, min(value) AS min, max(value) AS max, max(ms) - min(ms) AS duration_ms, max(n) AS rows,
        max(value) FILTER (WHERE place = least(n, 10)) AS v10, max(value) FILTER (WHERE place = least(n, 50)) AS v50, max(value) FILTER (WHERE place = least(n, 100)) AS v100, max(value) FILTER (WHERE place = (n - 1) // 4 + 1) AS q25, max(value) FILTER (WHERE place = (n - 1) // 2 + 1) AS q50, max(value) FILTER (WHERE place = (n - 1) * 3 // 4 + 1) AS q75 FROM r GROUP BY ALL)
    SELECT stream, sensor, start_value, end_value, min, max, duration_ms, rows, q25, q50, q75, round(end_value - start_value, 8) AS change, round((end_value - start_value) / start_value * 100, 8) AS change_pct,
           round(CASE WHEN rows > 1 THEN duration_ms / (rows - 1) END, 8) AS mean_interval_ms, round(v10 - start_value, 8) AS change_first_10, round(v50 - start_value, 8) AS change_first_50, round(v100 - start_value, 8) AS change_first_100 FROM p"""
)
def series_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.series_profile(obs(spark, sf_dir), ["stream", "sensor"]), "change", "change_pct", "mean_interval_ms", "change_first_10", "change_first_50", "change_first_100")


@query(
    f"""WITH {RESULTS}, d AS (SELECT approach, stream, window_number, value, value - lag(value) OVER (PARTITION BY approach, stream ORDER BY window_number) AS d FROM results WHERE window_number <= 12 OR approach <> 'chunked')
    SELECT approach, stream, CASE WHEN bool_and(d = 0) THEN 'flat' WHEN bool_and(d >= 0) THEN 'increasing' WHEN bool_and(d <= 0) THEN 'decreasing' ELSE 'mixed' END AS trend, round(regr_slope(value, window_number), 8) AS slope FROM d GROUP BY ALL"""
)
def trend_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    rows = first_windows(rows.where("approach = 'chunked'"), 12).unionByName(rows.where("approach <> 'chunked'"))
    return rounded(M.trend(rows, "window_number", "value", ["approach", "stream"]), "slope")


# --- traffic and resources

USED = "SUM(length(props)) OVER (PARTITION BY sensor, ms // 432000000 ORDER BY ms, event_id)"
SAMPLES = f"{OBS}, samples AS (SELECT sensor AS run, ms AS timestamp, CAST({USED} AS DOUBLE) AS tree_cpu_seconds, 5.0 + event_id % 40 AS total_cpu_pct, 1000000 + event_id % 977 * 1000 AS tree_rss_bytes, CAST(1 + event_id % 6 AS BIGINT) AS process_count FROM obs)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples: a counter that starts anew every five days."""
    from pyspark.sql.window import Window as W

    used = F.sum(F.length("props")).over(W.partitionBy("sensor", F.floor(F.col("ms") / 432_000_000)).orderBy("ms", "event_id"))
    n = F.col("event_id")
    return obs(spark, sf_dir).select(
        F.col("sensor").alias("run"), F.col("ms").alias("timestamp"), used.cast("double").alias("tree_cpu_seconds"), (5.0 + n % 40).alias("total_cpu_pct"), (1_000_000 + n % 977 * 1000).alias("tree_rss_bytes"), (1 + n % 6).alias("process_count")
    )


@query(f"WITH {SAMPLES} SELECT run, round(avg(total_cpu_pct), 8) AS mean_cpu, CAST(max(total_cpu_pct) AS DOUBLE) AS peak_cpu, round(avg(tree_rss_bytes), 8) AS mean_rss, max(tree_rss_bytes) AS peak_rss, max(process_count) AS peak_processes FROM samples GROUP BY run")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.resource_summary(samples(spark, sf_dir)), "mean_cpu", "mean_rss")


@query(
    f"""WITH {OBS} SELECT sensor AS run, event_id % 5 AS pid, count(*) AS samples, round((max(ms) - min(ms)) / 1000, 8) AS wall_s, CAST(sum(length(props)) AS DOUBLE) AS cpu_seconds, round(avg(5.0 + event_id % 40), 8) AS mean_cpu,
        CAST(max(5.0 + event_id % 40) AS DOUBLE) AS peak_cpu, round(avg(1000000 + event_id % 977 * 1000), 8) AS mean_rss, max(1000000 + event_id % 977 * 1000) AS peak_rss FROM obs GROUP BY ALL"""
)
def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = obs(spark, sf_dir).select(
        F.col("sensor").alias("run"), (n % 5).alias("pid"), F.col("ms").alias("timestamp"), F.length("props").cast("double").alias("cpu_seconds"), (5.0 + n % 40).alias("cpu_pct"), (1_000_000 + n % 977 * 1000).alias("rss_bytes")
    )
    return rounded(T.process_summary(rows), "wall_s", "mean_cpu", "mean_rss")


@query(f"WITH {SAMPLES}, d AS (SELECT run, tree_cpu_seconds - lag(tree_cpu_seconds) OVER (PARTITION BY run ORDER BY timestamp) AS delta FROM samples) SELECT run, sum(greatest(delta, 0)) AS growth, count(*) FILTER (WHERE delta < 0) AS resets FROM d GROUP BY run")
def counter_delta_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counter_delta(samples(spark, sf_dir), "timestamp", "tree_cpu_seconds", ["run"])


@query(
    f"""WITH {SAMPLES}, d AS (SELECT run, (tree_cpu_seconds - lag(tree_cpu_seconds) OVER o) / ((timestamp - lag(timestamp) OVER o) / 1000 * 10) * 100 AS rate FROM samples WINDOW o AS (PARTITION BY run ORDER BY timestamp))
    SELECT run, round(avg(rate), 8) AS mean_pct FROM d WHERE rate >= 0 GROUP BY run"""
)
def rate_from_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.counter_rate(samples(spark, sf_dir), "timestamp", "tree_cpu_seconds", ["run"], 10), "mean_pct")


@query(f"WITH {OBS} SELECT stream, c.counter, CAST(sum(c.n) AS BIGINT) AS total FROM obs, LATERAL (VALUES ('bytes', length(props)), ('rows', 1), ('large', CASE WHEN value > 15 THEN 1 ELSE 0 END)) c(counter, n) GROUP BY ALL")
def counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = F.create_map(F.lit("bytes"), F.length("props").cast("long"), F.lit("rows"), F.lit(1).cast("long"), F.lit("large"), F.when(F.col("value") > 15, 1).otherwise(0).cast("long"))
    return T.counter_rollup(obs(spark, sf_dir).select("stream", counters.alias("counters")), ["stream"])


TOPIC = "CASE event_id % 6 WHEN 0 THEN 'output/' WHEN 1 THEN 'chunked/' WHEN 2 THEN 'sub/' WHEN 3 THEN 'in/wearableX/' WHEN 4 THEN 'control/' ELSE 'in/smartphoneX/' END || stream"
APPROACH = "CASE WHEN sensor % 4 = 0 THEN 'fetching' WHEN sensor % 4 = 1 THEN 'chunked' WHEN sensor % 4 = 2 THEN 'naive_distributed' ELSE 'approximation' END"
#: Some messages tell their kind themselves.
GIVEN = "CASE WHEN event_id % 18 = 2 THEN 'reusable_result' WHEN event_id % 18 = 8 THEN 'subquery_result' END"
TRAFFIC = f"""{OBS}, traffic AS (SELECT event_id, ms AS timestamp, {APPROACH} AS approach, {TOPIC} AS topic, CAST(length(props) + 40 AS BIGINT) AS published_bytes,
    coalesce({GIVEN}, ['superquery_result', 'chunk_result', 'unknown', 'raw_input_stream', 'control', 'raw_input_stream'][event_id % 6 + 1]) AS message_type FROM obs),
classified AS (SELECT *, CASE message_type WHEN 'raw_input_stream' THEN CASE WHEN approach IN ('chunked', 'naive_distributed') THEN 2 ELSE 1 END WHEN 'reusable_result' THEN CASE WHEN approach = 'chunked' THEN 0 ELSE 1 END
    WHEN 'control' THEN CASE WHEN approach = 'fetching' THEN 1 ELSE 0 END ELSE 1 END AS subscriber_count FROM traffic)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).select("event_id", F.col("ms").alias("timestamp"), F.expr(APPROACH).alias("approach"), F.expr(TOPIC).alias("topic"), (F.length("props") + 40).cast("long").alias("published_bytes"), F.expr(GIVEN).alias("message_type"))
    return T.classify(rows)


@query(f"WITH {TRAFFIC} SELECT approach, message_type, count(*) AS messages, CAST(sum(published_bytes) AS BIGINT) AS bytes, CAST(sum(published_bytes * subscriber_count) AS BIGINT) AS delivered FROM classified GROUP BY ALL")
def traffic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir).groupBy("approach", "message_type")
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.sum("published_bytes").alias("bytes"), F.sum("delivered_bytes").alias("delivered"))


_SUM = "CAST(coalesce(sum(published_bytes) FILTER (WHERE NOT warmup AND message_type = '{0}'), 0) AS BIGINT) AS {0}_bytes"


@query(
    f"""WITH {TRAFFIC}, c AS (SELECT approach, min(timestamp) AS cut FROM classified WHERE message_type = 'superquery_result' GROUP BY approach), w AS (SELECT k.*, timestamp < cut AS warmup FROM classified k JOIN c USING (approach))
    SELECT approach, count(*) FILTER (WHERE warmup) AS warmup_messages, {', '.join(_SUM.format(k) for k in ('raw_input_stream', 'chunk_result', 'superquery_result'))},
           CAST(sum(published_bytes * subscriber_count) FILTER (WHERE NOT warmup) AS BIGINT) AS delivered_bytes,
           round(sum(published_bytes) FILTER (WHERE NOT warmup) / 1024 / ((max(timestamp) FILTER (WHERE NOT warmup) - min(timestamp) FILTER (WHERE NOT warmup)) / 1000), 9) AS kb_per_s FROM w GROUP BY approach"""
)
def traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.traffic_summary(classified(spark, sf_dir)).withColumn("kb_per_s", F.round("kb_per_s", 9))


@query(
    f"""WITH {PANES}, d AS (SELECT stream || ':' || start_ms AS key, CASE WHEN start_ms // {PANE} % 9 = 0 THEN c.k ELSE 0 END AS execution_id, CASE WHEN start_ms // {PANE} % 14 = 0 THEN count + c.k ELSE count END AS value
        FROM panes, unnest(range(4)) AS c(k) WHERE NOT (start_ms // {PANE} % 5 = 0 AND c.k = 3)),
    f AS (SELECT key, count(*) AS deliveries, count(DISTINCT execution_id) AS executions, count(DISTINCT value) AS "values" FROM d GROUP BY key)
    SELECT key, deliveries, executions, "values", concat_ws(';', CASE WHEN deliveries <> 4 THEN 'deliveries' END, CASE WHEN executions <> 1 THEN 'executions' END, CASE WHEN "values" > 1 THEN 'values' END) AS reasons, deliveries = 4 AND executions = 1 AND "values" <= 1 AS valid FROM f"""
)
def fanout_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("start_ms") / PANE)
    rows = states(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(~((n % 5 == 0) & (F.col("k") == 3)))
    rows = rows.select(F.concat_ws(":", "stream", "start_ms").alias("key"), F.when(n % 9 == 0, F.col("k")).otherwise(0).alias("execution_id"), F.when(n % 14 == 0, F.col("count") + F.col("k")).otherwise(F.col("count")).alias("value"))
    return T.validate_fanout(rows, 4)


# --- M: signatures

STATS = f"""{OBS}, g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY stream, ms // 86400000 ORDER BY ms, event_id) AS gap FROM obs),
stats AS (SELECT stream, ms // 86400000 * 86400000 AS win_start, count(value) AS n, avg(value) AS mean, var_pop(value) AS variance, min(value) AS min, max(value) AS max, max(ms) - min(ms) AS duration_ms, avg(gap) AS mean_interval_ms,
    CASE WHEN max(ms) > min(ms) THEN (count(*) - 1) / ((max(ms) - min(ms)) / 1000) END AS rate_hz FROM g GROUP BY ALL)"""


@query(f"WITH {STATS} SELECT stream, win_start, n, round(mean, 8) AS mean, round(variance, 8) AS variance, min, max, duration_ms, round(mean_interval_ms, 8) AS mean_interval_ms, round(rate_hz, 9) AS rate_hz FROM stats")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.window_stats(obs(spark, sf_dir), 86_400_000)
    return rounded(rows, "mean", "variance", "mean_interval_ms").withColumn("rate_hz", F.round("rate_hz", 9))


SIGN = f"""{OBS}, b AS (SELECT stream, ms // 86400000 * 86400000 AS win_start, value, floor(value / 5) AS bin FROM obs WHERE value IS NOT NULL),
h AS (SELECT stream, win_start, bin, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT stream, win_start, sum(c) AS n FROM h GROUP BY ALL),
e AS (SELECT stream, win_start, -sum(c / n * log2(c / n)) AS entropy FROM h JOIN t USING (stream, win_start) GROUP BY ALL),
m AS (SELECT stream, win_start, count(*) AS n, avg(value) AS mu, var_pop(value) AS variance FROM b GROUP BY ALL),
k AS (SELECT b.stream, b.win_start, sum(pow(value - mu, 3)) / any_value(n) / pow(any_value(variance), 1.5) AS skewness FROM b JOIN m USING (stream, win_start) GROUP BY ALL),
sig AS (SELECT stream, win_start, n, CASE WHEN n >= 5 THEN round(variance, 8) END AS variance, CASE WHEN n >= 5 THEN round(entropy, 8) END AS entropy, CASE WHEN n >= 5 THEN round(skewness, 8) END AS skewness FROM m JOIN e USING (stream, win_start) JOIN k USING (stream, win_start))"""


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.stream_signature(obs(spark, sf_dir), 86_400_000, 5.0), "variance", "entropy", "skewness")


@query(f"WITH {SIGN} SELECT * FROM sig")
def stream_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signature(spark, sf_dir)


#: The discrete Fourier transform of each window by its definition.
SPECTRAL = f"""{OBS}, y AS (SELECT stream, ms // 86400000 * 86400000 AS win_start, value, row_number() OVER o - 1 AS j, count(*) OVER p AS n, value - avg(value) OVER p AS v FROM obs WHERE value IS NOT NULL
    WINDOW o AS (PARTITION BY stream, ms // 86400000 ORDER BY ms, event_id), p AS (PARTITION BY stream, ms // 86400000)),
power AS (SELECT stream, win_start, n, k, pow(sum(v * cos(2 * pi() * (k * j % n) / n)), 2) + pow(sum(v * sin(2 * pi() * (k * j % n) / n)), 2) AS p FROM y, unnest(range(1, n // 2 + 1)) AS t(k) WHERE n >= 5 GROUP BY ALL),
shares AS (SELECT stream, win_start, p / sum(p) OVER (PARTITION BY stream, win_start) AS s FROM power),
spectral AS (SELECT stream, win_start, round(-sum(CASE WHEN s > 0 THEN s * log2(s) ELSE 0 END), 6) AS spectral_entropy FROM shares GROUP BY ALL)"""
KIND_OF = "CASE WHEN variance IS NULL THEN 'unknown' WHEN variance < 10 AND entropy < 2 THEN 'stable' WHEN variance > 50 THEN 'volatile' WHEN abs(skewness) > 1 THEN 'irregular' WHEN spectral_entropy > 2 THEN 'periodic' ELSE 'mixed' END"


def _whole_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectral = G.spectral_entropy(obs(spark, sf_dir), 86_400_000).withColumn("spectral_entropy", F.round("spectral_entropy", 6))
    return _signature(spark, sf_dir).join(spectral, ["stream", "win_start"], "left")


@query(f"WITH {SIGN}, {SPECTRAL.replace(OBS + ', ', '')} SELECT stream, win_start, {KIND_OF} AS stream_type FROM sig LEFT JOIN spectral USING (stream, win_start)")
def stream_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_signature(spark, sf_dir).select("stream", "win_start", G.stream_type(F.col("spectral_entropy")).alias("stream_type"))


@query(f"WITH {SIGN}, {SPECTRAL.replace(OBS + ', ', '')} SELECT stream, win_start, {KIND_OF} AS stream_type FROM (SELECT * REPLACE (variance / 100 AS variance, skewness / 3 AS skewness) FROM sig) LEFT JOIN spectral USING (stream, win_start)")
def stream_type_of_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on values a tenth as wide and a third as skewed, which reaches the later branches."""
    rows = _whole_signature(spark, sf_dir).withColumn("variance", F.col("variance") / 100).withColumn("skewness", F.col("skewness") / 3)
    return rows.select("stream", "win_start", G.stream_type(F.col("spectral_entropy")).alias("stream_type"))


@query(f"WITH {SPECTRAL} SELECT stream, win_start, spectral_entropy FROM spectral UNION ALL SELECT DISTINCT stream, win_start, NULL FROM y WHERE n < 5")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spectral_entropy(obs(spark, sf_dir), 86_400_000).withColumn("spectral_entropy", F.round("spectral_entropy", 6))


#: The standard bounds, moved to the range of the events' values.
CONFIGS = [("approximation", None, 1000.0, 4.0, 4.8, None, 1), ("fetching", 1700.0, None, None, None, None, 2), ("chunked", None, 1650.0, None, None, 40, 3)]
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in CONFIGS)
RECOMMEND = f"""{SIGN}, {SPECTRAL.replace(OBS + ', ', '')}, configs(approach, variance_lo, variance_hi, entropy_hi, spectral_hi, n_lo, priority) AS (VALUES {_ROWS}),
rec AS (SELECT stream, win_start, arg_min(approach, priority) AS approach, round(1 - 0.25 * (min(priority) - 1), 6) AS confidence FROM sig JOIN spectral USING (stream, win_start), configs
    WHERE variance IS NOT NULL AND coalesce(variance >= variance_lo, true) AND coalesce(variance <= variance_hi, true) AND coalesce(entropy <= entropy_hi, true) AND coalesce(spectral_entropy <= spectral_hi, true) AND coalesce(n >= n_lo, true) GROUP BY ALL)"""


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recommend(_whole_signature(spark, sf_dir), spark.createDataFrame(CONFIGS, G.CONFIG_SCHEMA))


@query(f"WITH {RECOMMEND} SELECT stream, win_start, approach, CAST(confidence AS DOUBLE) AS confidence FROM rec")
def approach_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir)


@query(f"WITH {RECOMMEND} SELECT stream, win_start, m.mode, CASE WHEN m.mode = 'automatic' AND confidence > 0.6 THEN approach WHEN m.mode = 'hybrid' AND confidence > 0.7 THEN approach WHEN m.mode IN ('manual', 'hybrid') THEN 'panes' ELSE 'exact' END AS chosen FROM rec, (VALUES ('manual'), ('automatic'), ('hybrid')) m(mode)")
def approach_mode_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recommended(spark, sf_dir)
    parts = [G.select_mode(rows, mode, "panes", "exact").withColumn("mode", F.lit(mode)) for mode in ("manual", "automatic", "hybrid")]
    return reduce(DataFrame.unionByName, parts).select("stream", "win_start", "mode", "chosen")


@query(f"WITH {RECOMMEND}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY win_start DESC) AS back FROM rec) SELECT stream, approach, count(*) AS times, CAST(round(avg(confidence), 8) AS DOUBLE) AS mean_confidence FROM r WHERE back <= 5 GROUP BY ALL")
def recommendation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.recommendation_history(_recommended(spark, sf_dir), 5), "mean_confidence")


# --- N: query logs

# Query texts of the log: (name, text).  Derived per consumer of the customer table, so the log grows with it.
_WINDOW = "FROM NAMED WINDOW :w ON STREAM <mqtt://host/{s}> [RANGE {r} STEP {t}]"
_BODY = "WHERE { WINDOW :w { ?o saref:hasValue ?v . ?o saref:relatesToProperty :{s} } }"
TEXTS = [
    ("PREFIX b: <urn:b>\nPREFIX a: <urn:a>\nREGISTER RStream <out> AS\nSELECT (AVG(?v) AS ?x)\n" + _WINDOW + "\n" + _BODY),
    ("prefix a: <urn:a>  prefix b: <urn:b>\n# comment\nregister RStream <other> as select (avg(?v) as ?x) " + _WINDOW.lower() + " " + _BODY.lower().replace("hasvalue", "hasValue").replace("relatestoproperty", "relatesToProperty")),
    ("SELECT (COUNT(*) AS ?n) " + _WINDOW + " " + _BODY),
    ("SELECT (SUM(?v) AS ?x) (MAX(?v) AS ?y) " + _WINDOW + " " + _BODY.replace("?v .", "?v . FILTER(?v > 3)")),
    ("SELECT (MIN(?v) AS ?x) " + _WINDOW + " " + _WINDOW.replace(":w", ":w2").replace("{s}", "other") + " " + _BODY),
    ("SELECT DISTINCT (MAX(?v) AS ?x) " + _WINDOW + " " + _BODY + " GROUP BY ?o"),
    ("SELECT ( COUNT( * ) AS ?m ) # another name\n" + _WINDOW + " " + _BODY),
]
# What the texts are canonically.
_W = "FROM NAMED WINDOW :w ON STREAM<mqtt://host/{s}>[RANGE {r} STEP {t}]"
_B = "WHERE{WINDOW :w{?o saref:hasValue ?v . ?o saref:relatesToProperty :{s}}}"
_P = "PREFIX a: <urn:a> PREFIX b: <urn:b> "
CANONICAL = [
    _P + "SELECT(AVG(?v)AS ?x)" + _W + _B,
    _P + "SELECT(AVG(?v)AS ?x)" + _W + _B,
    "SELECT(COUNT(*)AS ?n)" + _W + _B,
    "SELECT(SUM(?v)AS ?x)(MAX(?v)AS ?y)" + _W + _B.replace("?v . ", "?v . FILTER(?v>3)"),
    "SELECT(MIN(?v)AS ?x)" + _W + _W.replace(":w", ":w2").replace("{s}", "other") + _B,
    "SELECT DISTINCT(MAX(?v)AS ?x)" + _W + _B + "GROUP BY ?o",
    "SELECT(COUNT(*)AS ?m)" + _W + _B,
]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of queries: consumer c asks one of the texts, of one of four streams, with a range of 60, 120 or 180 s."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"))
    text = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("c") % len(TEXTS) + 1).cast("int"))
    stream = F.element_at(F.array(*map(F.lit, ("accx", "accy", "accz", "hr"))), (F.floor(F.col("c") / 7) % 4 + 1).cast("int"))
    span = (F.floor(F.col("c") / 28) % 3 + 1) * 60_000
    text = F.replace(F.replace(F.replace(text, F.lit("{s}"), stream), F.lit("{r}"), span.cast("string")), F.lit("{t}"), F.lit("60000"))
    return rows.select(F.concat(F.lit("q"), F.lpad(F.col("c").cast("string"), 9, "0")).alias("query_id"), F.concat(F.lit("consumer"), F.col("c") % 97).alias("consumer_id"), text.alias("query_text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(texts: list[str]) -> str:
    return f"replace(replace(replace([{', '.join(map(_sql, texts))}][c % {len(TEXTS)} + 1], '{{s}}', ['accx', 'accy', 'accz', 'hr'][c // 7 % 4 + 1]), '{{r}}', CAST((c // 28 % 3 + 1) * 60000 AS VARCHAR)), '{{t}}', '60000')"


LOG = f"""log AS (
    SELECT 'q' || lpad(CAST(c AS VARCHAR), 9, '0') AS query_id, 'consumer' || (c % 97) AS consumer_id, c, {_filled(TEXTS)} AS query_text, {_filled(CANONICAL)} AS canonical,
           c % {len(TEXTS)} AS form, c // 7 % 4 AS s, c // 28 % 3 AS r
    FROM (SELECT c_custkey AS c FROM customer))"""


@query(f"WITH {LOG} SELECT query_id, canonical AS canonical_text, sha256(canonical) AS canonical_hash FROM log")
def canonical_query_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.canonical(query_log(spark, sf_dir)).select("query_id", "canonical_text", "canonical_hash")


@query(f"WITH {LOG}, g AS (SELECT CASE WHEN form = 1 THEN 0 ELSE form END AS form, s, r, count(*) AS consumers FROM log GROUP BY ALL) SELECT consumers, consumers - 1 AS hits, count(*) AS groups FROM g GROUP BY ALL")
def exact_reuse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.exact_reuse(query_log(spark, sf_dir)).groupBy("consumers", "hits").agg(F.count(F.lit(1)).alias("groups"))


@query(f"WITH {LOG} SELECT query_id, consumer_id, ['AVG', 'AVG', 'COUNT', 'MAX,SUM', 'MIN', 'MAX', 'COUNT'][form + 1] AS aggregates, 'SELECT' AS form, 'RSTREAM' AS output FROM log")
def query_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.query_signature(query_log(spark, sf_dir))


@query(
    f"""WITH {LOG}, d AS (SELECT query_id, ':w' AS window_name, ['accx', 'accy', 'accz', 'hr'][s + 1] AS topic, r FROM log UNION ALL SELECT query_id, ':w2', 'other', r FROM log WHERE form = 4)
    SELECT query_id, window_name, 'mqtt://host/' || topic AS stream, 'host' AS host, topic, CAST((r + 1) * 60000 AS BIGINT) AS range_ms, CAST(60000 AS BIGINT) AS step_ms FROM d"""
)
def window_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.window_declarations(query_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT count(*) AS queries, any_value(s) AS s, any_value(r) AS r, form = 4 AS two FROM log GROUP BY s, r, form = 4")
def equal_window_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that declare the same windows, whatever else they ask."""
    rows = reuse.window_sets(query_log(spark, sf_dir)).groupBy("window_set").agg(F.count(F.lit(1)).alias("queries"), F.min("query_id").alias("first"))
    c = F.substring("first", 2, 9).cast("long")
    return rows.select("queries", (F.floor(c / 7) % 4).alias("s"), (F.floor(c / 28) % 3).alias("r"), F.contains("window_set", F.lit("\n")).alias("two"))


STATE = "'mqtt://host/' || ['accx', 'accy', 'accz', 'hr'][s + 1] || '::' || md5(regexp_replace(canonical, 'SELECT.*?FROM', 'FROM')) || '::' || CASE WHEN form < 2 THEN '?v::sum,count::' ELSE '*::count::' END || ((r + 1) * 60000) || '::60000'"


@query(f"WITH {LOG} SELECT query_id, consumer_id, ['', '', '', 'construct', 'windows', 'construct', ''][form + 1] AS reason, CASE WHEN form IN (0, 1, 2, 6) THEN {STATE} END AS state_key FROM log")
def chunk_reuse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.reuse_class(query_log(spark, sf_dir)).select("query_id", "consumer_id", "reason", "state_key")


@query(
    f"""WITH {LOG}, e AS (SELECT canonical, min(query_id) AS first FROM log GROUP BY canonical), k AS (SELECT s, r, count(DISTINCT form) AS same FROM log WHERE form IN (2, 6) GROUP BY ALL)
    SELECT query_id, consumer_id, CASE WHEN query_id <> first THEN 'exact' WHEN form IN (2, 6) AND same > 1 THEN 'chunk_state' ELSE 'fresh' END AS level FROM log JOIN e USING (canonical) LEFT JOIN k USING (s, r)"""
)
def reuse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.reuse_level(query_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT query_id, CAST([7, 7, 7, 10, 9, 7, 7][form + 1] AS BIGINT) AS complexity FROM log")
def query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", reuse.query_complexity(F.col("query_text")).alias("complexity"))


@query(f"WITH {LOG}, d AS (SELECT s, r FROM log UNION ALL SELECT 9, r FROM log WHERE form = 4) SELECT count(*) AS dependencies, count(DISTINCT (s, r)) AS producers, round((count(*) - count(DISTINCT (s, r))) / count(*), 8) AS reused_share FROM d")
def reuse_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reuse.reuse_density(query_log(spark, sf_dir)), "reused_share")


