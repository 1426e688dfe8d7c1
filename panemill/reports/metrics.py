"""Accuracy, latency and series reports over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.functions.tables import broadcast_if_small, numbered, quantiles, same_keys, with_previous
from panemill.functions.time import WindowSpec


def with_gap(rows: DataFrame, keys: Sequence[str], bucket_ms: int) -> DataFrame:
    """Adds gap: milliseconds since the key's row before."""
    rows = with_previous(rows, keys, ["ms", "event_id"], F.floor(F.col("ms") / bucket_ms))
    return rows.withColumn("gap", F.col("ms") - F.col("previous.ms")).drop("previous")


def inactivity(rows: DataFrame, keys: Sequence[str], multiple: float, most_ms: int) -> DataFrame:
    """Rows that follow a silence longer than the usual gap times ``multiple``, or than ``most_ms``."""
    usual = rows.groupBy(*keys).agg(F.try_divide(F.max("ms") - F.min("ms"), F.count(F.lit(1)) - 1).alias("usual"))  # the mean of all gaps; null for one row
    gaps = with_gap(rows, keys, most_ms)
    return gaps.join(usual, list(keys)).where(F.col("gap") > F.least(F.col("usual") * multiple, F.lit(float(most_ms))))


def matched(baseline: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both values side by side by key: base, value."""
    return baseline.select(*keys, F.col("value").alias("base")).join(result.select(*keys, "value"), list(keys), "full")


def accuracy(baseline: DataFrame, result: DataFrame, keys: Sequence[str], by: Sequence[str] = (), tol: float = 1e-12) -> DataFrame:
    """Matched and unmatched windows, mean absolute, root mean square, mean absolute percentage (base not 0) and largest error, exact matches."""
    error = F.abs(F.col("value") - F.col("base"))
    both = F.col("base").isNotNull() & F.col("value").isNotNull()
    return matched(baseline, result, keys).groupBy(*by).agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("value").isNull()).alias("baseline_only"),
        F.count_if(F.col("base").isNull()).alias("approach_only"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.when(F.col("base") != 0, error / F.abs("base") * 100)).alias("mape"),
        F.max(error).alias("max_error"),
        F.count_if(both & (error <= tol)).alias("exact"),
    )


def accuracy_positional(baseline: DataFrame, result: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Mean absolute percentage error of rows matched by their position; a base of 0 counts as 0 %."""
    place = lambda df: numbered(df, keys, [order])
    pairs = place(baseline).select(*keys, "place", F.col("value").alias("base")).join(place(result).select(*keys, "place", "value"), [*keys, "place"])
    error = F.when(F.col("base") == 0, 0.0).otherwise(F.abs((F.col("value") - F.col("base")) / F.col("base")) * 100)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("compared"), F.avg(error).alias("mape"))


def correlation(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson correlation of base and value; null where one of them doesn't vary."""
    varied = (F.stddev_pop("base") > 0) & (F.stddev_pop("value") > 0)
    return pairs.groupBy(*keys).agg(F.when(varied, F.corr("base", "value")).alias("correlation"))


def percentage_accuracy(base: Column, value: Column) -> Column:
    return F.when(base == 0, F.when(value == 0, 100.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 100 - F.abs((value - base) / base) * 100))


def grade(mape: Column) -> Column:
    return F.when(mape < 1, "good").when(mape < 5, "fair").otherwise("poor")


def equivalence(base: Column, value: Column, comparable: Column, tol: float = 1e-3) -> Column:
    error = F.abs(value - base)
    return F.when(~comparable | error.isNull(), "not_comparable").when(error == 0, "exact").when(error <= tol, "numerically_equivalent").otherwise("non_exact")


def winners(errors: DataFrame, case: Sequence[str], group: str) -> DataFrame:
    """How often each approach has the smallest error of a case (first by name if equal), by group."""
    best = errors.groupBy(*case, group).agg(F.min(F.struct("error", "approach")).alias("best"))
    return best.groupBy(group, F.col("best.approach").alias("winner")).agg(F.count(F.lit(1)).alias("wins"))


def anchored_latency(results: DataFrame, spec: WindowSpec) -> DataFrame:
    """Close of each window by the registration, and the result's delay behind registration and close."""
    close = F.col("registered_at") + spec.range_ms + (F.col("window_number") - 1) * spec.step_ms
    rows = results.withColumn("expected_close", close)
    return rows.withColumn("since_registration", F.col("emitted_at") - F.col("registered_at")).withColumn("after_close", F.col("emitted_at") - F.col("expected_close"))


def emission_latencies(results: DataFrame, spec: WindowSpec) -> DataFrame:
    """Delay behind the close that counts from the first data, wait from the last pane to the trigger, and computation from trigger to result."""
    close = F.col("first_data_at") + spec.range_ms + (F.col("window_number") - 1) * spec.step_ms
    rows = results.withColumn("after_data_close", F.col("emitted_at") - close)
    return rows.withColumn("interval_wait", F.col("triggered_at") - F.col("last_pane_at")).withColumn("computation", F.col("emitted_at") - F.col("triggered_at"))


def expected_value(rate: Column, at: Column, growing: Column) -> Column:
    """What an exponential series should show at a time: exp(rate * t), or exp(-rate * t) where it falls."""
    return F.exp(F.when(growing, rate * at).otherwise(-rate * at))


def wall_clock_close(results: DataFrame, most_apart_ms: int = 86_400_000) -> DataFrame:
    """Wall-clock close of event-time windows, with the status of the mapping."""
    mapped = F.col("runtime_anchor") + F.col("win_end") - F.col("event_anchor")
    status = (
        F.when(F.col("runtime_anchor").isNull(), "runtime_anchor_missing")
        .when(F.col("event_anchor").isNull() | F.col("win_end").isNull(), "event_time_missing")
        .when(F.abs(F.col("emitted_at") - mapped) > most_apart_ms, "domain_mismatch")
        .otherwise("wall_clock_mapped")
    )
    return results.withColumn("domain_status", status).withColumn("wall_close", F.when(status == "wall_clock_mapped", mapped))


def ready_to_emit(required: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """When the last pane that a window needs arrived, and how long the result took after it."""
    ready = required.groupBy(*keys).agg(F.max("arrived_at").alias("ready_at"))
    rows = results.join(ready, list(keys))
    return rows.withColumn("ready_to_result", F.col("emitted_at") - F.col("ready_at")).withColumn("close_to_ready", F.col("ready_at") - F.col("win_end"))


def startup_latency(rows: DataFrame) -> DataFrame:
    """The first usable of several candidates for the time to the first result, and why others were not."""
    data = F.when(F.col("first_data_at").isNotNull() & (F.col("emitted_at") >= F.col("first_data_at")), F.col("emitted_at") - F.col("first_data_at"))
    registered = F.when(F.col("emitted_at") >= F.col("registered_at"), F.col("emitted_at") - F.col("registered_at"))
    reason = F.when(data.isNotNull(), "data_start").when(registered.isNotNull(), F.when(F.col("first_data_at").isNull(), "no_data_start").otherwise("data_after_result")).otherwise("invalid")
    return rows.withColumn("startup_ms", F.coalesce(data, registered)).withColumn("startup_basis", reason)


def first_emitted_accuracy(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidate's first emitted window against the baseline's result of that window."""
    first = candidate.groupBy(*keys).agg(F.min_by(F.struct("win_start", "value"), F.struct("emitted_at", "win_start")).alias("first")).select(*keys, "first.win_start", "first.value")
    rows = first.join(baseline.select(*keys, "win_start", F.col("value").alias("base")), [*keys, "win_start"], "left")
    return rows.withColumn("error_pct", F.when(F.col("base") != 0, F.abs((F.col("value") - F.col("base")) / F.col("base")) * 100))


def summarize(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str], std: str = "pop", accuracy: int | None = None) -> DataFrame:
    """Count, mean, spread, extremes, median and 95th percentile of each metric.

    Percentiles are exact, by linear interpolation, from counted values that are dealt to tasks by ranges; with an ``accuracy`` they are approximate (rank error 1 / accuracy),
    without a further pass.
    """
    at = (lambda m, q: F.lit(None)) if accuracy is None else (lambda m, q: F.percentile_approx(m, q, accuracy))
    spread = {"pop": F.stddev_pop, "samp": F.stddev_samp}[std]
    columns = [
        column
        for m in metrics
        for column in (
            F.count(m).alias(f"{m}_n"),
            F.avg(m).alias(f"{m}_mean"),
            spread(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
            at(m, 0.5).alias(f"{m}_median"),
            at(m, 0.95).alias(f"{m}_p95"),
        )
    ]
    out = rows.groupBy(*keys).agg(*columns)
    if accuracy is not None:
        return out
    order, exact = out.columns, [f"{m}_{name}" for m in metrics for name in ("median", "p95")]
    return same_keys(out.drop(*exact), quantiles(rows, keys, {m: F.col(m) for m in metrics}, {"median": 0.5, "p95": 0.95}), keys).select(*order)


def rank_percentile(rows: DataFrame, metric: str, keys: Sequence[str], p: float) -> DataFrame:
    """The value at place floor(n * p) of the sorted values, counted from 0."""
    ranked = numbered(rows.select(*keys, metric).where(F.col(metric).isNotNull()), keys, [metric], "place", "n")
    return ranked.where(F.col("place") - 1 == F.least(F.floor(F.col("n") * p), F.col("n") - 1)).select(*keys, F.col(metric).alias("value"))


def rollup(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], ok: Column) -> DataFrame:
    """Means and spreads of metrics over iterations, and the share of those that succeeded."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"),
        F.avg(ok.cast("double")).alias("success_rate"),
        *(c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))),
    )


def ratio_to(rows: DataFrame, baseline: str, metrics: Sequence[str], keys: Sequence[str], kind: str = "saving") -> DataFrame:
    """Each approach's metrics against the baseline's, case by case: (base - value) / base, or with the other sign as overhead; mean and spread.

    score is the mean over the metrics, and best tells the approach of the greatest score (of overheads, the least).
    """
    sign = {"saving": 1, "overhead": -1}[kind]
    base = rows.where(F.col("approach") == baseline).select(*keys, *(F.col(m).alias(f"{m}_base") for m in metrics))
    pairs = rows.where(F.col("approach") != baseline).join(base, list(keys))
    ratio = {m: F.when(F.col(f"{m}_base") != 0, sign * (1 - F.col(m) / F.col(f"{m}_base"))) for m in metrics}
    out = pairs.groupBy("approach").agg(*(c for m, r in ratio.items() for c in (F.avg(r).alias(f"{m}_{kind}"), F.stddev_pop(r).alias(f"{m}_spread"))))
    means = F.array_compact(F.array(*(F.col(f"{m}_{kind}") for m in metrics)))
    out = out.withColumn("score", F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(means), F.lit(0)))
    top = out.agg((F.max_by if sign > 0 else F.min_by)("approach", "score").alias("top"))  # one row
    return out.join(F.broadcast(top)).withColumn("best", F.col("approach") == F.col("top")).drop("top")


def matrix_missing(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Cells of (first, second) without a run."""
    grid = runs.select(first).distinct().join(broadcast_if_small(runs.select(second).distinct()))
    return grid.join(runs.select(first, second).distinct(), [first, second], "left_anti")


def first_vs_average_error(pairs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first result's percentage error beside the mean, least and greatest of all."""
    error = F.abs(F.try_divide(F.col("value") - F.col("base"), "base")) * 100
    rows = pairs.where("base <> 0").withColumn("error", error)
    return rows.groupBy(*keys).agg(F.min_by("error", order).alias("first_error"), F.avg("error").alias("mean_error"), F.min("error").alias("least_error"), F.max("error").alias("greatest_error"))


def run_validity(runs: DataFrame, baseline: str, keys: Sequence[str], tol: float) -> DataFrame:
    """Reasons against each run (no windows, too few, fall-backs, error over the tolerance); valid without any."""
    base = runs.where(F.col("approach") == baseline).select(*keys, F.col("windows").alias("base_windows"), F.col("value").alias("base_value"))
    rows = runs.join(base, list(keys), "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("windows") == 0, "no_windows"),
            F.when(F.col("base_value").isNull(), "no_baseline"),
            F.when(F.col("windows") < F.col("base_windows"), "missing_windows"),
            F.when(F.col("fallbacks") > 0, "fallbacks"),
            F.when(F.abs(F.col("value") - F.col("base_value")) > tol, "error"),
        )
    )
    return rows.withColumn("reasons", F.concat_ws(";", reasons)).withColumn("valid", F.size(reasons) == 0)


def relative_error_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    error = F.when(F.col("base") != 0, F.abs((F.col("value") - F.col("base")) / F.col("base")) * 100)
    out = pairs.groupBy(*keys).agg(
        F.count(error).alias("n"),
        F.count_if(F.col("base") == F.col("value")).alias("exact"),
        F.avg(error).alias("mean_pct"),
        F.max(error).alias("max_pct"),
    )
    return same_keys(out, quantiles(pairs, keys, {"median": error}, {"pct": 0.5}), keys)


# --- series


def latest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key.  One aggregate, so a key's rows need not be sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, *(f"last.{c}" for c in rest))


def result_intervals(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("interval", F.col(order) - F.lag(order).over(W.partitionBy(*keys).orderBy(order)))


def stable_cadence(rows: DataFrame, keys: Sequence[str], order: str, step_ms: int, tol_ms: int) -> DataFrame:
    """Whether all intervals of a key lie within the step and tolerance."""
    gaps = result_intervals(rows, keys, order)
    return gaps.groupBy(*keys).agg(F.count("interval").alias("intervals"), F.coalesce(F.bool_and(F.abs(F.col("interval") - step_ms) <= tol_ms), F.lit(True)).alias("stable"))


def first_complete(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key that is complete and comparable."""
    return rows.where(F.col("complete") & F.col("comparable")).groupBy(*keys).agg(F.min(order).alias(order), F.min_by("value", order).alias("value"))


def head_tail_trend(rows: DataFrame, field: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Means of the first and the last tenth (10 rows at most) and the change in percent."""
    ranked = numbered(rows, keys, order, "place", "n")
    take = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)))
    out = ranked.groupBy(*keys).agg(F.avg(F.when(F.col("place") <= take, F.col(field))).alias("head"), F.avg(F.when(F.col("place") > F.col("n") - take, F.col(field))).alias("tail"))
    return out.withColumn("change_pct", F.when(F.col("head") != 0, (F.col("tail") - F.col("head")) / F.col("head") * 100))


def series_profile(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start, end, extremes, change, duration, mean interval, change over the first 10, 50 and 100 rows, values at the quarters."""
    ranked = numbered(obs.select(*keys, "ms", "event_id", "value"), keys, ["ms", "event_id"], "place", "n")
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("value")))
    first = (10, 50, 100)
    out = ranked.groupBy(*keys).agg(
        at(F.lit(1)).alias("start_value"),
        at(F.col("n")).alias("end_value"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("ms") - F.min("ms")).alias("duration_ms"),
        F.max("n").alias("rows"),
        *(at(F.least(F.col("n"), F.lit(k))).alias(f"change_first_{k}") for k in first),
        *(at(F.floor((F.col("n") - 1) * q) + 1).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)),
    )
    out = out.withColumn("change", F.col("end_value") - F.col("start_value")).withColumn("change_pct", F.when(F.col("start_value") != 0, F.col("change") / F.col("start_value") * 100))
    out = out.withColumn("mean_interval_ms", F.when(F.col("rows") > 1, F.col("duration_ms") / (F.col("rows") - 1)))
    return out.withColumns({f"change_first_{k}": F.col(f"change_first_{k}") - F.col("start_value") for k in first})


def trend(rows: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """increasing, decreasing, flat or mixed, and the slope of y over x."""
    order = W.partitionBy(*keys).orderBy(x)
    steps = rows.withColumn("d", F.col(y) - F.lag(y).over(order))
    kind = F.when(F.bool_and(F.col("d") == 0), "flat").when(F.bool_and(F.col("d") >= 0), "increasing").when(F.bool_and(F.col("d") <= 0), "decreasing").otherwise("mixed")
    return steps.groupBy(*keys).agg(F.coalesce(kind, F.lit("mixed")).alias("trend"), F.regr_slope(y, x).alias("slope"))
