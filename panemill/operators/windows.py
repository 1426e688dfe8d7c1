"""Windowed aggregation over observations (stream, sensor, ms, value, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panemill.functions.tables import small
from panemill.functions.time import WindowSpec, align_start, window_number, window_starts

#: The aggregates that queries may ask for.
AGGREGATES = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "count_all": lambda _: F.count(F.lit(1))}


def aliases(aggs: Sequence[str | tuple[str, str]]) -> dict[str, str]:
    """Aggregates, given by name or as (name, alias), by alias.  The same alias twice is kept once; with another aggregate it is an error."""
    found: dict[str, str] = {}
    for item in aggs:
        name, alias = (item, item) if isinstance(item, str) else item
        if found.setdefault(alias, name) != name:
            raise ValueError(f"alias {alias} stands for {found[alias]} and for {name}")
    return found


def agg_columns(aggs: Sequence[str | tuple[str, str]], value: str = "value") -> list[Column]:
    """The aggregates as columns."""
    return [AGGREGATES[name](value).alias(alias) for alias, name in aliases(aggs).items()]


def assign_windows(obs: DataFrame, spec: WindowSpec) -> DataFrame:
    """A row for each observation and window that holds it: win_start, win_end."""
    start = F.explode(window_starts(F.col("ms"), spec.range_ms, spec.step_ms, spec.origin_ms)).alias("win_start")
    return obs.select("*", start).withColumn("win_end", F.col("win_start") + spec.range_ms)


def window_agg(obs: DataFrame, spec: WindowSpec, aggs: Sequence, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Aggregates of each window, straight from the observations."""
    return assign_windows(obs, spec).groupBy(*keys, "win_start", "win_end").agg(*agg_columns(aggs))


def tumbling_agg(obs: DataFrame, range_ms: int, aggs: Sequence, keys: Sequence[str] = ("stream",), origin_ms: int = 0) -> DataFrame:
    """Aggregates of windows side by side; no row is copied."""
    start = align_start(F.col("ms"), range_ms, origin_ms)
    rows = obs.withColumn("win_start", start).withColumn("win_end", F.col("win_start") + range_ms)
    return rows.groupBy(*keys, "win_start", "win_end").agg(*agg_columns(aggs))


def union_window_agg(streams: Sequence[DataFrame], spec: WindowSpec, aggs: Sequence) -> DataFrame:
    """One aggregate over several streams' observations."""
    return window_agg(reduce(DataFrame.unionByName, streams), spec, aggs, keys=())


def multi_spec_agg(obs: DataFrame, specs: DataFrame, aggs: Sequence, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """The same aggregate for every (id, range_ms, step_ms, and origin_ms if there is one) of a small table, in one pass over the observations.

    Rows are first brought to one state for each key and pane, the widest that fits all specifications; windows are made from those.
    """
    specs = specs.select("id", "range_ms", "step_ms", (F.col("origin_ms") if "origin_ms" in specs.columns else F.lit(0)).cast("long").alias("origin_ms"))
    rows = small(specs).collect()
    if not rows:
        return window_agg(obs.limit(0), WindowSpec(1, 1), aggs, keys).select(F.lit(None).cast(specs.schema["id"].dataType).alias("id"), "*")
    pane = gcd(*(int(r[c]) for r in rows for c in ("range_ms", "step_ms", "origin_ms")))
    parts = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "count_all": lambda _: F.count(F.lit(1))}
    states = obs.groupBy(*keys, align_start(F.col("ms"), pane).alias("ms")).agg(*(f("value").alias(f"_{name}") for name, f in parts.items()))
    states = states.join(small(specs))
    states = states.withColumn("win_start", F.explode(window_starts(F.col("ms"), F.col("range_ms"), F.col("step_ms"), F.col("origin_ms"))))
    states = states.withColumn("win_end", F.col("win_start") + F.col("range_ms"))
    merged = {"count": F.sum("_count"), "sum": F.sum("_sum"), "min": F.min("_min"), "max": F.max("_max"), "count_all": F.sum("_count_all")}
    merged["avg"] = F.when(F.sum("_count") > 0, F.sum("_sum") / F.sum("_count"))
    return states.groupBy("id", *keys, "win_start", "win_end").agg(*(merged[name].alias(alias) for alias, name in aliases(aggs).items()))


def exact_baseline(obs: DataFrame, spec: WindowSpec, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Count, sum, avg, min and max of every window."""
    return window_agg(obs, spec, ["count", "sum", "avg", "min", "max"], keys)


def logical_windows(spans: DataFrame, spec: WindowSpec, anchor: str = "anchor", tolerance_ms: int = 1000) -> DataFrame:
    """From (first_ms, last_ms, anchor): the window that a bundle of rows belongs to, and whether the rows span it."""
    index = F.greatest(F.lit(0), F.floor((F.col("first_ms") - F.col(anchor)) / spec.step_ms)).cast("long")
    start = F.col(anchor) + index * spec.step_ms
    whole = (F.col("last_ms") - F.col("first_ms")) >= spec.range_ms - tolerance_ms
    return spans.withColumn("win_index", index).withColumn("win_start", start).withColumn("win_end", start + spec.range_ms).withColumn("complete", whole)


def completeness(windows: DataFrame, expected: Column, spec: WindowSpec, tolerance_ms: int = 1000) -> DataFrame:
    """Adds expected_count, allowed_missing and status of (win_start, win_end, first_ms, last_ms, count)."""
    allowed = F.greatest(F.lit(2.0), F.ceil(expected * 0.01).cast("double"))
    status = (
        F.when(~(F.col("win_end") > F.col("win_start")), "invalid_window_bounds")
        .when(F.col("last_ms") - F.col("first_ms") < spec.range_ms - tolerance_ms, "incomplete_span")
        .when(F.col("count") < expected - allowed, "incomplete_count")
        .otherwise("complete")
    )
    return windows.withColumn("expected_count", expected).withColumn("allowed_missing", allowed).withColumn("status", status)


def numbered(windows: DataFrame, anchor: int | Column, spec: WindowSpec) -> DataFrame:
    return windows.withColumn("window_number", window_number(F.col("win_start"), anchor, spec.step_ms))


def comparable(first: Column, last: Column, start: Column, end: Column, spec: WindowSpec, least_ms: int) -> Column:
    """Whether a window has its full range and its rows span at least ``least_ms`` of it."""
    return (last - first >= least_ms) & (end - start == spec.range_ms)


def first_windows(windows: DataFrame, most: int) -> DataFrame:
    """The first so many numbered output windows."""
    return windows.where(F.col("window_number") <= most)


def merge_streams(partials: DataFrame, n_streams: int, first_by: Sequence[str]) -> DataFrame:
    """Partials (window_number, stream, count, sum, min, max, ...) of at least n streams merged by window; each stream's first partial counts."""
    first = partials.groupBy("window_number", "stream").agg(F.min_by(F.struct("count", "sum", "min", "max"), F.struct(*first_by)).alias("p")).select("window_number", "stream", "p.*")
    merged = first.groupBy("window_number").agg(
        F.count_distinct("stream").alias("streams"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    return merged.where(F.col("streams") >= n_streams).withColumn("avg", F.try_divide("sum", "count"))


def relation_to_stream(result: DataFrame, spec: WindowSpec, mode: str, keys: Sequence[str]) -> DataFrame:
    """rstream: each window's rows; istream: rows that the window before had not; dstream: rows of the window before that are gone.

    A window's rows are told apart by ``keys``; win_start names the window that reports.
    """
    if mode == "rstream":
        return result
    # Only windows that exist report; the one before is a step earlier.
    shift = spec.step_ms if mode == "istream" else -spec.step_ms
    other = result.select("win_start", *keys).withColumn("win_start", F.col("win_start") + shift)
    if mode == "istream":
        return result.join(other, ["win_start", *keys], "left_anti")
    if mode == "dstream":
        gone = result.join(other, ["win_start", *keys], "left_anti").withColumn("win_start", F.col("win_start") + spec.step_ms).withColumn("win_end", F.col("win_end") + spec.step_ms)
        return gone.join(result.select("win_start").distinct(), "win_start", "left_semi")
    raise ValueError(f"unknown mode {mode}")
