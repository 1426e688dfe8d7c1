"""Streams of observations: windows, panes recomposed, fan-out, late data, and the batch twins of stateful logic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from panemill.functions.tables import shared_folder, written
from panemill.functions.time import WindowSpec
from panemill.operators.windows import agg_columns


def _ms(ms: int) -> str:
    return f"{ms} milliseconds"


def observation_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Observations from parquet files as they appear in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select("event_id", F.col("event_type").alias("stream"), F.col("user_id").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")


def stream_window_agg(stream: DataFrame, spec: WindowSpec, aggs: Sequence, delay_ms: int, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Windowed aggregates in event time: with append output (``run_to_table``) each window once, when the watermark passes its end; with
    update output (``run_upserts``) at each change.  Rows later than the delay are dropped.  Needs step <= range."""
    window = F.window("ts", _ms(spec.range_ms), _ms(spec.step_ms), _ms(spec.origin_ms % spec.step_ms))
    rows = stream.withWatermark("ts", _ms(delay_ms)).groupBy(*keys, window).agg(*agg_columns(aggs))
    return rows.select(*keys, F.unix_millis("window.start").alias("win_start"), F.unix_millis("window.end").alias("win_end"), *[c for c in rows.columns if c not in (*keys, "window")])


def stream_recompose(stream: DataFrame, spec: WindowSpec, pane_ms: int, delay_ms: int, keys: Sequence[str] = ("stream",), require_complete: bool = True) -> DataFrame:
    """Windows from pane states, as two chained aggregates: the second keeps one small row a pane instead of raw rows.

    A producer is one value of the keys.  Only windows of which it delivered every pane are given out, unless told otherwise.
    """
    pane = F.window("ts", _ms(pane_ms))
    states = stream.withWatermark("ts", _ms(delay_ms)).groupBy(*keys, pane.alias("pane"))
    states = states.agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    window = F.window("pane", _ms(spec.range_ms), _ms(spec.step_ms))
    merged = states.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("panes"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))
    if require_complete:
        merged = merged.where(F.col("panes") == spec.range_ms // pane_ms)
    return merged.select(*keys, F.unix_millis("window.start").alias("win_start"), F.unix_millis("window.end").alias("win_end"), "panes", "count", "sum", "min", "max", F.try_divide("sum", "count").alias("avg"))


def run_to_table(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, with append output into a parquet table, and returns the table."""
    out = shared_folder(spark, name)
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


def _run_batches(spark: SparkSession, rows: DataFrame, name: str, mode: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream batch by batch into a folder for each batch, so a batch that is repeated replaces itself; adds ``emission``, the batch's number."""
    out = shared_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/data/emission={number}")

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{rows.schema.toDDL()}, emission long").parquet(f"{out}/data")


def run_upserts(spark: SparkSession, rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Runs a stream with update output: a row at each change of content, of which the latest version of each key is the table."""
    versions = _run_batches(spark, rows, name, "update", lambda batch: batch)
    rest = [c for c in rows.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "emission").alias("last"), F.count(F.lit(1)).alias("versions")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest), "versions")


def run_ordered(spark: SparkSession, rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Runs a stream with append output in chronological order: windows come out as the watermark passes their ends, so batches
    follow one another in time, and each batch is range-sorted.  Adds emission."""
    return _run_batches(spark, rows, name, "append", lambda batch: batch.repartitionByRange(*order).sortWithinPartitions(*order))


def early_windows(stream: DataFrame, spec: WindowSpec, aggs: Sequence, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Windows by the time of processing: what arrived in each [now - range, now], one for each step, whatever its event time."""
    now = stream.withColumn("arrived", F.current_timestamp())
    window = F.window("arrived", _ms(spec.range_ms), _ms(spec.step_ms))
    rows = now.withWatermark("arrived", "0 seconds").groupBy(*keys, window).agg(*agg_columns(aggs))
    return rows.select(*keys, F.unix_millis("window.start").alias("win_start"), F.unix_millis("window.end").alias("win_end"), *[c for c in rows.columns if c not in (*keys, "window")])


def stop_when_quiet(query: StreamingQuery, most_ms: int, multiple: float = 3.0, poll_s: float = 0.2) -> float:
    """Stops a running stream once nothing has arrived for min(usual interval * multiple, most_ms); the seconds it was quiet."""
    last, first, batches, seen = time.monotonic(), None, 0, -1
    while query.isActive:
        progress = query.lastProgress
        if progress and progress["batchId"] != seen and progress["numInputRows"] > 0:
            last, seen, batches = time.monotonic(), progress["batchId"], batches + 1
            first = first or last
        usual = (last - first) / (batches - 1) * 1000 if batches > 1 else most_ms
        if (quiet := time.monotonic() - last) * 1000 > min(max(usual * multiple, poll_s * 1000), most_ms):
            query.stop()
            return quiet
        time.sleep(poll_s)
    return 0.0


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """One stream into several sinks; each batch is computed once.  A batch may come twice after a failure, with the same number, by which sinks can replace it."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- batch twins


def late_classes(arrivals: DataFrame, spec: WindowSpec, delay_ms: int) -> DataFrame:
    """Arrivals (ms, arrived) as on_time, late (behind the watermark, but its last window still open) or too_late.

    The watermark before an arrival is the latest time seen before it less the delay.  Arrivals are range-partitioned by arrival; running maxima
    are taken within each part, and over the parts' maxima, so no task sorts all arrivals.
    """
    rows = written(arrivals.repartitionByRange("arrived", "event_id").withColumn("part", F.spark_partition_id()), "arrivals")
    inside = W.partitionBy("part").orderBy("arrived", "event_id").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("part").agg(F.max("ms").alias("top"))  # a row for each part
    before = tops.withColumn("seen_before", F.max("top").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("top")
    rows = rows.withColumn("inside", F.max("ms").over(inside)).join(F.broadcast(before), "part")
    rows = rows.withColumn("watermark", F.greatest("inside", "seen_before"))
    last_end = F.col("ms") - F.pmod(F.col("ms"), F.lit(spec.step_ms)) + spec.range_ms
    kind = F.when(F.col("watermark").isNull() | (F.col("ms") >= F.col("watermark")), "on_time").when(last_end + delay_ms > F.col("watermark"), "late").otherwise("too_late")
    return rows.drop("inside", "seen_before", "part").withColumn("class", kind)


def producer_watermarks(states: DataFrame, producer: str, watermark: str, arrival: Sequence[str]) -> DataFrame:
    """Each producer's watermarks in order of arrival: advanced, equal (both accepted) or rejected for going back.  A producer has a state for each pane."""
    before = W.partitionBy(producer).orderBy(*arrival).rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(watermark).over(before)
    return states.withColumn("seen", seen).withColumn("verdict", F.when(F.col("seen").isNull() | (F.col(watermark) > F.col("seen")), "advanced").when(F.col(watermark) == F.col("seen"), "equal").otherwise("rejected")).drop("seen")


def reconstruction_watermark(states: DataFrame, producer: str, watermark: str, n: int) -> DataFrame:
    """The least of the producers' latest watermarks, once n producers have reported; else null."""
    latest = states.groupBy(producer).agg(F.max(watermark).alias("latest"))
    return latest.agg(F.count(F.lit(1)).alias("producers"), F.min("latest").alias("least")).select("producers", F.when(F.col("producers") >= n, F.col("least")).alias("watermark"))


def finalizable(windows: DataFrame, obs: DataFrame, n_streams: int, replay_over: bool = False) -> DataFrame:
    """Windows whose end all streams have reached; all of them once a finite replay is over."""
    reached = obs.groupBy("stream").agg(F.max("ms").alias("latest")).agg(F.min("latest").alias("reached"), F.count(F.lit(1)).alias("streams"))
    final = F.lit(replay_over) | ((F.col("streams") >= n_streams) & (F.col("win_end") <= F.col("reached")))
    return windows.join(F.broadcast(reached)).where(final).select(*windows.columns)


def _accept(times: Sequence[int], last: int | None, step_ms: int, tol_ms: int) -> tuple[list[bool], int | None]:
    """Folds over times in order: a time passes if the last accepted lies about a whole number of steps, one at least, before it."""
    kept = []
    for t in times:
        apart = None if last is None else t - last
        near = apart is None or (apart >= step_ms - tol_ms and min(apart % step_ms, step_ms - apart % step_ms) <= tol_ms)
        kept.append(near)
        if near:
            last = t
    return kept, last


def cadence_filter(rows: DataFrame, step_ms: int, tol_ms: int, keys: Sequence[str], at: str = "emitted_at") -> DataFrame:
    """Results that come in the step's rhythm.  Whether one passes depends on the last that passed, so each key is a fold, over one result a window:
    as many as time has steps, whatever the number of raw rows.  ``stream_cadence`` keeps the last accepted time only."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        return part[_accept(part[at].tolist(), None, step_ms, tol_ms)[0]]

    return rows.groupBy(*keys).applyInPandas(fold, rows.schema)


def stream_cadence(stream: DataFrame, step_ms: int, tol_ms: int, key: str, at: str = "emitted_at") -> DataFrame:
    """The same filter on a stream: the last accepted time is the state of each key.  key and accepted time come out."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for part in parts for t in part[at].tolist())
        kept, last = _accept(times, last, step_ms, tol_ms)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * sum(kept), at: [t for t, ok in zip(times, kept, strict=True) if ok]})

    return stream.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} string, {at} long", "last long", "append", GroupStateTimeout.NoTimeout)
