"""Queries on streams with keyed state: each stream is cut in several batches, and the rows must be those of the SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.tables import written
from panemill.queries.registry import ANCHOR, HOUR, OBS, PANE, PANES, SPEC, SUB, TARGETS, WINS, obs, query, rounded, sliding, states, sub_results, targets
from panemill.streaming import stateful as S
from panemill.streaming.streams import run_ordered, stream_window_agg

DELAY = HOUR
BATCHES = 6
PRODUCERS = ("click", "error", "purchase", "signup", "view")
NTH = f"((start_ms - {ANCHOR}) // {PANE})"
# A pane's message: some come two panes late, some twice (the second with doubled sums), some with a watermark behind the producer's last.
_LATE = f"{NTH} * 10 + CASE WHEN {NTH} % 7 = 3 THEN 25 ELSE 0 END"
MESSAGES = f"""{PANES}, sent AS (SELECT stream AS producer, start_ms, end_ms, count * copy AS count, sum * copy AS sum, min, max, {_LATE} + (copy - 1) * 10 AS arrival, {NTH} AS nth FROM panes, unnest(range(1, CASE WHEN {NTH} % 5 = 2 THEN 3 ELSE 2 END)) AS t(copy)),
messages AS (SELECT *, {ANCHOR} + (arrival // 10 - 3 - CASE WHEN nth % 11 = 5 THEN 5 ELSE 0 END) * {PANE} AS watermark FROM sent),
judged AS (SELECT *, max(watermark) OVER (PARTITION BY producer ORDER BY arrival, start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM messages),
verdicts AS (SELECT *, CASE WHEN watermark < seen THEN 'rejected' WHEN row_number() OVER (PARTITION BY producer, start_ms, watermark < coalesce(seen, watermark) ORDER BY arrival) > 1 THEN 'duplicate' ELSE 'kept' END AS kind FROM judged),
reached AS (SELECT min(w) AS least, count(*) AS n FROM (SELECT producer, max(watermark) AS w FROM messages GROUP BY producer))"""


def _batched(rows: DataFrame, order: str) -> DataFrame:
    """Adds batch: six parts of equal length by an order."""
    span = rows.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    part = F.floor((F.col(order) - F.col("_lo")) * BATCHES / (F.col("_hi") - F.col("_lo") + 1))
    return rows.join(F.broadcast(span)).withColumn("batch", part).drop("_lo", "_hi")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.floor((F.col("start_ms") - ANCHOR) / PANE)
    rows = states(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(nth % 5 == 2, 2).otherwise(1))))
    arrival = nth * 10 + F.when(nth % 7 == 3, 25).otherwise(0) + (F.col("copy") - 1) * 10
    rows = rows.select(F.lit("all").alias("plan"), F.col("stream").alias("producer"), "start_ms", "end_ms", (F.col("count") * F.col("copy")).alias("count"), (F.col("sum") * F.col("copy")).alias("sum"), "min", "max", arrival.alias("arrival"), nth.alias("nth"))
    mark = ANCHOR + (F.floor(F.col("arrival") / 10) - 3 - F.when(F.col("nth") % 11 == 5, 5).otherwise(0)) * PANE
    return _batched(written(rows.withColumn("watermark", mark).drop("nth"), "messages"), "arrival")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir)
    stream = S.batch_stream(rows, "batch", BATCHES, "messages_in")
    return S.run_counted(S.pane_store(stream, SPEC, PANE, PRODUCERS), "pane_store")[0]


@query(
    f"""WITH {MESSAGES}, kept AS (SELECT * FROM verdicts WHERE kind = 'kept')
    SELECT win_start, win_end, count(*) AS panes, CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 8) AS sum, min(min) AS min, max(max) AS max, count(*) = 15 AS complete FROM ({sliding('kept', 'start_ms')}), reached WHERE n = 5 AND win_end <= least GROUP BY ALL"""
)
def stream_pane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five producers' panes, which come out of order, twice, or with a watermark that goes back, in six batches."""
    return rounded(_stored(spark, sf_dir).where("kind = 'window'"), "sum").select("win_start", "win_end", "panes", "count", "sum", "min", "max", "complete")


@query(f"WITH {MESSAGES} SELECT producer, start_ms, kind FROM verdicts WHERE kind <> 'kept'")
def stream_pane_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the pane store has dropped, and why."""
    return _stored(spark, sf_dir).where("kind <> 'window'").select("producer", F.col("win_start").alias("start_ms"), "kind")


def _event_batches(spark: SparkSession, sf_dir: str, arrived: str = "ms") -> DataFrame:
    """Events in six batches by a time of arrival."""
    rows = obs(spark, sf_dir).select("event_id", "stream", "sensor", "ts", "ms", "value").withColumn("arrived", F.expr(arrived))
    return _batched(rows, "arrived").drop("arrived")


LAG = 48 * HOUR


@query(
    f"""WITH {WINS}, marks AS (SELECT min(m) - {DELAY} AS watermark FROM (SELECT max(ms) AS m FROM obs WHERE stream <> 'view' UNION ALL SELECT max(ms) FROM obs WHERE stream = 'view' AND ms < (SELECT max(ms) - {LAG} FROM obs)))
    SELECT stream, win_start, win_end, count(value) AS count, round(avg(value), 8) AS avg FROM wins, marks WHERE win_end <= watermark AND (stream <> 'view' OR ms < (SELECT max(ms) - {LAG} FROM obs)) GROUP BY ALL"""
)
def stream_several_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, of which one ends two days before the other: the least of their watermarks holds windows back."""
    rows = _event_batches(spark, sf_dir)
    last = obs(spark, sf_dir).agg((F.max("ms") - LAG).alias("_last"))
    slow = rows.where("stream = 'view'").join(F.broadcast(last)).where("ms < _last").drop("_last")
    parts = [(S.batch_stream(part, "batch", BATCHES, "source"), DELAY) for part in (rows.where("stream <> 'view'"), slow)]
    return rounded(S.run_counted(S.union_window_agg(parts, SPEC, ["count", "avg"]), "several_watermarks")[0], "avg")


@query(f"WITH {OBS} SELECT stream, count(*) AS rows, round(sum(value), 8) AS sum, CAST(sum(1 + event_id % 3) AS BIGINT) AS arrived FROM obs GROUP BY stream")
def stream_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to three times, in one batch or in the next: each counts once."""
    rows = obs(spark, sf_dir).select("event_id", "stream", "ts", "ms", "value").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)))
    rows = _batched(rows.withColumn("arrived", F.col("ms") + F.col("copy") % 2 * 130 * HOUR), "arrived").drop("arrived", "copy")
    stream = S.batch_stream(rows, "batch", BATCHES, "copies_in")
    made, counts = S.run_counted(S.distinct_contributions(stream, ["event_id"], 800 * HOUR), "distinct")
    if counts["kept"] != made.count():
        raise ValueError(f"observed counts don't fit the table: {counts}")
    sent = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("arrived"))
    return rounded(made.groupBy("stream").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("sum")).join(sent, "stream"), "sum")


LATE = f"(ms + (event_id * 7919) % 11 * {20 * HOUR})"


@query(
    f"""WITH {OBS}, a AS (SELECT event_id, ms, {LATE} AS arrived FROM obs), s AS (SELECT min(arrived) AS lo, max(arrived) AS hi FROM a), b AS (SELECT a.*, (arrived - lo) * {BATCHES} // (hi - lo + 1) AS batch FROM a, s),
    t AS (SELECT batch, max(ms) AS top FROM b GROUP BY batch), w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM t)
    SELECT event_id, watermark, CASE WHEN watermark IS NULL OR ms >= watermark THEN 'on_time' WHEN ms // {PANE} * {PANE} + {SPEC.range_ms} + {DELAY} > watermark THEN 'late' ELSE 'too_late' END AS class FROM b JOIN w USING (batch)"""
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a stream with its class: none is lost, whatever the watermark."""
    rows = _event_batches(spark, sf_dir, LATE)
    stream = S.batch_stream(rows, "batch", BATCHES, "late_in")
    return S.run_by_lateness(stream, SPEC, DELAY, "lateness").select("event_id", "watermark", "class")


_SAME = "x.stream = w.stream AND x.sensor = w.sensor"


@query(
    f"""WITH {WINS}, w AS (SELECT DISTINCT stream, win_start, win_end, sensor FROM wins), mark AS (SELECT max(ms) - {DELAY} AS watermark FROM obs)
    SELECT stream, sensor, win_start, win_end, 'insert' AS change FROM w, mark WHERE win_end <= watermark AND NOT EXISTS (SELECT 1 FROM w x WHERE x.win_start = w.win_start - {PANE} AND {_SAME})
    UNION ALL SELECT stream, sensor, win_start + {PANE}, win_end + {PANE}, 'delete' FROM w, mark WHERE win_end + {PANE} <= watermark AND NOT EXISTS (SELECT 1 FROM w x WHERE x.win_start = w.win_start + {PANE} AND {_SAME})"""
)
def stream_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that come into a stream's windows or leave them, as windows close."""
    rows = _event_batches(spark, sf_dir)
    stream = S.batch_stream(rows, "batch", BATCHES, "members_in")
    return S.run_counted(S.window_differences(stream, SPEC, ["stream", "sensor"], DELAY), "differences")[0]


# Estimates of targets that the watermarks have long passed.
SETTLED = 96 * HOUR


@query(
    f"""WITH {SUB}, {TARGETS}, last AS (SELECT max(end_ms) - {SETTLED} AS settled FROM sub)
    SELECT topic, b_start, b_end, round(sum(value * (least(end_ms, b_end) - greatest(start_ms, b_start))::DOUBLE) / sum((least(end_ms, b_end) - greatest(start_ms, b_start))::DOUBLE), 8) AS avg, count(*) AS results
    FROM sub, targets, last WHERE end_ms > b_start AND start_ms < b_end AND b_end <= settled GROUP BY ALL"""
)
def stream_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap-weighted means of live results for live targets, both in six batches."""
    results = _batched(written(sub_results(spark, sf_dir).withColumns({"start_ts": F.timestamp_millis("start_ms"), "end_ts": F.timestamp_millis("end_ms")}), "results"), "end_ms")
    asked = _batched(targets(spark, sf_dir).select(F.timestamp_millis("b_start").alias("b_start_ts"), F.timestamp_millis("b_end").alias("b_end_ts"), "b_end"), "b_end").drop("b_end")
    results_in = S.batch_stream(results, "batch", BATCHES, "results_in").drop("start_ms", "end_ms")
    asked_in = S.batch_stream(asked, "batch", BATCHES, "targets_in")
    made = S.run_counted(S.stream_overlap_avg(results_in, asked_in, SPEC.range_ms, 5 * HOUR, DELAY), "estimates")[0]
    last = results.agg((F.max("end_ms") - SETTLED).alias("settled"))
    return rounded(made.join(F.broadcast(last)).where("b_end <= settled").drop("settled"), "avg")


@query(f"WITH {OBS} SELECT event_id, sensor, c_nationkey, c_mktsegment FROM obs LEFT JOIN customer ON c_custkey = sensor")
def stream_static_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of six batches with static data beside each row."""
    rows = _event_batches(spark, sf_dir)
    stream = S.batch_stream(rows, "batch", BATCHES, "enrich_in")
    static = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sensor"), "c_nationkey", "c_mktsegment")
    return S.run_counted(S.stream_enrich(stream, static, ["sensor"], "left"), "enriched")[0].select("event_id", "sensor", "c_nationkey", "c_mktsegment")


# Arrivals up to forty minutes late, less than the watermark's delay: no row is dropped.
SHUFFLED = f"(ms + (event_id * 7919) % 5 * {HOUR // 6})"


@query(
    f"""WITH {WINS}, a AS (SELECT ms, {SHUFFLED} AS arrived FROM obs), s AS (SELECT min(arrived) AS lo, max(arrived) AS hi FROM a), b AS (SELECT ms, (arrived - lo) * {BATCHES} // (hi - lo + 1) AS batch FROM a, s),
    t AS (SELECT batch, max(max(ms)) OVER (ORDER BY batch) - {DELAY} AS watermark FROM b GROUP BY batch)
    SELECT stream, win_start, win_end, count, min(batch) + 1 AS emission FROM (SELECT stream, win_start, win_end, count(value) AS count FROM wins GROUP BY ALL) w JOIN t ON w.win_end <= t.watermark GROUP BY ALL"""
)
def stream_emission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch in which each window comes out: the first after the one whose latest time, less the delay, passes the window's end."""
    rows = _event_batches(spark, sf_dir, SHUFFLED)
    stream = S.batch_stream(rows, "batch", BATCHES, "ordered_in")
    return run_ordered(spark, stream_window_agg(stream, SPEC, ["count"], DELAY), "ordered", ["win_end", "stream"]).select("stream", "win_start", "win_end", "count", "emission")
