"""Queries on streams, and on the batch twins of stateful stream logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.tables import numbered
from panemill.operators import windows as W
from panemill.queries.registry import HOUR, OBS, PANE, PANES, SPEC, WINS, obs, query, rounded, sliding, states
from panemill.queries.reports import RESULTS, results
from panemill.streaming import streams as S

DELAY = HOUR
#: What the watermark leaves closed at the end: windows that end at or before it.
CLOSED = f"{OBS}, mark AS (SELECT max(ms) - {DELAY} AS watermark FROM obs), wins AS ({sliding('obs')})"


@query(f"WITH {CLOSED} SELECT stream, win_start, win_end, count(value) AS count, round(avg(value), 8) AS avg FROM wins, mark WHERE win_end <= watermark GROUP BY ALL")
def stream_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.stream_window_agg(S.observation_stream(spark, sf_dir), SPEC, ["count", "avg"], DELAY)
    return rounded(S.run_to_table(spark, rows, "stream_window_agg"), "avg")


@query(
    f"""WITH {PANES}, mark AS (SELECT max(ms) - {DELAY} AS watermark FROM obs)
    SELECT stream, win_start, win_end, count(*) AS panes, CAST(sum(count) AS BIGINT) AS count, round(sum(sum) / sum(count), 8) AS avg FROM ({sliding('panes', 'start_ms')}), mark WHERE win_end <= watermark GROUP BY ALL HAVING count(*) = 3"""
)
def stream_recompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.stream_recompose(S.observation_stream(spark, sf_dir), SPEC, PANE, DELAY)
    return rounded(S.run_to_table(spark, rows, "stream_recompose"), "avg").select("stream", "win_start", "win_end", "panes", "count", "avg")


@query(
    f"""WITH {PANES}, mark AS (SELECT max(ms) - {DELAY} AS watermark FROM obs), w AS (SELECT stream, win_start, win_end FROM ({sliding('panes', 'start_ms')}), mark WHERE win_end <= watermark GROUP BY ALL HAVING count(*) = 3)
    SELECT stream, win_start, row_number() OVER (PARTITION BY stream ORDER BY win_end) AS place FROM w"""
)
def ordered_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each whole window in the order in which a stream of one batch a file gives them out."""
    rows = S.stream_recompose(S.observation_stream(spark, sf_dir, files_per_batch=1), SPEC, PANE, DELAY)
    return numbered(S.run_ordered(spark, rows, "ordered", ["win_end", "stream"]), ["stream"], ["emission", "win_end"]).select("stream", "win_start", "place")


@query(f"WITH {WINS} SELECT stream, win_start, win_end, count(value) AS count, round(avg(value), 8) AS avg FROM wins GROUP BY ALL")
def stream_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of every window, closed or not, of a stream that reports each change."""
    rows = S.stream_window_agg(S.observation_stream(spark, sf_dir), SPEC, ["count", "avg"], DELAY)
    return rounded(S.run_upserts(spark, rows, "changes", ["stream", "win_start", "win_end"]), "avg").drop("versions")


ARRIVED = f"(ms + (event_id * 7919) % 11 * {2 * HOUR})"


@query(
    f"""WITH {OBS}, a AS (SELECT event_id, ms, {ARRIVED} AS arrived FROM obs), w AS (SELECT *, max(ms) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark FROM a)
    SELECT event_id, CASE WHEN watermark IS NULL OR ms >= watermark THEN 'on_time' WHEN ms // {PANE} * {PANE} + {SPEC.range_ms} + {DELAY} > watermark THEN 'late' ELSE 'too_late' END AS class FROM w"""
)
def late_event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).withColumn("arrived", F.expr(ARRIVED))
    return S.late_classes(rows, SPEC, DELAY).select("event_id", "class")


MARKED = f"marked AS (SELECT stream, start_ms, end_ms - start_ms // {PANE} % 3 * {PANE} AS input_watermark, start_ms AS arrived FROM panes)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.floor(F.col("start_ms") / PANE) % 3 * PANE
    return states(spark, sf_dir).select("stream", "start_ms", (F.col("end_ms") - back).alias("input_watermark"), F.col("start_ms").alias("arrived"))


@query(
    f"""WITH {PANES}, {MARKED}, s AS (SELECT *, max(input_watermark) OVER (PARTITION BY stream ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM marked)
    SELECT stream, start_ms, CASE WHEN seen IS NULL OR input_watermark > seen THEN 'advanced' WHEN input_watermark = seen THEN 'equal' ELSE 'rejected' END AS verdict FROM s"""
)
def producer_watermark_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.producer_watermarks(_marked(spark, sf_dir), "stream", "input_watermark", ["arrived"]).select("stream", "start_ms", "verdict")


@query(f"WITH {PANES}, {MARKED}, l AS (SELECT stream, max(input_watermark) AS latest FROM marked GROUP BY stream) SELECT count(*) AS producers, CASE WHEN count(*) >= 5 THEN min(latest) END AS watermark FROM l")
def reconstruction_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reconstruction_watermark(_marked(spark, sf_dir), "stream", "input_watermark", 5)


@query(f"WITH {WINS}, r AS (SELECT min(m) AS reached FROM (SELECT max(ms) AS m FROM obs GROUP BY stream)) SELECT stream, win_start, win_end, count(value) AS count FROM wins, r WHERE win_end <= reached GROUP BY ALL")
def finalizable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    return S.finalizable(W.window_agg(rows, SPEC, ["count"]), rows, 5)


@query(f"WITH {WINS} SELECT stream, win_start, win_end, count(value) AS count FROM wins GROUP BY ALL")
def flushed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, pending ones too, once a finite replay is over."""
    rows = obs(spark, sf_dir)
    return S.finalizable(W.window_agg(rows, SPEC, ["count"]), rows, 5, replay_over=True)


CADENCE = f"""{RESULTS}, e AS (SELECT stream, window_number, emitted_at + window_number % 9 * 400 AS emitted_at FROM results WHERE approach = 'approximation'),
kept AS (SELECT stream, min(emitted_at) AS emitted_at FROM e GROUP BY stream
    UNION ALL SELECT k.stream, min(e.emitted_at) FROM kept k JOIN e ON e.stream = k.stream AND e.emitted_at - k.emitted_at >= {PANE - 1000} AND least((e.emitted_at - k.emitted_at) % {PANE}, {PANE} - (e.emitted_at - k.emitted_at) % {PANE}) <= 1000 GROUP BY k.stream, k.emitted_at)"""


@query(f"WITH RECURSIVE {CADENCE} SELECT e.stream, e.window_number, e.emitted_at FROM e JOIN kept USING (stream, emitted_at)")
def cadence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).where("approach = 'approximation'").withColumn("emitted_at", F.col("emitted_at") + F.col("window_number") % 9 * 400)
    return S.cadence_filter(rows, PANE, 1000, ["stream"]).select("stream", "window_number", "emitted_at")
