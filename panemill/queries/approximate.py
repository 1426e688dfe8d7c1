"""Queries on windows estimated from other windows' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.operators import approx as A
from panemill.operators.relational import in_windows, overlap_join, overlap_join_mixed
from panemill.queries.registry import ANCHOR, HOUR, OBS, PANE, PANES, SUB, TARGETS, obs, query, rounded, states, sub_results, targets

BUCKET = 6 * HOUR
OVER = f"{SUB}, {TARGETS}, pairs AS (SELECT topic, start_ms, end_ms, value, b_start, b_end, CAST(least(end_ms, b_end) - greatest(start_ms, b_start) AS DOUBLE) AS w FROM sub, targets WHERE end_ms > b_start AND start_ms < b_end)"


@query(f"WITH {OVER} SELECT topic, start_ms, b_start, b_end, round(value, 8) AS value FROM pairs")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap_join(sub_results(spark, sf_dir), targets(spark, sf_dir), BUCKET), "value").select("topic", "start_ms", "b_start", "b_end", "value")


# Spans of sensors over all their days and over each, beside windows of hours and of weeks: lengths from nothing to a month in one table.
SPANS = f"""{OBS}, spans AS (SELECT sensor, min(ms) AS start_ms, max(ms) + 1 AS end_ms FROM obs GROUP BY sensor UNION ALL SELECT sensor, min(ms), max(ms) + 1 FROM obs GROUP BY sensor, ms // {24 * HOUR}), {TARGETS},
asked AS (SELECT * FROM targets UNION ALL SELECT DISTINCT b_start // {168 * HOUR} * {168 * HOUR}, b_start // {168 * HOUR} * {168 * HOUR} + {168 * HOUR} FROM targets)"""


@query(f"WITH {SPANS} SELECT b_start, b_end, count(*) AS spans, CAST(sum(sensor) AS BIGINT) AS sensors, max(end_ms - start_ms) AS longest FROM spans, asked WHERE end_ms > b_start AND start_ms < b_end GROUP BY ALL")
def interval_overlap_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors' spans of very different lengths beside windows of hours and weeks."""
    rows, asked = obs(spark, sf_dir), targets(spark, sf_dir)
    span = (F.min("ms").alias("start_ms"), (F.max("ms") + 1).alias("end_ms"))
    spans = rows.groupBy("sensor").agg(*span).unionAll(rows.groupBy("sensor", F.floor(F.col("ms") / (24 * HOUR)).alias("day")).agg(*span).drop("day"))
    week = F.floor(F.col("b_start") / (168 * HOUR)) * (168 * HOUR)
    asked = asked.unionAll(asked.select(week.alias("b_start"), (week + 168 * HOUR).alias("b_end")).distinct())
    found = overlap_join_mixed(spans, asked)
    return found.groupBy("b_start", "b_end").agg(F.count(F.lit(1)).alias("spans"), F.sum("sensor").alias("sensors"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"))


@query(f"WITH {OBS}, {TARGETS} SELECT event_id, b_start, b_end FROM obs, targets WHERE ms >= b_start AND ms < b_end")
def observations_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_windows(obs(spark, sf_dir), targets(spark, sf_dir), BUCKET).select("event_id", "b_start", "b_end")


def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.approx_naive(sub_results(spark, sf_dir), targets(spark, sf_dir), BUCKET), "sum", "avg", "min", "max")


for _agg in ("avg", "sum", "count", "min", "max"):
    _value = {"avg": "round(avg(value), 8)", "sum": "round(sum(value), 8)", "count": "count(*)"}.get(_agg, f"round({_agg}(value), 8)")

    @query(f"WITH {OVER} SELECT topic, b_start, b_end, {_value} AS {_agg} FROM pairs GROUP BY ALL", name=f"approx_naive_{_agg}")
    def _approx_naive(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        return _naive(spark, sf_dir).select("topic", "b_start", "b_end", agg)


@query(
    f"""WITH {SUB}, few AS (SELECT * FROM sub WHERE start_ms // {24 * HOUR} % 3 = 0), {TARGETS}, n AS (SELECT topic, b_start, b_end, avg(value) AS avg, count(*) AS count FROM few, targets WHERE end_ms > b_start AND start_ms < b_end GROUP BY ALL)
    SELECT topic, b_start, b_end, round(coalesce(avg, 0), 8) AS avg, coalesce(count, 0) AS count FROM (SELECT topic, b_start, b_end FROM (SELECT DISTINCT topic FROM few), targets) t LEFT JOIN n USING (topic, b_start, b_end)"""
)
def approx_naive_all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of every target, 0 where no result overlaps it."""
    few = sub_results(spark, sf_dir).where(F.floor(F.col("start_ms") / (24 * HOUR)) % 3 == 0)
    found = A.approx_naive(few, targets(spark, sf_dir), BUCKET).select("topic", "b_start", "b_end", "avg", "count")
    return rounded(A.at_all_targets(found, few, targets(spark, sf_dir), missing=0), "avg")


@query(f"WITH {OVER} SELECT topic, b_start, b_end, round(sum(value * w) / sum(w), 8) AS avg FROM pairs GROUP BY ALL")
def approx_overlap_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.approx_overlap_avg(sub_results(spark, sf_dir), targets(spark, sf_dir), BUCKET), "avg")


SEGMENTS = f"""{OVER}, points AS (
    SELECT DISTINCT topic, b_start, b_end, unnest([b_start, b_end, greatest(start_ms, b_start), least(end_ms, b_end)]) AS seg_start FROM pairs),
cuts AS (SELECT *, lead(seg_start) OVER (PARTITION BY topic, b_start, b_end ORDER BY seg_start) AS seg_end FROM points),
covered AS (
    SELECT c.*, p.value, p.start_ms, p.end_ms FROM cuts c JOIN pairs p ON c.topic = p.topic AND c.b_start = p.b_start AND p.start_ms <= c.seg_start AND p.end_ms >= c.seg_end)"""


def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.approx_rate_sums(sub_results(spark, sf_dir), targets(spark, sf_dir), BUCKET), "sum", "segment_count")


@query(f"WITH {SEGMENTS} SELECT topic, b_start, b_end, round(sum(value / (end_ms - start_ms) * (seg_end - seg_start)), 8) AS sum FROM covered GROUP BY ALL")
def approx_rate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate(spark, sf_dir).select("topic", "b_start", "b_end", "sum")


@query(f"WITH {SEGMENTS} SELECT topic, b_start, b_end, round(sum(value), 8) AS segment_count FROM covered GROUP BY ALL")
def approx_segment_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate(spark, sf_dir).select("topic", "b_start", "b_end", "segment_count")


@query(f"WITH {OVER} SELECT topic, b_start, b_end, round(min(value), 8) AS min, round(max(value), 8) AS max FROM pairs GROUP BY ALL")
def approx_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.approx_extremes(sub_results(spark, sf_dir), targets(spark, sf_dir), BUCKET), "min", "max")


# Results of four lengths, and targets of two, that overlap many times.
DEEP = f"""{OBS}, sub AS (SELECT stream AS topic, ms AS start_ms, ms + (1 + event_id % 4) * {7 * HOUR} AS end_ms, value FROM obs WHERE value IS NOT NULL),
targets AS (SELECT DISTINCT ms // {12 * HOUR} * {12 * HOUR} + event_id % 5 * {HOUR} AS b_start, ms // {12 * HOUR} * {12 * HOUR} + event_id % 5 * {HOUR} + (1 + event_id % 5 % 2 * 6) * {5 * HOUR} AS b_end FROM obs WHERE event_id % 50 < 5)"""


@query(
    f"""WITH {DEEP}, o AS (SELECT topic, b_start, b_end, start_ms, end_ms, value FROM sub, targets WHERE end_ms > b_start AND start_ms < b_end),
    points AS (SELECT DISTINCT topic, b_start, b_end, unnest([b_start, greatest(start_ms, b_start), least(end_ms, b_end)]) AS t FROM o),
    cuts AS (SELECT topic, b_start, b_end, list_sort(list(t)) AS ts FROM points WHERE t < b_end GROUP BY ALL),
    counted AS (SELECT o.*, len(list_filter(ts, lambda t: t >= greatest(start_ms, o.b_start) AND t < least(end_ms, o.b_end))) AS segments FROM o JOIN cuts USING (topic, b_start, b_end))
    SELECT topic, b_start, b_end, round(sum(value / (end_ms - start_ms) * (least(end_ms, b_end) - greatest(start_ms, b_start))), 5) AS sum, round(sum(value * segments), 4) AS segment_count FROM counted GROUP BY ALL"""
)
def approx_rate_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from results, a reading each, of which very many overlap at any time."""
    rows = obs(spark, sf_dir).where("value is not null")
    sub = rows.select(F.col("stream").alias("topic"), F.col("ms").alias("start_ms"), (F.col("ms") + (1 + F.col("event_id") % 4) * (7 * HOUR)).alias("end_ms"), "value")
    start = F.floor(F.col("ms") / (12 * HOUR)) * (12 * HOUR) + F.col("event_id") % 5 * HOUR
    asked = rows.where("event_id % 50 < 5").select(start.alias("b_start"), (start + (1 + F.col("event_id") % 5 % 2 * 6) * (5 * HOUR)).alias("b_end")).distinct()
    found = A.approx_rate_sums(sub, asked, BUCKET)
    return found.withColumns({"sum": F.round("sum", 5), "segment_count": F.round("segment_count", 4)})


PAIR = f"""{SUB}, nb AS (
    SELECT topic, start_ms, end_ms, value AS v1, lead(value) OVER o AS v2, lead(start_ms) OVER o AS s2, lead(end_ms) OVER o AS e2 FROM sub WINDOW o AS (PARTITION BY topic ORDER BY start_ms)),
p AS (SELECT *, (v1 + v2) / 2 AS vo, v1 * (end_ms - start_ms) + v2 * (e2 - s2) - (v1 + v2) / 2 * (end_ms - s2) AS num FROM nb WHERE s2 < end_ms)"""


@query(f"WITH {PAIR} SELECT topic, start_ms, e2 AS end_ms, round(num / (e2 - start_ms), 8) AS avg, round(num, 2) AS sum, round(v1 + v2 - vo, 8) AS count, round(least(v1, v2, vo), 8) AS min, round(greatest(v1, v2, vo), 8) AS max FROM p")
def approx_pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.approx_pair(A.neighbours(sub_results(spark, sf_dir)))
    return rounded(rows, "avg", "count", "min", "max").withColumn("sum", F.round("sum", 2)).select("topic", "start_ms", "end_ms", "avg", "sum", "count", "min", "max")


@query(f"WITH {SUB}, {TARGETS}, r AS (SELECT min(m) AS reached FROM (SELECT max(end_ms) AS m FROM sub WHERE topic <> 'view' OR start_ms < {ANCHOR + 120 * HOUR} GROUP BY topic)) SELECT b_start, b_end FROM targets, r WHERE b_end <= reached")
def approx_ready_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sub_results(spark, sf_dir).where((F.col("topic") != "view") | (F.col("start_ms") < ANCHOR + 120 * HOUR))
    return A.ready_windows(rows, targets(spark, sf_dir), 5)


FEW = f"{SUB}, few AS (SELECT * FROM sub WHERE start_ms // {24 * HOUR} % 3 = 0), {TARGETS}"
LATEST = f"""{FEW}, o AS (
    SELECT topic, b_start, b_end, sum(value * (least(end_ms, b_end) - greatest(start_ms, b_start))::DOUBLE) / sum((least(end_ms, b_end) - greatest(start_ms, b_start))::DOUBLE) AS avg
    FROM few, targets WHERE end_ms > b_start AND start_ms < b_end GROUP BY ALL),
g AS (SELECT t.topic, b_start, b_end FROM (SELECT DISTINCT topic FROM few) t, targets),
l AS (SELECT g.topic, g.b_start, arg_max(value, end_ms) AS last FROM g JOIN few f ON f.topic = g.topic AND f.end_ms <= g.b_end GROUP BY ALL),
latest AS (
    SELECT g.topic, g.b_start, g.b_end, round(coalesce(avg, last), 8) AS value, CASE WHEN avg IS NOT NULL THEN 'overlap' WHEN last IS NOT NULL THEN 'latest' ELSE 'none' END AS source
    FROM g LEFT JOIN o USING (topic, b_start, b_end) LEFT JOIN l ON l.topic = g.topic AND l.b_start = g.b_start)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = sub_results(spark, sf_dir).where(F.floor(F.col("start_ms") / (24 * HOUR)) % 3 == 0)
    return rounded(A.latest_value(few, targets(spark, sf_dir), BUCKET), "value")


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_value_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


for _agg, _sql in {"avg": "round(avg(value), 8)", "sum": "round(sum(value), 8)", "min": "min(value)", "max": "max(value)", "topic_count": "count(value)"}.items():

    @query(f"WITH {LATEST} SELECT b_start, b_end, {_sql} AS {_agg} FROM latest GROUP BY ALL", name=f"approx_unified_{_agg.removeprefix('topic_')}")
    def _unified(spark: SparkSession, sf_dir: str, agg: str = _agg) -> DataFrame:
        rows = A.unify_topics(_latest(spark, sf_dir))
        return (rounded(rows, agg) if agg in ("avg", "sum") else rows).select("b_start", "b_end", agg)


@query(
    f"""WITH {OBS}, g AS (SELECT stream, ms, ms - lag(ms) OVER (PARTITION BY stream ORDER BY ms, event_id) AS gap FROM obs),
    m AS (SELECT stream, avg(gap) AS mean_gap FROM g GROUP BY stream)
    SELECT stream, ms, gap FROM g JOIN m USING (stream) WHERE gap > least(mean_gap * 3, {12 * HOUR})"""
)
def inactivity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panemill.reports.metrics import inactivity

    return inactivity(obs(spark, sf_dir), ["stream"], 3, 12 * HOUR).select("stream", "ms", "gap")


@query(f"WITH {PANES} SELECT stream, CASE WHEN start_ms // {PANE} % 4 = 0 THEN 'legacy' WHEN start_ms // {PANE} % 7 = 0 THEN 'rejected' ELSE 'structured' END AS kind, count(*) AS messages FROM panes GROUP BY ALL")
def message_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("start_ms") / PANE)
    json = F.to_json(F.struct(F.col("start_ms").alias("window_start"), F.col("end_ms").alias("window_end"), F.col("sum").alias("value")))
    rows = states(spark, sf_dir).select("stream", F.when(n % 4 == 0, F.col("sum").cast("string")).when(n % 7 == 0, "{").otherwise(json).alias("payload"))
    return rows.groupBy("stream", A.message_kind(F.col("payload")).alias("kind")).agg(F.count(F.lit(1)).alias("messages"))


@query(f"WITH {SUB}, {TARGETS}, c AS (SELECT min(b_start) AS since FROM (SELECT b_start FROM targets ORDER BY b_start DESC LIMIT 101)) SELECT topic, start_ms, end_ms FROM sub, c WHERE end_ms >= since")
def buffer_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that the last hundred targets can still use."""
    rows = targets(spark, sf_dir)
    first = rows.orderBy(F.desc("b_start")).limit(101).agg(F.min("b_start")).first()[0]  # all of them where there are fewer
    return A.prune(sub_results(spark, sf_dir), first or 0).select("topic", "start_ms", "end_ms")
