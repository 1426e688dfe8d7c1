"""Names of queries, what they share, and the SQL that mirrors it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.time import WindowSpec
from panemill.operators.panes import chunk_states
from panemill.sources.observations import observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HOUR = 3_600_000
PANE = 2 * HOUR
SPEC = WindowSpec(6 * HOUR, 2 * HOUR)
#: Midnight of the events' first day: the anchor of window numbers.
ANCHOR = 1_704_067_200_000


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name; ``sql`` gives the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, f"{sf_dir}/events.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_states(obs(spark, sf_dir), PANE)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Sums in another order differ in the last bits.

    Doubles are rounded in doubles, as the SQL does it: as a whole number of units of the last place.  Spark's own rounding is decimal, and beyond 2^53 units it
    gives other last bits.
    """
    kinds = dict(df.dtypes)
    of = lambda c: F.when(F.abs(c) < 1e300, F.round(F.col(c) * 1e8) / 1e8).otherwise(F.col(c)) if kinds[c] == "double" else F.round(c, 8)
    return df.withColumns({c: of(c) for c in cols})


def sub_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, start_ms, end_ms, value: averages of the default windows."""
    from panemill.operators.panes import recompose

    rows = recompose(states(spark, sf_dir), SPEC, PANE)
    return rows.select(F.col("stream").alias("topic"), F.col("win_start").alias("start_ms"), F.col("win_end").alias("end_ms"), F.col("avg").alias("value"))


OBS = "obs AS (SELECT event_id, event_type AS stream, user_id AS sensor, epoch_us(ts) // 1000 AS ms, value, props FROM events WHERE ts IS NOT NULL)"
PANES = f"""{OBS}, panes AS (
    SELECT stream, ms // {PANE} * {PANE} AS start_ms, ms // {PANE} * {PANE} + {PANE} AS end_ms,
           count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max
    FROM obs GROUP BY ALL)"""


def sliding(source: str, at: str = "ms", r: int = SPEC.range_ms, s: int = SPEC.step_ms) -> str:
    """Rows of a source by window, for s <= r."""
    back = (r - 1) // s * s
    return f"SELECT x.*, w AS win_start, w + {r} AS win_end FROM {source} x, unnest(range({at} // {s} * {s} - {back}, {at} // {s} * {s} + 1, {s})) AS t(w) WHERE w + {r} > {at}"


WINS = f"{OBS}, wins AS ({sliding('obs')})"
REC = f"""{PANES}, rec AS (
    SELECT stream, win_start, win_end, count(*) AS panes, CAST(sum(count) AS BIGINT) AS count, sum(sum) AS sum, min(min) AS min, max(max) AS max,
           sum(sum) / sum(count) AS avg, avg(sum / count) AS mean_of_panes
    FROM ({sliding('panes', 'start_ms')}) GROUP BY ALL)"""
SUB = f"{REC}, sub AS (SELECT stream AS topic, win_start AS start_ms, win_end AS end_ms, avg AS value FROM rec)"
#: Targets of the approximate operators: windows of 5 hours side by side, from the first event to the last.
TARGETS = f"""targets AS (SELECT t AS b_start, t + {5 * HOUR} AS b_end
    FROM (SELECT min(ms) // {5 * HOUR} * {5 * HOUR} - {4 * HOUR} AS lo, max(ms) AS hi FROM obs), unnest(range(lo, hi + 1, {5 * HOUR})) AS u(t))"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = obs(spark, sf_dir).agg((F.floor(F.min("ms") / (5 * HOUR)) * (5 * HOUR) - 4 * HOUR).alias("lo"), F.max("ms").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi", F.lit(5 * HOUR))).alias("b_start")).withColumn("b_end", F.col("b_start") + 5 * HOUR)
