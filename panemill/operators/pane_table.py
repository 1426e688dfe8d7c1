"""Pane states that are kept: a table that grows by updates, partitioned by time, and results that are written once for all who read them.

States merge, so an update only adds the states of its own rows: rows of former updates are never read again, and a pane that two updates share is merged when it is read.
Each update has a name; one that is repeated replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panemill.operators.panes import chunk_states, merge_states

DAY_MS = 86_400_000


def add_panes(obs: DataFrame, path: str, update: str, pane_ms: int, keys: Sequence[str] = ("stream",), origin_ms: int = 0) -> None:
    """Adds the pane states of new observations to a table; one file or more for each day that they touch."""
    states = chunk_states(obs, pane_ms, keys, origin_ms).withColumn("day", F.floor(F.col("start_ms") / DAY_MS))
    states.write.mode("overwrite").partitionBy("day").parquet(f"{path}/update={update}")


def read_panes(spark: SparkSession, path: str, keys: dict[str, str] | None = None, lo_ms: int | None = None, hi_ms: int | None = None) -> DataFrame:
    """The merged states of panes that begin in [lo_ms, hi_ms): only the days in between are read.  ``keys`` gives the key columns' types."""
    keys = keys or {"stream": "string"}
    schema = ", ".join([*(f"{k} {kind}" for k, kind in keys.items()), "start_ms long, end_ms long, count long, sum double, min double, max double, update string, day long"])
    rows = spark.read.schema(schema).parquet(path)
    if lo_ms is not None:
        rows = rows.where((F.col("day") >= lo_ms // DAY_MS) & (F.col("start_ms") >= lo_ms))
    if hi_ms is not None:
        rows = rows.where((F.col("day") <= (hi_ms - 1) // DAY_MS) & (F.col("start_ms") < hi_ms))
    return merge_states(rows, [*keys, "start_ms", "end_ms"])


def stream_to_panes(stream: DataFrame, path: str, checkpoint: str, pane_ms: int, keys: Sequence[str] = ("stream",), **trigger) -> StreamingQuery:
    """A stream of observations (keys, ms, value) into the table: each batch is an update by its number, so one that is repeated replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        add_panes(batch, path, f"batch-{number}", pane_ms, keys)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def share(results: DataFrame, path: str) -> DataFrame:
    """Writes results once; whoever joins what comes back reads the table and computes nothing."""
    results.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)
