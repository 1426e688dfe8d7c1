"""Publishing lag, traffic and resource reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panemill.functions.tables import quantiles, same_keys, with_previous

#: Samples of a key are compared within so many milliseconds, and from bucket to bucket by one row each.
SAMPLED_MS = 3_600_000


def publish_lag(traffic: DataFrame, keys: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Lag of actual behind target publishing times, and how fast the replay ran (null where all was published at one time).

    The 95th percentile is exact, from counted lags that are dealt to tasks by ranges; with an ``accuracy`` it is approximate, without a further pass.
    """
    lag = F.col("actual_publish_time") - F.col("target_publish_time")
    span = lambda c: F.max(c) - F.min(c)
    out = traffic.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg(lag).alias("mean_lag_ms"),
        (F.lit(None) if accuracy is None else F.percentile_approx(lag, 0.95, accuracy)).alias("p95_lag_ms"),
        F.max(lag).alias("max_lag_ms"),
        F.try_divide(span("target_publish_time"), span("actual_publish_time")).alias("replay_speed"),
    )
    if accuracy is not None:
        return out
    return same_keys(out.drop("p95_lag_ms"), quantiles(traffic, keys, {"lag": lag}, {"p95": 0.95}).withColumnRenamed("lag_p95", "p95_lag_ms"), keys).select(*out.columns)


# The parts of a topic that tell a message's kind, first match first, and how many subscribers read the raw input under each approach.
KINDS = [
    ("control", ("__benchmark_control__", "control")),
    ("raw_input_stream", ("smartphoneX", "wearableX")),
    ("chunk_result", ("chunked/",)),
    ("superquery_result", ("output", "benchmark/results/")),
]
RAW_SUBSCRIBERS = {"fetching": 1, "naive_distributed": 2, "approximation": 1, "chunked": 2}


def message_type(topic: Column, given: Column | None = None) -> Column:
    """The kind of a message: the given one, else by its topic, else unknown."""
    found = F.coalesce(*(F.when(F.contains(topic, F.lit(part)), kind) for kind, parts in KINDS for part in parts), F.lit("unknown"))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def subscribers(kind: Column, approach: Column, raw: Column | None = None) -> Column:
    """How many read a message of a kind, by approach; ``raw`` overrides the estimate for raw input."""
    estimate = F.coalesce(*(F.when(approach == name, n) for name, n in RAW_SUBSCRIBERS.items()), F.lit(1))
    return (
        F.when(kind == "raw_input_stream", estimate if raw is None else F.coalesce(raw, estimate))
        .when(kind == "reusable_result", F.when(approach == "chunked", 0).otherwise(1))
        .when(kind == "control", F.when(approach == "fetching", 1).otherwise(0))
        .otherwise(1)
        .cast("long")
    )


def classify(traffic: DataFrame) -> DataFrame:
    """Adds message_type (kept where it is given), subscriber_count and delivered_bytes."""
    given = F.col("message_type") if "message_type" in traffic.columns else None
    rows = traffic.withColumn("message_type", message_type(F.col("topic"), given))
    rows = rows.withColumn("subscriber_count", subscribers(F.col("message_type"), F.col("approach")))
    return rows.withColumn("delivered_bytes", F.col("published_bytes") * F.col("subscriber_count"))


def traffic_summary(traffic: DataFrame, keys: Sequence[str] = ("approach",)) -> DataFrame:
    """Bytes by kind after the warm-up (before a key's first final result), and KB a second over the rest."""
    cut = traffic.where("message_type = 'superquery_result'").groupBy(*keys).agg(F.min("timestamp").alias("cut"))
    rows = traffic.join(cut, list(keys), "left").withColumn("warmup", F.coalesce(F.col("timestamp") < F.col("cut"), F.lit(False)))
    steady = ~F.col("warmup")
    of = lambda kind: F.coalesce(F.sum(F.when(steady & (F.col("message_type") == kind), F.col("published_bytes"))), F.lit(0)).alias(f"{kind}_bytes")
    span = (F.max(F.when(steady, F.col("timestamp"))) - F.min(F.when(steady, F.col("timestamp")))) / 1000
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("warmup")).alias("warmup_messages"),
        of("raw_input_stream"),
        of("chunk_result"),
        of("superquery_result"),
        F.sum(F.when(steady, F.col("delivered_bytes"))).alias("delivered_bytes"),
        F.when(span > 0, F.sum(F.when(steady, F.col("published_bytes"))) / 1024 / span).alias("kb_per_s"),
    )


def resource_summary(samples: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.avg("total_cpu_pct").alias("mean_cpu"),
        F.max("total_cpu_pct").alias("peak_cpu"),
        F.avg("tree_rss_bytes").alias("mean_rss"),
        F.max("tree_rss_bytes").alias("peak_rss"),
        F.max("process_count").alias("peak_processes"),
    )


def process_summary(samples: DataFrame, keys: Sequence[str] = ("run", "pid")) -> DataFrame:
    """Of each process: samples, wall time, CPU seconds, mean and peak of CPU and memory."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        ((F.max("timestamp") - F.min("timestamp")) / 1000).alias("wall_s"),
        F.sum("cpu_seconds").alias("cpu_seconds"),
        F.avg("cpu_pct").alias("mean_cpu"),
        F.max("cpu_pct").alias("peak_cpu"),
        F.avg("rss_bytes").alias("mean_rss"),
        F.max("rss_bytes").alias("peak_rss"),
    )


def counter_delta(samples: DataFrame, ts: str, counter: str, keys: Sequence[str]) -> DataFrame:
    """Growth of a counter that may start anew: the sum of its rises, and the number of falls.  Samples of one time count from the lower to the higher."""
    rows = with_previous(samples, keys, [ts, counter], F.floor(F.col(ts) / SAMPLED_MS)).withColumn("delta", F.col(counter) - F.col(f"previous.{counter}"))
    return rows.groupBy(*keys).agg(F.sum(F.greatest("delta", F.lit(0.0))).alias("growth"), F.count_if(F.col("delta") < 0).alias("resets"))


def counter_rate(samples: DataFrame, ts: str, counter: str, keys: Sequence[str], cores: int) -> DataFrame:
    """Mean percent of the cores' time between samples (ts in milliseconds, counter in seconds); two samples of one time have no rate."""
    rows = with_previous(samples, keys, [ts, counter], F.floor(F.col(ts) / SAMPLED_MS))
    rate = F.try_divide(F.col(counter) - F.col(f"previous.{counter}"), (F.col(ts) - F.col(f"previous.{ts}")) / 1000 * cores) * 100
    return rows.withColumn("rate", rate).where("rate >= 0").groupBy(*keys).agg(F.avg("rate").alias("mean_pct"))


def counter_rollup(artefacts: DataFrame, keys: Sequence[str], counters: str = "counters") -> DataFrame:
    """Sums of named counters over all artefacts of a key."""
    rows = artefacts.select(*keys, F.explode(counters).alias("counter", "n"))
    return rows.groupBy(*keys, "counter").agg(F.sum("n").alias("total"))


def validate_fanout(deliveries: DataFrame, k: int) -> DataFrame:
    """For each result (key): K deliveries of one execution, all of one value; else the reasons."""
    found = deliveries.groupBy("key").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("execution_id").alias("executions"), F.count_distinct("value").alias("values"))
    reasons = F.array_compact(
        F.array(F.when(F.col("deliveries") != k, "deliveries"), F.when(F.col("executions") != 1, "executions"), F.when(F.col("values") > 1, "values"))
    )
    return found.withColumn("reasons", F.concat_ws(";", reasons)).withColumn("valid", F.size(reasons) == 0)


def states_consumed(consumed: DataFrame, range_ms: int, pane_ms: int, targets: int) -> DataFrame:
    """Pane states that each result should have used against those it used."""
    expected = range_ms // pane_ms * targets
    rows = consumed.groupBy("win_start").agg(F.count(F.lit(1)).alias("consumed"))
    return rows.withColumn("expected", F.lit(expected).cast("long")).withColumn("complete", F.col("consumed") == F.col("expected"))
