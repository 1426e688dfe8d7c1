"""Stream signatures, and the evaluation strategy they suggest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.functions.tables import small
from panemill.functions.time import align_start

#: Values of a window from which a signature is given.
LEAST = 5
# Bounds of each approach (approach, least variance, greatest variance, greatest entropy, greatest spectral entropy, least number of values, priority).
CONFIGS = [
    ("approximation", None, 10.0, 2.0, 1.5, None, 1),
    ("fetching", 50.0, None, None, None, None, 2),
    ("chunked", None, 30.0, None, None, 100, 3),
]
CONFIG_SCHEMA = "approach string, variance_lo double, variance_hi double, entropy_hi double, spectral_hi double, n_lo long, priority int"


def window_stats(obs: DataFrame, range_ms: int) -> DataFrame:
    """Mean, variance, extremes, duration, mean interval and rate of each stream's windows."""
    rows = obs.withColumn("win_start", align_start(F.col("ms"), range_ms))
    span = F.max("ms") - F.min("ms")
    return rows.groupBy("stream", "win_start").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        span.alias("duration_ms"),
        F.try_divide(span, F.count(F.lit(1)) - 1).alias("mean_interval_ms"),
        F.when(span > 0, (F.count(F.lit(1)) - 1) / (span / 1000)).alias("rate_hz"),
    )


def stream_signature(obs: DataFrame, range_ms: int, bin_width: float) -> DataFrame:
    """Variance, entropy (bits, of a histogram) and skewness of windows with enough values; else nulls."""
    rows = obs.where("value is not null").withColumn("win_start", align_start(F.col("ms"), range_ms))
    moments = rows.groupBy("stream", "win_start").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("variance"), F.skewness("value").alias("skewness"))
    bins = rows.groupBy("stream", "win_start", F.floor(F.col("value") / bin_width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/n log(c/n)) = log(n) - sum(c log c) / n
    entropy = bins.groupBy("stream", "win_start").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))
    enough = F.col("n") >= LEAST
    return moments.join(entropy, ["stream", "win_start"]).select("stream", "win_start", "n", *(F.when(enough, F.col(c)).alias(c) for c in ("variance", "entropy", "skewness")))


def spectral_entropy(obs: DataFrame, range_ms: int) -> DataFrame:
    """Entropy, in bits, of the power spectrum (without its mean) of each window's values in time order.  A window is one group, so its
    size is bounded by its range and rate."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(["ms", "event_id"])["value"].to_numpy(float)
        entropy = None
        if len(values) >= LEAST:
            power = np.abs(np.fft.rfft(values - values.mean()))[1:] ** 2
            if (total := power.sum()) > 0 and len(power) > 1:
                share = power[power > 0] / total
                entropy = float(-(share * np.log2(share)).sum())
            else:
                entropy = 0.0
        return pd.DataFrame({"stream": [rows["stream"].iloc[0]], "win_start": [rows["win_start"].iloc[0]], "spectral_entropy": [entropy]})

    rows = obs.where("value is not null").select("stream", align_start(F.col("ms"), range_ms).alias("win_start"), "ms", "event_id", "value")
    return rows.groupBy("stream", "win_start").applyInPandas(of, "stream string, win_start long, spectral_entropy double")


def stream_type(spectral: Column | None = None) -> Column:
    """stable, volatile, irregular, periodic (if the spectral entropy is given) or mixed; unknown without a signature."""
    kind = F.when(F.col("variance").isNull(), "unknown").when((F.col("variance") < 10) & (F.col("entropy") < 2), "stable").when(F.col("variance") > 50, "volatile").when(F.abs("skewness") > 1, "irregular")
    return (kind if spectral is None else kind.when(spectral > 2, "periodic")).otherwise("mixed")


def standard_configs(spark: SparkSession) -> DataFrame:
    """The standard bounds as a table."""
    return spark.createDataFrame(CONFIGS, CONFIG_SCHEMA)


def recommend(signatures: DataFrame, configs: DataFrame) -> DataFrame:
    """The approach of least priority all of whose bounds hold; lower priorities give less confidence.  A null bound holds always.

    Signatures hold variance, entropy, spectral_entropy and n.
    """
    lo = lambda c, b: F.col(b).isNull() | (F.col(c) >= F.col(b))
    hi = lambda c, b: F.col(b).isNull() | (F.col(c) <= F.col(b))
    fits = F.col("variance").isNotNull() & lo("variance", "variance_lo") & hi("variance", "variance_hi") & hi("entropy", "entropy_hi") & hi("spectral_entropy", "spectral_hi") & lo("n", "n_lo")
    rows = signatures.join(small(configs), fits)
    return rows.groupBy("stream", "win_start").agg(F.min_by("approach", "priority").alias("approach"), F.round(1 - 0.25 * (F.min("priority") - 1), 6).alias("confidence"))


def select_mode(recommended: DataFrame, mode: str, manual: str, default: str) -> DataFrame:
    """The approach to run: the manual one, or the recommended one if the mode trusts it enough."""
    trusted = {"manual": 2.0, "automatic": 0.6, "hybrid": 0.7}[mode]
    other = default if mode == "automatic" else manual
    return recommended.withColumn("chosen", F.when(F.col("confidence") > trusted, F.col("approach")).otherwise(other))


def recommendation_history(recommended: DataFrame, last: int) -> DataFrame:
    """How often each approach came up in a stream's last windows, and how surely."""
    order = W.partitionBy("stream").orderBy(F.desc("win_start"))
    rows = recommended.withColumn("back", F.row_number().over(order)).where(F.col("back") <= last)
    return rows.groupBy("stream", "approach").agg(F.count(F.lit(1)).alias("times"), F.avg("confidence").alias("mean_confidence"))
