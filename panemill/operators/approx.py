"""Approximate reuse: a window estimated from the results of other windows that overlap it.

Sub-results are (topic, start_ms, end_ms, value); targets are (b_start, b_end).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.functions.tables import is_small
from panemill.operators.relational import overlap_join

TARGET = ("b_start", "b_end")
#: Slices of a table that is too large to broadcast where every row meets every other.
SLICES = 64


def _overlap() -> Column:
    return (F.least("end_ms", "b_end") - F.greatest("start_ms", "b_start")).cast("double")


def approx_naive(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Sum, plain mean, number, least and greatest of the overlapping results."""
    rows = overlap_join(sub, targets, bucket_ms)
    return rows.groupBy(*keys, *TARGET).agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))


def at_all_targets(found: DataFrame, sub: DataFrame, targets: DataFrame, keys: Sequence[str] = ("topic",), missing: float | None = None) -> DataFrame:
    """Estimates with a row for each key and target: those that no result overlaps have nulls, or a given value."""
    grid = all_pairs(targets.select(*TARGET).distinct(), sub.select(*keys).distinct())
    rows = grid.join(found, [*keys, *TARGET], "left")
    return rows if missing is None else rows.fillna(missing, [c for c in found.columns if c not in (*keys, *TARGET)])


def approx_pair(pairs: DataFrame) -> DataFrame:
    """Two neighbouring results (v1, d1, v2, d2) with an overlap (vo, dov) merged for a target of length dt."""
    weighted = F.col("v1") * F.col("d1") + F.col("v2") * F.col("d2") - F.col("vo") * F.col("dov")
    return pairs.withColumns(
        {
            "avg": F.try_divide(weighted, "dt"),
            "sum": weighted,
            "count": F.col("v1") + F.col("v2") - F.col("vo"),
            "min": F.least("v1", "v2", "vo"),
            "max": F.greatest("v1", "v2", "vo"),
        }
    )


def neighbours(sub: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Each result beside the next that overlaps it; the overlap is taken at the mean of both."""
    order = W.partitionBy(*keys).orderBy("start_ms")
    rows = sub.select(*keys, "start_ms", "end_ms", F.col("value").alias("v1"), F.lead("value").over(order).alias("v2"), F.lead("start_ms").over(order).alias("s2"), F.lead("end_ms").over(order).alias("e2"))
    rows = rows.where("s2 < end_ms")
    return rows.select(
        *keys,
        "start_ms",
        F.col("e2").alias("end_ms"),
        "v1",
        (F.col("end_ms") - F.col("start_ms")).cast("double").alias("d1"),
        "v2",
        (F.col("e2") - F.col("s2")).cast("double").alias("d2"),
        ((F.col("v1") + F.col("v2")) / 2).alias("vo"),
        (F.col("end_ms") - F.col("s2")).cast("double").alias("dov"),
        (F.col("e2") - F.col("start_ms")).cast("double").alias("dt"),
    )


def approx_overlap_avg(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """The mean of overlapping results, weighted by the length of the overlap."""
    rows = overlap_join(sub, targets, bucket_ms).withColumn("w", _overlap())
    return rows.groupBy(*keys, *TARGET).agg(F.try_divide(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("avg"))


def _asked(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str]) -> DataFrame:
    """keys and targets that may overlap: those that meet in a bucket, of which a key has one row however many results it has there."""
    cut = lambda df, lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor((F.col(hi) - 1) / bucket_ms))).alias("_bucket")
    held = sub.select(*keys, cut(sub, "start_ms", "end_ms")).distinct()
    wanted = targets.where("b_end > b_start").select(*TARGET, cut(targets, "b_start", "b_end")).distinct()
    return held.join(wanted, "_bucket").select(*keys, *TARGET).distinct()


def approx_rate_sums(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """sum: each result adds its rate times the overlap; segment_count: each result adds its value once a segment, targets being cut at all bounds within.

    A sweep over bounds: each time at which results begin or end has the change of rate and value, and running sums give what is active.  A target reads them at its own
    two bounds, so the work is one row a bound, however many results overlap one another.  Time is cut in blocks of a power of two, at least as long as the target: sums
    run within a block, from the rates and values that are active at its beginning, so nothing is taken from sums over all of time.
    """
    whole = sub.where("end_ms > start_ms and value is not null")
    rate = F.col("value") / (F.col("end_ms") - F.col("start_ms"))
    change = lambda at, sign: whole.select(*keys, F.col(at).alias("_t"), (sign * rate).alias("_dr"), (sign * F.col("value")).alias("_dv"), F.lit(sign).alias("_dn"))
    bounds = change("start_ms", 1).unionAll(change("end_ms", -1)).groupBy(*keys, "_t").agg(F.sum("_dr").alias("_dr"), F.sum("_dv").alias("_dv"), F.sum("_dn").cast("long").alias("_dn"))

    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col("b_end") - F.col("b_start") - 1)))  # a power of two, no less than the target
    asked = _asked(whole, targets, bucket_ms, keys).withColumn("_width", width)
    widths = [F.lit(r[0]) for r in targets.where("b_end > b_start").select(width).distinct().collect()]  # 63 at most
    # In the order of time: a target's end, then the changes, then a target's start.
    asks = asked.select(*keys, *TARGET, "_width", F.explode(F.array(F.struct(F.col("b_end").alias("_t"), F.lit(0).alias("_kind")), F.struct(F.col("b_start").alias("_t"), F.lit(2).alias("_kind")))).alias("_ask")).select(*keys, *TARGET, "_width", "_ask.*")
    rows = bounds.withColumns({"_width": F.explode(F.array(*widths).cast("array<bigint>")), "_kind": F.lit(1)}).unionByName(asks, allowMissingColumns=True)
    # An end on the border of two blocks belongs to the one before.
    block = F.col("_t") - F.when(F.col("_kind") == 0, 1).otherwise(0)
    rows = rows.withColumn("_block", block - F.pmod(block, F.col("_width"))).withColumn("_in", F.col("_t") - F.col("_block"))

    part = [*keys, "_width", "_block"]
    blocks = rows.groupBy(*part).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_dr", "_dv", "_dn")), F.coalesce(F.sum(F.col("_dr") * F.col("_in")), F.lit(0.0)).alias("_drt"))
    earlier = W.partitionBy(*keys, "_width").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(c).alias(f"_b{c}") for c in part), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_0{c}") for c in ("_dr", "_dv", "_dn")), F.col("_dr").alias("_all_dr"), F.col("_drt").alias("_all_drt"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in part))
    rows = rows.join(blocks, same)

    so_far = W.partitionBy(*part).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    rows = rows.withColumns({"_r": run("_dr"), "_rt": run(F.col("_dr") * F.col("_in")), "_v": run("_dv"), "_n": run("_dn") + F.col("_0_dn")})
    # Nothing active is exactly nothing, whatever rounding left.
    rows = rows.withColumn("_active", F.when(F.col("_n") > 0, F.col("_0_dv") + F.col("_v")).otherwise(0.0))
    at_bound = F.when(F.col("_kind") == 1, F.col("_active"))
    everything = W.partitionBy(*part)
    rows = rows.withColumns(
        {
            "_area": F.col("_0_dr") * F.col("_in") + F.col("_r") * F.col("_in") - F.col("_rt"),
            "_whole": (F.col("_0_dr") + F.col("_all_dr")) * F.col("_width") - F.col("_all_drt"),
            "_seen": F.coalesce(F.sum(at_bound).over(so_far), F.lit(0.0)),
            "_seen_all": F.coalesce(F.sum(at_bound).over(everything), F.lit(0.0)),
            "_bounds": F.count(at_bound).over(so_far),
            "_bounds_all": F.count(at_bound).over(everything),
        }
    ).where("_kind <> 1")
    of = lambda c, kind: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    one = of("_block", 0) == of("_block", 2)
    between = lambda c, total: of(c, 0) - of(c, 2) + F.when(one, F.lit(0)).otherwise(of(total, 2))
    found = rows.groupBy(*keys, *TARGET).agg(
        between("_area", "_whole").alias("sum"), (of("_active", 2) + between("_seen", "_seen_all")).alias("segment_count"), (of("_n", 2) + between("_bounds", "_bounds_all")).alias("_any")
    )
    return found.where("_any > 0").drop("_any")


def approx_extremes(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """Least and greatest of the overlapping results."""
    return overlap_join(sub, targets, bucket_ms).groupBy(*keys, *TARGET).agg(F.min("value").alias("min"), F.max("value").alias("max"))


def approx_rate(sub: DataFrame, targets: DataFrame, bucket_ms: int, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """sum, segment_count, min and max of each key and target that results overlap."""
    return approx_rate_sums(sub, targets, bucket_ms, keys).join(approx_extremes(sub, targets, bucket_ms, keys), [*keys, *TARGET])


def prune(sub: DataFrame, start_ms: int | Column) -> DataFrame:
    """Results that a target from ``start_ms`` on can still use; what ended before it is forgotten."""
    return sub.where(F.col("end_ms") >= start_ms)


def message_kind(payload: Column) -> Column:
    """structured (an object with window bounds), legacy (a bare number) or rejected."""
    bounded = F.get_json_object(payload, "$.window_end").isNotNull() | F.get_json_object(payload, "$.window.end").isNotNull()
    return F.when(bounded, "structured").when(payload.try_cast("double").isNotNull(), "legacy").otherwise("rejected")


def ready_windows(sub: DataFrame, targets: DataFrame, n_topics: int) -> DataFrame:
    """Targets whose end every topic has reached."""
    latest = sub.groupBy("topic").agg(F.max("end_ms").alias("latest"))
    reached = latest.agg(F.min("latest").alias("reached"), F.count(F.lit(1)).alias("topics")).where(F.col("topics") >= n_topics)
    return targets.join(F.broadcast(reached), F.col("b_end") <= F.col("reached")).select(*targets.columns)


def all_pairs(many: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of one table beside every row of another, as a result is defined to have; a large second table is dealt to ``SLICES`` tasks a row instead of broadcast."""
    if is_small(few):
        return many.join(F.broadcast(few))
    sliced = few.withColumn("_slice", F.pmod(F.xxhash64(*few.columns), F.lit(SLICES)))
    return many.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long")))).join(sliced, "_slice").drop("_slice")


def latest_value(sub: DataFrame, targets: DataFrame, bucket_ms: int) -> DataFrame:
    """For each topic and target the overlap-weighted mean, or else the topic's latest value before the target's end (``source`` tells which).

    The result has a row for each topic and target.  The latest value is carried along within buckets of time, and from bucket to bucket, so
    a task orders one bucket of one topic.
    """
    exact = approx_overlap_avg(sub, targets, bucket_ms)
    # A row for each topic and target: the side that is counted to be small is broadcast, or else both are dealt out by the blocks of a grid.
    grid = all_pairs(targets.select(*TARGET), sub.select("topic").distinct())
    points = sub.select("topic", F.col("end_ms").alias("at"), "value", F.lit(0).alias("kind"))
    asks = grid.select("topic", F.col("b_end").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("kind"), "b_start")
    rows = points.unionByName(asks, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("at") / bucket_ms))
    ends = rows.groupBy("topic", "bucket").agg(F.max_by("value", F.when(F.col("kind") == 0, F.col("at"))).alias("end"))
    earlier = W.partitionBy("topic").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("topic", "bucket", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    inside = W.partitionBy("topic", "bucket").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = rows.withColumn("inside", F.last("value", ignorenulls=True).over(inside)).where("kind = 1").join(ends, ["topic", "bucket"])
    carried = carried.select("topic", "b_start", F.col("at").alias("b_end"), F.coalesce("inside", "before").alias("last"))
    rows = carried.join(exact, ["topic", *TARGET], "left")
    return rows.select("topic", *TARGET, F.coalesce("avg", "last").alias("value"), F.when(F.col("avg").isNotNull(), "overlap").when(F.col("last").isNotNull(), "latest").otherwise("none").alias("source"))


def unify_topics(rows: DataFrame, value: str = "value") -> DataFrame:
    """Per-topic results of a target made one: plain mean, sum, extremes, and the number of topics."""
    return rows.groupBy(*TARGET).agg(F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("topic_count"))
