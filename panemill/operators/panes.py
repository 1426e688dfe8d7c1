"""Exact reuse: aggregate states of disjoint panes, and any compatible window recomposed from them.

Raw rows are read once, to make one small state for each (key, pane); every window whose range and step are multiples of
the pane is then a merge of states.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.functions.tables import small, with_previous
from panemill.functions.time import WindowSpec, align_start, finite, window_starts

#: State columns that each aggregate needs.
SIGNATURE = {"avg": ("sum", "count"), "sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",)}


def chunk_size(specs: Sequence[WindowSpec]) -> int:
    """The widest pane that fits all ranges and steps; 1 for no specs."""
    return reduce(gcd, (x for s in specs for x in (s.range_ms, s.step_ms))) if specs else 1


def common_multiple(specs: Sequence[WindowSpec]) -> int:
    """The least time after which all windows begin together again; 1 for no specs."""
    return lcm(*(s.step_ms for s in specs)) if specs else 1


@dataclass(frozen=True)
class ChunkPlan:
    """Panes every ``step_ms``; sub-queries keep windows of ``width_ms``, which is a step unless they were wider before."""

    step_ms: int
    width_ms: int


def chunk_plan(output: WindowSpec, subs: Sequence[WindowSpec]) -> ChunkPlan:
    """The step that fits the output window and all sub-queries, and the widest range that a sub-query had."""
    step = chunk_size([output, *subs])
    return ChunkPlan(step, max([step, *(s.range_ms for s in subs)]))


def chunk_states(obs: DataFrame, pane_ms: int, keys: Sequence[str] = ("stream",), origin_ms: int = 0) -> DataFrame:
    """keys, start_ms, end_ms, count, sum, min, max of each pane that has rows."""
    start = align_start(F.col("ms"), pane_ms, origin_ms)
    states = obs.withColumn("start_ms", start).groupBy(*keys, "start_ms")
    states = states.agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return states.select(*keys, "start_ms", (F.col("start_ms") + pane_ms).alias("end_ms"), "count", "sum", "min", "max")


def merge_states(states: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Merges states by keys; ``more`` are further aggregates.

    A missing sum is made up from avg and count where there is an avg column.  A state that lacks what an aggregate needs makes that aggregate
    of the merged state null, rather than wrong; a state of no rows needs nothing.
    """
    total = finite(F.col("sum"))
    if "avg" in states.columns:
        total = F.coalesce(total, finite(F.col("avg")) * F.col("count"))
    empty = F.coalesce(F.col("count") == 0, F.lit(False))
    whole = lambda value, merged: F.when(~F.bool_or(value.isNull() & ~empty), merged)
    return states.groupBy(*keys).agg(
        *more,
        F.when(~F.bool_or(F.col("count").isNull()), F.sum("count")).alias("count"),
        whole(total, F.sum(total)).alias("sum"),
        whole(F.col("min"), F.min("min")).alias("min"),
        whole(F.col("max"), F.max("max")).alias("max"),
    )


def merge_producers(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merges the partials of all producers of a pane; a partial without a sum counts with avg * count."""
    return merge_states(states, [*keys, "start_ms", "end_ms"])


def final_of(agg: str) -> Column:
    """An aggregate from a merged state; null if the state has nothing for it."""
    return {
        "count": F.col("count"),
        "sum": F.col("sum"),
        "avg": F.when(F.col("count") > 0, F.col("sum") / F.col("count")),
        "min": F.col("min"),
        "max": F.col("max"),
    }[agg]


def recomposable(agg: str) -> Column:
    """Whether a state has what the aggregate needs."""
    return reduce(Column.__and__, (F.col(c).isNotNull() for c in SIGNATURE[agg]))


def project_state(states: DataFrame, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """Output columns (aggregate, alias) of states, in order; the average of an empty state is 0."""
    keep = [c for c in states.columns if c not in ("count", "sum", "min", "max")]
    made = {"avg": F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0)}
    return states.select(*keep, *(made.get(agg, final_of(agg)).alias(alias) for agg, alias in terms))


def chunks_to_windows(states: DataFrame, spec: WindowSpec, pane_ms: int, min_start: int | None = None) -> DataFrame:
    """A row for each pane and final window that uses it, range / step at most; none for panes of another width or ranges that panes don't fill."""
    if spec.range_ms % pane_ms:
        return states.withColumn("win_start", F.lit(None).cast("long")).withColumn("win_end", F.lit(None).cast("long")).where(F.lit(False))
    rows = states.where(F.col("end_ms") - F.col("start_ms") == pane_ms)
    rows = rows.withColumn("win_start", F.explode(window_starts(F.col("start_ms"), spec.range_ms, spec.step_ms, spec.origin_ms)))
    rows = rows.where(F.pmod(F.col("start_ms") - F.col("win_start"), F.lit(pane_ms)) == 0)
    if min_start is not None:
        rows = rows.where(F.col("win_start") >= min_start)
    return rows.withColumn("win_end", F.col("win_start") + spec.range_ms)


#: Windows that hold a pane at most for panes to be copied to each; beyond that, windows are put together from running aggregates.
COPIES = 4


def unfit(spec: WindowSpec, pane_ms: int, pane_origin_ms: int = 0) -> str:
    """Why panes can't make up a specification's windows; '' if they can."""
    return next((why for bad, why in ((spec.range_ms % pane_ms, "range"), (spec.step_ms % pane_ms, "step"), ((spec.origin_ms - pane_origin_ms) % pane_ms, "origin")) if bad), "")


def _swept(states: DataFrame, pane_ms: int, keys: Sequence[str]) -> DataFrame:
    """Merged states of all windows of rows (keys, pane, range_ms, step_ms, origin_ms), in constant work for each pane and window.

    Time is cut in blocks as long as a window.  A window that begins inside a block is the rest of that block, from its first pane on, and the beginning of the
    next block; both come from running aggregates, backward and forward.  A window is made once, by the first pane that it holds.
    """
    block = lambda at: align_start(at, F.col("range_ms"), F.col("origin_ms"))
    total = finite(F.col("sum"))
    if "avg" in states.columns:
        total = F.coalesce(total, finite(F.col("avg")) * F.col("count"))
    empty = F.coalesce(F.col("count") == 0, F.lit(False))
    rows = states.where((F.col("end_ms") - F.col("start_ms") == pane_ms) & (F.pmod(F.col("start_ms") - F.col("origin_ms"), F.lit(pane_ms)) == 0))
    rows = rows.select(*keys, "start_ms", "range_ms", "step_ms", "origin_ms", F.lit(1).alias("_panes"), F.col("count").alias("_count"), total.alias("_sum"), F.col("min").alias("_min"), F.col("max").alias("_max"),
        F.col("count").isNull().alias("_no_count"), (total.isNull() & ~empty).alias("_no_sum"), (F.col("min").isNull() & ~empty).alias("_no_min"), (F.col("max").isNull() & ~empty).alias("_no_max"))
    merges = {"_panes": F.sum, "_count": F.sum, "_sum": F.sum, "_min": F.min, "_max": F.max, **{f"_no_{c}": F.max for c in ("count", "sum", "min", "max")}}
    rows = with_previous(rows.withColumn("_block", block(F.col("start_ms"))), keys, ["start_ms"], F.col("_block"), "_earlier")

    # Backward, to the end of the pane's block.
    rest = W.partitionBy(*keys, "_block").orderBy("start_ms").rangeBetween(W.currentRow, W.unboundedFollowing)
    made = rows.withColumns({f"_rest{c}": merge(c).over(rest) for c, merge in merges.items()})
    after = F.greatest("_earlier.start_ms", F.col("start_ms") - F.col("range_ms"))
    first = align_start(after, F.col("step_ms"), F.col("origin_ms")) + F.col("step_ms")
    last = align_start(F.col("start_ms"), F.col("step_ms"), F.col("origin_ms"))
    starts = F.when(first <= last, F.sequence(first, last, F.col("step_ms")))
    made = made.withColumn("win_start", F.explode(starts))
    inside = F.col("_block") == block(F.col("win_start"))
    made = made.select(*keys, "win_start", (F.col("win_start") + F.col("range_ms")).alias("win_end"), (block(F.col("win_start")) + F.col("range_ms")).alias("_block"),
        (F.col("win_start") + F.col("range_ms") - pane_ms).alias("_at"), *(F.when(inside, F.col(f"_rest{c}")).alias(f"_rest{c}") for c in merges))

    # Forward, from the beginning of the next block.
    given = rows.select(*keys, "_block", F.col("start_ms").alias("_at"), *merges)
    both = made.unionByName(given, allowMissingColumns=True)
    begun = W.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumns({f"_begun{c}": merge(c).over(begun) for c, merge in merges.items()}).where("win_start is not null")
    added = lambda c: F.when(F.col(f"_rest{c}").isNull(), F.col(f"_begun{c}")).otherwise(F.col(f"_rest{c}") + F.coalesce(F.col(f"_begun{c}"), F.lit(0)))
    known = lambda c, value: F.when(~(F.coalesce(F.col(f"_rest_no_{c}"), F.lit(False)) | F.coalesce(F.col(f"_begun_no_{c}"), F.lit(False))), value).alias(c)
    return both.select(
        *keys, "win_start", "win_end", added("_panes").cast("long").alias("panes"), known("count", added("_count")), known("sum", added("_sum")), known("min", F.least("_rest_min", "_begun_min")), known("max", F.greatest("_rest_max", "_begun_max"))
    )


def _recomposed(states: DataFrame, pane_ms: int, keys: Sequence[str], copied: bool) -> DataFrame:
    """Merged states of all windows, and their average, by either way."""
    if not copied:
        return _swept(states, pane_ms, keys).withColumn("avg", final_of("avg"))
    rows = states.where((F.col("end_ms") - F.col("start_ms") == pane_ms) & (F.pmod(F.col("start_ms") - F.col("origin_ms"), F.lit(pane_ms)) == 0))
    rows = rows.withColumn("win_start", F.explode(window_starts(F.col("start_ms"), F.col("range_ms"), F.col("step_ms"), F.col("origin_ms")))).withColumn("win_end", F.col("win_start") + F.col("range_ms"))
    return merge_states(rows, [*keys, "win_start", "win_end"], F.count(F.lit(1)).alias("panes")).withColumn("avg", final_of("avg"))


def recompose(states: DataFrame, spec: WindowSpec, pane_ms: int, keys: Sequence[str] = ("stream",), require_complete: bool = False) -> DataFrame:
    """Merged states of all windows, with the number of panes; only windows with every pane if required.

    An aggregate that one of the panes can't support is null (see ``merge_states``).  A specification that panes don't fill is an error.
    """
    if why := unfit(spec, pane_ms, spec.origin_ms):
        raise ValueError(f"{why} is no multiple of the pane")
    rows = states.withColumns({"range_ms": F.lit(spec.range_ms), "step_ms": F.lit(spec.step_ms), "origin_ms": F.lit(spec.origin_ms)})
    merged = _recomposed(rows, pane_ms, keys, spec.range_ms <= COPIES * spec.step_ms)
    return merged.where(F.col("panes") == spec.range_ms // pane_ms) if require_complete else merged


def recompose_flat(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges partial rows straight by key, without the level of panes."""
    return merge_states(states, keys).withColumn("avg", final_of("avg"))


def _specs(specs: DataFrame) -> list[tuple]:
    """(id, specification) of a small table; an origin column is optional."""
    columns = ["id", "range_ms", "step_ms", *(["origin_ms"] if "origin_ms" in specs.columns else [])]
    return [(r["id"], WindowSpec(*(int(r[c]) for c in columns[1:]))) for r in small(specs.select(*columns)).collect()]


def unfit_specs(specs: DataFrame, pane_ms: int, pane_origin_ms: int = 0) -> dict:
    """Specifications (id: reason) of a small table whose range, step or origin panes don't fit."""
    return {name: why for name, spec in _specs(specs) if (why := unfit(spec, pane_ms, pane_origin_ms))}


def derive_original(states: DataFrame, specs: DataFrame, pane_ms: int, keys: Sequence[str] = ("stream",), pane_origin_ms: int = 0) -> DataFrame:
    """Windows of every (id, range_ms, step_ms, and origin_ms if there is one) of a small table, rebuilt from the same states.

    A specification that panes don't fit is an error that names it; ``unfit_specs`` finds them before.  Each state is read once for a specification, and
    windows of many steps cost no copies.
    """
    if bad := unfit_specs(specs, pane_ms, pane_origin_ms):
        raise ValueError(f"panes don't fit these specifications: {bad}")
    kind, parts = specs.schema["id"].dataType.simpleString(), []
    known = _specs(specs)
    for copied in (True, False):
        own = [(name, s.range_ms, s.step_ms, s.origin_ms) for name, s in known if (s.range_ms <= COPIES * s.step_ms) == copied]
        if own or (copied and not known):
            table = states.sparkSession.createDataFrame(own, f"id {kind}, range_ms long, step_ms long, origin_ms long")
            parts.append(_recomposed(states.join(F.broadcast(table)), pane_ms, ["id", *keys], copied).drop("panes"))
    return reduce(DataFrame.unionByName, parts)


def early_partial(states: DataFrame, spec: WindowSpec, pane_ms: int, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """An early result of each window from the panes of its first step; never comparable with a whole window."""
    early = WindowSpec(spec.step_ms, spec.step_ms, spec.origin_ms)
    found = recompose(states, early, pane_ms, keys).withColumnRenamed("win_end", "seen_to")
    return found.withColumn("win_end", F.col("win_start") + spec.range_ms).withColumn("comparable", F.lit(False))


def chunk_key(start: Column, end: Column, origin: int | None = None) -> Column:
    parts = [start.cast("string"), end.cast("string")]
    return F.concat_ws(":", *([F.lit(str(origin))] if origin is not None else []), *parts)


def expected_keys(start: Column, end: Column, pane_ms: int, origin: int | None = None) -> Column:
    """Keys of all panes of a window; empty if they don't fill it."""
    panes = F.sequence(start, end - pane_ms, F.lit(pane_ms))
    keys = F.transform(panes, lambda s: chunk_key(s, s + pane_ms, origin))
    return F.when((end - start) % pane_ms == 0, keys).otherwise(F.array().cast("array<string>"))


def coverage(states: DataFrame, spec: WindowSpec, pane_ms: int, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Expected, received, missing and duplicate pane keys of each window, and whether it is covered."""
    rows = chunks_to_windows(states, spec, pane_ms).withColumn("chunk", chunk_key(F.col("start_ms"), F.col("end_ms")))
    counted = rows.groupBy(*keys, "win_start", "win_end", "chunk").count()
    found = counted.groupBy(*keys, "win_start", "win_end").agg(
        F.array_sort(F.collect_list("chunk")).alias("received"), F.array_sort(F.collect_list(F.when(F.col("count") > 1, F.col("chunk")))).alias("duplicates")
    )  # at most range / pane keys each
    found = found.withColumn("expected", expected_keys(F.col("win_start"), F.col("win_end"), pane_ms))
    found = found.withColumn("missing", F.array_except("expected", "received"))
    return found.withColumn("complete", F.size("missing") == 0)


def emission_proof(states: DataFrame, spec: WindowSpec, pane_ms: int, producer: str) -> DataFrame:
    """For each window and producer, a row each, the required, received, missing and duplicate panes, and whether all are there.

    ``proof_maps`` puts the producers of a window in one row.
    """
    return coverage(states, spec, pane_ms, [producer]).withColumnRenamed("expected", "required")


def proof_maps(proofs: DataFrame, producer: str) -> DataFrame:
    """The proof of each window with maps by producer, for windows of few producers."""
    lists = ("received", "missing", "duplicates")
    found = proofs.withColumnRenamed("required", "expected")
    return found.groupBy("win_start", "win_end").agg(
        F.first("expected").alias("required"),
        *(F.map_from_entries(F.collect_list(F.struct(producer, name))).alias(name) for name in lists),
        F.bool_and("complete").alias("complete"),
        F.count(F.lit(1)).alias("producers"),
    )


def all_producers(states: DataFrame, producer: str, n: int) -> DataFrame:
    """Panes to which at least n different producers contributed."""
    return states.groupBy("start_ms", "end_ms").agg(F.count_distinct(producer).alias("producers")).where(F.col("producers") >= n)


def contiguous_runs(states: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Runs of panes without a gap: first start, last end, number of panes.  A key has as many panes as time has, whatever the number of rows."""
    order = W.partitionBy(*keys).orderBy("start_ms")
    breaks = F.coalesce((F.lag("end_ms").over(order) != F.col("start_ms")).cast("long"), F.lit(1))
    rows = states.withColumn("fresh", breaks).withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy(*keys, "run").agg(F.min("start_ms").alias("run_start"), F.max("end_ms").alias("run_end"), F.count(F.lit(1)).alias("panes"))


def dedupe_contributions(states: DataFrame, identity: Sequence[str], arrival: str) -> DataFrame:
    """The first contribution of each identity by arrival, with the number of all."""
    rest = [c for c in states.columns if c not in identity]
    first = states.groupBy(*identity).agg(F.min_by(F.struct(*rest), arrival).alias("first"), F.count(F.lit(1)).alias("contributions"))
    return first.select(*identity, *(F.col(f"first.{c}").alias(c) for c in rest), "contributions")


def temporally_complete(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States whose panes were watched whole, and those that claim so falsely."""
    whole = (F.col("start_ms") >= F.col("coverage_origin")) & (F.col("input_watermark") >= F.col("end_ms"))
    return states.where(whole), states.where(~whole & F.col("claims_complete"))


def weighted_merge(rows: DataFrame, keys: Sequence[str], value: str = "value", count: str = "count") -> DataFrame:
    """The average of averages by their counts, null where they sum to 0, and the count of all."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(count)), F.sum(count)).alias("avg"), F.sum(count).alias("count"))


def shared_result(consumers: DataFrame, results: DataFrame, on: str = "canonical_id") -> DataFrame:
    """One computed result handed to every consumer of its canonical query."""
    return consumers.join(results, on)


def nested_targets(states: DataFrame, rank: str) -> DataFrame:
    """For each window the aggregate over the streams of rank 1 to k, for every k, from one state a stream."""
    order = W.partitionBy("win_start", "win_end").orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    return states.withColumn("sum_to", F.sum("sum").over(order)).withColumn("count_to", F.sum("count").over(order)).withColumn("avg_to", F.try_divide("sum_to", "count_to"))
