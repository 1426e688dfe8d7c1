"""Relational surface over observations and triples: patterns, static data, range joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panemill.functions.tables import broadcast_if_small


def star_join(triples: DataFrame, predicates: dict[str, str], having: dict[str, str] | None = None) -> DataFrame:
    """The basic graph pattern ``?s p1 ?a . ?s p2 ?b ...``: every combination of the objects that a subject has for the predicates.

    One shuffle by subject, whatever the number of predicates; a subject without one of them gives no row.  ``having`` (name: object) are constants of the pattern.
    """
    wanted = triples.where(F.col("p").isin(list(predicates.values())))
    if having:  # subjects without a wanted object are dropped before anything is gathered
        held = reduce(Column.__and__, (F.max((F.col("p") == predicates[name]) & (F.col("o") == value)) for name, value in having.items()))
        keep = wanted.where(reduce(Column.__or__, ((F.col("p") == predicates[name]) & (F.col("o") == value) for name, value in having.items()))).groupBy("s").agg(held.alias("_held")).where("_held").select("s")
        other = ~F.col("p").isin([predicates[name] for name in having])
        matched = reduce(Column.__or__, ((F.col("p") == predicates[name]) & (F.col("o") == value) for name, value in having.items()))
        wanted = wanted.where(other | matched).join(keep, "s", "left_semi")
    rows = wanted.groupBy("s").agg(*(F.collect_list(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in predicates.items()))
    for name in predicates:
        rows = rows.withColumn(name, F.explode(name))
    return rows


def enrich(obs: DataFrame, static: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Static data beside each observation: inner (join), left (optional), left_anti (minus).  Broadcast if it is counted to be small."""
    return obs.join(broadcast_if_small(static), list(on), how)


def overlap_join(a: DataFrame, b: DataFrame, bucket_ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals of a (start_ms, end_ms) and b (b_start, b_end) that overlap.

    Each interval is dealt to the buckets it touches, and a pair is kept in the bucket where the later of the two
    begins, so it appears once and the join is an equi-join.
    """
    cut = lambda df, lo, hi: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor((F.col(hi) - 1) / bucket_ms))))
    pairs = cut(a, "start_ms", "end_ms").join(cut(b, "b_start", "b_end"), [*keys, "bucket"])
    overlap = (F.col("end_ms") > F.col("b_start")) & (F.col("start_ms") < F.col("b_end"))
    once = F.col("bucket") == F.floor(F.greatest("start_ms", "b_start") / bucket_ms)
    return pairs.where(overlap & once).drop("bucket")


def overlap_join_mixed(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals of a (start_ms, end_ms) and b (b_start, b_end) that overlap, of whatever lengths: seconds and years in one table.

    An interval's level is the power of two that its length needs; it touches two cells of that width at most.  Of a pair the longer one waits in its own cells, and the
    shorter one is looked up there, two cells for each level of the other table (63 at most).  A pair is kept in the cell where the later of both begins.
    Intervals without length overlap nothing.
    """
    bits = lambda lo, hi: F.length(F.bin(F.col(hi) - F.col(lo) - 1))
    a = a.where("end_ms > start_ms").withColumn("_level", bits("start_ms", "end_ms"))
    b = b.where("b_end > b_start").withColumn("_level", bits("b_start", "b_end"))
    sides = {"a": (a, "start_ms", "end_ms"), "b": (b, "b_start", "b_end")}
    levels = {name: sorted(r[0] for r in df.select("_level").distinct().collect()) for name, (df, _, _) in sides.items()}

    def dealt(name: str, other: str | None, above: int) -> DataFrame:
        df, lo, hi = sides[name]
        if other:
            df = df.withColumn("_at", F.explode(F.array(*map(F.lit, levels[other])).cast("array<int>"))).where(F.col("_at") >= F.col("_level") + above)
        else:
            df = df.withColumn("_at", F.col("_level"))
        cell = lambda c: F.call_function("shiftright", c, F.col("_at"))
        return df.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi) - 1)))).drop("_level")

    found = []
    for long, short, above in (("a", "b", 0), ("b", "a", 1)):
        own, looked = dealt(long, None, 0), dealt(short, long, above)
        pairs = own.join(looked, [*keys, "_at", "_cell"]) if long == "a" else looked.join(own, [*keys, "_at", "_cell"])
        overlap = (F.col("end_ms") > F.col("b_start")) & (F.col("start_ms") < F.col("b_end"))
        found.append(pairs.where(overlap & (F.col("_cell") == F.call_function("shiftright", F.greatest("start_ms", "b_start"), F.col("_at")))).drop("_at", "_cell"))
    return found[0].unionByName(found[1])


def in_windows(obs: DataFrame, windows: DataFrame, bucket_ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Observations in arbitrary windows (b_start, b_end): start <= ms < end."""
    dealt = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b_start") / bucket_ms), F.floor((F.col("b_end") - 1) / bucket_ms))))
    rows = obs.withColumn("bucket", F.floor(F.col("ms") / bucket_ms)).join(dealt, [*keys, "bucket"])
    return rows.where((F.col("ms") >= F.col("b_start")) & (F.col("ms") < F.col("b_end"))).drop("bucket")


def set_difference(actual: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of either table with status matched, missing (expected only) or extra (actual only)."""
    both = actual.select(*on).distinct().withColumn("a", F.lit(True)).join(expected.select(*on).distinct().withColumn("e", F.lit(True)), list(on), "full")
    return both.select(*on, F.when(F.col("a") & F.col("e"), "matched").when(F.col("e"), "missing").otherwise("extra").alias("status"))


def matched_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list[str]:
    """What two result tables are matched by: the window's bounds if all rows have them, else the window's number."""
    bounds = [c for c in ("win_start", "win_end") if c in a.columns and c in b.columns]
    missing = " or ".join(f"{c} is null" for c in bounds)
    whole = len(bounds) == 2 and a.where(missing).isEmpty() and b.where(missing).isEmpty()
    return [*keys, *(bounds if whole else ["window_number"])]
