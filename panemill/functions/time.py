"""Window specifications and arithmetic on epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """Windows [start, start + range_ms) whose starts lie on the grid origin_ms + k * step_ms."""

    range_ms: int
    step_ms: int
    origin_ms: int = 0
    id: str = ""

    def __post_init__(self):
        if self.range_ms <= 0 or self.step_ms <= 0:
            raise ValueError("range and step must be positive")


def align_start(ms: Column, step_ms: int | Column, origin_ms: int | Column = 0) -> Column:
    """The grid point at or before a time."""
    step = step_ms if isinstance(step_ms, Column) else F.lit(step_ms)
    return ms - F.pmod(ms - origin_ms, step)


def window_starts(ms: Column, range_ms: int | Column, step_ms: int | Column, origin_ms: int | Column = 0) -> Column:
    """Starts of all windows that hold a time; empty in a gap of windows shorter than their step."""
    span, step = (x if isinstance(x, Column) else F.lit(x) for x in (range_ms, step_ms))
    last = align_start(ms, step, origin_ms)
    first = last - F.floor((span - 1) / step) * step
    return F.filter(F.sequence(first, last, step), lambda start: start + span > ms)


def window_number(start: Column, anchor: int | Column, step_ms: int) -> Column:
    """1 for the window at the anchor; null before it."""
    n = F.round((start - anchor) / step_ms).cast("long") + 1
    return F.when(n > 0, n)


def parse_iso_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 time; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
