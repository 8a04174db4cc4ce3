"""Window helpers that keep undefined warm-up rows null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL = ("symbol",)


def bar_window(keys: Sequence[str] = SYMBOL) -> WindowSpec:
    """Bars of one symbol in time order; every operator uses this one spec, so one sort serves all."""
    return Window.partitionBy(*keys).orderBy("ts")


def trailing(n: int, keys: Sequence[str] = SYMBOL) -> WindowSpec:
    return bar_window(keys).rowsBetween(-(n - 1), 0)


def rolling(agg, x: Column, n: int, keys: Sequence[str] = SYMBOL) -> Column:
    """agg over the last n bars; null until n values are known."""
    w = trailing(n, keys)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def captured(when: Column, payload: Column, keys: Sequence[str] = SYMBOL) -> Column:
    """Payload of the latest row where ``when`` holds, even if that payload is null."""
    latest = F.last(F.when(when, F.struct(payload.alias("x"))), ignorenulls=True)
    return latest.over(bar_window(keys).rowsBetween(Window.unboundedPreceding, 0))["x"]


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def change(x: Column, keys: Sequence[str] = SYMBOL) -> Column:
    """Bar-over-bar relative change; null on the first bar and after a zero."""
    return F.try_divide(x, F.lag(x).over(bar_window(keys))) - 1
