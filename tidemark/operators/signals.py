"""Swing points, divergences, crossovers and price levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.folds import folded
from tidemark.functions.windows import SYMBOL, bar_window, flag


def is_extreme(name: str, before: int, after: int, high: bool, keys: Sequence[str] = SYMBOL) -> Column:
    """Strictly beyond all of the neighbours, each of which has to be there and known."""
    w = bar_window(keys)
    past, coming = w.rowsBetween(-before, -1), w.rowsBetween(1, after)
    agg = F.max if high else F.min
    x = F.col(name)
    ahead, behind = agg(x).over(past), agg(x).over(coming)
    beyond = (x > ahead) & (x > behind) if high else (x < ahead) & (x < behind)
    return flag((F.count(x).over(past) == before) & (F.count(x).over(coming) == after) & beyond)


def with_swing(bars: DataFrame, value: str, before: int, after: int, high: bool, name: str, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """The extreme's value on the bar ``after`` bars later, when it is known; else null."""
    marked = bars.withColumn("_x", F.when(is_extreme(value, before, after, high, keys), F.col(value)))
    return marked.withColumn(name, F.lag("_x", after).over(bar_window(keys))).drop("_x")


def with_joint_extreme(bars: DataFrame, before: int, after: int, high: bool, name: str, values: tuple[str, str] = ("close", "rsi"), keys: Sequence[str] = SYMBOL) -> DataFrame:
    """True on bars where both series are extreme at once."""
    a, b = (is_extreme(v, before, after, high, keys) for v in values)
    return bars.withColumn(name, a & b)


def with_divergence(bars: DataFrame, direction: str, first: tuple[int, int], second: tuple[int, int], expiration: int, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """divergence_<direction>: price and oscillator disagree between two extremes in a row.

    Triggers are joint extremes by the second window. A trigger pairs with the trigger just before
    it, if that one is an anchor (joint extreme by the first window) fewer than ``expiration`` bars
    ago. The flag stands on the bar when both are known.
    """
    high = direction == "short"
    w = bar_window(keys)
    marked = with_joint_extreme(bars, *first, high, "_anchor", keys=keys)
    marked = with_joint_extreme(marked, *second, high, "_trigger", keys=keys)
    here = F.when(F.col("_trigger"), F.struct("rn", "close", "rsi", "_anchor"))
    marked = marked.withColumn("_p", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = F.col("_p")
    apart = (p["close"] < F.col("close")) & (p["rsi"] > F.col("rsi")) if high else (p["close"] > F.col("close")) & (p["rsi"] < F.col("rsi"))
    hit = F.col("_trigger") & p["_anchor"] & (F.col("rn") - p["rn"] < expiration) & apart
    # Bars from the trigger to where both extremes are known; the anchor lies before the trigger.
    marked = marked.withColumn("_wait", F.when(hit, F.greatest(p["rn"] + F.lit(first[1]) - F.col("rn"), F.lit(second[1]))))
    waits = range(second[1], max(second[1], first[1] - 1) + 1)
    known = [flag(F.lag("_wait", n).over(w) == n) for n in waits]
    return marked.withColumn(f"divergence_{direction}", reduce(lambda a, b: a | b, known)).drop("_anchor", "_trigger", "_p", "_wait")


class Crossover:
    """Bars where a pending watch fires; unknown values compare false.

    A watch arms while %K is past the threshold, dies ``expiration`` bars later, and fires once %K
    has crossed %D and reached the level, which is absolute or relative to %K at arming. A bar on
    which a watch dies arms no other.
    """

    def __init__(self, long: bool, threshold: float, flexible: bool, value: float, expiration: int) -> None:
        self.side = 1.0 if long else -1.0
        self.bound, self.level = (threshold, value) if long else (100 - threshold, 100 - value)
        self.flexible, self.value, self.expiration = flexible, value, expiration
        self.t, self.since, self.base = 0, None, 0.0

    def __call__(self, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros(len(k), dtype=bool)
        side = self.side
        for at, (x, y) in enumerate(zip(k.tolist(), d.tolist(), strict=True)):
            if self.since is None:
                if side * x < side * self.bound:
                    self.since, self.base = self.t, x
            elif self.t - self.since >= self.expiration:
                self.since = None
            if self.since is not None:
                reached = side * x > side * (self.base + side * self.value if self.flexible else self.level)
                if reached and side * x > side * y:
                    out[at], self.since = True, None
            self.t += 1
        return (out,)


def crossovers(k: np.ndarray, d: np.ndarray, long: bool, threshold: float, flexible: bool, value: float, expiration: int) -> np.ndarray:
    """The firing bars of one series."""
    return Crossover(long, threshold, flexible, value, expiration)(np.asarray(k, dtype=float), np.asarray(d, dtype=float))[0]


def with_crossover(bars: DataFrame, direction: str, threshold: float = 50.0, flexible: bool = True, value: float = 10.0, expiration: int = 10, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """stochastic_crossover_<direction>, an automaton folded over each symbol's bars."""
    return with_crossovers(bars, (direction,), threshold, flexible, value, expiration, keys)


def with_crossovers(bars: DataFrame, directions: Sequence[str], threshold: float = 50.0, flexible: bool = True, value: float = 10.0, expiration: int = 10, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Crossovers of several directions in one fold."""

    def start() -> Callable:
        watches = [Crossover(d == "long", threshold, flexible, value, expiration) for d in directions]
        return lambda k, d: [w(k, d)[0] for w in watches]

    return folded(bars, {f"stochastic_crossover_{d}": T.BooleanType() for d in directions}, ["stoch_k", "stoch_d"], start, keys)


class Levels:
    """Standing highs and lows, and their ascending prices on the bars that ask."""

    def __init__(self) -> None:
        self.highs: list[float] = []
        self.lows: list[float] = []

    def __call__(self, highs: np.ndarray, lows: np.ndarray, ask: np.ndarray) -> tuple[list[list[float]]]:
        out: list[list[float]] = [[]] * len(ask)
        for at in np.nonzero(ask.astype(bool) | ~np.isnan(highs) | ~np.isnan(lows))[0].tolist():
            hi, lo = float(highs[at]), float(lows[at])
            if hi == hi:
                while self.highs and self.highs[-1] <= hi:
                    self.highs.pop()
                self.highs.append(hi)
            if lo == lo:
                while self.lows and self.lows[-1] >= lo:
                    self.lows.pop()
                self.lows.append(lo)
            if ask[at]:
                out[at] = sorted(self.highs + self.lows)
        return (out,)


def with_levels(bars: DataFrame, before: int = 8, after: int = 8, at: Column | None = None, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """support_resistance_levels: ascending prices of the standing highs and lows; empty if none.

    A high stands until a later one is as high or higher, a low until one is as low or lower.
    ``at`` restricts the work to rows that will read the levels (buy bars do); others get none.
    The fold is linear in the confirmed swings and the asking rows.
    """
    marked = with_swing(with_swing(bars, "high", before, after, True, "_hi", keys), "low", before, after, False, "_lo", keys)
    marked = marked.withColumn("_ask", flag(F.lit(True) if at is None else at))
    return folded(marked, {"support_resistance_levels": T.ArrayType(T.DoubleType())}, ["_hi", "_lo", "_ask"], Levels, keys).drop("_hi", "_lo", "_ask")


def before_here(keys: Sequence[str] = SYMBOL):
    return bar_window(keys).rowsBetween(Window.unboundedPreceding, 0)
