"""Oscillators and volatility over bars."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.folds import folded
from tidemark.functions.windows import SYMBOL, change, rolling


class Wilder:
    """Relative strength by Wilder's averages, bar by bar; the first ``length`` values are NaN."""

    def __init__(self, length: int) -> None:
        self.length, self.steps, self.close = length, 0, float("nan")
        self.gain = self.loss = 0.0
        self.begun = False

    def __call__(self, close: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(close), np.nan)
        n = self.length
        for t, c in enumerate(close.tolist()):
            if self.begun:
                step = c - self.close
                gain, loss = (step, 0.0) if step > 0 else (0.0, -step) if step < 0 else (0.0, 0.0)
                self.steps += 1
                if self.steps <= n:
                    self.gain += gain
                    self.loss += loss
                    if self.steps == n:
                        self.gain, self.loss = self.gain / n, self.loss / n
                else:
                    self.gain = (self.gain * (n - 1) + gain) / n
                    self.loss = (self.loss * (n - 1) + loss) / n
                if self.steps >= n:
                    both = self.gain + self.loss
                    out[t] = 100 * self.gain / both if both else 0.0
            self.begun, self.close = True, c
        return (out,)


def wilder_rsi(close: np.ndarray, length: int) -> np.ndarray:
    """The indicator of one series."""
    return Wilder(length)(np.asarray(close, dtype=float))[0]


def with_rsi(bars: DataFrame, length: int, name: str = "rsi", keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Adds the indicator. The average carries state over all earlier bars, so it is folded per symbol."""
    return folded(bars, {name: T.DoubleType()}, ["close"], lambda: Wilder(length), keys)


def stochastic(high: Column, low: Column, close: Column, fast: int, keys: Sequence[str] = SYMBOL) -> Column:
    """Place of the close in the range of the last ``fast`` bars, 0 to 100; 0 where it has no width."""
    top, bottom = rolling(F.max, high, fast, keys), rolling(F.min, low, fast, keys)
    return F.when(top == bottom, F.lit(0.0)).otherwise(100 * (close - bottom) / F.nullif(top - bottom, F.lit(0.0)))


def with_stochastic(bars: DataFrame, fast: int = 5, slow_k: int = 3, slow_d: int = 3, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """stoch_k and stoch_d, smoothed by simple means; both are null until %D is known."""
    raw = bars.withColumn("_raw", stochastic(F.col("high"), F.col("low"), F.col("close"), fast, keys))
    k = raw.withColumn("_k", rolling(F.avg, F.col("_raw"), slow_k, keys))
    d = k.withColumn("stoch_d", rolling(F.avg, F.col("_k"), slow_d, keys))
    return d.withColumn("stoch_k", F.when(F.col("stoch_d").isNotNull(), F.col("_k"))).drop("_raw", "_k")


def with_volatility(bars: DataFrame, length: int, name: str = "volatility", keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Sample deviation of the last ``length`` bar returns."""
    ret = bars.withColumn("_ret", change(F.col("close"), keys))
    return ret.withColumn(name, rolling(F.stddev_samp, F.col("_ret"), length, keys)).drop("_ret")
