"""Candlestick patterns as boolean expressions over lagged bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import SYMBOL, bar_window, flag


class _Shapes:
    """Body, shadows and trailing means of a bar and of those before it, as precomputed columns."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = keys

    def at(self, name: str, back: int = 0) -> Column:
        return F.col(name) if back == 0 else F.lag(name, back).over(bar_window(self.keys))

    def mean(self, name: str, n: int, back: int = 0) -> Column:
        """Mean over the n bars before the bar that is ``back`` bars ago; null until all are there."""
        w = bar_window(self.keys).rowsBetween(-(n + back), -(1 + back))
        return F.when(F.count(name).over(w) == n, F.avg(name).over(w))


def _white(s: _Shapes, back: int = 0) -> Column:
    return s.at("close", back) >= s.at("open", back)


def _top(s: _Shapes, back: int = 0) -> Column:
    return F.greatest(s.at("open", back), s.at("close", back))


def _bottom(s: _Shapes, back: int = 0) -> Column:
    return F.least(s.at("open", back), s.at("close", back))


def _tiny_shadow(s: _Shapes, shadow: str, back: int = 0) -> Column:
    return s.at(shadow, back) < 0.1 * s.mean("_range", 10, back)


def hammer(s: _Shapes) -> Column:
    near = s.at("low", 1) + 0.2 * s.mean("_range", 5, 1)
    return (s.at("_body") < s.mean("_body", 10)) & (s.at("_lower") > s.at("_body")) & _tiny_shadow(s, "_upper") & (_bottom(s) <= near)


def shooting_star(s: _Shapes) -> Column:
    return (s.at("_body") < s.mean("_body", 10)) & (s.at("_upper") > s.at("_body")) & _tiny_shadow(s, "_lower") & (_bottom(s) > _top(s, 1))


def engulfing_up(s: _Shapes) -> Column:
    return _white(s) & ~_white(s, 1) & (s.at("close") > s.at("open", 1)) & (s.at("open") < s.at("close", 1))


def engulfing_down(s: _Shapes) -> Column:
    return ~_white(s) & _white(s, 1) & (s.at("open") > s.at("close", 1)) & (s.at("close") < s.at("open", 1))


def morning_star(s: _Shapes) -> Column:
    first = ~_white(s, 2) & (s.at("_body", 2) > s.mean("_body", 10, 2))
    second = (s.at("_body", 1) <= s.mean("_body", 10, 1)) & (_top(s, 1) < _bottom(s, 2))
    return first & second & _white(s) & (s.at("_body") > s.mean("_body", 10)) & (s.at("close") > s.at("close", 2) + 0.3 * s.at("_body", 2))


def evening_star(s: _Shapes) -> Column:
    first = _white(s, 2) & (s.at("_body", 2) > s.mean("_body", 10, 2))
    second = (s.at("_body", 1) <= s.mean("_body", 10, 1)) & (_bottom(s, 1) > _top(s, 2))
    return first & second & ~_white(s) & (s.at("_body") > s.mean("_body", 10)) & (s.at("close") < s.at("close", 2) - 0.3 * s.at("_body", 2))


def three_white_soldiers(s: _Shapes) -> Column:
    near = lambda b: s.at("close", b) + 0.2 * s.mean("_range", 5, b)
    far = lambda b: s.at("_body", b) - 0.6 * s.mean("_range", 5, b)
    rising = (s.at("close") > s.at("close", 1)) & (s.at("close", 1) > s.at("close", 2))
    opens = (s.at("open", 1) > s.at("open", 2)) & (s.at("open", 1) <= near(2)) & (s.at("open") > s.at("open", 1)) & (s.at("open") <= near(1))
    bodies = (s.at("_body", 1) > far(2)) & (s.at("_body") > far(1)) & (s.at("_body") > s.mean("_body", 10))
    whites = _white(s, 2) & _white(s, 1) & _white(s)
    shadows = _tiny_shadow(s, "_upper", 2) & _tiny_shadow(s, "_upper", 1) & _tiny_shadow(s, "_upper")
    return whites & shadows & rising & opens & bodies


def three_black_crows(s: _Shapes) -> Column:
    inside = lambda b: (s.at("open", b) < s.at("open", b + 1)) & (s.at("open", b) > s.at("close", b + 1))
    blacks = _white(s, 3) & ~_white(s, 2) & ~_white(s, 1) & ~_white(s)
    shadows = _tiny_shadow(s, "_lower", 2) & _tiny_shadow(s, "_lower", 1) & _tiny_shadow(s, "_lower")
    falling = (s.at("close", 1) < s.at("close", 2)) & (s.at("close") < s.at("close", 1))
    return blacks & shadows & inside(1) & inside(0) & (s.at("high", 3) > s.at("close", 2)) & falling


#: Patterns by name, and the ones that make up each direction's flag.
PATTERNS: dict[str, Callable[[_Shapes], Column]] = {
    "hammer": hammer,
    "shooting_star": shooting_star,
    "engulfing_up": engulfing_up,
    "engulfing_down": engulfing_down,
    "morning_star": morning_star,
    "evening_star": evening_star,
    "three_white_soldiers": three_white_soldiers,
    "three_black_crows": three_black_crows,
}
BY_DIRECTION = {
    "long": ("hammer", "engulfing_up", "morning_star", "three_white_soldiers"),
    "short": ("shooting_star", "engulfing_down", "evening_star", "three_black_crows"),
}


def with_patterns(bars: DataFrame, names: Sequence[str], keys: Sequence[str] = SYMBOL) -> DataFrame:
    """A boolean column candle_<name> for each pattern; never null."""
    shaped = bars.withColumns(
        {
            "_body": F.abs(F.col("close") - F.col("open")),
            "_range": F.col("high") - F.col("low"),
            "_upper": F.col("high") - F.greatest("open", "close"),
            "_lower": F.least("open", "close") - F.col("low"),
        }
    )
    s = _Shapes(keys)
    return shaped.withColumns({f"candle_{n}": flag(PATTERNS[n](s)) for n in names}).drop("_body", "_range", "_upper", "_lower")


def with_candlestick(bars: DataFrame, direction: str, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """candlestick_<direction>: any pattern of the direction."""
    names = BY_DIRECTION[direction]
    found = with_patterns(bars, names, keys)
    any_ = F.lit(False)
    for n in names:
        any_ = any_ | F.col(f"candle_{n}")
    return found.withColumn(f"candlestick_{direction}", any_).drop(*[f"candle_{n}" for n in names])
