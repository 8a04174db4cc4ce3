"""Entry chains and exit rules as column expressions over the bars of all symbols."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import SYMBOL, captured, flag, rolling
from tidemark.functions.windows import change as bar_change
from tidemark.operators.signals import before_here

#: Configured signal names and the columns that hold them, less the direction.
SIGNALS = {"rsi_divergence": "divergence", "stochastic_crossover": "stochastic_crossover", "candle sticks": "candlestick"}
INDICATORS = {"rsi": "rsi", "stochastic_k": "stoch_k", "stochastic_d": "stoch_d", "stoch_k": "stoch_k", "stoch_d": "stoch_d"}


def orderings(stages: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Every order of the signals that keeps the stages in place."""
    return [tuple(n for part in chosen for n in part) for chosen in product(*(permutations(s) for s in stages))]


def with_buy(bars: DataFrame, direction: str, stages: Sequence[Sequence[str]], expirations: Sequence[int], keys: Sequence[str] = SYMBOL) -> DataFrame:
    """buy_signal_<direction>: the last signal of a chain fires and the nearest ones before it fit.

    Backwards from the last signal, the nearest earlier (or equal) bar with the signal before it is
    taken, and it has to be within that link's expiration; there is no second try further back. So
    each row only needs, for each link, where the signal was last seen and whether the chain up to
    that row held.
    """
    if not any(stages):
        raise ValueError("buy_signal_order needs a signal")
    out, finals = bars, []
    for n, order in enumerate(orderings(stages)):
        held = F.lit(True)
        for i, signal in enumerate(order):
            here = F.col(f"{SIGNALS[signal]}_{direction}")
            if i:
                last = F.col(f"_last{n}_{i - 1}")
                held = flag((F.col("rn") - last["rn"] <= expirations[i - 1]) & last["ok"])
            out = out.withColumn(f"_ok{n}_{i}", here & held)
            if i < len(order) - 1:
                seen = F.last(F.when(here, F.struct(F.col("rn").alias("rn"), F.col(f"_ok{n}_{i}").alias("ok"))), ignorenulls=True)
                out = out.withColumn(f"_last{n}_{i}", seen.over(before_here(keys)))
        finals.append(F.col(f"_ok{n}_{len(order) - 1}"))
    out = out.withColumn(f"buy_signal_{direction}", reduce(lambda a, b: a | b, finals))
    return out.drop(*[c for c in out.columns if c.startswith(("_ok", "_last"))])


class Fired:
    """A rule's outcome on a row: whether it fires and the level it was filled at (null: at close)."""

    def __init__(self, fires: Column, level: Column | None = None) -> None:
        self.fires, self.level = flag(fires), level


def indicator_exit(direction: str, indicator: str, flexible: bool, value: float, entry) -> Fired:
    v = F.col(INDICATORS[indicator])
    sign = 1 if direction == "long" else -1
    if flexible:
        return Fired(sign * (v - entry(v)) >= value)
    bound = value if direction == "long" else 100 - value
    return Fired(entry(F.lit(1)).isNotNull() & (sign * v >= sign * bound))


def _two_sided(direction: str, profit: Column, stop: Column, on_touch: bool) -> Fired:
    """Profit side first; the stop side is judged on the close and, if it fires, sets the fill."""
    long = direction == "long"
    close, reach = F.col("close"), F.col("high" if long else "low")
    won = flag((reach if on_touch else close) >= profit if long else (reach if on_touch else close) <= profit)
    lost = flag(close <= stop if long else close >= stop)
    level = F.when(lost, close).when(won, profit if on_touch else close)
    return Fired(won | lost, level)


def margin_exit(direction: str, take_profit: float, stop_loss: float, on_touch: bool, entry, volatility: str) -> Fired:
    c, s = F.col("close"), F.col(volatility)
    if direction == "long":
        profit, stop = entry(c * (1 + s * take_profit)), entry(c * (1 - s * stop_loss))
    else:
        profit, stop = entry(F.try_divide(c, 1 + s * take_profit)), entry(F.try_divide(c, 1 - s * stop_loss))
    return _two_sided(direction, profit, stop, on_touch)


def nearest_above(levels: Column, bound: Column) -> Column:
    return F.array_min(F.filter(levels, lambda x: x > bound))


def nearest_below(levels: Column, bound: Column) -> Column:
    return F.array_max(F.filter(levels, lambda x: x < bound))


def level_exit(direction: str, resistance: float, support: float, on_touch: bool, entry) -> Fired:
    c, levels = F.col("close"), F.col("support_resistance_levels")
    if direction == "long":
        above, below = nearest_above(levels, c * resistance), nearest_below(levels, c * support)
        return _two_sided(direction, entry(above), entry(below), on_touch)
    # F.try_divide leaves a distance of zero without a level.
    above, below = nearest_above(levels, F.try_divide(c, F.lit(support))), nearest_below(levels, c / resistance)
    return _two_sided(direction, entry(below), entry(above), on_touch)


def time_exit(max_bars: int, entry) -> Fired:
    return Fired(F.col("rn") - entry(F.col("rn")) >= max_bars)


def with_sell(bars: DataFrame, direction: str, groups: Sequence[Sequence[dict]], keys: Sequence[str] = SYMBOL) -> DataFrame:
    """sell_signal_<direction> and sell_price_<direction>: any group of which all rules fire.

    Every rule is armed by the latest raw buy signal. The price is the worst level of the fired
    groups for the position (least for long, greatest for short), or the close if none has one.
    """
    buy = F.col(f"buy_signal_{direction}")

    def entry(x: Column) -> Column:
        return captured(buy, x, keys)

    out, fired = bars, []
    for rules in groups:
        own = []
        for r in rules:
            kind = r["kind"]
            if kind == "indicator":
                own.append(indicator_exit(direction, r.get("indicator", "rsi"), r["threshold"]["flexible"], r["threshold"]["value"], entry))
            elif kind == "margin":
                name = f"_vol{r['volatility_length']}"
                if name not in out.columns:
                    out = out.withColumn("_ret", bar_change(F.col("close"), keys))
                    out = out.withColumn(name, rolling(F.stddev_samp, F.col("_ret"), r["volatility_length"], keys)).drop("_ret")
                own.append(margin_exit(direction, r["take_profit_multiplier"], r["stop_loss_multiplier"], r["take_profit_triggers_on_high"], entry, name))
            elif kind == "support_resistance":
                own.append(level_exit(direction, r["resistance_min_distance"], r["support_min_distance"], r["resistance_triggers_on_high"], entry))
            elif kind == "time":
                own.append(time_exit(r["max_bars_held"], entry))
            else:
                raise ValueError(f"unknown sell rule kind {kind!r}")
        fired.append(own)
    names: dict[int, tuple[str, str | None]] = {}
    for n, f in enumerate(x for own in fired for x in own):
        out = out.withColumn(f"_fires{n}", f.fires)
        if f.level is not None:
            out = out.withColumn(f"_level{n}", f.level)
        names[id(f)] = (f"_fires{n}", f"_level{n}" if f.level is not None else None)
    all_of = [reduce(lambda a, b: a & b, [F.col(names[id(f)][0]) for f in own], F.lit(True)) for own in fired]
    sold = reduce(lambda a, b: a | b, all_of, F.lit(False))
    levels = [F.when(hit, F.col(names[id(f)][1])) for own, hit in zip(fired, all_of, strict=True) for f in own if names[id(f)][1]]
    pick = F.least if direction == "long" else F.greatest
    level = pick(*levels) if len(levels) > 1 else levels[0] if levels else F.lit(None).cast("double")
    out = out.withColumn(f"sell_signal_{direction}", sold)
    out = out.withColumn(f"sell_price_{direction}", F.when(sold, F.coalesce(level, F.col("close"))))
    return out.drop(*[c for c in out.columns if c.startswith(("_fires", "_level", "_vol"))])
