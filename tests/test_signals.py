import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import candles, indicators
from tidemark.operators import rules as R
from tidemark.operators import signals as G

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    kinds = {bool: "boolean", float: "double", list: "array<double>"}
    names, types = [], []
    for k, v in columns.items():
        names.append(k)
        types.append(kinds[type(next(x for x in v if x is not None))])
    rows = [("A", T0 + HOUR * i, i, *(columns[k][i] for k in names)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn int, " + ", ".join(f"{a} {b}" for a, b in zip(names, types, strict=True)))


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def floats(*x):
    return [float(v) for v in x]


def test_swings(spark):
    high = frame(spark, v=floats(1, 2, 5, 3, 2, 1, 1))
    assert column(G.with_swing(high, "v", 2, 2, True, "s"), "s") == [None] * 4 + [5.0] + [None] * 2
    low = frame(spark, v=floats(5, 4, 1, 3, 4, 5, 5))
    assert column(G.with_swing(low, "v", 2, 2, False, "s"), "s") == [None] * 4 + [1.0] + [None] * 2
    tie = frame(spark, v=floats(1, 2, 5, 3, 5, 1, 1))
    assert column(G.with_swing(tie, "v", 2, 2, True, "s"), "s") == [None] * 7
    near = frame(spark, v=floats(50, 60, 85, 55, 40))
    assert column(G.with_swing(near, "v", 1, 1, True, "s"), "s") == [None, None, None, 85.0, None]


def test_levels_against_rescans(spark):
    rng = random.Random(42)
    h = [float(rng.randrange(10, 40)) for _ in range(120)]
    lo = [x - rng.randrange(1, 9) for x in h]
    got = column(G.with_levels(frame(spark, high=h, low=lo), 2, 2), "support_resistance_levels")
    swing = lambda x, t, f: 4 <= t + 2 and t >= 2 and t + 2 < 120 and all(f(x[t], x[j]) for j in (t - 2, t - 1, t + 1, t + 2))
    want = []
    for t in range(120):
        up = [i for i in range(t - 1) if swing(h, i, lambda a, b: a > b)]
        down = [i for i in range(t - 1) if swing(lo, i, lambda a, b: a < b)]
        want.append(sorted([h[i] for i in up if not any(j > i and h[j] >= h[i] for j in up)] + [lo[i] for i in down if not any(j > i and lo[j] <= lo[i] for j in down)]))
    assert got == want


def test_divergence(spark):
    close, rsi = [100.0] * 25, [50.0] * 25
    close[5], rsi[5], close[15], rsi[15] = 90.0, 20.0, 80.0, 30.0
    hits = column(G.with_divergence(frame(spark, close=close, rsi=rsi), "long", (2, 3), (2, 1), 30), "divergence_long")
    assert [i for i, x in enumerate(hits) if x] == [16]
    assert not any(column(G.with_divergence(frame(spark, close=close, rsi=rsi), "long", (2, 3), (2, 1), 10), "divergence_long"))
    assert not any(column(G.with_divergence(frame(spark, close=close, rsi=rsi), "short", (2, 3), (2, 1), 30), "divergence_short"))


def test_crossover_automaton():
    k = np.array([60, 40, 38, 45, 52, 60, np.nan, 30, 41.0])
    d = np.array([50, 45, 44, 44, 50, 58, 10, 20, 30.0])
    assert np.nonzero(G.crossovers(k, d, True, 50, True, 10, 10))[0].tolist() == [4, 8]
    assert np.nonzero(G.crossovers(100 - k, 100 - d, False, 50, True, 10, 10))[0].tolist() == [4, 8]
    assert not G.crossovers(k, d, True, 50, True, 10, 3)[:8].any()
    assert np.nonzero(G.crossovers(np.array([45.0]), np.array([40.0]), True, 50, False, 44, 9))[0].tolist() == [0]


def test_rsi_and_stochastic(spark):
    rising = frame(spark, close=[float(i) for i in range(12)], high=[i + 1.0 for i in range(12)], low=[i - 1.0 for i in range(12)])
    assert column(indicators.with_rsi(rising, 5), "rsi") == [None] * 5 + [100.0] * 7
    out = indicators.with_stochastic(rising)
    assert column(out, "stoch_k")[:8] == [None] * 8 and column(out, "stoch_d")[8] == pytest.approx(column(out, "stoch_k")[8])
    flat = frame(spark, close=[5.0] * 12, high=[5.0] * 12, low=[5.0] * 12)
    assert column(indicators.with_stochastic(flat), "stoch_k")[-1] == 0.0
    assert column(indicators.with_rsi(flat, 3), "rsi")[-1] == 0.0


def test_prefix_invariance(spark):
    rng = np.random.default_rng(3)
    c = (100 + np.cumsum(rng.normal(size=90))).tolist()
    o = (np.array(c) + rng.normal(size=90)).tolist()
    full = dict(close=c, open=o, high=[max(a, b) + 0.5 for a, b in zip(c, o, strict=True)], low=[min(a, b) - 0.5 for a, b in zip(c, o, strict=True)])

    def derive(n):
        f = frame(spark, **{k: v[:n] for k, v in full.items()})
        f = indicators.with_stochastic(indicators.with_rsi(candles.with_candlestick(f, "long"), 5))
        f = G.with_levels(G.with_divergence(G.with_crossover(f, "long"), "long", (3, 3), (3, 1), 30), 3, 3)
        return [
            tuple(r)[1:]
            for r in f.select("ts", "rsi", "stoch_k", "candlestick_long", "divergence_long", "stochastic_crossover_long", "support_resistance_levels").orderBy("ts").collect()
        ]

    assert derive(90)[:60] == derive(60)


def greedy(signals, order, expirations, anchor):
    at = anchor
    if not signals[order[-1]][at]:
        return False
    for i in range(len(order) - 2, -1, -1):
        near = next((at - g for g in range(expirations[i] + 1) if at - g >= 0 and signals[order[i]][at - g]), None)
        if near is None:
            return False
        at = near
    return True


def test_buy_chains_against_greedy_search(spark):
    rng = random.Random(1)
    names = ["rsi_divergence", "stochastic_crossover", "candle sticks"]
    s = {n: [rng.random() < 0.15 for _ in range(200)] for n in names}
    for v in s.values():
        v[0] = True
    df = frame(spark, **{f"{R.SIGNALS[n]}_long": v for n, v in s.items()})
    for stages, exp in (([[names[0]]], []), ([[names[0]], [names[1]]], [3]), ([[names[0], names[2]]], [2]), ([[names[0]], [names[1], names[2]]], [4, 2])):
        got = column(R.with_buy(df, "long", stages, exp), "buy_signal_long")
        assert got == [any(greedy(s, o, exp, t) for o in R.orderings(stages)) for t in range(200)]
    with pytest.raises(ValueError, match="needs a signal"):
        R.with_buy(df, "long", [], [])


def sells(spark, groups, direction="long", **columns):
    n = len(columns["close"])
    base = {"high": columns["close"], "low": columns["close"], "rsi": [50.0] * n}
    out = R.with_sell(frame(spark, **(base | columns)), direction, groups)
    return column(out, f"sell_signal_{direction}"), column(out, f"sell_price_{direction}")


def test_exit_rules(spark):
    buy = [True, False, False, False, False]
    rsi = {"kind": "indicator", "indicator": "rsi", "threshold": {"flexible": True, "value": 10.0}}
    assert sells(spark, [[rsi]], close=floats(1, 1, 1, 1, 1), rsi=floats(40, 45, 50, 55, 30), buy_signal_long=buy)[0] == [False, False, True, True, False]
    time = {"kind": "time", "max_bars_held": 2}
    assert sells(spark, [[time]], close=floats(1, 2, 3, 4, 5), buy_signal_long=[True, False, False, True, False]) == ([False, False, True, False, False], [None, None, 3.0, None, None])
    level = {"kind": "support_resistance", "resistance_min_distance": 1.0, "support_min_distance": 1.0, "resistance_triggers_on_high": True}
    lv = [[90.0, 110.0]] * 5
    hit, price = sells(spark, [[level]], close=floats(100, 105, 111, 89, 100), high=floats(100, 109, 112, 89, 100), low=floats(99, 99, 99, 88, 99), support_resistance_levels=lv, buy_signal_long=buy)
    assert hit == [False, False, True, True, False] and price == [None, None, 110.0, 89.0, None]
    hit, price = sells(spark, [[level]], "short", close=floats(100, 105, 111, 89, 100), high=floats(100, 109, 112, 89, 100), low=floats(99, 99, 99, 88, 99), support_resistance_levels=lv, buy_signal_short=buy)
    assert hit == [False, False, True, True, False] and price == [None, None, 111.0, 90.0, None]
    # A group with no rules holds on every bar, no groups never sell.
    assert sells(spark, [[]], close=floats(1, 2), buy_signal_long=[True, False])[0] == [True, True]
    assert sells(spark, [], close=floats(1, 2), buy_signal_long=[True, False])[0] == [False, False]


def test_a_null_at_the_latest_entry_hides_older_ones(spark):
    level = {"kind": "support_resistance", "resistance_min_distance": 1.0, "support_min_distance": 1.0, "resistance_triggers_on_high": True}
    hit, _ = sells(spark, [[level]], close=floats(100, 100, 200), support_resistance_levels=[[110.0], [50.0], [50.0]], buy_signal_long=[True, True, False])
    assert hit == [False, False, False]


def test_margin_without_variance_fires_at_once(spark):
    margin = {"kind": "margin", "take_profit_multiplier": 2.0, "stop_loss_multiplier": 2.0, "volatility_length": 2, "take_profit_triggers_on_high": True}
    hit, price = sells(spark, [[margin]], close=floats(5, 5, 5, 5), buy_signal_long=[False, False, True, False])
    assert hit == [False, False, True, True] and price[2] == 5.0


def test_patterns_have_hand_made_cases(spark):
    o, c = [10.0] * 10 + [12.0, 9.5], [10.5] * 10 + [10.0, 12.5]
    df = frame(spark, open=o, close=c, high=[max(a, b) + 0.2 for a, b in zip(o, c, strict=True)], low=[min(a, b) - 0.2 for a, b in zip(o, c, strict=True)])
    out = candles.with_patterns(df, list(candles.PATTERNS))
    assert column(out, "candle_engulfing_up")[-1] is True and not any(column(out, "candle_engulfing_down"))
    assert out.where(F.col("candle_hammer").isNull()).count() == 0
