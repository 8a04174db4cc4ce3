import datetime as dt

import numpy as np
import pytest

from tidemark.operators import metrics as M
from tidemark.operators import simulate as S

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
SIGNALS = "combo_id int, symbol string, universe_rank int, rn int, ts timestamp_ntz, close double, buy_signal_long boolean, sell_signal_long boolean, sell_price_long double, buy_signal_short boolean, sell_signal_short boolean, sell_price_short double"


def events(spark, *bars):
    rows = [(0, "A", 0, i, T0 + HOUR * i, 10.0 + i, "B" in b, "S" in b, 99.0 if "S" in b else None, "b" in b, "s" in b, 77.0 if "s" in b else None) for i, b in enumerate(bars)]
    out = S.ticker_events(spark.createDataFrame(rows, SIGNALS), ("long", "short")).orderBy("seq").collect()
    return [(r.rn, r.kind, r.direction, r.price) for r in out]


def test_states(spark):
    assert events(spark, "", "B", "", "S", "") == [(1, "buy", "long", 11.0), (3, "sell", "long", 99.0)]
    assert events(spark, "BS", "") == [(0, "buy", "long", 10.0), (0, "sell", "long", 99.0)]
    assert events(spark, "B", "b", "") == [(0, "buy", "long", 10.0), (1, "sell", "long", 11.0), (1, "buy", "short", 11.0), (2, "sell", "short", 12.0)]
    assert events(spark, "B", "Sb", "") == [(0, "buy", "long", 10.0), (1, "sell", "long", 99.0)]
    assert events(spark, "", "", "B") == [(2, "buy", "long", 12.0), (2, "sell", "long", 12.0)]
    assert events(spark, "", "") == []


def run(spark, rows, slots=2, reject=False, threshold=0.0, correlations=None):
    ev = spark.createDataFrame([(0, s, rank, rn, T0 + HOUR * t, k, d, p, seq) for s, rank, rn, t, k, d, p, seq in rows], S.EVENTS)
    sizing = spark.createDataFrame([(0, slots, reject, threshold)], "combo_id int, max_positions int, reject boolean, threshold double")
    return S.simulate(ev, sizing, correlations)


def test_sizes_cash_and_shorts(spark):
    rec = run(spark, [("A", 0, 0, 0, "buy", "long", 10.0, 0), ("B", 1, 0, 1, "buy", "short", 20.0, 0), ("A", 0, 4, 4, "sell", "long", 11.0, 1), ("B", 1, 5, 5, "sell", "short", 10.0, 1)])
    trades = {r.symbol: r for r in rec.where("record = 'trade'").collect()}
    assert trades["A"].trade_size == 0.5 and trades["A"].profit == pytest.approx(0.1) and trades["A"].duration_bars == 4
    assert trades["B"].trade_size == 0.5 and trades["B"].profit == pytest.approx(0.5)
    cash = [(r.cash, r.open_positions) for r in rec.where("record = 'cash'").orderBy("seq").collect()]
    assert cash == [(0.5, 1), (0.0, 2), (pytest.approx(0.55), 1), (pytest.approx(1.3), 0)]


def test_a_round_trip_on_one_bar_stays_open_until_the_next_sell(spark):
    rec = run(spark, [("A", 0, 2, 2, "buy", "long", 10.0, 0), ("A", 0, 2, 2, "sell", "long", 11.0, 1), ("A", 0, 5, 5, "buy", "short", 12.0, 2), ("A", 0, 7, 7, "sell", "short", 15.0, 3)])
    trade = rec.where("record = 'trade'").collect()
    assert len(trade) == 1 and trade[0].direction == "long" and trade[0].exit_price == 15.0 and trade[0].profit == pytest.approx(0.5)
    left = run(spark, [("A", 0, 2, 2, "buy", "long", 10.0, 0), ("A", 0, 2, 2, "sell", "long", 11.0, 1)]).where("record = 'open'").collect()
    assert [(r.symbol, r.trade_size) for r in left] == [("A", 0.5)]


def test_rank_decides_the_last_slot(spark):
    rec = run(spark, [("Z", 0, 0, 0, "buy", "long", 1.0, 0), ("A", 1, 0, 0, "buy", "long", 1.0, 0)], slots=1)
    assert [r.symbol for r in rec.where("record = 'open'").collect()] == ["Z"]


def bars(spark, series):
    return spark.createDataFrame([(s, T0 + HOUR * i, float(c)) for s, v in series.items() for i, c in enumerate(v)], "symbol string, ts timestamp_ntz, close double")


def test_correlation_gate(spark):
    rng = np.random.default_rng(0)
    a = 100 * np.cumprod(1 + 0.01 * rng.normal(size=30))
    other = 100 * np.cumprod(1 + 0.01 * rng.normal(size=30))
    b = bars(spark, {"A": a, "B": 2 * a, "C": 1e4 / a, "D": other})
    rows = [("A", 0, 20, 20, "buy", "long", 1.0, 0), ("B", 1, 21, 21, "buy", "long", 1.0, 0), ("C", 2, 22, 22, "buy", "long", 1.0, 0), ("D", 3, 23, 23, "buy", "long", 1.0, 0)]
    ev = spark.createDataFrame([(0, s, k, rn, T0 + HOUR * t, x, d, p, q) for s, k, rn, t, x, d, p, q in rows], S.EVENTS)
    found = S.held_correlations(ev, b, 10)
    maps = {r.symbol: r.correlations for r in found.collect()}
    ret = np.array([x[1:] / x[:-1] - 1 for x in (a, other)])
    assert maps["B"]["A"] == pytest.approx(1.0) and maps["C"]["A"] < -0.9
    assert maps["D"]["A"] == pytest.approx(np.corrcoef(ret[0][13:23], ret[1][13:23])[0, 1])
    rec = run(spark, rows, slots=4, reject=True, threshold=0.95, correlations=found)
    assert sorted(r.symbol for r in rec.where("record = 'open'").collect()) == ["A", "C", "D"]


def test_curves(spark):
    b = bars(spark, {"A": [10, 11, 12, 13, 14, 15]})
    rec = run(spark, [("A", 0, 1, 1, "buy", "long", 11.0, 0), ("A", 0, 4, 4, "sell", "long", 14.0, 1)], slots=2)
    curve = M.equity_curve(rec, b, spark.createDataFrame([(0,)], "combo_id int")).orderBy("ts").collect()
    assert [r.cash for r in curve] == pytest.approx([1, 0.5, 0.5, 0.5, 0.5 + 7 / 11, 0.5 + 7 / 11])
    assert [r.equity for r in curve] == pytest.approx([1, 1, 0.5 + 6 / 11, 0.5 + 6.5 / 11, 0.5 + 7 / 11, 0.5 + 7 / 11])
    late = M.equity_curve(rec, b, spark.createDataFrame([(0,)], "combo_id int"), warmup=2).orderBy("ts").collect()
    assert late[0].equity == 1.0 and late[0].cash == pytest.approx(0.5 / (0.5 + 6 / 11)) and len(late) == 4


def curve(spark, values, step=dt.timedelta(days=1)):
    return spark.createDataFrame([(0, T0 + step * i, float(v), float(v)) for i, v in enumerate(values)], "combo_id int, ts timestamp_ntz, cash double, equity double")


def test_risk_and_outcomes(spark):
    v = 1.001 ** np.arange(400)
    v[200:] *= 0.99
    c = M.periods(curve(spark, v), None)
    got = M.risk(c, ["combo_id", "period"], 0.04).collect()[0]
    years = 399 / 365.25
    assert got.annualized_return == pytest.approx(v[-1] ** (1 / years) - 1)
    assert got.volatility == pytest.approx(np.std(v[1:] / v[:-1] - 1, ddof=1) * np.sqrt(400 / years))
    days = M.outcomes(c, "day", ["combo_id", "period"]).collect()[0]
    assert (days.days_won, days.days_lost, days.days_flat) == (398, 1, 0)
    with pytest.raises(Exception, match="zero or below"):
        M.risk(M.periods(curve(spark, [1, 0.5, -0.1]), None), ["combo_id", "period"], 0.04).collect()
    short = M.risk(M.periods(curve(spark, [1, 1.1, 1.2]), "2024-01-03"), ["combo_id", "period"], 0.04)
    assert {r.period for r in short.collect()} == {"overall", "train"}


def test_trade_statistics(spark):
    rows = [(0, 0.5, 0.5, 3), (0, -0.1, 0.5, 5), (0, 0.0, 0.5, 4)]
    t = spark.createDataFrame(rows, "combo_id int, profit double, trade_size double, duration_bars int")
    c = spark.createDataFrame([(0, 1), (0, 3)], "combo_id int, open_positions int")
    r = M.trade_statistics(t, c, ["combo_id"]).collect()[0]
    assert (r.trade_count, r.trades_won, r.trades_lost, r.most_positions) == (3, 1, 2, 3)
    assert r.average_profit == pytest.approx((1.5 * 0.9 * 1.0) ** (1 / 3) - 1) and r.average_duration_bars == 4
    none = M.trade_statistics(t.limit(0), c, ["combo_id"]).collect()[0]
    assert none.trade_count == 0 and none.average_win is None


def test_bootstrap():
    up = M.bootstrap_paths(np.full(50, 0.01), 100, 30, 10)
    assert np.allclose(up, 1.01**30)
    x = np.random.default_rng(1).normal(0, 0.01, 200)
    assert (M.bootstrap_paths(x, 50, 25, 10) == M.bootstrap_paths(x, 50, 25, 10)).all()
    assert np.allclose(M.bootstrap_paths(np.array([0.5]), 5, 3, 10), 1.5**3)
    assert M.bootstrap_paths(np.zeros(0), 3, 5, 10).tolist() == [1.0] * 3
    # Ruin and worse: zero stays zero, and signs multiply.
    assert M.bootstrap_paths(np.array([-1.0, -1.0]), 4, 5, 2).tolist() == [0.0] * 4
    assert np.allclose(M.bootstrap_paths(np.full(9, -1.5), 4, 5, 2), (-0.5) ** 5)
    # Each path is a product of runs of consecutive returns.
    y = np.array([0.1, 0.2, 0.4])
    runs = {round(a * b, 9) for a in (1.1 * 1.2, 1.2 * 1.4) for b in (1.1, 1.2, 1.4)}
    assert {round(g, 9) for g in M.bootstrap_paths(y, 500, 3, 2)} == runs
    own = M.bootstrap_paths(x, 50, 25, 10, rng=np.random.default_rng(3))
    assert (own == M.bootstrap_paths(x, 50, 25, 10, seed=3)).all() and (own != M.bootstrap_paths(x, 50, 25, 10)).any()


def test_as_of_keeps_known_nulls(spark):
    rows = spark.createDataFrame([("A", T0, 1.0), ("A", T0 + 2 * HOUR, None)], "symbol string, ts timestamp_ntz, v double")
    times = spark.createDataFrame([("A", T0 + HOUR * i) for i in range(-1, 4)], "symbol string, ts timestamp_ntz")
    assert [r.v for r in M.as_of(times, rows, "v", ["symbol"]).orderBy("ts").collect()] == [None, 1.0, 1.0, None, None]
