"""One query for each operator of the engine, on bars walked from the events table.

Times leave as text and figures rounded, so that any SQL engine can be held against them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import candles, indicators
from tidemark.functions.windows import change, flag
from tidemark.operators import metrics as M
from tidemark.operators import rules as R
from tidemark.operators import signals as G
from tidemark.operators import simulate as S
from tidemark.plans.backtest import grid_rank, sharpe_correlation
from tidemark.plans.backtest import run as run_points
from tidemark.plans.config import Config, GridPoint, with_value
from tidemark.sources import universe
from tidemark.sources.bars import build_bars, numbered, walk_bars
from tidemark.sources.scratch import cut

SPLIT = "2024-01-20 00:00:00"
#: The exit rules, sizing and signals that the portfolio queries share.
MARGIN = {"kind": "margin", "take_profit_multiplier": 2.0, "stop_loss_multiplier": 2.0, "volatility_length": 30, "take_profit_triggers_on_high": True}
LEVELS = {"kind": "support_resistance", "resistance_min_distance": 1.0, "support_min_distance": 1.0, "resistance_triggers_on_high": True}
RSI_EXIT = {"kind": "indicator", "indicator": "rsi", "threshold": {"flexible": False, "value": 50.0}}
TIME = {"kind": "time", "max_bars_held": 30}
MAX_POSITIONS, THRESHOLD, LOOKBACK, WARMUP = 3, 0.1, 60, 15

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def r(name: str | Column, digits: int = 6) -> Column:
    return F.round(name, digits)


def bars_of(spark: SparkSession, d: str) -> DataFrame:
    return numbered(walk_bars(spark, d))


def rowed(df: DataFrame, *columns) -> DataFrame:
    """symbol, time and the columns of every bar."""
    return df.select("symbol", text("ts").alias("ts"), *columns)


def oscillators(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.with_stochastic(indicators.with_rsi(bars_of(spark, d), 12))
    return out.withColumns({"stoch_k": r("stoch_k", 8), "stoch_d": r("stoch_d", 8)})


@query
def bars_build(spark, d):
    return rowed(walk_bars(spark, d), r("open").alias("open"), r("high").alias("high"), r("low").alias("low"), r("close").alias("close"), r("volume").alias("volume"))


@query
def bars_daily_orders(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    b = build_bars(orders, "o_orderpriority", "o_orderdate", F.col("o_totalprice"), ["o_orderkey"], "1d")
    return rowed(b, r("open").alias("open"), r("high").alias("high"), r("low").alias("low"), r("close").alias("close"), r("volume").alias("volume"))


@query
def universe_topn(spark, d):
    names = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") - 1).alias("pos"), F.concat(F.lit("T-"), (F.col("c_custkey") % 40).cast("string")).alias("ticker"))
    return universe.ranked(names).where("rank <= 25").select("symbol", F.col("rank").cast("long").alias("rank"))


@query
def store_roundtrip(spark, d):
    from tidemark.sources.scratch import scratch_folder
    from tidemark.sources.store import BarStore

    store = BarStore(spark, scratch_folder(spark, "store"), "1h")
    store.write(walk_bars(spark, d))
    back = store.read()
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), r(F.sum("close"), 6).alias("close_sum"))


@query
def missing_symbols(spark, d):
    held = walk_bars(spark, d).select("symbol").distinct().where("symbol <> 'view'")
    return walk_bars(spark, d).select("symbol").distinct().join(held, "symbol", "left_anti")


@query
def pct_change(spark, d):
    return rowed(bars_of(spark, d), r(change(F.col("close")), 9).alias("ret"))


@query
def rolling_volatility(spark, d):
    return rowed(indicators.with_volatility(bars_of(spark, d), 30), r("volatility", 9).alias("volatility"))


@query
def stochastic(spark, d):
    return rowed(indicators.with_stochastic(bars_of(spark, d)), r("stoch_k").alias("stoch_k"), r("stoch_d").alias("stoch_d"))


@query
def rsi(spark, d):
    return rowed(indicators.with_rsi(bars_of(spark, d), 12), r("rsi").alias("rsi"))


def _candle(name: str) -> Query:
    def run(spark, d):
        return rowed(candles.with_patterns(bars_of(spark, d), [name]), F.col(f"candle_{name}").alias("hit"))

    return run


for _name in ("hammer", "shooting_star", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows"):
    _found[f"candle_{_name}"] = _candle(_name)


@query
def candle_engulfing(spark, d):
    found = candles.with_patterns(bars_of(spark, d), ["engulfing_up", "engulfing_down"])
    return rowed(found, F.when(F.col("candle_engulfing_up"), 100).when(F.col("candle_engulfing_down"), -100).otherwise(0).cast("long").alias("hit"))


def _candlestick(direction: str) -> Query:
    return lambda spark, d: rowed(candles.with_candlestick(bars_of(spark, d), direction), F.col(f"candlestick_{direction}").alias("hit"))


for _way in ("long", "short"):
    _found[f"candlestick_signal_{_way}"] = _candlestick(_way)


@query
def swing_highs(spark, d):
    return rowed(G.with_swing(bars_of(spark, d), "high", 5, 5, True, "swing"), r("swing").alias("swing"))


@query
def swing_lows(spark, d):
    return rowed(G.with_swing(bars_of(spark, d), "low", 5, 1, False, "swing"), r("swing").alias("swing"))


@query
def joint_extrema(spark, d):
    o = indicators.with_rsi(bars_of(spark, d), 12)
    o = G.with_joint_extreme(G.with_joint_extreme(o, 5, 1, True, "highs"), 5, 1, False, "lows")
    return rowed(o, "highs", "lows")


def _divergence(direction: str) -> Query:
    return lambda spark, d: rowed(G.with_divergence(indicators.with_rsi(bars_of(spark, d), 12), direction, (5, 5), (5, 1), 30), F.col(f"divergence_{direction}").alias("hit"))


def _crossover(direction: str) -> Query:
    return lambda spark, d: rowed(G.with_crossover(oscillators(spark, d), direction), F.col(f"stochastic_crossover_{direction}").alias("hit"))


for _way in ("long", "short"):
    _found[f"divergence_{_way}"] = _divergence(_way)
    _found[f"stochastic_crossover_{_way}"] = _crossover(_way)


@query
def sr_levels(spark, d):
    lv = F.col("support_resistance_levels")
    return rowed(
        G.with_levels(bars_of(spark, d), 8, 8),
        F.size(lv).cast("long").alias("n_levels"),
        r(F.aggregate(lv, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_levels"),
        r(R.nearest_above(lv, F.col("close"))).alias("above"),
        r(R.nearest_below(lv, F.col("close"))).alias("below"),
    )


def signalled(spark: SparkSession, d: str, ways=("long",)) -> DataFrame:
    """Bars with the entry signals of the chain queries."""
    o = oscillators(spark, d)
    for w in ways:
        o = G.with_crossover(candles.with_candlestick(o, w), w)
        # Closes beyond the mean of ten stand in for divergences, which are rare on a month of bars.
        mean = F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-9, 0))
        o = o.withColumn(f"divergence_{w}", flag(F.col("close") < mean * 0.99 if w == "long" else F.col("close") > mean * 1.01))
    return o


def _chain(stages, expirations) -> Query:
    return lambda spark, d: rowed(R.with_buy(signalled(spark, d), "long", stages, expirations), F.col("buy_signal_long").alias("hit"))


_found["buy_chain_single"] = _chain([["stochastic_crossover"]], [])
_found["buy_chain_two_stage"] = _chain([["rsi_divergence"], ["stochastic_crossover"]], [8])
_found["buy_chain_tied"] = _chain([["rsi_divergence", "candle sticks"]], [6])
_found["buy_chain_triple"] = _chain([["rsi_divergence"], ["candle sticks"], ["stochastic_crossover"]], [8, 10])


def diverging(spark: SparkSession, d: str) -> DataFrame:
    """Bars with real divergences and the crossovers that may follow them."""
    o = G.with_crossover(oscillators(spark, d), "long")
    return R.with_buy(G.with_divergence(o, "long", (5, 5), (5, 1), 30), "long", [["rsi_divergence"], ["stochastic_crossover"]], [10])


@query
def buy_chain_divergence(spark, d):
    return rowed(diverging(spark, d), F.col("buy_signal_long").alias("hit"))


@query
def divergence_trades(spark, d):
    """Divergence, crossover, exit and trade: the events of the demo strategy's kind."""
    o = R.with_sell(diverging(spark, d), "long", [[RSI_EXIT], [TIME]])
    found = S.ticker_events(o.join(F.broadcast(ranks_of(o)), "symbol").withColumn("combo_id", F.lit(0)), ("long",))
    return found.select("symbol", F.col("rn").cast("long").alias("rn"), "kind", "direction", r("price").alias("price"), F.col("seq").cast("long").alias("seq"))


def bought(spark: SparkSession, d: str, ways=("long", "short")) -> DataFrame:
    o = oscillators(spark, d)
    for w in ways:
        o = R.with_buy(G.with_crossover(o, w), w, [["stochastic_crossover"]], [])
    return o


def _exit(groups, direction: str = "long", levels: bool = False) -> Query:
    def run(spark, d):
        o = bought(spark, d, (direction,))
        if levels:
            o = G.with_levels(o, 8, 8, at=F.col(f"buy_signal_{direction}"))
        o = R.with_sell(o, direction, groups)
        return rowed(o, F.col(f"sell_signal_{direction}").alias("sold"), r(f"sell_price_{direction}").alias("price"))

    return run


_found["sell_indicator"] = _exit([[RSI_EXIT]])
_found["sell_indicator_flexible"] = _exit([[RSI_EXIT | {"threshold": {"flexible": True, "value": 12.0}}]])
_found["sell_margin"] = _exit([[MARGIN]])
_found["sell_margin_short"] = _exit([[MARGIN]], "short")
_found["sell_support_resistance"] = _exit([[LEVELS]], levels=True)
_found["sell_support_resistance_short"] = _exit([[LEVELS]], "short", levels=True)
_found["sell_time"] = _exit([[TIME]])
_found["sell_groups"] = _exit([[RSI_EXIT, MARGIN], [MARGIN, LEVELS], [TIME]], levels=True)


def signals_both(spark: SparkSession, d: str) -> DataFrame:
    o = bought(spark, d)
    for w in ("long", "short"):
        o = R.with_sell(o, w, [[MARGIN], [TIME]])
    return o.join(F.broadcast(ranks_of(o)), "symbol").withColumn("combo_id", F.lit(0))


def events_of(spark: SparkSession, d: str) -> DataFrame:
    return cut(S.ticker_events(signals_both(spark, d), ("long", "short")))


@query
def ticker_events(spark, d):
    return events_of(spark, d).select("symbol", F.col("rn").cast("long").alias("rn"), "kind", "direction", r("price").alias("price"), F.col("seq").cast("long").alias("seq"))


@query
def held_correlations(spark, d):
    found = S.held_correlations(events_of(spark, d), walk_bars(spark, d), LOOKBACK)
    return found.select("symbol", text("ts").alias("ts"), F.explode("correlations").alias("other", "c")).select("symbol", "ts", "other", r("c").alias("c")).distinct()


def simulated(spark: SparkSession, d: str, reject: bool = True) -> DataFrame:
    events = events_of(spark, d)
    sizing = F.broadcast(spark.createDataFrame([(0, MAX_POSITIONS, reject, THRESHOLD)], "combo_id int, max_positions int, reject boolean, threshold double"))
    return cut(S.simulate(events, sizing, S.held_correlations(events, walk_bars(spark, d), LOOKBACK) if reject else None))


def _trades(reject: bool) -> Query:
    def run(spark, d):
        t = simulated(spark, d, reject).where("record = 'trade'")
        return t.select("symbol", "direction", text("entry_ts").alias("entry_ts"), text("exit_ts").alias("exit_ts"), r("entry_price").alias("entry_price"), r("exit_price").alias("exit_price"), r("trade_size").alias("trade_size"), r("profit").alias("profit"), F.col("duration_bars").cast("long").alias("duration_bars"))

    return run


_found["simulate_trades"] = _trades(False)
_found["correlation_gate"] = _trades(True)


def curve_of(spark: SparkSession, d: str) -> DataFrame:
    combos = spark.createDataFrame([(0,)], "combo_id int")
    return cut(M.equity_curve(simulated(spark, d), walk_bars(spark, d), combos, WARMUP))


@query
def cash_curve(spark, d):
    cal = M.calendar(walk_bars(spark, d))
    found = M.cash_curve(simulated(spark, d), cal, spark.createDataFrame([(0,)], "combo_id int"))
    return found.select(text("ts").alias("ts"), r("cash").alias("cash"))


@query
def interval_mark_to_market(spark, d):
    bars = walk_bars(spark, d)
    return M.position_values(simulated(spark, d), bars, M.calendar(bars)).select(text("ts").alias("ts"), r("value").alias("value"))


@query
def equity_curve(spark, d):
    return curve_of(spark, d).select(text("ts").alias("ts"), r("cash").alias("cash"), r("equity").alias("equity"))


@query
def asof_ffill(spark, d):
    bars = walk_bars(spark, d)
    sparse = bars.where(F.hour("ts") % 5 == 0)
    times = bars.select("symbol", "ts")
    return M.as_of(times, sparse, "close", ["symbol"]).select("symbol", text("ts").alias("ts"), r("close").alias("close"))


FIGURES = ("period_return", "annualized_return", "volatility", "sharpe_ratio")


def _risk(found: DataFrame) -> DataFrame:
    return found.select("period", text("start").alias("start"), text("end").alias("end"), "bars", *[r(c, 5).alias(c) for c in FIGURES])


@query
def risk_metrics(spark, d):
    return _risk(M.risk(M.periods(curve_of(spark, d), None), ["combo_id", "period"], 0.04))


@query
def train_test_metrics(spark, d):
    return _risk(M.risk(M.periods(curve_of(spark, d), SPLIT), ["combo_id", "period"], 0.04))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return M.buy_and_hold(walk_bars(spark, d).where("symbol = 'view'"))


@query
def benchmark_report(spark, d):
    return _risk(M.risk(M.periods(held_out(spark, d), SPLIT), ["period"], 0.04))


def _outcomes(unit: str) -> Query:
    def run(spark, d):
        return M.outcomes(M.periods(curve_of(spark, d), SPLIT), unit, ["combo_id", "period"]).drop("combo_id")

    return run


for _unit in ("day", "week", "month"):
    _found[f"outcomes_{_unit}"] = _outcomes(_unit)


@query
def trade_stats(spark, d):
    rec = simulated(spark, d)
    found = M.trade_statistics(rec.where("record = 'trade'"), rec.where("record = 'cash'"), ["combo_id"])
    means = ("average_profit", "average_profit_weighted", "average_win", "average_loss", "average_duration_bars")
    return found.select("trade_count", "trades_won", "trades_lost", *[r(c).alias(c) for c in means], "most_positions")


@query
def avg_invested(spark, d):
    return M.average_invested(M.periods(curve_of(spark, d), SPLIT), ["combo_id", "period"]).select("period", r("average_fraction_invested").alias("average_fraction_invested"))


@query
def benchmark_correlation(spark, d):
    found = M.correlation_with(M.periods(curve_of(spark, d), SPLIT), M.periods(held_out(spark, d), SPLIT), ["combo_id", "period"], ["period"])
    return found.select("period", r("benchmark_correlation").alias("benchmark_correlation"))


@query
def profit_odds(spark, d):
    curve = M.periods(curve_of(spark, d), SPLIT)
    stats = M.risk(curve, ["combo_id", "period"], 0.04).where("volatility is not null").select("combo_id", "period", "bars_per_year", F.lit(0.05).alias("benchmark_return"))
    return M.profit_odds(curve.join(stats, ["combo_id", "period"]), ["combo_id", "period"], 0.04)


@lru_cache(maxsize=1)
def grid_points() -> tuple[GridPoint, ...]:
    base = {
        "risk": {"simulate_profit_odds": False},
        "strategy": {"buy_signal_order": [["stochastic_crossover"]], "buy_signal_expiration_bars": [], "sell_rule_groups": [[{"kind": "margin"}], [{"kind": "time", "max_bars_held": 30}]]},
    }
    axes = [("position_sizing.correlation_reject_threshold", t) for t in (0.0, 0.1, 0.9)]
    return tuple(GridPoint({p: v, "position_sizing.max_positions": n}, Config.model_validate(with_value(with_value(base, p, v), "position_sizing.max_positions", n))) for p, v in axes for n in (2, 4))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    bars = walk_bars(spark, d)
    return grid_rank(run_points(bars, ranks_of(bars), list(grid_points()), split=SPLIT).report)


@query
def grid_rank_query(spark, d):
    return _ranked(spark, d).select("combo_id", r("train_sharpe", 5).alias("train_sharpe"), r("test_sharpe", 5).alias("test_sharpe"), "rank")


@query
def grid_sharpe_correlation(spark, d):
    return sharpe_correlation(_ranked(spark, d)).select("pairs", r("correlation", 5).alias("correlation"))


def risk_points() -> list[GridPoint]:
    """Points that differ in the risk-free rate, the warm-up and the split date only."""
    base = {
        "universe": {"start_date": "2023-01-01", "train_test_split_date": "2024-01-20", "end_date": "2025-01-01"},
        "strategy": {"buy_signal_order": [["stochastic_crossover"]], "buy_signal_expiration_bars": [], "sell_rule_groups": [[{"kind": "margin"}], [{"kind": "time", "max_bars_held": 30}]]},
    }
    out = []
    for rate, warmup, split in ((0.0, 15, "2024-01-20"), (0.5, 15, "2024-01-20"), (0.04, 60, "2024-01-10"), (0.04, 15, "2024-01-10")):
        own = base | {"universe": base["universe"] | {"train_test_split_date": split}, "risk": {"simulate_profit_odds": False, "risk_free_rate": rate, "portfolio_warmup_bars": warmup}}
        out.append(GridPoint({"risk.risk_free_rate": rate, "risk.portfolio_warmup_bars": warmup, "universe.train_test_split_date": split}, Config.model_validate(own)))
    return out


def ranks_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().withColumn("universe_rank", F.row_number().over(Window.orderBy("symbol")))


@query
def grid_risk(spark, d):
    """A grid whose points are reported each with its own rate, warm-up and split."""
    bars = walk_bars(spark, d)
    held = bars.where("symbol = 'view'").select("ts", "close")
    found = run_points(bars, ranks_of(bars), risk_points(), held).report
    return found.select("combo_id", "series", "benchmark_id", "period", text("start").alias("start"), text("end").alias("end"), "bars", *[r(c, 5).alias(c) for c in FIGURES])


@query
def backtest_report(spark, d):
    """The flagship: a whole backtest with benchmark and periods; profit_odds has the bootstrap."""
    bars = walk_bars(spark, d)
    config = Config.model_validate(
        {
            "directions": ["long", "short"],
            "risk": {"simulate_profit_odds": False},
            "strategy": {"buy_signal_order": [["stochastic_crossover"]], "sell_rule_groups": [[{"kind": "margin"}], [{"kind": "support_resistance"}], [{"kind": "time"}]]},
        }
    )
    held = bars.where("symbol = 'view'").select("ts", "close")
    found = run_points(bars, ranks_of(bars), [GridPoint({}, config)], held, SPLIT).report
    counts = [f"{u}s_{w}" for u in ("day", "week", "month") for w in ("won", "lost", "flat")] + ["trade_count", "trades_won", "trades_lost", "most_positions"]
    means = ("average_profit", "average_profit_weighted", "average_win", "average_loss", "average_duration_bars", "average_fraction_invested", "benchmark_correlation")
    figures = [r(c, 5).alias(c) for c in (*FIGURES, "benchmark_return")] + [r(c).alias(c) for c in means]
    return found.select("series", "period", text("start").alias("start"), text("end").alias("end"), "bars", *counts, *figures)


def queries() -> dict[str, Query]:
    return {name.removesuffix("_query"): f for name, f in _found.items()}

