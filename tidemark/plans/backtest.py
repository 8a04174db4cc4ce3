"""A backtest, or a grid of them, as one plan over the bars of all symbols."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.candles import with_candlestick
from tidemark.functions.indicators import with_rsi, with_stochastic
from tidemark.operators import metrics as M
from tidemark.operators import simulate as S
from tidemark.operators.rules import with_buy, with_sell
from tidemark.operators.signals import with_crossovers, with_divergence, with_levels
from tidemark.plans.config import Config, GridPoint
from tidemark.sources.bars import numbered
from tidemark.sources.scratch import cut


def indicators(bars: DataFrame, config: Config) -> DataFrame:
    """Adds rsi, stoch_k, stoch_d and a candlestick flag for each direction."""
    i = config.indicators
    out = with_stochastic(with_rsi(bars, i.rsi_length), i.stochastic_fastk_period, i.stochastic_slowk_period, i.stochastic_slowd_period)
    return reduce(with_candlestick, sorted(config.directions), out)


def signals(bars: DataFrame, config: Config) -> DataFrame:
    """Adds a divergence and a crossover flag for each direction."""
    e, c = config.extrema, config.stochastic_crossover
    bars = with_crossovers(bars, sorted(config.directions), c.extreme_threshold, c.cross_level.flexible, c.cross_level.value, c.expiration_bars)
    for d in sorted(config.directions):
        bars = with_divergence(bars, d, (e.divergence_first.before, e.divergence_first.after), (e.divergence_second.before, e.divergence_second.after), config.divergence.expiration_bars)
    return bars


def strategy(bars: DataFrame, config: Config) -> DataFrame:
    """Adds buy and sell signals and sell prices. Levels are only worked out for bars that read them."""
    s = config.strategy
    groups = [[r.model_dump() for r in g] for g in s.sell_rule_groups]
    ways = sorted(config.directions)
    for d in ways:
        bars = with_buy(bars, d, s.buy_signal_order, s.buy_signal_expiration_bars)
    if any(r["kind"] == "support_resistance" for g in groups for r in g):
        w = config.extrema.support_resistance
        bars = with_levels(bars, w.before, w.after, at=reduce(lambda a, b: a | b, [F.col(f"buy_signal_{d}") for d in ways]))
    for d in ways:
        bars = with_sell(bars, d, groups)
    return bars


@dataclass
class Backtest:
    """Tables of one or more combinations, told apart by combo_id."""

    records: DataFrame
    curve: DataFrame
    report: DataFrame


def _sizing(spark, points: list[GridPoint]) -> DataFrame:
    rows = [(n, p.config.position_sizing.max_positions, p.config.position_sizing.reject_correlated_entries, p.config.position_sizing.correlation_reject_threshold) for n, p in enumerate(points)]
    return F.broadcast(spark.createDataFrame(rows, "combo_id int, max_positions int, reject boolean, threshold double"))


def all_events(bars: DataFrame, ranks: DataFrame, points: list[GridPoint]) -> DataFrame:
    """Events of every combination. Shared stages are one plan each: indicators and signals once for
    each setting of theirs, strategies once for each of those; combinations that only differ in
    sizing or risk read the same events."""
    made: dict[str, DataFrame] = {}

    def once(key: tuple, build) -> DataFrame:
        text = repr(key)
        if text not in made:
            made[text] = cut(build())
        return made[text]

    parts: dict[str, tuple[DataFrame, list[int], tuple[str, ...]]] = {}
    for n, p in enumerate(points):
        c = p.config
        ways = tuple(sorted(c.directions))
        i_key = (c.indicators, ways)
        s_key = (*i_key, c.extrema, c.divergence, c.stochastic_crossover)
        found = once(s_key, lambda c=c, k=i_key: signals(once(k, lambda: indicators(numbered(bars), c)), c))
        key = repr((*s_key, c.strategy))
        if key not in parts:
            parts[key] = (strategy(found, c), [], ways)
        parts[key][1].append(n)
    out = []
    for ready, combos, ways in parts.values():
        flagged = ready.join(F.broadcast(ranks), "symbol").withColumn("combo_id", F.lit(combos[0]))
        events = S.ticker_events(flagged, ways).drop("combo_id")
        out.append(events.withColumn("combo_id", F.explode(F.array(*map(F.lit, combos)))))
    return reduce(DataFrame.unionByName, out)


def _settings(spark, points: list[GridPoint], split: str | None) -> DataFrame:
    """A row for each point: what its report is made with, and the id of the benchmark rows beside it.

    Points of equal risk settings and split date share one benchmark: -1 less the first one's number.
    """
    rows, first = [], {}
    for n, p in enumerate(points):
        r, at = p.config.risk, split or str(p.config.universe.train_test_split_date)
        own = (r.risk_free_rate, at, r.simulate_profit_odds, r.calculate_spy_correlation, r.monte_carlo_paths, r.holding_period_hours, r.monte_carlo_block_size)
        rows.append((n, -1 - first.setdefault(own, n), r.portfolio_warmup_bars, *own))
    return spark.createDataFrame(rows, "combo_id int, benchmark_id int, warmup int, risk_free double, split string, simulate boolean, correlate boolean, paths int, horizon int, block int")


def run(bars: DataFrame, ranks: DataFrame, points: list[GridPoint], benchmark: DataFrame | None = None, split: str | None = None) -> Backtest:
    """Simulate all points over bars(symbol, ts, open, high, low, close, volume).

    ``ranks`` has symbol and universe_rank, which decides ties; ``benchmark`` has ts and close;
    ``split`` goes before the points' own dates. The report has a row for each combination, series
    (model, benchmark) and period, made with the point's own risk settings, warm-up and split date;
    ``benchmark_id`` names the combo_id of the benchmark rows that go with a row.
    """
    spark = bars.sparkSession
    bars = cut(bars)
    events = cut(all_events(bars, ranks, points))
    lookback = {p.config.position_sizing.correlation_lookback_bars for p in points if p.config.position_sizing.reject_correlated_entries}
    correlations = None
    for n in sorted(lookback):
        own = [k for k, p in enumerate(points) if p.config.position_sizing.correlation_lookback_bars == n and p.config.position_sizing.reject_correlated_entries]
        part = S.held_correlations(events.where(F.col("combo_id").isin(own)), bars, n)
        correlations = part if correlations is None else correlations.unionByName(part)
    records = S.simulate(events, _sizing(spark, points), correlations)
    records = cut(records)
    settings = _settings(spark, points, split)
    curve = cut(M.equity_curve(records, bars, settings.select("combo_id", "warmup")))
    return Backtest(records, curve, report(records, curve, benchmark, settings))


def report(records: DataFrame, curve: DataFrame, benchmark: DataFrame | None, settings: DataFrame) -> DataFrame:
    """One row for each combination, series and period; ``settings`` has what each is made with."""
    keys = ["combo_id", "period"]

    def figures(rows: DataFrame) -> DataFrame:
        return M.risk(rows, keys, "risk_free").join(M.outcomes(rows, M.UNITS, keys), keys, "left")

    settings = F.broadcast(settings)
    model = cut(M.periods(curve.join(settings, "combo_id"), F.col("split")))
    stats = cut(figures(model))
    begun = curve.groupBy("combo_id").agg(F.min("ts").alias("_start"))
    inside = lambda rows, at: rows.join(F.broadcast(begun), "combo_id").where(F.col(at) >= F.col("_start")).drop("_start").join(F.broadcast(stats.select(*keys, "start", "end")), "combo_id").where(F.col(at).between(F.col("start"), F.col("end")))
    trades = inside(records.where("record = 'trade'"), "entry_ts")
    cash = inside(records.where("record = 'cash'"), "ts")
    stats = stats.join(M.trade_statistics(trades, cash, keys), keys, "left").join(M.average_invested(model, keys), keys, "left")
    stats = stats.join(settings.select("combo_id", "benchmark_id"), "combo_id")
    rate = F.lit(None).cast("double")
    paths = model
    if benchmark is not None:
        # A grid has few settings, each of which gets the benchmark's curve once.
        own = settings.groupBy("benchmark_id").agg(*[F.first(c).alias(c) for c in ("risk_free", "split", "simulate", "correlate", "paths", "horizon", "block")])
        kinds = [tuple(r) for r in own.collect()]
        each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(own.columns, k, strict=True)]) for k in kinds])
        held = M.buy_and_hold(benchmark).withColumn("_s", F.explode(each)).select("*", "_s.*").drop("_s").withColumnRenamed("benchmark_id", "combo_id")
        held = cut(M.periods(held, F.col("split")))
        base = cut(figures(held))
        rates = base.select(F.col("combo_id").alias("benchmark_id"), "period", F.col("annualized_return").alias("benchmark_return"))
        bench_keys = ["benchmark_id", "period"]
        both = M.correlation_with(model.where("correlate"), held.select(F.col("combo_id").alias("benchmark_id"), "period", "ts", "equity"), keys, bench_keys)
        stats = stats.join(both, keys, "left").join(F.broadcast(rates), bench_keys, "left")
        stats = stats.unionByName(base.withColumns({"benchmark_return": rate, "benchmark_id": F.col("combo_id")}), allowMissingColumns=True)
        paths = model.unionByName(held, allowMissingColumns=True)
    else:
        stats = stats.withColumn("benchmark_return", rate)
    stats = cut(stats)
    known = stats.where("volatility is not null").select(*keys, "bars_per_year", "benchmark_return")
    paths = paths.where("simulate").select(*keys, "ts", "equity", "risk_free", "paths", "horizon", "block").join(F.broadcast(known), keys)
    series = F.when(F.col("combo_id") < 0, "benchmark").otherwise("model")
    return stats.join(M.profit_odds(paths, keys), keys, "left").withColumn("series", series)


def grid_rank(report: DataFrame) -> DataFrame:
    """Combinations by Sharpe ratio in training, unknown ones last, ties by number."""
    from pyspark.sql import Window

    train = report.where("series = 'model' and period = 'train'").select("combo_id", F.col("sharpe_ratio").alias("train_sharpe"))
    test = report.where("series = 'model' and period = 'test'").select("combo_id", F.col("sharpe_ratio").alias("test_sharpe"))
    every = report.where("series = 'model'").select("combo_id").distinct()
    both = every.join(train, "combo_id", "left").join(test, "combo_id", "left")
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("train_sharpe"), "combo_id")))


def sharpe_correlation(ranked: DataFrame) -> DataFrame:
    """Pearson correlation of train and test Sharpe ratios; null under two pairs or without variance."""
    x, y = F.col("train_sharpe"), F.col("test_sharpe")
    known = ranked.where(x.isNotNull() & y.isNotNull())
    c = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return known.agg(F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) >= 2, c).alias("correlation"))
