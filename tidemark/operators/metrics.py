"""Curves, outcomes and risk figures of simulated combinations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut

#: The seed of every bootstrap, so that combinations are comparable.
SEED = 42
_DAY_MICROS = 86_400_000_000


def calendar(bars: DataFrame) -> DataFrame:
    """All times of all symbols, numbered from 0."""
    return bars.select("ts").distinct().withColumn("at", F.row_number().over(Window.orderBy("ts")) - 1)


def as_of(times: DataFrame, rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The latest row's value at or before each time of a key; a known null isn't passed over.

    ``times`` has the keys and ts; ``rows`` the keys, ts and the value, one row per key and time.
    A union and one window: no join on inequality.
    """
    seen = rows.select(*keys, "ts", F.struct(F.col(value).alias("v")).alias("_v"), F.lit(False).alias("_ask"))
    asked = times.select(*keys, "ts", F.lit(None).cast(seen.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_ask"))
    w = Window.partitionBy(*keys).orderBy("ts", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    filled = seen.unionByName(asked).withColumn("_x", F.last("_v", ignorenulls=True).over(w))
    return filled.where("_ask").select(*keys, "ts", F.col("_x.v").alias(value))


def cash_curve(records: DataFrame, cal: DataFrame, combos: DataFrame) -> DataFrame:
    """combo_id, ts, cash: the last cash known at each time, 1.0 before the first event."""
    cash = records.where("record = 'cash'").groupBy("combo_id", "ts").agg(F.max_by("cash", "seq").alias("cash"))
    # Combinations are as many as the grid has points, so their side is the one to copy.
    times = cal.select("ts").join(F.broadcast(combos.select("combo_id").distinct()))
    return as_of(times, cash, "cash", ["combo_id"]).withColumn("cash", F.coalesce("cash", F.lit(1.0)))


def spread(rows: DataFrame, cal: DataFrame, begin: str, end: str) -> DataFrame:
    """Each row once for every calendar time from ``begin`` up to, not at, ``end`` (null: for good).

    Both ends are calendar times, so they become numbers by equality and the range is written out:
    nothing is joined on inequality.
    """
    after = F.broadcast(cal.agg((F.max("at") + 1).alias("_after")))
    first = cal.select(F.col("ts").alias(begin), F.col("at").alias("_first"))
    last = cal.select(F.col("ts").alias(end), F.col("at").alias("_last"))
    out = rows.join(first, begin).join(last, end, "left").join(after).withColumn("_stop", F.coalesce("_last", "_after"))
    out = out.where("_first < _stop").withColumn("at", F.explode(F.sequence(F.col("_first"), F.col("_stop") - 1)))
    return out.drop("_first", "_last", "_after", "_stop").join(cal, "at")


def position_values(records: DataFrame, bars: DataFrame, cal: DataFrame) -> DataFrame:
    """combo_id, ts, value: positions marked to the latest close from entry up to, not at, exit."""
    w = Window.partitionBy("combo_id", "symbol", "seq", "record").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = records.where("record in ('trade', 'open')").select("combo_id", "symbol", "seq", "record", "direction", "entry_ts", "exit_ts", "entry_price", "trade_size")
    days = spread(held, cal, "entry_ts", "exit_ts")
    priced = days.join(bars.select("symbol", "ts", F.struct("close").alias("_c")), ["symbol", "ts"], "left").withColumn("px", F.last("_c", ignorenulls=True).over(w)["close"])
    ratio = F.col("px") / F.col("entry_price")
    value = F.col("trade_size") * F.when(F.col("direction") == "long", ratio).otherwise(2 - ratio)
    return priced.groupBy("combo_id", "ts").agg(F.sum(value).alias("value"))


def equity_curve(records: DataFrame, bars: DataFrame, combos: DataFrame, warmup: int = 0) -> DataFrame:
    """combo_id, at, ts, cash, equity from the warm-up on, both scaled to an equity of 1.0 at its end.

    ``combos`` has combo_id and may have a ``warmup`` of its own for each."""
    cal = cut(calendar(bars))
    combos = combos if "warmup" in combos.columns else combos.withColumn("warmup", F.lit(warmup))
    end = cal.agg(F.max("at").alias("end"))
    start = combos.select("combo_id", "warmup").distinct().join(F.broadcast(end)).select("combo_id", F.least("warmup", "end").alias("start"))
    cash = cash_curve(records, cal, combos)
    curve = cash.join(position_values(records, bars, cal), ["combo_id", "ts"], "left").join(cal, "ts").join(F.broadcast(start), "combo_id").where("at >= start")
    curve = curve.withColumn("equity", F.col("cash") + F.coalesce("value", F.lit(0.0)))
    base = F.first("equity").over(Window.partitionBy("combo_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("_b", base).select("combo_id", "at", "ts", (F.col("cash") / F.col("_b")).alias("cash"), (F.col("equity") / F.col("_b")).alias("equity"))


def periods(curve: DataFrame, split: str | Column | None) -> DataFrame:
    """Each row once for every period it belongs to: overall, train and test (the split, a time or a
    column of times, is in both)."""
    if split is None:
        return curve.withColumn("period", F.lit("overall"))
    at = F.lit(split).cast("timestamp_ntz")
    label = F.array(F.lit("overall"), F.when(F.col("ts") <= at, F.lit("train")), F.when(F.col("ts") >= at, F.lit("test")))
    return curve.withColumn("period", F.explode(F.array_compact(label)))


UNITS = ("day", "week", "month")


def outcomes(curve: DataFrame, units: str | Sequence[str], keys: list[str]) -> DataFrame:
    """<unit>s_won, _lost, _flat: changes of the last equity of each calendar unit that has any; all
    units in one pass."""
    units = (units,) if isinstance(units, str) else tuple(units)
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "ts").alias("begin")) for u in units]))
    last = curve.select(*keys, "ts", "equity", each.alias("u")).groupBy(*keys, "u").agg(F.max_by("equity", "ts").alias("e"))
    step = last.withColumn("d", F.col("e") - F.lag("e").over(Window.partitionBy(*keys, "u.unit").orderBy("u.begin")))
    signs = {"won": F.col("d") > 0, "lost": F.col("d") < 0, "flat": F.col("d") == 0}
    return step.groupBy(*keys).agg(*[F.count_if((F.col("u.unit") == u) & c).cast("long").alias(f"{u}s_{n}") for u in units for n, c in signs.items()])


def elapsed_years(first: Column, last: Column) -> Column:
    """Whole days of 24 hours between two times, in years."""
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return F.floor(micros / _DAY_MICROS) / 365.25


def risk(curve: DataFrame, keys: list[str], risk_free: float | str) -> DataFrame:
    """Return, annualised return and deviation, and Sharpe ratio of each curve.

    ``risk_free`` is a yearly rate, or the name of a column that holds one for each curve.

    A curve whose period is "overall" starts from 1.0 and fails if it ever is 0 or less; any other
    one has nulls where a figure isn't defined, and no row if it has one bar or starts at 0 or less.
    """
    step = curve.withColumn("r", F.try_divide("equity", F.lag("equity").over(Window.partitionBy(*keys).orderBy("ts"))) - 1)
    a = step.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("bars"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"), F.min("equity").alias("least"), F.stddev_samp("r").alias("sd"),
        (F.first(risk_free) if isinstance(risk_free, str) else F.lit(risk_free)).alias("_rate"),
    )
    whole = F.col("period") == "overall" if "period" in keys else F.lit(True)
    broken = whole & (F.col("least") <= 0)
    a = a.withColumn("first", F.when(broken, F.raise_error(F.lit("equity went to zero or below: annual figures are undefined"))).otherwise(F.col("first")))
    a = a.where(whole | ((F.col("bars") >= 2) & (F.col("first") > 0))).withColumn("years", elapsed_years(F.col("start"), F.col("end")))
    some = F.col("years") > 0
    growth = F.when(whole, F.col("last")).otherwise(F.try_divide("last", "first"))
    a = a.withColumns(
        {
            "period_return": F.try_divide("last", "first") - 1,
            "bars_per_year": F.when(some, F.try_divide(F.col("bars"), F.col("years"))),
            "annualized_return": F.when(some & (growth > 0), F.pow(growth, F.try_divide(F.lit(1.0), F.col("years"))) - 1),
        }
    )
    vol = F.col("sd") * F.sqrt("bars_per_year")
    a = a.withColumn("volatility", F.when(some & (vol > 0), vol))
    a = a.withColumn("sharpe_ratio", F.try_divide(F.col("annualized_return") - F.col("_rate"), F.col("volatility")))
    return a.select(*keys, "start", "end", "bars", "period_return", "annualized_return", "volatility", "sharpe_ratio", "bars_per_year")


def average_invested(curve: DataFrame, keys: list[str]) -> DataFrame:
    return curve.groupBy(*keys).agg(F.avg(1 - F.try_divide("cash", "equity")).alias("average_fraction_invested"))


def _geometric(x: Column) -> Column:
    """Geometric mean of 1 + x, less 1; -1 if a factor is 0, null without values or below that."""
    mean = F.exp(F.avg(F.when(x > -1, F.log1p(x)))) - 1
    return F.when(F.min(x) == -1, F.lit(-1.0)).when(F.min(x) > -1, mean)


def trade_statistics(trades: DataFrame, cash: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, geometric means and duration of closed trades, and the most positions at once."""
    p = F.col("profit")
    t = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.count_if(p > 0).alias("trades_won"),
        F.count_if(p <= 0).alias("trades_lost"),
        _geometric(p).alias("average_profit"),
        _geometric(p * F.col("trade_size")).alias("average_profit_weighted"),
        _geometric(F.when(p > 0, p)).alias("average_win"),
        _geometric(F.when(p <= 0, p)).alias("average_loss"),
        F.avg("duration_bars").alias("average_duration_bars"),
    )
    most = cash.groupBy(*keys).agg(F.max("open_positions").alias("most_positions"))
    out = t.join(most, keys, "full")
    for c in ("trade_count", "trades_won", "trades_lost", "most_positions"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out


def correlation_with(curve: DataFrame, benchmark: DataFrame, keys: list[str], benchmark_keys: list[str]) -> DataFrame:
    """benchmark_correlation of bar returns on shared times; null under two rows or without variance."""
    r = curve.withColumn("x", F.try_divide("equity", F.lag("equity").over(Window.partitionBy(*keys).orderBy("ts"))) - 1)
    s = benchmark.withColumn("y", F.try_divide("equity", F.lag("equity").over(Window.partitionBy(*benchmark_keys).orderBy("ts"))) - 1) if benchmark_keys else benchmark.withColumn(
        "y", F.try_divide("equity", F.lag("equity").over(Window.orderBy("ts"))) - 1
    )
    both = r.join(s.select(*benchmark_keys, "ts", "y"), [*benchmark_keys, "ts"]).where("x is not null and y is not null")
    c = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    return both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, c).alias("benchmark_correlation"))


def bootstrap_paths(returns: np.ndarray, paths: int, horizon: int, block: int, seed: int = SEED, rng: np.random.Generator | None = None) -> np.ndarray:
    """Growth of ``paths`` futures of ``horizon`` bars, drawn in runs of ``block`` past returns.

    The log of a run's growth is a difference of running sums, so all runs of all paths are looked
    up at once. A run that holds a return of -1 or less is multiplied out by magnitude and sign: the
    running sums are of log |1 + r|, beside running counts of zeros and of negative factors.
    """
    rng = np.random.default_rng(seed) if rng is None else rng
    n, width = len(returns), min(block, len(returns))
    if not width or horizon <= 0:
        return np.ones(paths)
    factor = 1.0 + np.asarray(returns, dtype=float)
    magnitude = np.where(factor == 0, 1.0, np.abs(factor))
    logs, zeros, signs = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.log(magnitude), factor == 0, factor < 0))
    whole, rest = divmod(horizon, width)
    starts = rng.integers(0, n - width + 1, size=(paths, whole))
    lasts = rng.integers(0, n - rest + 1, size=paths)

    def drawn(total: np.ndarray) -> np.ndarray:
        return (total[starts + width] - total[starts]).sum(axis=1) + total[lasts + rest] - total[lasts]

    growth = np.exp(drawn(logs)) * np.where(drawn(signs) % 2 == 1, -1.0, 1.0)
    return np.where(drawn(zeros) > 0, 0.0, growth)


def profit_odds(
    curve: DataFrame, keys: list[str], risk_free: float = 0.04, paths: int = 10_000, horizon: int = 2016, block: int = 10, generator: Callable[[], np.random.Generator] | None = None
) -> DataFrame:
    """Chances of a bootstrapped horizon to end above 1, the risk-free rate and the benchmark's rate.

    ``curve`` also has bars_per_year and benchmark_return (null: no such chance). Each curve is a
    group: its returns are as many as the calendar's times, and the groups run side by side.
    ``generator`` gives each of them its source of draws; without it all start from SEED. Columns
    risk_free, paths, horizon or block of ``curve`` go before the arguments of these names.
    """
    schema = ", ".join(f"{k} {t}" for k, t in curve.dtypes if k in keys) + ", profit_odds double, risk_free_odds double, benchmark_odds double"
    ordered = [k for k, _ in curve.dtypes if k in keys]

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        own = {"risk_free": risk_free, "paths": paths, "horizon": horizon, "block": block}
        own |= {k: group[k].iloc[0] for k in own if k in group.columns}
        bars = int(own["horizon"])
        e = group.sort_values("ts")["equity"].to_numpy(dtype=float)
        growth = bootstrap_paths(e[1:] / e[:-1] - 1, int(own["paths"]), bars, int(own["block"]), rng=generator() if generator else None)
        per_year = float(group["bars_per_year"].iloc[0]) if group["bars_per_year"].notna().all() else float("nan")
        over = lambda rate: float((growth > (1 + rate) ** (bars / per_year)).mean())
        rate = group["benchmark_return"].iloc[0]
        row = [group[k].iloc[0] for k in ordered] + [float((growth > 1).mean()), over(float(own["risk_free"])), None if pd.isna(rate) else over(float(rate))]
        return pd.DataFrame([row], columns=[*ordered, "profit_odds", "risk_free_odds", "benchmark_odds"])

    return curve.groupBy(*keys).applyInPandas(draw, schema)


def buy_and_hold(prices: DataFrame) -> DataFrame:
    """ts, equity of holding one series from its first close on."""
    base = F.first("close").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return prices.select("ts", (F.col("close") / base).alias("equity"))
