"""From signals to trades: position states per symbol, then a portfolio per combination."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import change
from tidemark.operators.metrics import calendar, spread

EVENTS = "combo_id int, symbol string, universe_rank int, rn int, ts timestamp_ntz, kind string, direction string, price double, seq int"
RECORDS = (
    "record string, combo_id int, seq int, symbol string, direction string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, "
    "entry_price double, exit_price double, trade_size double, profit double, duration_bars int, ts timestamp_ntz, cash double, open_positions int"
)


def ticker_events(signals: DataFrame, directions: Sequence[str]) -> DataFrame:
    """Buy and sell events of each combination and symbol, with at most one open position.

    ``signals`` has combo_id, symbol, universe_rank, rn, ts, close and, for each direction,
    buy_signal, sell_signal and sell_price. On a bar the first of these that applies is done: enter
    long (closing a short at the close), leave long, enter short (closing a long), leave short. An
    entry whose sell signal is on the same bar is closed at once. What is open at a symbol's last
    bar is closed there. Only bars with a flag, and the last one, reach the fold.
    """
    flags = [F.col(f"{k}_signal_{d}") for d in directions for k in ("buy", "sell")]
    w = Window.partitionBy("combo_id", "symbol")
    rows = signals.withColumn("_last", F.col("ts") == F.max("ts").over(w))
    some = flags[0]
    for f in flags[1:]:
        some = some | f
    columns = [c for d in directions for c in (f"buy_signal_{d}", f"sell_signal_{d}", f"sell_price_{d}")]
    rows = rows.where(some | F.col("_last")).select("combo_id", "symbol", "universe_rank", "rn", "ts", "close", *columns)
    ways = [d for d in ("long", "short") if d in directions]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rn")
        out, state = [], None

        def emit(row, kind: str, direction: str, price: float) -> None:
            out.append((row.combo_id, row.symbol, row.universe_rank, row.rn, row.ts, kind, direction, price, len(out)))

        row = None
        for row in group.itertuples(index=False):
            for d in ways:
                if getattr(row, f"buy_signal_{d}") and state != d:
                    if state is not None:
                        emit(row, "sell", state, row.close)
                    emit(row, "buy", d, row.close)
                    state = d
                    if getattr(row, f"sell_signal_{d}"):
                        emit(row, "sell", d, getattr(row, f"sell_price_{d}"))
                        state = None
                    break
                if state == d and getattr(row, f"sell_signal_{d}"):
                    emit(row, "sell", d, getattr(row, f"sell_price_{d}"))
                    state = None
                    break
        if state is not None:
            emit(row, "sell", state, row.close)
        return pd.DataFrame(out, columns=["combo_id", "symbol", "universe_rank", "rn", "ts", "kind", "direction", "price", "seq"])

    return rows.groupBy("combo_id", "symbol").applyInPandas(fold, EVENTS)


def held_correlations(events: DataFrame, bars: DataFrame, lookback: int) -> DataFrame:
    """For each buy event a map from symbols that may be held then to their correlation with it.

    A symbol may be held from a buy to its next sell on a later bar (a sell on the same bar comes
    before the buy). Correlation is Pearson's over the last ``lookback`` rows of the calendar of all
    symbols, up to the event's own; rows where either return is unknown are left out, and a pair
    with fewer than two rows or no variance has none. Only pairs that meet are computed, each from
    two gathered rows of returns.
    """
    numbered = calendar(bars)
    returns = bars.withColumn("ret", change(F.col("close"))).join(numbered, "ts").select("symbol", "at", "ret")
    buys = events.where("kind = 'buy'")
    # A buy whose every sell is on its own bar, or earlier, stays open.
    times = events.groupBy("combo_id", "symbol", "ts").agg(F.max(F.when(F.col("kind") == "sell", F.col("ts"))).alias("sold"), F.max(F.col("kind") == "buy").alias("bought"))
    after = Window.partitionBy("combo_id", "symbol").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    spans = times.withColumn("until", F.first("sold", ignorenulls=True).over(after)).where("bought")
    open_ = spread(spans.select("combo_id", F.col("symbol").alias("other"), F.col("ts").alias("bought"), F.col("until")), numbered, "bought", "until")
    met = buys.select("combo_id", "symbol", "ts").join(open_.select("combo_id", "other", "ts"), ["combo_id", "ts"]).where("symbol <> other").distinct()
    pairs = met.select("symbol", "other", "ts").distinct().join(numbered, "ts")
    # A symbol's returns are gathered once for each time that asks for them, whatever pairs it is in.
    asked = pairs.select(F.explode(F.array("symbol", "other")).alias("symbol"), "at").distinct()
    rows = returns.where("ret is not null").withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)), allowMissingColumns=True)
    span = Window.partitionBy("symbol").orderBy("at").rangeBetween(-(lookback - 1), 0)
    recent = rows.withColumn("known", F.collect_list(F.when(~F.col("ask"), F.struct("at", "ret"))).over(span)).where("ask").select("symbol", "at", F.map_from_entries("known").alias("known"))
    x = recent.select("symbol", "at", F.col("known").alias("x"))
    y = recent.select(F.col("symbol").alias("other"), "at", F.col("known").alias("y"))
    both = pairs.join(x, ["symbol", "at"]).join(y, ["other", "at"])
    shared = F.filter(F.map_keys("x"), lambda k: F.map_contains_key("y", k))
    both = both.select("symbol", "other", "ts", F.transform(shared, lambda k: F.element_at("x", k)).alias("x"), F.transform(shared, lambda k: F.element_at("y", k)).alias("y"))
    values = both.select("symbol", "other", "ts", pearson("x", "y").alias("c")).where("c is not null")
    found = met.join(values, ["symbol", "other", "ts"]).groupBy("combo_id", "symbol", "ts")
    return found.agg(F.map_from_entries(F.collect_list(F.struct("other", "c"))).alias("correlations"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two array columns of equal length; null under two values or without variance."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "xx", "yy", "xy")])

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        dx, dy = v["p"] - a["mx"], v["q"] - a["my"]
        mx, my = a["mx"] + dx / n, a["my"] + dy / n
        return F.struct(
            n.alias("n"), mx.alias("mx"), my.alias("my"), (a["xx"] + dx * (v["p"] - mx)).alias("xx"), (a["yy"] + dy * (v["q"] - my)).alias("yy"), (a["xy"] + dx * (v["q"] - my)).alias("xy")
        )

    both = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.aggregate(both, zero, step, lambda a: F.when(a["n"] >= 2, F.try_divide(a["xy"], F.sqrt(a["xx"]) * F.sqrt(a["yy"]))))


def simulate(events: DataFrame, sizing: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """Run each combination's events through a portfolio; see RECORDS for what comes out.

    ``sizing`` has combo_id, max_positions, reject, threshold. Events go by time, sells before buys,
    then by universe_rank and order of emission. A buy is refused if the symbol is held, all slots
    are taken, or its correlation with any held symbol reaches the threshold; it takes an even share
    of the cash over the free slots. Records: ``trade`` for each closed position, ``open`` for what
    is left, ``cash`` after each executed event. Cash ties all symbols together, so a combination is
    one group, of its sparse events only; combinations run side by side.
    """
    rows = events.join(sizing, "combo_id")
    if correlations is None:
        rows = rows.withColumn("correlations", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(correlations, ["combo_id", "symbol", "ts"], "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_buy=(group["kind"] == "buy").astype(int)).sort_values(["ts", "_buy", "universe_rank", "seq"], kind="stable")
        cash, held, out, seq = 1.0, {}, [], 0

        def record(e) -> None:
            out.append(("cash", e.combo_id, seq, None, None, None, None, None, None, None, None, None, e.ts, cash, len(held)))

        for e in group.itertuples(index=False):
            if e.kind == "buy":
                if e.symbol in held or len(held) >= e.max_positions:
                    continue
                known = dict(e.correlations) if e.correlations is not None else {}
                if e.reject and any(known.get(s, float("-inf")) >= e.threshold for s in held):
                    continue
                size = cash / (e.max_positions - len(held))
                cash -= size
                held[e.symbol] = (e.direction, e.ts, e.price, e.rn, size)
            else:
                if e.symbol not in held:
                    continue
                direction, entry_ts, entry, rn, size = held.pop(e.symbol)
                profit = e.price / entry - 1 if direction == "long" else 1 - e.price / entry
                cash += size * (1 + profit)
                out.append(("trade", e.combo_id, seq, e.symbol, direction, entry_ts, e.ts, entry, e.price, size, profit, e.rn - rn, None, None, None))
            record(e)
            seq += 1
        combo = group["combo_id"].iloc[0]
        for s, (direction, entry_ts, entry, _, size) in held.items():
            out.append(("open", combo, seq, s, direction, entry_ts, None, entry, None, size, None, None, None, None, None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
        for c in ("duration_bars", "open_positions"):
            frame[c] = frame[c].astype("Int32")
        for c in ("exit_price", "entry_price", "trade_size", "profit", "cash"):
            frame[c] = frame[c].astype("Float64")
        for c in ("entry_ts", "exit_ts", "ts"):
            frame[c] = pd.to_datetime(frame[c])
        return frame

    return rows.groupBy("combo_id").applyInPandas(fold, RECORDS)
