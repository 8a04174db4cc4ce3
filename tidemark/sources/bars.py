"""Bars from facts: OHLCV by symbol and time unit, and clean-up of stored bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bar lengths and the unit that each is cut by: (amount, date_trunc unit).
TIMEFRAMES = {
    "1m": (1, "minute"),
    "2m": (2, "minute"),
    "5m": (5, "minute"),
    "15m": (15, "minute"),
    "30m": (30, "minute"),
    "1h": (1, "hour"),
    "1d": (1, "day"),
    "1wk": (1, "week"),
    "1mo": (1, "month"),
    "3mo": (3, "quarter"),
}
PRICES = ("open", "high", "low", "close", "volume")


def bar_start(ts: Column, length: str) -> Column:
    """Start of the bar that a time falls into."""
    if length not in TIMEFRAMES:
        raise ValueError(f"unknown bar length {length!r}; one of {', '.join(TIMEFRAMES)}")
    amount, unit = TIMEFRAMES[length]
    if unit == "minute" and amount > 1:
        hour = F.date_trunc("hour", ts)
        minute = (F.floor(F.minute(ts) / amount) * amount).cast("int")
        return (hour + F.make_dt_interval(mins=minute)).cast("timestamp_ntz")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def build_bars(facts: DataFrame, symbol: str, ts: str, price: Column, order: list[str], length: str = "1h", volume: Column | None = None) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: one pass with partial aggregation, then one shuffle."""
    key = F.struct(*order)
    rows = facts.select(F.col(symbol).alias("symbol"), bar_start(F.col(ts), length).alias("bar"), key.alias("k"), price.alias("p"), (volume if volume is not None else F.lit(1.0)).alias("v"))
    return rows.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume")
    )


def walk_bars(spark: SparkSession, sf_dir: str, length: str = "1h") -> DataFrame:
    """Bars of a strictly positive price walk per event type, driven by the events' values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    price = F.round(100 * F.exp(F.sum(0.005 * (F.col("value") / 50.0 - 1)).over(w)), 6)
    walk = events.withColumn("price", price)
    return build_bars(walk, "event_type", "ts", F.col("price"), ["ts", "event_id"], length, F.col("value"))


def numbered(bars: DataFrame) -> DataFrame:
    """Adds rn, the position of a bar within its symbol, from 0."""
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def clean(bars: DataFrame) -> DataFrame:
    """Lower-case columns, NaN as null, times without zone, and no rows without any value."""
    out = bars.toDF(*[c.lower() for c in bars.columns])
    present = [c for c in PRICES if c in out.columns]
    for c in present:
        out = out.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    time = "datetime" if "datetime" in out.columns else "timestamp" if "timestamp" in out.columns else "ts"
    if dict(out.dtypes)[time] == "bigint":
        out = out.withColumn(time, F.timestamp_micros(F.expr(f"`{time}` div 1000")))
    out = out.withColumn(time, F.col(time).cast("timestamp_ntz")).withColumnRenamed(time, "ts")
    return out.na.drop("all", subset=present)
