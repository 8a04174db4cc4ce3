"""Bars from a stream of priced events, for live use; batch results come from sources.bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, symbol: str, ts: str, price: Column, order: list[str], length: str = "1 hour", late: str = "10 minutes", volume: Column | None = None) -> DataFrame:
    """OHLCV per symbol and window; a bar is final once the watermark has passed its end."""
    key = F.struct(*order)
    rows = events.withWatermark(ts, late).select(F.col(symbol).alias("symbol"), F.col(ts), key.alias("k"), price.alias("p"), (volume if volume is not None else F.lit(1.0)).alias("v"))
    found = rows.groupBy(F.window(ts, length), "symbol").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").alias("volume")
    )
    return found.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
