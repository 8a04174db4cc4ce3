"""The symbols to trade, in their source's order."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The public listing of companies by market value.
LISTING = "https://www.sec.gov/files/company_tickers.json"


def fetch(url: str = LISTING, agent: str = "tidemark research@example.com") -> dict:
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=60) as r:
        return json.load(r)


def ranked(listing: DataFrame) -> DataFrame:
    """symbol, rank: class separators as dots, first place of each symbol, no gaps; from (pos, ticker)."""
    named = listing.select(F.replace(F.col("ticker"), F.lit("-"), F.lit(".")).alias("symbol"), "pos")
    first = named.groupBy("symbol").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.orderBy("pos"))).select("symbol", "rank")


def resolve(spark: SparkSession, number: int, source: Callable[[], dict] = fetch) -> list[str]:
    """The first ``number`` symbols of a listing {"0": {"ticker": ...}, ...}."""
    rows = [(i, entry["ticker"]) for i, entry in enumerate(source().values())]
    top = ranked(spark.createDataFrame(rows, "pos int, ticker string")).where(F.col("rank") <= number)
    return [r.symbol for r in top.orderBy("rank").collect()]
