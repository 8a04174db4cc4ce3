"""Fetching bars from a vendor in chunks, with retries, into a store."""

from __future__ import annotations

import logging
import os
import random
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from typing import Protocol

import pandas as pd

from tidemark.sources.bars import TIMEFRAMES, clean
from tidemark.sources.store import BarStore

log = logging.getLogger(__name__)


class Downloader(Protocol):
    """Gives long bars (symbol, timestamp, open, high, low, close, volume) of some symbols."""

    def __call__(self, tickers: list[str], start: date, end: date, length: str) -> pd.DataFrame: ...


def credentials(names: tuple[str, str] = ("ALPACA_API_KEY", "ALPACA_SECRET_KEY")) -> tuple[str, str]:
    found = [os.environ.get(n) for n in names]
    if not all(found):
        raise RuntimeError(f"set {' and '.join(names)} to download bars")
    return found[0], found[1]


def vendor_unit(length: str) -> tuple[int, str]:
    """(amount, unit) of a bar length in a vendor's terms: a quarter is three months."""
    amount, unit = TIMEFRAMES[length]
    return (3, "month") if unit == "quarter" else (amount, unit)


def chunks(items: list[str], size: int) -> Iterator[list[str]]:
    return (items[i : i + size] for i in range(0, len(items), size))


def _attempts(call: Callable[[], pd.DataFrame], retries: int, backoff: float, sleep: Callable[[float], None]) -> pd.DataFrame | None:
    for attempt in range(1, retries + 1):
        try:
            return call()
        except Exception as e:  # any vendor error is worth another try
            log.warning("attempt %d of %d failed: %s", attempt, retries, e)
            if attempt < retries:
                sleep(backoff * 2 ** (attempt - 1) + random.uniform(0, backoff / 2))
    return None


def ingest(
    tickers: list[str], start: date, end: date, store: BarStore, download: Downloader, *, chunk_size: int = 50, max_retries: int = 5, retry_backoff_seconds: float = 5.0, sleep: Callable[[float], None] = time.sleep
) -> list[str]:
    """Download chunk after chunk (vendors limit rates) and return the symbols that had bars."""
    done: set[str] = set()
    for part in chunks(tickers, chunk_size):
        found = _attempts(lambda part=part: download(part, start, end, store.length), max_retries, retry_backoff_seconds, sleep)
        if found is None or found.empty:
            continue
        long = found.reset_index() if not {"symbol", "timestamp"} & set(found.columns) else found
        bars = clean(store.spark.createDataFrame(long)).where("symbol is not null")
        store.write(bars)
        done.update(r[0] for r in bars.select("symbol").distinct().collect())
    return [t for t in tickers if t in done]


def wide(bars, value: str, symbols: Iterable[str]):
    """One row per time with a column for each symbol: what a vendor's wide batch looks like."""
    from pyspark.sql import functions as F

    return bars.groupBy("ts").pivot("symbol", list(symbols)).agg(F.first(value))
