"""Bars from a vendor's public market-data service over HTTP, page by page."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd

from tidemark.sources.ingest import vendor_unit

#: Fixed values of the service: its address, the names of its units, and the feed of free accounts.
ENDPOINT = "https://data.alpaca.markets/v2/stocks/bars"
UNITS = {"minute": "Min", "hour": "Hour", "day": "Day", "week": "Week", "month": "Month"}
FEED, PAGE = "iex", 10_000
FIELDS = {"t": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def over_http(url: str, headers: dict[str, str]) -> dict:
    with urlopen(Request(url, headers=headers), timeout=120) as r:
        return json.load(r)


class VendorBars:
    """A downloader: long bars of some symbols, of all pages that the service has."""

    def __init__(self, key: str, secret: str, fetch: Callable[[str, dict[str, str]], dict] = over_http) -> None:
        self.headers = {"APCA-API-KEY-ID": key, "APCA-API-SECRET-KEY": secret}
        self.fetch = fetch

    def __call__(self, tickers: list[str], start: date, end: date, length: str) -> pd.DataFrame:
        amount, unit = vendor_unit(length)
        asked = {"symbols": ",".join(tickers), "timeframe": f"{amount}{UNITS[unit]}", "start": str(start), "end": str(end), "feed": FEED, "limit": PAGE}
        rows, token = [], None
        while True:
            page = self.fetch(f"{ENDPOINT}?{urlencode(asked | ({'page_token': token} if token else {}))}", self.headers)
            for symbol, bars in (page.get("bars") or {}).items():
                rows += [{"symbol": symbol} | {name: bar.get(k) for k, name in FIELDS.items()} for bar in bars]
            token = page.get("next_page_token")
            if not token:
                break
        found = pd.DataFrame(rows, columns=["symbol", *FIELDS.values()])
        found["timestamp"] = pd.to_datetime(found["timestamp"], utc=True).dt.tz_localize(None)
        return found.astype({c: "float64" for c in ("open", "high", "low", "close", "volume")})
