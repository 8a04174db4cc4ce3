import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pydantic import ValidationError

from tidemark.plans import cli, config, report
from tidemark.sources import ingest as I
from tidemark.sources import universe
from tidemark.sources.bars import TIMEFRAMES, bar_start, clean
from tidemark.sources.store import BarStore


def write(tmp_path, text, name="c.yaml"):
    p = tmp_path / name
    p.write_text(text)
    return p


def test_defaults_and_presets(tmp_path):
    c = config.load_config()
    assert c.strategy.buy_signal_order == [["rsi_divergence"], ["stochastic_crossover"]]
    assert [r.kind for g in c.strategy.sell_rule_groups for r in g] == ["indicator", "time"]
    fast = config.load_config(write(tmp_path, "strategy: fast_divergence\n"))
    assert fast.strategy.sell_rule_groups[3][0].max_bars_held == 30 and fast.strategy.sell_rule_groups[1][0].volatility_length == 30
    assert config.load_config(tmp_path / "missing.yaml") == c


@pytest.mark.parametrize(
    "text, match",
    [
        ("universe: {end_date: 2020-01-01}", "end_date"),
        ("universe: {train_test_split_date: 2026-06-01}", "strictly between"),
        ("unknown: 1", "Extra inputs"),
        ("directions: []", "directions"),
        ("strategy: nope", "available: "),
        ("strategies: {bad: {buy_signal_expiration_bars: [1]}}", "strategies.bad"),
        ("strategies: {empty: {buy_signal_order: []}}", "at least one signal"),
        ("position_sizing: {max_positions: 0}", "greater than 0"),
        ("indicators: {rsi_length: 1}", "greater than 1"),
    ],
)
def test_bad_configurations(tmp_path, text, match):
    with pytest.raises((ValueError, ValidationError), match=match):
        config.load_config(write(tmp_path, text))


def test_grid(tmp_path):
    points = config.load_grid()
    assert len(points) == 24 and points[0].overrides == {"rsi_length": 4, "strategy": "momentum_divergence", "position_sizing.correlation_reject_threshold": 0}
    assert points[-1].config.indicators.rsi_length == 48 and points[-1].config.position_sizing.correlation_reject_threshold == 0.45
    for text, match in (("grid: {expiration_bars: [1]}", "ambiguous"), ("grid: {nothing: [1]}", "no configuration field"), ("grid: {rsi_length: 4}", "non-empty list"), ("grid: {strategy.sell_rule_groups.0: [1], strategy: [fast_divergence]}", "plain string")):
        with pytest.raises(ValueError, match=match):
            config.load_grid(write(tmp_path, text))


def test_store_and_missing(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"), "1h")
    assert store.tickers() == [] and not store.exists("A")
    t = dt.datetime(2024, 1, 1)
    rows = lambda s, x: spark.createDataFrame([(s, t, x, x, x, x, 1.0)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    store.write(rows("A", 1.0).union(rows("B", 2.0)))
    store.write(rows("B", 3.0))
    assert store.tickers() == ["A", "B"] and {r.symbol: r.close for r in store.read().collect()} == {"A": 1.0, "B": 3.0}
    assert [r.symbol for r in store.missing(spark.createDataFrame([("A",), ("C",)], "symbol string")).collect()] == ["C"]


def test_symbols_of_digits_stay_text(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"), "1d")
    t = dt.datetime(2024, 1, 1)
    names = ["0700", "0005", "1e3", "2024-01-01"]
    store.write(spark.createDataFrame([(s, t, 1.0, 1.0, 1.0, 1.0, 1.0) for s in names], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))
    assert store.tickers() == sorted(names) and store.exists("0700") and not store.exists("700")
    assert sorted(r.symbol for r in store.read(["0700", "1e3"]).collect()) == ["0700", "1e3"]
    assert store.missing(spark.createDataFrame([(s,) for s in names], "symbol string")).count() == 0


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    from tidemark.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())


def test_each_point_has_its_own_risk_and_split(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.plans.backtest import run

    base = {"universe": {"start_date": "2023-01-01", "train_test_split_date": "2024-01-04", "end_date": "2025-01-01"}, "strategy": {"buy_signal_order": [["stochastic_crossover"]], "buy_signal_expiration_bars": [], "sell_rule_groups": [[{"kind": "time", "max_bars_held": 20}]]}}
    own = [{"simulate_profit_odds": False, "risk_free_rate": 0.0}, {"simulate_profit_odds": False, "risk_free_rate": 0.5}, {"simulate_profit_odds": False, "portfolio_warmup_bars": 60}, {"monte_carlo_paths": 20, "holding_period_hours": 30}]
    points = [config.GridPoint({}, config.Config.model_validate(base | {"risk": r})) for r in own]
    later = base["universe"] | {"train_test_split_date": "2024-01-06"}
    points.append(config.GridPoint({}, config.Config.model_validate(base | {"universe": later, "risk": own[0]})))
    bars = spark.createDataFrame(prices(["A", "B", "M"], 400)).withColumnRenamed("timestamp", "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ranks = bars.select("symbol").distinct().withColumn("universe_rank", F.row_number().over(Window.orderBy("symbol")))
    held = bars.where("symbol = 'M'").select("ts", "close")
    together = {(r.combo_id, r.period): r for r in run(bars, ranks, points, held).report.collect()}
    assert len({round(together[n, "overall"].sharpe_ratio, 9) for n in range(4)}) == 4
    assert together[4, "train"].end > together[0, "train"].end and together[2, "overall"].bars == 400 - 60
    assert {together[n, "overall"].benchmark_id for n in range(5)} == {-1, -2, -3, -4, -5}
    figures = ("start", "end", "bars", "period_return", "sharpe_ratio", "trade_count", "benchmark_return", "benchmark_correlation", "profit_odds", "days_won")
    for n, p in enumerate(points):
        alone = {(r.series, r.period): r for r in run(bars, ranks, [p], held).report.collect()}
        for period in ("overall", "train", "test"):
            for series, k in (("model", n), ("benchmark", together[n, period].benchmark_id)):
                for c in figures:
                    x, y = together[k, period][c], alone[series, period][c]
                    assert x == (pytest.approx(y) if isinstance(y, float) else y), (n, series, period, c)
    assert together[3, "overall"].profit_odds is not None and together[0, "overall"].profit_odds is None


def test_clean_and_bar_starts(spark):
    t = pd.DataFrame({"symbol": ["A", "A"], "timestamp": [dt.datetime(2024, 5, 17, 10, 47), dt.datetime(2024, 5, 17, 11)], "Open": [1.0, None], "Close": [float("nan"), None]})
    got = clean(spark.createDataFrame(t)).collect()
    assert len(got) == 1 and got[0].close is None and got[0].open == 1.0
    from pyspark.sql import functions as F

    at = F.lit("2024-05-17 10:47:31").cast("timestamp_ntz")
    starts = [str(spark.range(1).select(bar_start(at, x)).first()[0]) for x in TIMEFRAMES]
    assert starts == ["2024-05-17 10:47:00", "2024-05-17 10:46:00", "2024-05-17 10:45:00", "2024-05-17 10:45:00", "2024-05-17 10:30:00", "2024-05-17 10:00:00", "2024-05-17 00:00:00", "2024-05-13 00:00:00", "2024-05-01 00:00:00", "2024-04-01 00:00:00"]
    with pytest.raises(ValueError, match="unknown bar length"):
        bar_start(at, "7m")


def test_universe(spark):
    listing = {"0": {"ticker": "NVDA"}, "1": {"ticker": "AAPL"}, "2": {"ticker": "BRK-B"}, "3": {"ticker": "NVDA"}, "4": {"ticker": "X"}}
    assert universe.resolve(spark, 3, lambda: listing) == ["NVDA", "AAPL", "BRK.B"]


def prices(tickers, n=150, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for k, s in enumerate(tickers):
        c = 100 + np.cumsum(rng.normal(size=n))
        for i in range(n):
            out.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), c[i], c[i] + 1, c[i] - 1, c[i], 1000.0 + k))
    return pd.DataFrame(out, columns=["symbol", "timestamp", "open", "high", "low", "close", "volume"])


def test_ingest_retries_and_chunks(spark, tmp_path):
    calls, naps = [], []

    def download(tickers, start, end, length):
        calls.append(list(tickers))
        if len(calls) < 3:
            raise OSError("busy")
        if "C" in tickers:
            raise OSError("gone")
        return prices(tickers, 3)

    store = BarStore(spark, str(tmp_path / "i"), "1h")
    done = I.ingest(["A", "B", "C"], dt.date(2024, 1, 1), dt.date(2024, 2, 1), store, download, chunk_size=2, max_retries=3, retry_backoff_seconds=1.0, sleep=naps.append)
    assert done == ["A", "B"] and calls == [["A", "B"]] * 3 + [["C"]] * 3 and len(naps) == 4
    assert 1.0 <= naps[0] <= 1.5 and 2.0 <= naps[1] <= 2.5
    with pytest.raises(RuntimeError, match="to download"):
        I.credentials(("TIDEMARK_NO_KEY", "TIDEMARK_NO_SECRET"))
    assert I.vendor_unit("3mo") == (3, "month")


def test_vendor_pages(spark, tmp_path):
    from urllib.parse import parse_qs, urlparse

    from tidemark.sources.vendor import VendorBars

    bar = lambda t, c: {"t": t, "o": 1, "h": 2, "l": 0.5, "c": c, "v": 10, "n": 3, "vw": 1.1}
    pages = [{"bars": {"A": [bar("2024-01-02T10:00:00Z", 1.5)]}, "next_page_token": "x"}, {"bars": {"A": [bar("2024-01-02T11:00:00Z", 1.6)], "B": [bar("2024-01-02T10:00:00Z", 7)]}, "next_page_token": None}]
    seen = []

    def fetch(url, headers):
        seen.append((parse_qs(urlparse(url).query), headers))
        return pages[len(seen) - 1]

    found = VendorBars("k", "s", fetch)(["A", "B"], dt.date(2024, 1, 1), dt.date(2024, 2, 1), "3mo")
    assert found[["symbol", "close"]].values.tolist() == [["A", 1.5], ["A", 1.6], ["B", 7.0]]
    assert seen[0][0]["timeframe"] == ["3Month"] and seen[0][0]["symbols"] == ["A,B"] and "page_token" not in seen[0][0] and seen[1][0]["page_token"] == ["x"]
    assert seen[0][1]["APCA-API-KEY-ID"] == "k"
    store = BarStore(spark, str(tmp_path / "v"), "1h")
    pages[0]["next_page_token"] = None
    seen.clear()
    assert I.ingest(["A", "B"], dt.date(2024, 1, 1), dt.date(2024, 2, 1), store, VendorBars("k", "s", fetch)) == ["A"]
    assert VendorBars("k", "s", lambda u, h: {"bars": None})(["A"], dt.date(2024, 1, 1), dt.date(2024, 2, 1), "1h").empty


def test_command_line(spark, tmp_path, monkeypatch):
    text = f"data_dir: {tmp_path}/data\nuniverse: {{stock_number: 2, refresh_data: true, start_date: 2024-01-01, train_test_split_date: 2024-01-03, end_date: 2024-02-01}}\nrisk: {{monte_carlo_paths: 50, holding_period_hours: 40}}\ngrid: {{rsi_length: [5], strategy: [range_scalp_divergence], position_sizing.correlation_reject_threshold: [0, 1]}}\n"
    listing = lambda: {"0": {"ticker": "AA"}, "1": {"ticker": "BB"}}
    page = tmp_path / "out.html"
    code = cli.main(["--config", str(write(tmp_path, text)), "--output", str(page)], spark, lambda t, s, e, n: prices(t), listing)
    body = page.read_text()
    assert code == 0 and body.count("data-combo=") == 2 and "train Sharpe" in body and "polyline" in body
    assert "ff7f0e" in body  # the benchmark's line
    for name in ("ALPACA_API_KEY", "ALPACA_SECRET_KEY"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(RuntimeError, match="to download"):
        cli.main(["--config", str(write(tmp_path, text))], spark, None, listing)
    assert cli.plugged(f"{__name__}:prices") is prices
    with pytest.raises(RuntimeError, match="no bars"):
        cli.main(["--no-refresh", "--config", str(write(tmp_path, text.replace("/data", "/none")))], spark, None, listing)


def test_text_report():
    row = {"series": "model", "combo_id": 0, "period": "overall", "start": "a", "end": "b", "period_return": 0.5, "sharpe_ratio": 1.25, "trade_count": 3, "average_win": None, "volatility": 0.1}
    other = row | {"series": "benchmark", "combo_id": -1, "period_return": 0.2, "volatility": 0.1}
    plain = report.text_report([row, other])
    assert "50.00%" in plain and "20.00%" in plain and "n/a" in plain and "\x1b" not in plain
    tinted = report.text_report([row, other], color=True)
    assert "\x1b[32m        50.00%\x1b[0m" in tinted and "\x1b[31m        20.00%" in tinted and tinted.count("10.00%\x1b") == 0
    page = report.grid_page([{"combo_id": 0, "rank": 1, "train_sharpe": None, "test_sharpe": 1.0}], [{"<x>": "</script>"}], {0: "</script>"})
    assert "&lt;x&gt;" in page and page.count("</script>") == 1


def test_streaming_bars(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming.bars import streaming_bars

    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [("A", t0 + dt.timedelta(minutes=m), float(p), i) for i, (m, p) in enumerate([(1, 5), (30, 9), (59, 7), (61, 8), (400, 1)])]
    schema = "s string, ts timestamp, p double, id int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming_bars(stream, "s", "ts", F.col("p"), ["ts", "id"]).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(str(r.ts), r.open, r.high, r.low, r.close, r.volume) for r in spark.table("live").orderBy("ts").collect()]
    assert got == [("2024-01-01 10:00:00", 5.0, 9.0, 5.0, 7.0, 3.0), ("2024-01-01 11:00:00", 8.0, 8.0, 8.0, 8.0, 1.0)]
