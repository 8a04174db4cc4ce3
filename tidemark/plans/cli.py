"""Command line: read configuration files, run the grid they span and write a page."""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import buy_and_hold
from tidemark.plans.backtest import grid_rank, run, sharpe_correlation
from tidemark.plans.config import GridPoint, load_grid
from tidemark.plans.report import equity_svg, grid_page, text_report, write_page
from tidemark.sources.ingest import Downloader, credentials, ingest
from tidemark.sources.store import BarStore
from tidemark.sources.universe import fetch, resolve

log = logging.getLogger(__name__)
#: The series that results are compared with; it is kept apart from the universe.
BENCHMARK = "SPY"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", action="append", default=[], help="YAML file, later ones override earlier ones")
    p.add_argument("--no-refresh", action="store_true", help="never download, whatever the configuration says")
    p.add_argument("--downloader", default="tidemark.sources.vendor:VendorBars", help="module:attribute of what downloads bars; see tidemark.sources.ingest.Downloader")
    p.add_argument("--output", default="report.html")
    p.add_argument("--log-level", default="INFO")
    return p.parse_args(argv)


def plugged(name: str) -> Downloader:
    """The downloader that a "module:attribute" names; a class is made with the vendor's credentials."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "download")
    return found(*credentials()) if isinstance(found, type) else found


def acquire(spark: SparkSession, points: list[GridPoint], refresh: bool, download: Downloader | None, listing: Callable[[], dict]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Bars, ranks and benchmark of the first point's universe; all points share them."""
    c = points[0].config
    symbols = resolve(spark, c.universe.stock_number, listing)
    store = BarStore(spark, f"{c.data_dir}", c.universe.candle_length)
    apart = BarStore(spark, f"{c.data_dir}/benchmarks", c.universe.candle_length)
    if refresh:
        if download is None:
            raise RuntimeError("refreshing data needs a downloader")
        ingest(symbols, c.universe.start_date, c.universe.end_date, store, download)
        ingest([BENCHMARK], c.universe.start_date, c.universe.end_date, apart, download)
    ranks = spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "symbol string, universe_rank int")
    missing = [r.symbol for r in store.missing(ranks).collect()]
    if len(missing) == len(symbols):
        raise RuntimeError(f"no bars for any of {len(symbols)} symbols under {c.data_dir}")
    if missing:
        log.warning("no bars for %s", ", ".join(missing))
    held = [s for s in symbols if s not in set(missing)]
    if not apart.exists(BENCHMARK):
        log.warning("no bars for the benchmark %s under %s/benchmarks: reports go without it", BENCHMARK, c.data_dir)
    benchmark = apart.read([BENCHMARK]).select("ts", "close") if apart.exists(BENCHMARK) else None
    return store.read(held), ranks, benchmark


def main(argv: list[str] | None = None, spark: SparkSession | None = None, download: Downloader | None = None, listing: Callable[[], dict] = fetch) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=args.log_level, stream=sys.stdout, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    points = load_grid(*args.config)
    refresh = points[0].config.universe.refresh_data and not args.no_refresh
    bars, ranks, benchmark = acquire(spark, points, refresh, download or (plugged(args.downloader) if refresh else None), listing)
    done = run(bars, ranks, points, benchmark)
    report = done.report.persist()
    rows = [r.asDict() for r in report.collect()]
    ranked_df = grid_rank(report)
    ranked = [r.asDict() for r in ranked_df.orderBy("rank").collect()]
    texts = {n: text_report(rows, n) for n in range(len(points))}
    held = None if benchmark is None else [tuple(r) for r in buy_and_hold(benchmark).orderBy("ts").collect()]
    charts = {}
    for n in range(len(points)):
        curve = done.curve.where(F.col("combo_id") == n).orderBy("ts").select("ts", "equity").collect()
        charts[n] = equity_svg([tuple(r) for r in curve], held, points[n].config.risk.risk_free_rate)
    correlation = sharpe_correlation(ranked_df).first()["correlation"] if len(points) > 1 else None
    page = grid_page(ranked, [p.overrides for p in points], texts, charts, correlation)
    log.info("wrote %s", write_page(page, args.output))
    if len(points) == 1:
        print(text_report(rows, 0, color=sys.stdout.isatty(), label=BENCHMARK))
    return 0


if __name__ == "__main__":
    sys.exit(main())
