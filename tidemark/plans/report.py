"""Reports of a backtest: text for a terminal, one self-contained page for a grid."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

_PERCENT = ("period_return", "annualized_return", "volatility", "average_fraction_invested", "profit_odds", "risk_free_odds", "benchmark_odds")
#: (label, column, better if larger; None: no comparison)
ROWS: list[tuple[str, str, bool | None]] = [
    ("return", "period_return", True),
    ("annual return", "annualized_return", True),
    ("Sharpe ratio", "sharpe_ratio", True),
    ("volatility", "volatility", False),
    ("days won", "days_won", True),
    ("days lost", "days_lost", False),
    ("days flat", "days_flat", None),
    ("weeks won", "weeks_won", True),
    ("weeks lost", "weeks_lost", False),
    ("months won", "months_won", True),
    ("months lost", "months_lost", False),
    ("odds of profit", "profit_odds", True),
    ("odds over risk-free", "risk_free_odds", True),
]
TRADES: list[tuple[str, str]] = [
    ("odds over benchmark", "benchmark_odds"),
    ("correlation to benchmark", "benchmark_correlation"),
    ("average invested", "average_fraction_invested"),
    ("trades", "trade_count"),
    ("trades won", "trades_won"),
    ("trades lost", "trades_lost"),
    ("profit per trade", "average_profit"),
    ("weighted profit per trade", "average_profit_weighted"),
    ("average win", "average_win"),
    ("average loss", "average_loss"),
    ("mean duration (bars)", "average_duration_bars"),
    ("most positions", "most_positions"),
]
_GREEN, _RED, _PLAIN = "\x1b[32m", "\x1b[31m", "\x1b[0m"


def shown(column: str, value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "n/a"
    if column in _PERCENT or column.startswith("average_") and column != "average_duration_bars":
        return f"{value:.2%}"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def _tint(text: str, own, other, larger: bool | None, color: bool) -> str:
    if not color or larger is None or own is None or other is None or own == other:
        return text
    return f"{_GREEN if (own > other) == larger else _RED}{text}{_PLAIN}"


def block(model: dict, benchmark: dict | None, color: bool = False, label: str = "SPY") -> str:
    """One period: model against benchmark, the better figure green and the other red."""
    lines = [f"== {model['period']}: {model['start']} to {model['end']} =="]
    head = f"{'':<26}{'model':>14}"
    lines.append(head + (f"{label:>14}" if benchmark else ""))
    for name, column, larger in ROWS:
        a, b = model.get(column), (benchmark or {}).get(column)
        # Padding comes before colour, whose marks have no width on screen.
        line = f"{name:<26}" + _tint(f"{shown(column, a):>14}", a, b, larger, color)
        lines.append(line + (_tint(f"{shown(column, b):>14}", b, a, larger, color) if benchmark else ""))
    lines += [f"{name:<26}{shown(column, model.get(column)):>14}" for name, column in TRADES]
    return "\n".join(lines)


def text_report(rows: list[dict], combo_id: int = 0, color: bool = False, label: str = "SPY") -> str:
    """All periods of a combination, from rows of the report table."""
    own = {r["period"]: r for r in rows if r["series"] == "model" and r["combo_id"] == combo_id}
    beside = {r.get("benchmark_id", -1) for r in own.values()}
    held = {r["period"]: r for r in rows if r["series"] == "benchmark" and r.get("combo_id", -1) in beside}
    return "\n\n".join(block(own[p], held.get(p), color, label) for p in ("overall", "train", "test") if p in own)


def equity_svg(curve: list[tuple], benchmark: list[tuple] | None = None, risk_free: float = 0.04, width: int = 720, height: int = 260) -> str:
    """Model, benchmark and (dashed) risk-free growth as an inline drawing; points are (time, value)."""
    if not curve:
        return "<svg/>"
    ends = [t for points in (curve, benchmark or curve) for t in (points[0][0], points[-1][0])]
    t0, t1 = min(ends), max(ends)
    span = max((t1 - t0).total_seconds(), 1.0)
    years = lambda t: (t - curve[0][0]).total_seconds() / (365.25 * 86400)
    free = [(t, (1 + risk_free) ** years(t)) for t, _ in curve]
    lines = [("#1f77b4", "", curve), ("#888888", "6 4", free)] + ([("#ff7f0e", "", benchmark)] if benchmark else [])
    values = [v for _, _, points in lines for _, v in points]
    low, high = min(values), max(values)
    scale = (high - low) or 1.0
    parts = []
    for stroke, dash, points in lines:
        at = " ".join(f"{(t - t0).total_seconds() / span * width:.1f},{height - (v - low) / scale * height:.1f}" for t, v in points)
        parts.append(f'<polyline fill="none" stroke="{stroke}" stroke-dasharray="{dash}" points="{at}"/>')
    return f'<svg viewBox="0 0 {width} {height}" xmlns="http://www.w3.org/2000/svg">{"".join(parts)}</svg>'


def grid_page(ranked: list[dict], overrides: list[dict], details: dict[int, str], charts: dict[int, str] | None = None, correlation: float | None = None) -> str:
    """Combinations in rank order, each of which opens its text report and chart on a click."""
    axes = list(dict.fromkeys(k for o in overrides for k in o))
    head = "".join(f"<th>{html.escape(a)}</th>" for a in ["rank", *axes, "train Sharpe", "test Sharpe"])
    body = []
    for r in ranked:
        own = overrides[r["combo_id"]]
        cells = [r["rank"], *(own.get(a, "") for a in axes), shown("sharpe_ratio", r["train_sharpe"]), shown("sharpe_ratio", r["test_sharpe"])]
        body.append(f'<tr data-combo="{r["combo_id"]}">' + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>")
    data = json.dumps({str(k): {"text": v, "chart": (charts or {}).get(k, "")} for k, v in details.items()}).replace("</", "<\\/")
    foot = "n/a" if correlation is None else f"{correlation:.3f}"
    script = "document.querySelectorAll('tr[data-combo]').forEach(r=>r.onclick=()=>{const d=DATA[r.dataset.combo];document.getElementById('text').textContent=d.text;document.getElementById('chart').innerHTML=d.chart;});"
    return (
        "<!doctype html><meta charset='utf-8'><title>Grid report</title><style>body{font-family:sans-serif}td,th{padding:2px 10px;text-align:right}tr[data-combo]{cursor:pointer}</style>"
        f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table><p>Correlation of train and test Sharpe ratios: {foot}</p>"
        f"<div id='chart'></div><pre id='text'></pre><script>const DATA={data};{script}</script>"
    )


def write_page(page: str, path: str | Path) -> Path:
    out = Path(path)
    out.write_text(page, encoding="utf-8")
    return out
