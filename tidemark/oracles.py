"""SQL that gives each query's rows on the same tables, written apart from the operators.

Each piece is a named common table expression with the pieces it reads; a query takes what it needs.
"""

from __future__ import annotations

import re

from tidemark.queries import LOOKBACK, MAX_POSITIONS, SPLIT, THRESHOLD, WARMUP

_W = "PARTITION BY symbol ORDER BY rn"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _prior(x: str, back: int) -> str:
    return f"lag({x}, {back}) OVER ({_W})" if back else x


def _mean(x: str, n: int, back: int = 0) -> str:
    frame = f"({_W} ROWS BETWEEN {n + back} PRECEDING AND {1 + back} PRECEDING)"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN avg({x}) OVER {frame} END)"


def _extreme(x: str, before: int, after: int, high: bool) -> str:
    """By lags and leads one by one, unlike the operator."""
    op = ">" if high else "<"
    parts = [f"{x} {op} lag({x}, {k}) OVER ({_W})" for k in range(1, before + 1)] + [f"{x} {op} lead({x}, {k}) OVER ({_W})" for k in range(1, after + 1)]
    return f"coalesce({' AND '.join(parts)}, false)"


def _candles() -> dict[str, str]:
    p = _prior
    white = lambda b=0: f"({p('c', b)} >= {p('o', b)})"
    top = lambda b=0: f"greatest({p('o', b)}, {p('c', b)})"
    low = lambda b=0: f"least({p('o', b)}, {p('c', b)})"
    tiny = lambda s, b=0: f"{p(s, b)} < 0.1 * {_mean('rng', 10, b)}"
    near = lambda b: f"({p('c', b)} + 0.2 * {_mean('rng', 5, b)})"
    far = lambda b: f"({p('body', b)} - 0.6 * {_mean('rng', 5, b)})"
    stars = f"{p('body', 2)} > {_mean('body', 10, 2)} AND {p('body', 1)} <= {_mean('body', 10, 1)} AND body > {_mean('body', 10)}"
    inside = lambda b: f"{p('o', b)} < {p('o', b + 1)} AND {p('o', b)} > {p('c', b + 1)}"
    return {
        "hammer": f"body < {_mean('body', 10)} AND dn > body AND {tiny('up')} AND {low()} <= {p('l', 1)} + 0.2 * {_mean('rng', 5, 1)}",
        "shooting_star": f"body < {_mean('body', 10)} AND up > body AND {tiny('dn')} AND {low()} > {top(1)}",
        "engulfing_up": f"{white()} AND NOT {white(1)} AND c > {p('o', 1)} AND o < {p('c', 1)}",
        "engulfing_down": f"NOT {white()} AND {white(1)} AND o > {p('c', 1)} AND c < {p('o', 1)}",
        "morning_star": f"{stars} AND NOT {white(2)} AND {top(1)} < {low(2)} AND {white()} AND c > {p('c', 2)} + 0.3 * {p('body', 2)}",
        "evening_star": f"{stars} AND {white(2)} AND {low(1)} > {top(2)} AND NOT {white()} AND c < {p('c', 2)} - 0.3 * {p('body', 2)}",
        "three_white_soldiers": f"{white(2)} AND {white(1)} AND {white()} AND {tiny('up', 2)} AND {tiny('up', 1)} AND {tiny('up')} AND c > {p('c', 1)} AND {p('c', 1)} > {p('c', 2)} "
        f"AND {p('o', 1)} > {p('o', 2)} AND {p('o', 1)} <= {near(2)} AND o > {p('o', 1)} AND o <= {near(1)} AND {p('body', 1)} > {far(2)} AND body > {far(1)} AND body > {_mean('body', 10)}",
        "three_black_crows": f"{white(3)} AND NOT {white(2)} AND NOT {white(1)} AND NOT {white()} AND {tiny('dn', 2)} AND {tiny('dn', 1)} AND {tiny('dn')} "
        f"AND {inside(1)} AND {inside(0)} AND {p('h', 3)} > {p('c', 2)} AND {p('c', 1)} < {p('c', 2)} AND c < {p('c', 1)}",
    }


def _crossover(way: str) -> str:
    """An automaton as recursion over bar positions, all symbols at once."""
    k, d = ("k", "d") if way == "long" else ("100 - k", "100 - d")
    return f"""SELECT symbol, -1::BIGINT AS rn, NULL::BIGINT AS since, NULL::DOUBLE AS base, false AS hit FROM (SELECT DISTINCT symbol FROM osc)
UNION ALL
SELECT symbol, rn, CASE WHEN expired OR fire THEN NULL ELSE armed END, base, fire FROM (
  SELECT *, coalesce(NOT expired AND armed IS NOT NULL AND k > d AND k > base + 10, false) AS fire FROM (
    SELECT *, coalesce(rn - armed >= 10, false) AS expired FROM (
      SELECT o.symbol, o.rn, {k} AS k, {d} AS d, CASE WHEN x.since IS NULL AND {k} < 50 THEN o.rn ELSE x.since END AS armed, CASE WHEN x.since IS NULL THEN {k} ELSE x.base END AS base
      FROM x_{way} x JOIN osc o ON o.symbol = x.symbol AND o.rn = x.rn + 1)))"""


def _swings(kind: str) -> str:
    x = "h" if kind == "high" else "l"
    return f"""SELECT symbol, rn, lag(v, 8) OVER ({_W}) AS level FROM (SELECT symbol, rn, CASE WHEN {_extreme(x, 8, 8, kind == 'high')} THEN {x} END AS v FROM b)"""


def _exit(kind: str, way: str) -> tuple[str, str]:
    """(fires, level) of a rule, from the bar and its entry bar e."""
    long = way == "long"
    if kind == "indicator":
        return f"coalesce(e.rn IS NOT NULL AND q.rsi {'>=' if long else '<='} 50, false)", "NULL"
    if kind == "flexible":
        return ("coalesce(q.rsi - e.rsi >= 12, false)" if long else "coalesce(e.rsi - q.rsi >= 12, false)"), "NULL"
    if kind.startswith("time"):
        return f"coalesce(q.rn - e.rn >= {kind[4:] or 30}, false)", "NULL"
    if kind == "margin":
        profit, stop = ("e.c * (1 + 2 * e.vol)", "e.c * (1 - 2 * e.vol)") if long else ("e.c / (1 + 2 * e.vol)", "e.c / (1 - 2 * e.vol)")
    else:
        profit, stop = ("e.above", "e.below") if long else ("e.below", "e.above")
    won, lost = (f"coalesce(q.h >= {profit}, false)", f"coalesce(q.c <= {stop}, false)") if long else (f"coalesce(q.l <= {profit}, false)", f"coalesce(q.c >= {stop}, false)")
    return f"({won} OR {lost})", f"(CASE WHEN {lost} THEN q.c WHEN {won} THEN {profit} END)"


def _sell(way: str, groups: list[list[str]], tag: str = "") -> str:
    sold, levels = [], []
    for g in groups:
        rules = [_exit(k, way) for k in g]
        hit = " AND ".join(f for f, _ in rules)
        sold.append(f"({hit})")
        levels += [f"CASE WHEN {hit} THEN {v} END" for _, v in rules if v != "NULL"]
    pick = ("least" if way == "long" else "greatest") + f"({', '.join(levels)})" if levels else "NULL"
    any_ = " OR ".join(sold)
    return f"SELECT q.symbol, q.rn, q.ts, ({any_}) AS sold, CASE WHEN {any_} THEN coalesce({pick}, q.c) END AS price FROM full_{way}{tag} q LEFT JOIN full_{way}{tag} e ON e.symbol = q.symbol AND e.rn = q.last_buy"


_PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT event_type AS symbol, ts, event_id, value, round(100 * exp(sum(0.005 * (value / 50.0 - 1)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 6) AS price FROM events"),
    "b0": (("ev",), "SELECT symbol, date_trunc('hour', ts) AS hour, first(price ORDER BY ts, event_id) AS o, max(price) AS h, min(price) AS l, last(price ORDER BY ts, event_id) AS c, sum(value) AS v FROM ev GROUP BY 1, 2"),
    "b": (("b0",), "SELECT symbol, hour AS ts, o, h, l, c, v, row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1 AS rn FROM b0"),
    "rets": (("b",), f"SELECT *, c / lag(c) OVER ({_W}) - 1 AS ret FROM b"),
    "vols": (("rets",), f"SELECT *, CASE WHEN rn >= 30 THEN stddev_samp(ret) OVER ({_W} ROWS 29 PRECEDING) END AS vol FROM rets"),
    "raws": (("b",), f"SELECT *, CASE WHEN rn >= 4 THEN CASE WHEN max(h) OVER f = min(l) OVER f THEN 0 ELSE 100 * (c - min(l) OVER f) / (max(h) OVER f - min(l) OVER f) END END AS raw FROM b WINDOW f AS ({_W} ROWS 4 PRECEDING)"),
    "ks": (("raws",), f"SELECT *, CASE WHEN rn >= 6 THEN avg(raw) OVER ({_W} ROWS 2 PRECEDING) END AS k0 FROM raws"),
    "sto": (("ks",), f"SELECT symbol, ts, rn, CASE WHEN rn >= 8 THEN k0 END AS k, CASE WHEN rn >= 8 THEN avg(k0) OVER ({_W} ROWS 2 PRECEDING) END AS d FROM ks"),
    "steps": (("b",), f"SELECT symbol, rn, c - lag(c) OVER ({_W}) AS step FROM b"),
    "rsis": (
        ("steps",),
        """SELECT symbol, 12::BIGINT AS rn, list_sum(list(greatest(step, 0) ORDER BY rn)) / 12 AS g, list_sum(list(greatest(-step, 0) ORDER BY rn)) / 12 AS d FROM steps WHERE rn BETWEEN 1 AND 12 GROUP BY symbol HAVING count(*) = 12
UNION ALL SELECT r.symbol, s.rn, (r.g * 11 + greatest(s.step, 0)) / 12, (r.d * 11 + greatest(-s.step, 0)) / 12 FROM rsis r JOIN steps s ON s.symbol = r.symbol AND s.rn = r.rn + 1""",
    ),
    "osc": (
        ("b", "sto", "rsis", "vols"),
        "SELECT b.*, round(sto.k, 8) AS k, round(sto.d, 8) AS d, CASE WHEN r.rn IS NULL THEN NULL WHEN r.g + r.d = 0 THEN 0 ELSE 100 * r.g / (r.g + r.d) END AS rsi, vols.vol FROM b JOIN sto USING (symbol, rn) JOIN vols USING (symbol, rn) LEFT JOIN rsis r ON r.symbol = b.symbol AND r.rn = b.rn",
    ),
    "shapes": (("b",), "SELECT symbol, ts, rn, o, h, l, c, abs(c - o) AS body, h - l AS rng, h - greatest(o, c) AS up, least(o, c) - l AS dn FROM b"),
    "cand": (("shapes",), "SELECT symbol, ts, rn, " + ", ".join(f"coalesce({e}, false) AS {n}" for n, e in _candles().items()) + " FROM shapes"),
    "x_long": (("osc",), _crossover("long")),
    "x_short": (("osc",), _crossover("short")),
    "highs": (("b",), _swings("high")),
    "lows": (("b",), _swings("low")),
    "standing": (
        ("b", "highs", "lows"),
        """SELECT q.symbol, q.rn, s.level FROM b q JOIN highs s ON s.symbol = q.symbol AND s.rn <= q.rn AND s.level IS NOT NULL AND NOT EXISTS (SELECT 1 FROM highs t WHERE t.symbol = s.symbol AND t.rn > s.rn AND t.rn <= q.rn AND t.level >= s.level)
UNION ALL SELECT q.symbol, q.rn, s.level FROM b q JOIN lows s ON s.symbol = q.symbol AND s.rn <= q.rn AND s.level IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lows t WHERE t.symbol = s.symbol AND t.rn > s.rn AND t.rn <= q.rn AND t.level <= s.level)""",
    ),
    "lev": (("b", "standing"), "SELECT b.symbol, b.rn, b.ts, count(level) AS n, coalesce(sum(level), 0) AS s, min(CASE WHEN level > c THEN level END) AS above, max(CASE WHEN level < c THEN level END) AS below FROM b LEFT JOIN standing USING (symbol, rn) GROUP BY ALL"),
    "chain": (
        ("osc", "cand", "x_long"),
        f"""SELECT symbol, rn, osc.ts, coalesce(c < 0.99 * avg(c) OVER ({_W} ROWS 9 PRECEDING), false) AS dv, coalesce(x.hit, false) AS so,
hammer OR engulfing_up OR morning_star OR three_white_soldiers AS cs FROM osc JOIN cand USING (symbol, rn) JOIN x_long x USING (symbol, rn)""",
    ),
}
for _way in ("long", "short"):
    _PIECES[f"full_{_way}"] = (
        ("osc", "lev", f"x_{_way}"),
        f"SELECT osc.*, lev.above, lev.below, x.hit AS buy, max(CASE WHEN x.hit THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_buy FROM osc JOIN lev USING (symbol, rn) JOIN x_{_way} x USING (symbol, rn)",
    )
    _PIECES[f"sells_{_way}"] = ((f"full_{_way}",), _sell(_way, [["margin"], ["time"]]))
    _high = _way == "short"
    _sign = ("<", ">") if _high else (">", "<")
    _PIECES[f"trig_{_way}"] = (("osc",), f"SELECT symbol, rn, c, rsi, {_extreme('c', 5, 5, _high)} AND {_extreme('rsi', 5, 5, _high)} AS anchor, {_extreme('c', 5, 1, _high)} AND {_extreme('rsi', 5, 1, _high)} AS trigger FROM osc")
    _PIECES[f"div_{_way}"] = (
        (f"trig_{_way}",),
        f"""SELECT DISTINCT z.symbol, greatest(a.rn + 5, z.rn + 1) AS rn FROM trig_{_way} z JOIN trig_{_way} a ON a.symbol = z.symbol AND a.rn = (SELECT max(t.rn) FROM trig_{_way} t WHERE t.symbol = z.symbol AND t.rn < z.rn AND t.trigger)
WHERE z.trigger AND a.anchor AND z.rn - a.rn < 30 AND a.c {_sign[0]} z.c AND a.rsi {_sign[1]} z.rsi""",
    )
_PIECES |= {
    "flags": (
        ("full_long", "full_short", "sells_long", "sells_short"),
        "SELECT symbol, rn, l.ts, l.c, l.buy AS bl, sl.sold AS sl, sl.price AS pl, s.buy AS bs, ss.sold AS ss, ss.price AS ps FROM full_long l JOIN full_short s USING (symbol, rn) JOIN sells_long sl USING (symbol, rn) JOIN sells_short ss USING (symbol, rn)",
    ),
    "states": (
        ("flags",),
        """SELECT symbol, -1::BIGINT AS rn, '' AS was, 0 AS way, '' AS state FROM (SELECT DISTINCT symbol FROM flags)
UNION ALL SELECT symbol, rn, was, way, CASE way WHEN 1 THEN CASE WHEN sl THEN '' ELSE 'long' END WHEN 3 THEN CASE WHEN ss THEN '' ELSE 'short' END WHEN 0 THEN was ELSE '' END FROM (
  SELECT q.symbol, q.rn, x.state AS was, q.sl, q.ss, CASE WHEN q.bl AND x.state <> 'long' THEN 1 WHEN x.state = 'long' AND q.sl THEN 2 WHEN q.bs AND x.state <> 'short' THEN 3 WHEN x.state = 'short' AND q.ss THEN 4 ELSE 0 END AS way
  FROM states x JOIN flags q ON q.symbol = x.symbol AND q.rn = x.rn + 1)""",
    ),
    "emitted": (
        ("states", "flags"),
        """SELECT symbol, rn, 0 AS part, 'sell' AS kind, was AS direction, c AS price FROM states JOIN flags USING (symbol, rn) WHERE way IN (1, 3) AND was <> ''
UNION ALL SELECT symbol, rn, 1, 'buy', CASE way WHEN 1 THEN 'long' ELSE 'short' END, c FROM states JOIN flags USING (symbol, rn) WHERE way IN (1, 3)
UNION ALL SELECT symbol, rn, 2, 'sell', CASE WHEN way <= 2 THEN 'long' ELSE 'short' END, CASE WHEN way <= 2 THEN pl ELSE ps END FROM states JOIN flags USING (symbol, rn) WHERE way IN (2, 4) OR (way = 1 AND sl) OR (way = 3 AND ss)
UNION ALL SELECT symbol, rn, 3, 'sell', state, c FROM states JOIN flags USING (symbol, rn) WHERE state <> '' AND rn = (SELECT max(m.rn) FROM flags m WHERE m.symbol = states.symbol)""",
    ),
    "te": (("emitted", "b"), "SELECT symbol, rn, b.ts, kind, direction, price, row_number() OVER (PARTITION BY symbol ORDER BY rn, part) - 1 AS seq FROM emitted JOIN b USING (symbol, rn)"),
    "cal": (("b",), "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM b)"),
    "calret": (("rets", "cal"), "SELECT symbol, pos, ret FROM rets JOIN cal USING (ts)"),
    "corrs": (
        ("te", "cal", "calret"),
        f"""SELECT e.symbol, e.ts, y.symbol AS other, CASE WHEN stddev_samp(x.ret) > 0 AND stddev_samp(y.ret) > 0 THEN corr(x.ret, y.ret) END AS c FROM (SELECT DISTINCT symbol, ts FROM te WHERE kind = 'buy') e JOIN cal USING (ts)
JOIN calret x ON x.symbol = e.symbol AND x.pos BETWEEN cal.pos - {LOOKBACK - 1} AND cal.pos JOIN calret y ON y.symbol <> e.symbol AND y.pos = x.pos WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "meets": (
        ("te",),
        """SELECT DISTINCT e.symbol, e.ts, h.symbol AS other FROM te e JOIN (SELECT symbol, ts, (SELECT min(s.ts) FROM te s WHERE s.symbol = t.symbol AND s.kind = 'sell' AND s.ts > t.ts) AS until FROM te t WHERE kind = 'buy') h
ON h.symbol <> e.symbol AND h.ts <= e.ts AND (h.until IS NULL OR h.until > e.ts) WHERE e.kind = 'buy'""",
    ),
}


def _sim(name: str, reject: bool, tag: str = "", slots: int = MAX_POSITIONS, threshold: float = THRESHOLD) -> None:
    bad = f"coalesce((SELECT list(other) FROM corrs{tag} k WHERE k.symbol = te{tag}.symbol AND k.ts = te{tag}.ts AND k.c >= {threshold}), [])" if reject else "[]::VARCHAR[]"
    _PIECES[f"o_{name}"] = ((f"te{tag}", *((f"corrs{tag}",) if reject else ())), f"SELECT *, {bad} AS bad, row_number() OVER (ORDER BY ts, kind = 'buy', symbol, seq) AS i FROM te{tag}")
    _PIECES[f"s_{name}"] = (
        (f"o_{name}",),
        f"""SELECT 0::BIGINT AS i, 1.0::DOUBLE AS cash, []::STRUCT(s VARCHAR, d VARCHAR, t TIMESTAMP, p DOUBLE, r BIGINT, z DOUBLE)[] AS held, 'none' AS act, NULL::STRUCT(s VARCHAR, d VARCHAR, t TIMESTAMP, p DOUBLE, r BIGINT, z DOUBLE) AS gone
UNION ALL SELECT i, CASE act WHEN 'buy' THEN cash - size WHEN 'sell' THEN cash + gone.z * (1 + CASE gone.d WHEN 'long' THEN price / gone.p - 1 ELSE 1 - price / gone.p END) ELSE cash END,
  CASE act WHEN 'buy' THEN list_append(held, {{'s': symbol, 'd': direction, 't': ts, 'p': price, 'r': rn, 'z': size}}) WHEN 'sell' THEN list_filter(held, lambda h: h.s <> symbol) ELSE held END, act, gone FROM (
    SELECT *, cash / nullif({slots} - len(held), 0) AS size, list_filter(held, lambda h: h.s = symbol)[1] AS gone,
      CASE WHEN kind = 'sell' THEN CASE WHEN list_contains(list_transform(held, lambda h: h.s), symbol) THEN 'sell' ELSE 'none' END
        WHEN list_contains(list_transform(held, lambda h: h.s), symbol) OR len(held) >= {slots} OR list_has_any(bad, list_transform(held, lambda h: h.s)) THEN 'none' ELSE 'buy' END AS act
    FROM (SELECT o.*, x.cash, x.held FROM s_{name} x JOIN o_{name} o ON o.i = x.i + 1))""",
    )
    _PIECES[f"t_{name}"] = (
        (f"s_{name}", f"o_{name}"),
        f"SELECT o.symbol, gone.d AS direction, gone.t AS entry_ts, o.ts AS exit_ts, gone.p AS entry_price, o.price AS exit_price, gone.z AS size, CASE gone.d WHEN 'long' THEN o.price / gone.p - 1 ELSE 1 - o.price / gone.p END AS profit, o.rn - gone.r AS bars FROM s_{name} JOIN o_{name} o USING (i) WHERE act = 'sell'",
    )


_sim("free", False)
_sim("gated", True)
_PIECES |= {
    "cashes": (("s_gated", "o_gated", "cal"), "SELECT cal.pos, cal.ts, coalesce((SELECT arg_max(s.cash, s.i) FROM s_gated s JOIN o_gated o USING (i) WHERE s.act <> 'none' AND o.ts <= cal.ts), 1.0) AS cash FROM cal"),
    "open": (("s_gated",), "SELECT h.s AS symbol, h.d AS direction, h.t AS entry_ts, NULL::TIMESTAMP AS exit_ts, h.p AS entry_price, h.z AS size FROM (SELECT unnest(held) AS h FROM s_gated WHERE i = (SELECT max(i) FROM s_gated))"),
    "marks": (
        ("t_gated", "open", "cal", "b"),
        """SELECT ts, sum(CASE direction WHEN 'long' THEN size * px / entry_price ELSE size * (2 - px / entry_price) END) AS value FROM (
  SELECT cal.ts, p.*, (SELECT arg_max(b.c, b.ts) FROM b WHERE b.symbol = p.symbol AND b.ts <= cal.ts) AS px
  FROM cal JOIN (SELECT symbol, direction, entry_ts, exit_ts, entry_price, size FROM t_gated UNION ALL SELECT * FROM open) p ON cal.ts >= p.entry_ts AND (p.exit_ts IS NULL OR cal.ts < p.exit_ts)) GROUP BY ts""",
    ),
    "curve0": (("cashes", "marks", "cal"), f"SELECT pos, ts, cash, cash + coalesce(value, 0) AS equity FROM cashes LEFT JOIN marks USING (ts) WHERE pos >= (SELECT least({WARMUP}, max(pos)) FROM cal)"),
    "curve": (("curve0",), "SELECT pos, ts, cash / first(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cash, equity / first(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM curve0"),
    "hold": (("b",), "SELECT ts, NULL::DOUBLE AS cash, c / first(c) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM b WHERE symbol = 'view'"),
}


def _periods(of: str, split: str = SPLIT) -> str:
    rows = "SELECT '{0}' AS period, ts, cash, equity FROM " + of
    return f"{rows.format('overall')} UNION ALL {rows.format('train')} WHERE ts <= TIMESTAMP '{split}' UNION ALL {rows.format('test')} WHERE ts >= TIMESTAMP '{split}'"


def _figures(of: str) -> tuple[tuple[str, ...], str]:
    return (
        (of,),
        f"""SELECT period, min(ts) AS s, max(ts) AS e, count(*) AS bars, arg_min(equity, ts) AS f, arg_max(equity, ts) AS z, stddev_samp(r) AS sd, floor(epoch(max(ts) - min(ts)) / 86400) / 365.25 AS years
FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY period ORDER BY ts) - 1 AS r FROM {of}) GROUP BY period""",
    )


_PIECES |= {"pc": (("curve",), _periods("curve")), "ph": (("hold",), _periods("hold"))}
_PIECES |= {"fc": _figures("pc"), "fh": _figures("ph")}


_GROWTH = "CASE period WHEN 'overall' THEN z ELSE z / f END"
_ANNUAL = f"(CASE WHEN years > 0 THEN pow({_GROWTH}, 1 / years) - 1 END)"
_VOL = "nullif(CASE WHEN years > 0 THEN sd * sqrt(bars / years) END, 0)"
_KNOWN = "(period = 'overall' OR (bars >= 2 AND f > 0))"


def _risk(of: str, where: str = "true", rate: float = 0.04) -> str:
    annual, vol = _ANNUAL, _VOL
    return (
        f"SELECT period, strftime(s, '%Y-%m-%d %H:%M:%S') AS \"start\", strftime(e, '%Y-%m-%d %H:%M:%S') AS \"end\", bars, round(z / f - 1, 5) AS period_return, round({annual}, 5) AS annualized_return, "
        f"round({vol}, 5) AS volatility, round(({annual} - {rate}) / {vol}, 5) AS sharpe_ratio FROM {of} WHERE {where} AND {_KNOWN}"
    )


def _outcome(unit: str, of: str = "pc") -> str:
    return (
        f"SELECT period, count(*) FILTER (d > 0) AS {unit}s_won, count(*) FILTER (d < 0) AS {unit}s_lost, count(*) FILTER (d = 0) AS {unit}s_flat FROM (SELECT period, e - lag(e) OVER (PARTITION BY period ORDER BY u) AS d "
        f"FROM (SELECT period, date_trunc('{unit}', ts) AS u, arg_max(equity, ts) AS e FROM {of} GROUP BY ALL)) GROUP BY period"
    )


def _geo(x: str) -> str:
    return f"round(exp(avg(ln(1 + {x}))) - 1, 6)"


def _trades(name: str) -> str:
    return f"SELECT symbol, direction, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_ts, strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(size, 6) AS trade_size, round(profit, 6) AS profit, bars AS duration_bars FROM t_{name}"


_ROWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars_build": (("b",), f"SELECT symbol, {_TS} AS ts, round(o, 6) AS open, round(h, 6) AS high, round(l, 6) AS low, round(c, 6) AS close, round(v, 6) AS volume FROM b"),
    "bars_daily_orders": (
        (),
        """SELECT o_orderpriority AS symbol, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS ts, round(first(o_totalprice ORDER BY o_orderkey), 6) AS open, round(max(o_totalprice), 6) AS high,
round(min(o_totalprice), 6) AS low, round(last(o_totalprice ORDER BY o_orderkey), 6) AS close, round(sum(1.0::DOUBLE), 6) AS volume FROM orders GROUP BY o_orderpriority, date_trunc('day', o_orderdate)""",
    ),
    "universe_topn": ((), "SELECT symbol, row_number() OVER (ORDER BY pos) AS rank FROM (SELECT 'T.' || (c_custkey % 40) AS symbol, min(c_custkey - 1) AS pos FROM customer GROUP BY 1) QUALIFY rank <= 25"),
    "store_roundtrip": (("b",), "SELECT symbol, count(*) AS bars, round(sum(c), 6) AS close_sum FROM b GROUP BY symbol"),
    "missing_symbols": (("b",), "SELECT DISTINCT symbol FROM b WHERE symbol = 'view'"),
    "pct_change": (("rets",), f"SELECT symbol, {_TS} AS ts, round(ret, 9) AS ret FROM rets"),
    "rolling_volatility": (("vols",), f"SELECT symbol, {_TS} AS ts, round(vol, 9) AS volatility FROM vols"),
    "stochastic": (("sto",), f"SELECT symbol, {_TS} AS ts, round(k, 6) AS stoch_k, round(d, 6) AS stoch_d FROM sto"),
    "rsi": (("osc",), f"SELECT symbol, {_TS} AS ts, round(rsi, 6) AS rsi FROM osc"),
    "candle_engulfing": (("cand",), f"SELECT symbol, {_TS} AS ts, CASE WHEN engulfing_up THEN 100 WHEN engulfing_down THEN -100 ELSE 0 END::BIGINT AS hit FROM cand"),
    "candlestick_signal_long": (("cand",), f"SELECT symbol, {_TS} AS ts, hammer OR engulfing_up OR morning_star OR three_white_soldiers AS hit FROM cand"),
    "candlestick_signal_short": (("cand",), f"SELECT symbol, {_TS} AS ts, shooting_star OR engulfing_down OR evening_star OR three_black_crows AS hit FROM cand"),
    "swing_highs": (("b",), f"SELECT symbol, {_TS} AS ts, round(lag(x, 5) OVER ({_W}), 6) AS swing FROM (SELECT symbol, ts, rn, CASE WHEN {_extreme('h', 5, 5, True)} THEN h END AS x FROM b)"),
    "swing_lows": (("b",), f"SELECT symbol, {_TS} AS ts, round(lag(x, 1) OVER ({_W}), 6) AS swing FROM (SELECT symbol, ts, rn, CASE WHEN {_extreme('l', 5, 1, False)} THEN l END AS x FROM b)"),
    "joint_extrema": (("trig_long", "trig_short", "b"), f"SELECT symbol, {_TS} AS ts, s.trigger AS highs, g.trigger AS lows FROM b JOIN trig_long g USING (symbol, rn) JOIN trig_short s USING (symbol, rn)"),
    "sr_levels": (("lev",), f"SELECT symbol, {_TS} AS ts, n AS n_levels, round(s, 6) AS sum_levels, round(above, 6) AS above, round(below, 6) AS below FROM lev"),
    "buy_chain_single": (("chain",), f"SELECT symbol, {_TS} AS ts, so AS hit FROM chain"),
    "buy_chain_two_stage": (("chain",), f"SELECT symbol, {_TS} AS ts, so AND coalesce(rn - max(CASE WHEN dv THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) <= 8, false) AS hit FROM chain"),
    "buy_chain_tied": (
        ("chain",),
        f"SELECT symbol, {_TS} AS ts, (cs AND coalesce(rn - max(CASE WHEN dv THEN rn END) OVER w <= 6, false)) OR (dv AND coalesce(rn - max(CASE WHEN cs THEN rn END) OVER w <= 6, false)) AS hit FROM chain WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)",
    ),
    "buy_chain_triple": (
        ("chain",),
        f"""SELECT a.symbol, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, a.so AND coalesce(a.rn - m.rn <= 10, false) AND coalesce(m.rn - m.dvrn <= 8, false) AS hit
FROM (SELECT *, max(CASE WHEN cs THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS csrn FROM chain) a LEFT JOIN (SELECT *, max(CASE WHEN dv THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS dvrn FROM chain) m ON m.symbol = a.symbol AND m.rn = a.csrn""",
    ),
    "buy_chain_divergence": (("full_long_d",), f"SELECT symbol, {_TS} AS ts, buy AS hit FROM full_long_d"),
    "divergence_trades": (("te_d",), "SELECT symbol, rn, kind, direction, round(price, 6) AS price, seq FROM te_d"),
    "ticker_events": (("te",), "SELECT symbol, rn, kind, direction, round(price, 6) AS price, seq FROM te"),
    "held_correlations": (("corrs", "meets"), f"SELECT symbol, {_TS} AS ts, other, round(c, 6) AS c FROM corrs JOIN meets USING (symbol, ts, other) WHERE c IS NOT NULL"),
    "simulate_trades": (("t_free",), _trades("free")),
    "correlation_gate": (("t_gated",), _trades("gated")),
    "cash_curve": (("cashes",), f"SELECT {_TS} AS ts, round(cash, 6) AS cash FROM cashes"),
    "interval_mark_to_market": (("marks",), f"SELECT {_TS} AS ts, round(value, 6) AS value FROM marks"),
    "equity_curve": (("curve",), f"SELECT {_TS} AS ts, round(cash, 6) AS cash, round(equity, 6) AS equity FROM curve"),
    "asof_ffill": (("b",), "SELECT a.symbol, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(s.c, 6) AS close FROM b a ASOF LEFT JOIN (SELECT * FROM b WHERE hour(ts) % 5 = 0) s ON s.symbol = a.symbol AND s.ts <= a.ts"),
    "risk_metrics": (("fc",), _risk("fc", "period = 'overall'")),
    "train_test_metrics": (("fc",), _risk("fc")),
    "benchmark_report": (("fh",), _risk("fh")),
    "outcomes_day": (("pc",), _outcome("day")),
    "outcomes_week": (("pc",), _outcome("week")),
    "outcomes_month": (("pc",), _outcome("month")),
    "trade_stats": (
        ("t_gated", "s_gated"),
        f"""SELECT count(*) AS trade_count, count(*) FILTER (profit > 0) AS trades_won, count(*) FILTER (profit <= 0) AS trades_lost, {_geo('profit')} AS average_profit, {_geo('profit * size')} AS average_profit_weighted,
{_geo('CASE WHEN profit > 0 THEN profit END')} AS average_win, {_geo('CASE WHEN profit <= 0 THEN profit END')} AS average_loss, round(avg(bars), 6) AS average_duration_bars, (SELECT max(len(held)) FROM s_gated) AS most_positions FROM t_gated""",
    ),
    "avg_invested": (("pc",), "SELECT period, round(avg(1 - cash / equity), 6) AS average_fraction_invested FROM pc GROUP BY period"),
    "benchmark_correlation": (
        ("pc", "ph"),
        """SELECT period, round(corr(x.r, y.r), 6) AS benchmark_correlation FROM (SELECT period, ts, equity / lag(equity) OVER (PARTITION BY period ORDER BY ts) - 1 AS r FROM pc) x
JOIN (SELECT period, ts, equity / lag(equity) OVER (PARTITION BY period ORDER BY ts) - 1 AS r FROM ph) y USING (period, ts) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY period HAVING count(*) >= 2""",
    ),
}
for _n in ("hammer", "shooting_star", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows"):
    _ROWS[f"candle_{_n}"] = (("cand",), f"SELECT symbol, {_TS} AS ts, {_n} AS hit FROM cand")
for _way in ("long", "short"):
    _ROWS[f"stochastic_crossover_{_way}"] = ((f"x_{_way}", "b"), f"SELECT symbol, {_TS} AS ts, hit FROM x_{_way} JOIN b USING (symbol, rn)")
    _ROWS[f"divergence_{_way}"] = (("b", f"div_{_way}"), f"SELECT b.symbol, {_TS} AS ts, d.rn IS NOT NULL AS hit FROM b LEFT JOIN div_{_way} d ON d.symbol = b.symbol AND d.rn = b.rn")
for _n, _way, _groups in (
    ("sell_indicator", "long", [["indicator"]]),
    ("sell_indicator_flexible", "long", [["flexible"]]),
    ("sell_margin", "long", [["margin"]]),
    ("sell_margin_short", "short", [["margin"]]),
    ("sell_support_resistance", "long", [["levels"]]),
    ("sell_support_resistance_short", "short", [["levels"]]),
    ("sell_time", "long", [["time"]]),
    ("sell_groups", "long", [["indicator", "margin"], ["margin", "levels"], ["time"]]),
):
    _ROWS[_n] = ((f"full_{_way}",), f"SELECT symbol, {_TS} AS ts, sold, round(price, 6) AS price FROM ({_sell(_way, _groups)})")


# Whole backtests: the engine's plan doesn't round its oscillators, so their means are summed here in
# the same order, and the crossover is judged on them as they are.
_PIECES |= {
    "k_own": (("raws",), f"SELECT *, CASE WHEN rn >= 6 THEN ({_prior('raw', 2)} + {_prior('raw', 1)} + raw) / 3 END AS k0 FROM raws"),
    "sto_own": (("k_own",), f"SELECT symbol, ts, rn, CASE WHEN rn >= 8 THEN k0 END AS k, CASE WHEN rn >= 8 THEN ({_prior('k0', 2)} + {_prior('k0', 1)} + k0) / 3 END AS d FROM k_own"),
    "osc_own": (("b", "sto_own", "vols"), "SELECT b.*, o.k, o.d, NULL::DOUBLE AS rsi, vols.vol FROM b JOIN sto_own o USING (symbol, rn) JOIN vols USING (symbol, rn)"),
}


def _watch(way: str) -> str:
    past, over, reached = ("k < 50", "k > d", "k > base + 10") if way == "long" else ("k > 50", "k < d", "k < base - 10")
    return f"""SELECT symbol, -1::BIGINT AS rn, NULL::BIGINT AS since, NULL::DOUBLE AS base, false AS hit FROM (SELECT DISTINCT symbol FROM osc_own)
UNION ALL
SELECT symbol, rn, CASE WHEN expired OR fire THEN NULL ELSE armed END, base, fire FROM (
  SELECT *, coalesce(NOT expired AND armed IS NOT NULL AND {over} AND {reached}, false) AS fire FROM (
    SELECT *, coalesce(rn - armed >= 10, false) AS expired FROM (
      SELECT o.symbol, o.rn, o.k, o.d, CASE WHEN x.since IS NULL AND {past.replace('k', 'o.k')} THEN o.rn ELSE x.since END AS armed, CASE WHEN x.since IS NULL THEN o.k ELSE x.base END AS base
      FROM watch_{way} x JOIN osc_own o ON o.symbol = x.symbol AND o.rn = x.rn + 1)))"""


#: Pieces that a strategy, and that a point of a grid, has of its own.
_OF_STRATEGY = ("flags", "states", "emitted", "te", "corrs")
_OF_POINT = ("cashes", "open", "marks", "curve0", "curve", "hold", "pc", "ph", "fc", "fh")


def _own(sql: str, names: dict[str, str]) -> str:
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: names[m[1]], sql)


def _strategy(tag: str, ways: tuple[str, ...], groups: list[list[str]]) -> None:
    for way in ways:
        _PIECES[f"watch_{way}"] = (("osc_own",), _watch(way))
        _PIECES[f"full_{way}{tag}"] = (
            ("osc_own", "lev", f"watch_{way}"),
            f"SELECT o.*, lev.above, lev.below, x.hit AS buy, max(CASE WHEN x.hit THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_buy FROM osc_own o JOIN lev USING (symbol, rn) JOIN watch_{way} x USING (symbol, rn)",
        )
        _PIECES[f"sells_{way}{tag}"] = ((f"full_{way}{tag}",), _sell(way, groups, tag))
    names = {n: n + tag for n in _OF_STRATEGY} | {f"{p}_{w}": f"{p}_{w}{tag}" for p in ("full", "sells") for w in ways}
    for n in _OF_STRATEGY:
        needs, sql = _PIECES[n]
        _PIECES[n + tag] = (tuple(names.get(x, x) for x in needs), _own(sql, names))
    if ways == ("long",):
        _PIECES[f"flags{tag}"] = (
            (f"full_long{tag}", f"sells_long{tag}"),
            f"SELECT symbol, rn, l.ts, l.c, l.buy AS bl, sl.sold AS sl, sl.price AS pl, false AS bs, false AS ss, NULL::DOUBLE AS ps FROM full_long{tag} l JOIN sells_long{tag} sl USING (symbol, rn)",
        )


def _point(tag: str, sim: str, warmup: int = WARMUP, split: str = SPLIT) -> None:
    names = {n: n + tag for n in _OF_POINT} | {f"{x}_gated": f"{x}_{sim}" for x in "sot"}
    for n in _OF_POINT:
        needs, sql = _PIECES[n]
        if n == "curve0":
            sql = sql.replace(f"least({WARMUP},", f"least({warmup},")
        _PIECES[n + tag] = (tuple(names.get(x, x) for x in needs), _own(sql.replace(SPLIT, split), names))


def _sharpe(of: str, period: str, rate: float = 0.04) -> str:
    return f"(SELECT ({_ANNUAL} - {rate}) / {_VOL} FROM {of} WHERE period = '{period}' AND {_KNOWN})"


_strategy("_d", ("long",), [["indicator"], ["time"]])
_PIECES["full_long_d"] = (
    ("osc", "lev", "x_long", "div_long"),
    f"""SELECT *, max(CASE WHEN buy THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_buy FROM (
SELECT osc.*, lev.above, lev.below, x.hit AND coalesce(rn - max(d.rn) OVER ({_W} ROWS UNBOUNDED PRECEDING) <= 10, false) AS buy
FROM osc JOIN lev USING (symbol, rn) JOIN x_long x USING (symbol, rn) LEFT JOIN div_long d USING (symbol, rn))""",
)
_strategy("_g", ("long",), [["margin"], ["time"]])
_GRID = [(t, n) for t in (0.0, 0.1, 0.9) for n in (2, 4)]
for _k, (_t, _n) in enumerate(_GRID):
    _sim(f"g{_k}", True, "_g", _n, _t)
    _point(f"_g{_k}", f"g{_k}")
_PIECES["ranked"] = (
    tuple(f"fc_g{k}" for k in range(len(_GRID))),
    " UNION ALL ".join(f"SELECT {k} AS combo_id, {_sharpe(f'fc_g{k}', 'train')} AS train_sharpe, {_sharpe(f'fc_g{k}', 'test')} AS test_sharpe" for k in range(len(_GRID))),
)
#: Points of the grid over risk settings, warm-up and split date: (rate, warm-up, split, benchmark).
RISK_GRID = [(0.0, 15, "2024-01-20", 0), (0.5, 15, "2024-01-20", 1), (0.04, 60, "2024-01-10", 2), (0.04, 15, "2024-01-10", 2)]
_sim("r", True, "_g", 4, 0.0)
for _k, (_, _warm, _split, _) in enumerate(RISK_GRID):
    _point(f"_r{_k}", "r", _warm, f"{_split} 00:00:00")
_strategy("_w", ("long", "short"), [["margin"], ["levels"], ["time60"]])
_sim("w", True, "_w", 4, 0.0)
_point("_w", "w")


def _geometric(x: str, digits: int = 6) -> str:
    return f"round(CASE WHEN min({x}) = -1 THEN -1 WHEN min({x}) > -1 THEN exp(avg(CASE WHEN {x} > -1 THEN ln(1 + {x}) END)) - 1 END, {digits})"


def _report() -> str:
    """All rows of one backtest: model and benchmark by period, without the random odds."""
    sides = []
    for series, f, p in (("model", "fc_w", "pc_w"), ("benchmark", "fh_w", "ph_w")):
        outcomes = " ".join(f"LEFT JOIN ({_outcome(u, p)}) USING (period)" for u in ("day", "week", "month"))
        sides.append(f"SELECT '{series}' AS series, * FROM ({_risk(f)}) {outcomes}")
    counted = ", ".join(f"{u}s_{w}" for u in ("day", "week", "month") for w in ("won", "lost", "flat"))
    figures = f'period, "start", "end", bars, period_return, annualized_return, volatility, sharpe_ratio, {counted}'
    span = "FROM fc_w f JOIN {0} ON {1} BETWEEN f.s AND f.e AND {1} >= (SELECT min(ts) FROM curve_w) GROUP BY period"
    profit, size = "t.profit", "t.size"
    trades = f"""SELECT period, count(*) AS trade_count, count(*) FILTER (profit > 0) AS trades_won, count(*) FILTER (profit <= 0) AS trades_lost, {_geometric(profit)} AS average_profit,
{_geometric(f'{profit} * {size}')} AS average_profit_weighted, {_geometric(f'(CASE WHEN {profit} > 0 THEN {profit} END)')} AS average_win, {_geometric(f'(CASE WHEN {profit} <= 0 THEN {profit} END)')} AS average_loss,
round(avg(t.bars), 6) AS average_duration_bars {span.format('t_w t', 't.entry_ts')}"""
    changed = "(SELECT o.ts, len(s.held) AS n FROM s_w s JOIN o_w o USING (i) WHERE s.act <> 'none') h"
    most = f"SELECT period, max(n) AS most_positions {span.format(changed, 'h.ts')}"
    held = f"SELECT period, coalesce(trade_count, 0) AS trade_count, coalesce(trades_won, 0) AS trades_won, coalesce(trades_lost, 0) AS trades_lost, average_profit, average_profit_weighted, average_win, average_loss, average_duration_bars, coalesce(most_positions, 0) AS most_positions FROM ({trades}) FULL JOIN ({most}) USING (period)"
    step = "SELECT period, ts, equity / lag(equity) OVER (PARTITION BY period ORDER BY ts) - 1 AS r FROM {0}"
    together = f"SELECT period, round(corr(x.r, y.r), 6) AS benchmark_correlation FROM ({step.format('pc_w')}) x JOIN ({step.format('ph_w')}) y USING (period, ts) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY period HAVING count(*) >= 2"
    traded = "trade_count, trades_won, trades_lost, average_profit, average_profit_weighted, average_win, average_loss, average_duration_bars, most_positions"
    nulls = ", ".join(f"NULL AS {c}" for c in traded.split(", "))
    return f"""SELECT 'model' AS series, {figures}, {traded}, average_fraction_invested, benchmark_correlation, benchmark_return FROM ({sides[0]})
LEFT JOIN ({held}) USING (period) LEFT JOIN (SELECT period, round(avg(1 - cash / equity), 6) AS average_fraction_invested FROM pc_w GROUP BY period) USING (period)
LEFT JOIN ({together}) USING (period) LEFT JOIN (SELECT period, annualized_return AS benchmark_return FROM ({_risk('fh_w')})) USING (period)
UNION ALL SELECT 'benchmark', {figures}, {nulls}, NULL, NULL, NULL FROM ({sides[1]})"""


_ROWS |= {
    "grid_rank": (("ranked",), "SELECT combo_id, round(train_sharpe, 5) AS train_sharpe, round(test_sharpe, 5) AS test_sharpe, row_number() OVER (ORDER BY round(train_sharpe, 9) DESC NULLS LAST, combo_id) AS rank FROM ranked"),
    "grid_sharpe_correlation": (("ranked",), "SELECT count(*) AS pairs, round(corr(train_sharpe, test_sharpe), 5) AS correlation FROM ranked WHERE train_sharpe IS NOT NULL AND test_sharpe IS NOT NULL"),
    "grid_risk": (
        tuple(f"{f}_r{k}" for k in range(len(RISK_GRID)) for f in ("fc", "fh")),
        " UNION ALL ".join(
            [f"SELECT {k} AS combo_id, 'model' AS series, {-1 - m} AS benchmark_id, * FROM ({_risk(f'fc_r{k}', rate=rate)})" for k, (rate, _, _, m) in enumerate(RISK_GRID)]
            + [f"SELECT {-1 - m}, 'benchmark', {-1 - m}, * FROM ({_risk(f'fh_r{k}', rate=rate)})" for k, (rate, _, _, m) in enumerate(RISK_GRID) if m == k]
        ),
    ),
    "backtest_report": (("fc_w", "fh_w", "pc_w", "ph_w", "curve_w", "t_w", "s_w", "o_w"), _report()),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _needed(_PIECES[n][0], seen)
            seen.append(n)
    return seen


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needs, rows) in _ROWS.items():
        order = _needed(needs, [])
        with_ = ",\n".join(f"{p} AS ({_PIECES[p][1]})" for p in order)
        out[name] = (f"WITH RECURSIVE {with_}\n" if order else "") + rows
    return out
