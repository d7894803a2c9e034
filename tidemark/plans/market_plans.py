"""Registered market queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import volume_label as volume_text
from tidemark.operators import bars, correlation, forecast, indicators, insights, sales
from tidemark.plans.common import MARKET, TICKS, bars_sql, r, rounded, with_ctes
from tidemark.sources import files
from tidemark.sources.tables import table, ticks
from tidemark.staging import new_path, stage

PAIR = ["purchase", "view"]
KEYS = ["symbol", "bar", "open_time"]


def _bars(spark, d, bar="1h"):
    return bars.resample(ticks(spark, d), bar)


def _series(spark, d, *columns):
    """Hourly closes of every symbol (and other named values), numbered and so staged once for all readers."""
    return indicators.numbered(_bars(spark, d), columns=["close", *columns])


def _all(spark, d):
    return indicators.all_indicators(_series(spark, d))


def _all_sizes(spark, d):
    """Bars of all four sizes from one look at the ticks: the hourly ones, and the others rolled up from them."""
    hourly = stage(_bars(spark, d), "hourly")
    out = hourly
    for bar in list(C.BAR_SECONDS)[1:]:
        out = out.unionByName(bars.rollup(hourly, bar))
    return out


def ohlcv_resample(spark, d):
    """Bars of all four sizes from one tick table."""
    return rounded(_all_sizes(spark, d))


def klines_typed(spark, d):
    return rounded(files.parse_klines(bars.to_klines(_bars(spark, d))))


def klines_latest_n(spark, d):
    return rounded(bars.latest_bars(_all_sizes(spark, d)))


def _ticker(spark, d):
    return files.parse_ticker(bars.ticker_24h(ticks(spark, d)))


def ticker_kpi(spark, d):
    latest = bars.latest_row(_bars(spark, d), "close", "quote_volume")
    return rounded(bars.ticker_kpi(latest, _ticker(spark, d)))


def sink_roundtrip(spark, d):
    """Daily bars written as CSV by symbol, read back and typed."""
    path = new_path(spark, "bars-csv")
    files.write_csv(_bars(spark, d, "1d"), path, partition_by=["symbol"])
    back = files.read_csv_text(spark, path)
    numbers = ["open", "high", "low", "close", "volume", "quote_volume"]
    typed = back.select(
        "symbol", "bar", F.col("open_time").cast("timestamp_ntz").alias("open_time"),
        *[F.col(c).try_cast("double").alias(c) for c in numbers], F.col("trades").try_cast("bigint").alias("trades"),
    )
    return rounded(typed)


def bar_direction(spark, d):
    return bars.bar_direction(_bars(spark, d)).select(*KEYS, "open", "close", "is_up")


def moving_averages(spark, d):
    return rounded(indicators.moving_averages(_series(spark, d)).select(*KEYS, "ma20", "ma50"))


def ema20(spark, d):
    return rounded(indicators.ema(_series(spark, d), "close", {"ema20": 20}).select(*KEYS, "ema20"))


def rsi14(spark, d):
    return rounded(indicators.rsi(_series(spark, d)).select(*KEYS, "rsi"))


def macd(spark, d):
    return rounded(indicators.macd(_series(spark, d)).select(*KEYS, "macd", "macd_signal", "macd_hist"))


def bollinger(spark, d):
    return rounded(indicators.bollinger(_series(spark, d)).select(*KEYS, "bb_upper", "bb_mid", "bb_lower"))


def volatility(spark, d):
    return rounded(indicators.volatility(_series(spark, d)).select(*KEYS, "returns", "rolling_vol", "annualized_vol"))


INDICATORS = [
    "ma20", "ma50", "ema20", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_mid", "bb_lower",
    "returns", "rolling_vol", "annualized_vol",
]


def all_indicators(spark, d):
    return rounded(_all(spark, d).select(*KEYS, "close", *INDICATORS))


def normalized_returns(spark, d):
    return rounded(indicators.normalized_returns(_series(spark, d)).select(*KEYS, "normalized_return"))


def tail_bars(spark, d):
    return indicators.tail_bars(_series(spark, d)).select(*KEYS, "close")


def vol_change(spark, d):
    """From the latest volatility values on; older bars are dropped before any window."""
    return rounded(indicators.volatility_change(indicators.volatility(indicators.recent(_series(spark, d), 9))))


def returns_hist(spark, d):
    """Distribution of the percent returns of each symbol over 40 bins."""
    moves = indicators.returns(_series(spark, d)).select("symbol", (F.col("returns") * 100).alias("returns_pct"))
    return rounded(sales.histogram(moves, "returns_pct", 40, ["symbol"]))


def _aligned(spark, d):
    return correlation.aligned_returns(indicators.returns(_series(spark, d)), PAIR)


def _returns_sizes(spark, d):
    """Returns of two bar sizes."""
    hourly = stage(_bars(spark, d), "hourly")
    return indicators.returns(indicators.numbered(hourly.unionByName(bars.rollup(hourly, "4h")), columns=["close"]))


def _aligned_sizes(spark, d):
    """Aligned returns of two bar sizes."""
    return correlation.aligned_returns(_returns_sizes(spark, d), PAIR)


def aligned_returns(spark, d):
    return rounded(_aligned(spark, d))


def corr_matrix(spark, d):
    pairs = correlation.pair_table(spark, [(x, y) for x in PAIR for y in PAIR])
    return rounded(correlation.correlation_matrix(_returns_sizes(spark, d), pairs))


def corr_pairs(spark, d):
    """Correlation of every two neighbours in the list of symbols, for two bar sizes."""
    names = F.array_sort(F.collect_set("event_type"))
    listed = table(spark, d, "events").agg(names.alias("n")).select(F.arrays_zip("n", F.slice("n", 2, F.size("n")).alias("m")).alias("p"))
    pairs = listed.select(F.explode("p").alias("p")).select(F.col("p.n").alias("symbol_x"), F.col("p.m").alias("symbol_y"))
    return rounded(correlation.correlation_matrix(_returns_sizes(spark, d), pairs))


def rolling_corr(spark, d):
    return rounded(correlation.rolling_correlation(_aligned(spark, d), *PAIR).select("bar", "open_time", "rolling_corr"))


def corr_insight(spark, d):
    return rounded(correlation.correlation_insight(correlation.rolling_correlation(_aligned_sizes(spark, d), *PAIR), *PAIR))


def ols_fit(spark, d):
    return rounded(forecast.ols_fit(_series(spark, d)))


def ols_forecast(spark, d):
    return rounded(forecast.ols_forecast(_series(spark, d)))


def market_insights(spark, d):
    return insights.market_insights(indicators.all_indicators(indicators.recent(_series(spark, d))))


def market_kpis(spark, d):
    return rounded(insights.market_kpis(indicators.all_indicators(indicators.recent(_series(spark, d, "quote_volume"))), _ticker(spark, d)))


def volume_label(spark, d):
    """Quote volume of each weekly bar as text, and a thousand and a million times it."""
    weekly = _bars(spark, d, "1w")
    v = F.col("quote_volume")
    return weekly.select(
        "symbol", "open_time", volume_text(v).alias("volume"), volume_text(v * 1000).alias("volume_k"),
        volume_text(v * 1000000).alias("volume_m"),
    )


def _rolling(name: str, expression: str, n: int, count: str) -> str:
    return f"CASE WHEN COUNT({count}) OVER w{n} = {n} THEN {expression} OVER w{n} END AS {name}"


_WINDOWS = "WINDOW " + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (14, 20, 50)
) + ", w AS (PARTITION BY symbol ORDER BY open_time)"

_ROLLED = f"""SELECT *, {_rolling('ma20', 'AVG(close)', 20, 'close')}, {_rolling('ma50', 'AVG(close)', 50, 'close')},
  {_rolling('sd', 'STDDEV_SAMP(close)', 20, 'close')}, close - LAG(close) OVER w AS delta,
  close / NULLIF(LAG(close) OVER w, 0) - 1 AS returns FROM s {_WINDOWS}"""

_RSI = f"""SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / (1 + gain / NULLIF(loss, 0)) END AS rsi,
    rolling_vol * SQRT(252) AS annualized_vol
  FROM (SELECT *, {_rolling('gain', 'AVG(GREATEST(delta, 0) + delta * 0)', 14, 'delta')},
    {_rolling('loss', 'AVG(GREATEST(-delta, 0) + delta * 0)', 14, 'delta')},
    {_rolling('rolling_vol', 'STDDEV_SAMP(returns)', 20, 'returns')} FROM rolled {_WINDOWS})"""


def _alpha(span: int) -> str:
    return f"(CAST(2 AS DOUBLE) / {span + 1})"


def _step(span: int, value: str, old: str) -> str:
    return f"{_alpha(span)} * {value} + (1 - {_alpha(span)}) * {old}"


_EMA = {
    "e": f"""SELECT symbol, pos, close AS e20, close AS e12, close AS e26 FROM s WHERE pos = 0 UNION ALL
      SELECT s.symbol, s.pos, {_step(20, 's.close', 'e.e20')}, {_step(12, 's.close', 'e.e12')}, {_step(26, 's.close', 'e.e26')}
      FROM e JOIN s ON s.symbol = e.symbol AND s.pos = e.pos + 1""",
    "line": "SELECT symbol, pos, e20 AS ema20, e12 - e26 AS macd FROM e",
    "g": f"""SELECT symbol, pos, macd AS sig FROM line WHERE pos = 0 UNION ALL
      SELECT l.symbol, l.pos, {_step(9, 'l.macd', 'g.sig')} FROM g JOIN line l ON l.symbol = g.symbol AND l.pos = g.pos + 1""",
}
_ROLL = {**MARKET, "rolled": _ROLLED, "ind": _RSI}
_FULL = {
    **_ROLL,
    **_EMA,
    "ind_all": """SELECT i.*, l.ema20, l.macd, g.sig AS macd_signal, l.macd - g.sig AS macd_hist, ma20 AS bb_mid,
      ma20 + 2 * sd AS bb_upper, ma20 - 2 * sd AS bb_lower
      FROM ind i JOIN line l ON l.symbol = i.symbol AND l.pos = i.pos JOIN g ON g.symbol = i.symbol AND g.pos = i.pos""",
}
_K = "symbol, bar, open_time"


def _columns(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


_TICKER = """SELECT t.symbol, last(t.price ORDER BY t.ts, t.tick_id) AS last_price,
  ROUND((last(t.price ORDER BY t.ts, t.tick_id) / NULLIF(first(t.price ORDER BY t.ts, t.tick_id), 0) - 1) * 100, 3) AS change_pct,
  CAST(SUM(CAST(t.quote AS DECIMAL(28,8))) AS DOUBLE) AS quote
  FROM ticks t JOIN (SELECT symbol, MAX(ts) AS e FROM ticks GROUP BY symbol) m ON m.symbol = t.symbol
  WHERE t.ts > m.e - INTERVAL 24 HOUR GROUP BY t.symbol"""

_BAR_COLUMNS = f"{_K}, {_columns('open', 'high', 'low', 'close', 'volume', 'quote_volume')}, trades"
_RETURNS = "SELECT *, close / NULLIF(LAG(close) OVER (PARTITION BY symbol ORDER BY open_time), 0) - 1 AS returns FROM s"
_ALIGNED = f"""SELECT a.bar, a.open_time, a.returns AS {PAIR[0]}, b.returns AS {PAIR[1]} FROM ret a JOIN ret b
  ON a.open_time = b.open_time AND a.symbol = '{PAIR[0]}' AND b.symbol = '{PAIR[1]}'
  WHERE a.returns IS NOT NULL AND b.returns IS NOT NULL"""
_CORR = {**MARKET, "ret": _RETURNS, "al": _ALIGNED}
_A, _B = PAIR
_PAIR_CORR = f"covar_samp({{x}}, {{y}}){{w}} / NULLIF(stddev_samp({{x}}){{w}} * stddev_samp({{y}}){{w}}, 0)"
_SIZES = {
    "ticks": TICKS,
    "bars": f"{bars_sql('1h')} UNION ALL {bars_sql('4h')}",
    "ret": "SELECT *, close / NULLIF(LAG(close) OVER (PARTITION BY symbol, bar ORDER BY open_time), 0) - 1 AS returns FROM bars",
    "al": _ALIGNED.replace("ON a.open_time = b.open_time", "ON a.bar = b.bar AND a.open_time = b.open_time"),
    "rc": f"""SELECT bar, open_time, CASE WHEN COUNT(*) OVER w = 20 THEN {_PAIR_CORR.format(x=_A, y=_B, w=' OVER w')} END AS rolling_corr
      FROM al WINDOW w AS (PARTITION BY bar ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
}
_ROLLCORR = {
    **_CORR,
    "rc": f"""SELECT bar, open_time, CASE WHEN COUNT(*) OVER w = 20 THEN {_PAIR_CORR.format(x=_A, y=_B, w=' OVER w')} END AS rolling_corr
      FROM al WINDOW w AS (ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
}


def _message(name: str, **parts: str) -> str:
    badge, label, text = C.MARKET_TEXTS[name]
    body = "'" + text.replace("'", "''") + "'"
    for key, value in parts.items():
        body = f"replace({body}, '{{{key}}}', {value})"
    return f"{{'badge': '{badge}', 'label': '{label}', 'text': {body}}}"


def _one(x: str, n: int = 1) -> str:
    return f"printf('%.{n}f', {x})"


_RSI_PARTS = {"symbol": "replace(symbol, 'USDT', '')", "rsi": _one("rsi")}
_MA_PARTS = {"ma20": "format('{:,.0f}', ma20)", "ma50": "format('{:,.0f}', ma50)"}
_VOL = "annualized_vol * 100"
_RULES = [
    f"""CASE WHEN rsi > 70 THEN {_message('overbought', **_RSI_PARTS)} WHEN rsi < 30 THEN {_message('oversold', **_RSI_PARTS)}
      WHEN rsi IS NOT NULL THEN {_message('rsi_neutral', **_RSI_PARTS)} END""",
    f"""CASE WHEN macd > macd_signal AND (pm IS NULL OR pm <= ps) THEN {_message('cross_up')}
      WHEN macd < macd_signal AND (pm IS NULL OR pm >= ps) THEN {_message('cross_down')}
      WHEN macd_signal IS NOT NULL AND macd > 0 THEN {_message('trend_up', macd=_one('macd', 2))}
      WHEN macd_signal IS NOT NULL THEN {_message('trend_down', macd=_one('macd', 2))} END""",
    f"CASE WHEN ma20 > ma50 THEN {_message('golden', **_MA_PARTS)} WHEN ma20 <= ma50 THEN {_message('death', **_MA_PARTS)} END",
    f"CASE WHEN close > bb_upper THEN {_message('above_band')} WHEN close < bb_lower THEN {_message('below_band')} END",
    f"""CASE WHEN (bb_upper - bb_lower) / close * 100 < 5
      THEN {_message('narrow_band', width=_one('(bb_upper - bb_lower) / close * 100'))} END""",
    f"""CASE WHEN {_VOL} > 80 THEN {_message('high_vol', vol=_one(_VOL))} WHEN {_VOL} < 30
      THEN {_message('low_vol', vol=_one(_VOL))} END""",
]
_STATE = """SELECT *, LAG(macd) OVER (PARTITION BY symbol ORDER BY pos) AS pm, LAG(macd_signal) OVER (PARTITION BY symbol ORDER BY pos) AS ps
  FROM ind_all QUALIFY pos = n - 1"""

_LINE = """SELECT symbol, bar, COUNT(*) AS bars, regr_slope(close, pos) AS slope, regr_intercept(close, pos) AS intercept,
  sqrt(greatest(regr_syy(close, pos) - regr_slope(close, pos) * regr_sxy(close, pos), 0) / COUNT(*)) AS resid_std,
  MAX(open_time) AS last_time, MAX(open_time) - MAX(open_time) FILTER (pos = n - 2) AS gap FROM s GROUP BY symbol, bar"""

QUERIES = {
    "ohlcv_resample": (
        ohlcv_resample,
        with_ctes(
            f"SELECT {_BAR_COLUMNS} FROM ({' UNION ALL '.join(bars_sql(b) for b in C.BAR_SECONDS)})",
            ticks=TICKS,
        ),
    ),
    "klines_typed": (
        klines_typed,
        with_ctes(
            f"""SELECT {_BAR_COLUMNS}, open_time + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_time, '0' AS taker_buy_base,
            '0' AS taker_buy_quote, '0' AS ignore FROM bars""",
            ticks=TICKS,
            bars=bars_sql(),
        ),
    ),
    "klines_latest_n": (
        klines_latest_n,
        with_ctes(
            f"""SELECT {_BAR_COLUMNS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, bar ORDER BY open_time DESC) AS rn
            FROM ({' UNION ALL '.join(bars_sql(b) for b in C.BAR_SECONDS)}))
            WHERE rn <= CASE bar {' '.join(f"WHEN '{b}' THEN {n}" for b, n in C.BAR_LIMITS.items())} END""",
            ticks=TICKS,
        ),
    ),
    "ticker_kpi": (
        ticker_kpi,
        with_ctes(
            f"SELECT symbol, '1h' AS bar, {r('last_price')} AS price, {r('change_pct')} AS change_pct, {r('quote')} AS volume_24h FROM t",
            ticks=TICKS,
            t=_TICKER,
        ),
    ),
    "sink_roundtrip": (sink_roundtrip, with_ctes(f"SELECT {_BAR_COLUMNS} FROM bars", ticks=TICKS, bars=bars_sql("1d"))),
    "bar_direction": (
        bar_direction,
        with_ctes(f"SELECT {_K}, open, close, close >= open AS is_up FROM bars", ticks=TICKS, bars=bars_sql()),
    ),
    "moving_averages": (moving_averages, with_ctes(f"SELECT {_K}, {_columns('ma20', 'ma50')} FROM ind", **_ROLL)),
    "ema20": (
        ema20,
        with_ctes(
            f"SELECT {_K}, {_columns('ema20')} FROM s JOIN line l ON l.symbol = s.symbol AND l.pos = s.pos".replace("symbol, bar", "s.symbol, bar", 1),
            recursive=True,
            **MARKET,
            **_EMA,
        ),
    ),
    "rsi14": (rsi14, with_ctes(f"SELECT {_K}, {_columns('rsi')} FROM ind", **_ROLL)),
    "macd": (
        macd,
        with_ctes(f"SELECT {_K}, {_columns('macd', 'macd_signal', 'macd_hist')} FROM ind_all", recursive=True, **_FULL),
    ),
    "bollinger": (
        bollinger,
        with_ctes(
            f"SELECT {_K}, {r('ma20 + 2 * sd')} AS bb_upper, {r('ma20')} AS bb_mid, {r('ma20 - 2 * sd')} AS bb_lower FROM ind", **_ROLL
        ),
    ),
    "volatility": (volatility, with_ctes(f"SELECT {_K}, {_columns('returns', 'rolling_vol', 'annualized_vol')} FROM ind", **_ROLL)),
    "all_indicators": (
        all_indicators,
        with_ctes(f"SELECT {_K}, {_columns('close', *INDICATORS)} FROM ind_all", recursive=True, **_FULL),
    ),
    "normalized_returns": (
        normalized_returns,
        with_ctes(
            f"""SELECT {_K}, {r('(close / NULLIF(first(close) OVER (PARTITION BY symbol ORDER BY open_time), 0) - 1) * 100')}
            AS normalized_return FROM s""",
            **MARKET,
        ),
    ),
    "tail_bars": (tail_bars, with_ctes(f"SELECT {_K}, close FROM s WHERE pos >= n - 60", **MARKET)),
    "vol_change": (
        vol_change,
        with_ctes(
            f"""SELECT symbol, bar, {r('a')} AS latest_vol, {r('c')} AS vol_change_pp,
            CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END AS direction,
            CASE WHEN a > 60 THEN '{C.VOL_ELEVATED}' ELSE '{C.VOL_MODERATE}' END AS outlook
            FROM (SELECT symbol, bar, a, CASE WHEN cnt > 8 THEN a - b ELSE 0 END AS c FROM
              (SELECT symbol, bar, MAX(annualized_vol) FILTER (rn = 1) * 100 AS a, MAX(annualized_vol) FILTER (rn = 8) * 100 AS b, COUNT(*) AS cnt
               FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM ind WHERE annualized_vol IS NOT NULL)
               GROUP BY symbol, bar))""",
            **_ROLL,
        ),
    ),
    "returns_hist": (
        returns_hist,
        with_ctes(
            f"""SELECT symbol, bin, {r('MAX(lo) + (MAX(hi) - MAX(lo)) / 40.0::DOUBLE * (bin - 1)')} AS bin_from,
            {r('MAX(lo) + (MAX(hi) - MAX(lo)) / 40.0::DOUBLE * bin')} AS bin_to, COUNT(*) AS cnt
            FROM (SELECT symbol, CAST(LEAST(floor((x - lo) / (hi - lo) * 40) + 1, 40) AS INTEGER) AS bin, lo, hi FROM
              (SELECT symbol, x, MIN(x) OVER (PARTITION BY symbol) AS lo, MAX(x) OVER (PARTITION BY symbol) AS hi
               FROM (SELECT symbol, returns * 100 AS x FROM ret WHERE returns IS NOT NULL)))
            GROUP BY symbol, bin""",
            **MARKET,
            ret=_RETURNS,
        ),
    ),
    "aligned_returns": (aligned_returns, with_ctes(f"SELECT bar, open_time, {_columns(*PAIR)} FROM al", **_CORR)),
    "corr_matrix": (
        corr_matrix,
        with_ctes(
            " UNION ALL ".join(
                f"SELECT bar, '{x}' AS symbol_x, '{y}' AS symbol_y, {r(_PAIR_CORR.format(x=x, y=y, w=''))} AS corr FROM al GROUP BY bar"
                for x in PAIR
                for y in PAIR
            ),
            **_SIZES,
        ),
    ),
    "corr_pairs": (
        corr_pairs,
        with_ctes(
            f"""SELECT a.bar, x AS symbol_x, y AS symbol_y, {r(_PAIR_CORR.format(x='a.returns', y='b.returns', w=''))} AS corr
            FROM (SELECT s AS x, LEAD(s) OVER (ORDER BY s) AS y FROM (SELECT DISTINCT event_type AS s FROM events)) p
            JOIN ret a ON a.symbol = x JOIN ret b ON b.symbol = y AND b.bar = a.bar AND b.open_time = a.open_time
            WHERE a.returns IS NOT NULL AND b.returns IS NOT NULL GROUP BY a.bar, x, y""",
            **_SIZES,
        ),
    ),
    "rolling_corr": (rolling_corr, with_ctes(f"SELECT bar, open_time, {_columns('rolling_corr')} FROM rc", **_ROLLCORR)),
    "corr_insight": (
        corr_insight,
        with_ctes(
            f"""SELECT bar, {r('c')} AS latest_corr, k AS corr_class, CASE WHEN k = 'low' THEN 'badge-bullish' ELSE 'badge-neutral' END AS badge,
            replace(replace(CASE k """
            + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t) in C.CORRELATION_TEXTS.items())
            + f""" END, '{{a}}', '{_A}'), '{{b}}', '{_B}') AS insight FROM (SELECT bar, c, CASE WHEN c > 0.7 THEN 'high' WHEN c > 0.3
            THEN 'moderate' ELSE 'low' END AS k FROM (SELECT bar, COALESCE(arg_max(rolling_corr, open_time) FILTER (rolling_corr IS NOT NULL), 0) AS c FROM rc GROUP BY bar))""",
            **_SIZES,
        ),
    ),
    "ols_fit": (
        ols_fit,
        with_ctes(f"SELECT symbol, bar, bars, {_columns('slope', 'intercept', 'resid_std')} FROM lin", **MARKET, lin=_LINE),
    ),
    "ols_forecast": (
        ols_forecast,
        with_ctes(
            f"""SELECT symbol, bar, step, ds, {r('y')} AS yhat, {r('y - 1.96 * resid_std')} AS yhat_lower, {r('y + 1.96 * resid_std')} AS yhat_upper
            FROM (SELECT symbol, bar, CAST(step AS INTEGER) AS step, last_time + gap * CAST(step AS INTEGER) AS ds,
              intercept + slope * (bars - 1 + step) AS y, resid_std FROM lin, generate_series(1, 7) t(step))""",
            **MARKET,
            lin=_LINE,
        ),
    ),
    "market_insights": (
        market_insights,
        with_ctes(
            f"""SELECT symbol, bar, CAST(ord AS INTEGER) AS ord, m.badge AS badge, m.label AS label, m.text AS text FROM
            ({' UNION ALL '.join(f"SELECT symbol, bar, {i} AS ord, {rule} AS m FROM st WHERE n >= 30" for i, rule in enumerate(_RULES))})
            WHERE m IS NOT NULL""",
            recursive=True,
            **_FULL,
            st=_STATE,
        ),
    ),
    "market_kpis": (
        market_kpis,
        with_ctes(
            f"""SELECT s.symbol, s.bar, {r('t.last_price')} AS price, {r('t.change_pct')} AS change_pct, t.change_pct >= 0 AS is_up,
            {r('t.quote')} AS volume_24h, {r('annualized_vol * 100')} AS ann_vol_pct,
            CASE WHEN annualized_vol * 100 > 80 THEN 'High' WHEN annualized_vol * 100 < 30 THEN 'Low' ELSE 'Moderate' END AS vol_regime,
            {r('rsi')} AS rsi, CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_class,
            CASE WHEN macd > macd_signal THEN 'Bullish' ELSE 'Bearish' END AS macd_class, {_columns('macd', 'macd_signal')}
            FROM st s JOIN t ON t.symbol = s.symbol""",
            recursive=True,
            **_FULL,
            st=_STATE,
            t=_TICKER,
        ),
    ),
    "volume_label": (
        volume_label,
        with_ctes(
            "SELECT symbol, open_time, "
            + ", ".join(
                f"""CASE WHEN {v} >= 1e9 THEN '$' || printf('%.2f', {v} / 1e9) || 'B' WHEN {v} >= 1e6 THEN '$' || printf('%.2f', {v} / 1e6) || 'M'
                ELSE '$' || format('{{:,.0f}}', {v}) END AS {name}"""
                for name, v in (("volume", "quote_volume"), ("volume_k", "(quote_volume * 1000)"), ("volume_m", "(quote_volume * 1000000)"))
            )
            + " FROM bars",
            ticks=TICKS,
            bars=bars_sql("1w"),
        ),
    ),
}
