"""Indicator and correlation edge cases on tiny series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import correlation, forecast, indicators, insights
from tidemark.operators.bars import latest_bars

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, bar string, open_time timestamp_ntz, close double"


def bars(spark, values, symbol="s", bar="1h"):
    rows = [(symbol, bar, START + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("quote_volume", F.lit(1.0))


def series(spark, values, symbol="s"):
    return indicators.numbered(bars(spark, values, symbol))


def column(df, name):
    return [r[0] for r in df.orderBy("open_time").select(name).collect()]


def test_constant_close(spark):
    full = indicators.all_indicators(series(spark, [5] * 40))
    assert set(column(full, "rsi")) == {None}
    assert column(full, "rolling_vol")[-1] == 0 and column(full, "rolling_vol")[19] is None
    assert column(full, "macd")[-1] == pytest.approx(0, abs=1e-12)


def test_rising_close_has_rsi_100_from_row_15(spark):
    got = column(indicators.rsi(series(spark, range(1, 31))), "rsi")
    assert got[:14] == [None] * 14 and set(got[14:]) == {100.0}


def test_falling_close_has_rsi_0(spark):
    assert column(indicators.rsi(series(spark, range(40, 10, -1))), "rsi")[-1] == 0


def test_windows_not_full_are_null(spark):
    got = indicators.moving_averages(series(spark, range(19)))
    assert set(column(got, "ma20")) == {None}
    assert column(indicators.moving_averages(series(spark, range(20))), "ma20")[-1] == 9.5


def test_zero_close_gives_null_return(spark):
    got = column(indicators.returns(series(spark, [0, 2, 3])), "returns")
    assert got[:2] == [None, None] and got[2] == 0.5


def test_volatility_change_needs_nine_values(spark):
    values = [10 + (i * 7 % 5) for i in range(40)]
    long = indicators.volatility_change(indicators.volatility(series(spark, values))).first()
    vols = [v for v in column(indicators.volatility(series(spark, values)), "annualized_vol") if v is not None]
    assert long["vol_change_pp"] == pytest.approx((vols[-1] - vols[-8]) * 100)
    eight = values[:28]
    short = indicators.volatility_change(indicators.volatility(series(spark, eight))).first()
    assert short["vol_change_pp"] == 0 and short["direction"] == "decreased"


def test_latest_bars_keep_the_limit(spark):
    got = latest_bars(bars(spark, range(30)).unionByName(bars(spark, range(30), "t", "1d")), {"1h": 4, "1d": 6})
    assert {(r["symbol"], r["count"]) for r in got.groupBy("symbol").count().collect()} == {("s", 4), ("t", 6)}
    assert got.where("symbol = 's'").agg(F.min("close")).first()[0] == 26


def test_correlation_of_constant_returns_is_null_and_low(spark):
    rows = [("1h", START + dt.timedelta(hours=i), 0.1, float(i % 3)) for i in range(30)]
    aligned = spark.createDataFrame(rows, "bar string, open_time timestamp_ntz, a double, b double")
    rolled = correlation.rolling_correlation(aligned, "a", "b", 5)
    assert rolled.where("rolling_corr IS NOT NULL").count() == 0
    insight = correlation.correlation_insight(rolled, "a", "b").first()
    assert insight["latest_corr"] == 0 and insight["corr_class"] == "low"
    assert "a and b are diverging" in insight["insight"]


@pytest.mark.parametrize("noise,kind", [(0.0, "high"), (1.2, "moderate")])
def test_correlation_classes(spark, noise, kind):
    rows = []
    for i in range(60):
        x, e = math.sin(i * 1.7), math.cos(i * 2.9)
        rows.append(("1h", START + dt.timedelta(hours=i), x, x + noise * e))
    aligned = spark.createDataFrame(rows, "bar string, open_time timestamp_ntz, a double, b double")
    assert correlation.correlation_insight(correlation.rolling_correlation(aligned, "a", "b", 40), "a", "b").first()["corr_class"] == kind


def test_line_fit_and_forecast(spark):
    s = series(spark, [3 + 2 * i for i in range(10)])
    fit = forecast.ols_fit(s).first()
    assert (fit["slope"], fit["intercept"], fit["resid_std"]) == (pytest.approx(2), pytest.approx(3), pytest.approx(0, abs=1e-6))
    ahead = forecast.ols_forecast(s, 3).orderBy("step").collect()
    assert [round(r["yhat"], 6) for r in ahead] == [23, 25, 27]
    assert ahead[0]["ds"] == START + dt.timedelta(hours=10)


def test_rules_are_silent_below_thirty_bars_and_on_missing_input(spark):
    short = insights.market_insights(indicators.all_indicators(series(spark, range(1, 30))))
    assert short.count() == 0
    thirty = insights.market_insights(indicators.all_indicators(series(spark, range(1, 31)))).collect()
    labels = [r["label"] for r in thirty]
    assert labels[0] == "Overbought Signal" and "Golden Cross Zone" not in labels
    assert "RSI at 100.0" in thirty[0]["text"]


def test_symbol_suffix_is_dropped_in_texts(spark):
    got = insights.market_insights(indicators.all_indicators(series(spark, [10 + (i * 7 % 5) for i in range(60)], "BTCUSDT"))).first()
    assert got["text"].startswith("BTC RSI at ")


def test_listed_pairs_of_many_symbols(spark):
    """Two hundred symbols, some bars missing, against numpy; the plan has no column per symbol."""
    import numpy as np

    r = np.random.default_rng(1)
    moves = {f"s{k:03d}": {t: float(v) for t, v in enumerate(r.normal(size=40)) if r.random() < 0.9} for k in range(200)}
    rows = [("1h", START + dt.timedelta(hours=t), s, v) for s, own in moves.items() for t, v in own.items()]
    df = spark.createDataFrame(rows, "bar string, open_time timestamp_ntz, symbol string, returns double")
    pairs = sorted({(f"s{a:03d}", f"s{b:03d}") for a, b in r.integers(0, 200, (1000, 2)).tolist()})
    listed = spark.createDataFrame([*pairs, ("s000", "none"), (None, "s001"), ("s005", "s006"), ("s006", "s005")], "symbol_x string, symbol_y string")
    got = {(row["symbol_x"], row["symbol_y"]): row["corr"] for row in correlation.correlation_matrix(df, listed).collect()}
    assert set(got) == {*pairs, ("s005", "s006"), ("s006", "s005")}
    for x, y in [*pairs[::50], ("s005", "s006"), ("s006", "s005")]:
        both = sorted(set(moves[x]) & set(moves[y]))
        assert got[x, y] == pytest.approx(np.corrcoef([moves[x][t] for t in both], [moves[y][t] for t in both])[0, 1])
