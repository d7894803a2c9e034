"""Order-dependent operators against pandas, with one key holding most rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import indicators, ordered
from tidemark.operators.bars import KEYS

START = dt.datetime(2024, 1, 1)


def skewed(rng, big=900, small=60):
    frames = []
    for symbol, n in (("hot", big), ("a", small), ("b", 3), ("c", 1)):
        hours = np.sort(rng.choice(np.arange(n * 2), n, replace=False))
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "bar": "1h",
                    "open_time": [START + dt.timedelta(hours=int(h)) for h in hours],
                    "close": rng.lognormal(3, 1, n),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def as_bars(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def pdf():
    return skewed(np.random.default_rng(3))


def collected(df, columns):
    out = df.select("symbol", "open_time", *columns).toPandas()
    return out.sort_values(["symbol", "open_time"]).reset_index(drop=True)


def by_symbol(pdf, function):
    parts = [function(g.sort_values("open_time")).assign(symbol=s) for s, g in pdf.groupby("symbol")]
    return pd.concat(parts).sort_values(["symbol", "open_time"]).reset_index(drop=True)


def same(got, want, columns, tolerance=1e-9):
    assert len(got) == len(want)
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=tolerance, atol=1e-9, err_msg=c)


def test_positions_number_each_series(spark, pdf, many_ranges):
    got = collected(indicators.numbered(as_bars(spark, pdf)), ["pos", "n"])
    want = by_symbol(pdf, lambda g: g.assign(pos=range(len(g)), n=len(g)))
    same(got, want, ["pos", "n"])


def test_a_hot_series_is_spread_over_tasks(spark, pdf, many_ranges):
    rows = ordered._sorted_by_range(as_bars(spark, pdf), KEYS, [F.col("open_time")])
    sizes = [r["count"] for r in rows.where("symbol = 'hot'").groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 900 / 2
    chunks = ordered.chunked(indicators.numbered(as_bars(spark, pdf)), KEYS, 100, 20)
    assert chunks.groupBy(*KEYS, "_chunk").count().agg(F.max("count")).first()[0] <= 120


def test_running_sums_match_cumsum(spark, many_ranges):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 500, p=[0.9, 0.1]), "o": rng.permutation(500), "w": rng.integers(0, 9, 500)})
    got = ordered.running_sums(spark.createDataFrame(pdf), ["k"], [F.desc("o")], {"w": F.col("w")}).toPandas()
    want = pdf.sort_values("o", ascending=False)
    want["before"] = want.groupby("k")["w"].cumsum() - want["w"]
    want["all"] = want.groupby("k")["w"].transform("sum")
    merged = got.merge(want, on=["k", "o"])
    assert len(merged) == 500
    assert (merged["w_before"] == merged["before"]).all() and (merged["w_total"] == merged["all"]).all()


def test_quantiles_match_pandas(spark, many_ranges):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 701, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 50, 701) / 3})
    probabilities = [0, 0.1, 0.25, 0.5, 0.77, 1]
    names = [f"q{i}" for i in range(len(probabilities))]
    df = spark.createDataFrame(pdf)
    got = ordered.quantiles(df, ["k"], "v", probabilities, names).toPandas().set_index("k").sort_index()
    whole = ordered.quantiles(df, [], "v", probabilities, names).toPandas()
    np.testing.assert_allclose(whole[names].to_numpy()[0], pdf["v"].quantile(probabilities).to_numpy(), rtol=1e-12)
    want = pdf.groupby("k")["v"].quantile(probabilities).unstack()
    np.testing.assert_allclose(got[names].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_brackets_hold_little_and_misses_fall_back(spark, many_ranges, monkeypatch):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 120_000, p=[0.7, 0.3]), "v": rng.lognormal(0, 2, 120_000)})
    df = spark.createDataFrame(pdf).repartition(8)
    names, probabilities = ["a", "b", "c"], [0.25, 0.5, 0.999]
    want = pdf.groupby("k")["v"].quantile(probabilities).unstack().to_numpy()

    ranked_rows = []
    whole_rank = ordered._rank
    monkeypatch.setattr(ordered, "_rank", lambda counts, *a: (ranked_rows.append(counts.count()), whole_rank(counts, *a))[1])

    def run():
        ranked_rows.clear()
        out = ordered.quantiles(df, ["k"], "v", probabilities, names).toPandas().set_index("k").sort_index()
        np.testing.assert_allclose(out[names].to_numpy(), want, rtol=1e-12)

    run()
    assert len(ranked_rows) == 1 and ranked_rows[0] < 1500
    # A bracket that misses its rank: the sketch is asked for the wrong places.
    monkeypatch.setattr(ordered.F, "approx_percentile", lambda v, points, accuracy: ordered.F.array(*[ordered.F.max(v)] * len(points)))
    run()
    assert len(ranked_rows) == 2 and ranked_rows[1] > 100_000


@pytest.mark.parametrize("span", [2, 9, 20, 26])
@pytest.mark.parametrize("chunk", [64, 150])
def test_ema_matches_pandas_for_any_chunk(spark, pdf, span, chunk, many_ranges):
    got = collected(indicators.ema(indicators.numbered(as_bars(spark, pdf)), "close", {"e": span}, chunk), ["e"])
    want = by_symbol(pdf, lambda g: g.assign(e=g["close"].ewm(span=span, adjust=False).mean()))
    same(got, want, ["e"], 1e-10)


def test_ema_carries_over_missing_values(spark):
    values = [None, 4.0, None, None, 7.0, 1.0, None, 3.0]
    rows = [("s", "1h", START + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    bars = spark.createDataFrame(rows, "symbol string, bar string, open_time timestamp_ntz, close double")
    got = collected(indicators.ema(indicators.numbered(bars), "close", {"e": 5}), ["e"])
    want = pd.Series(values, dtype=float).ewm(span=5, adjust=False).mean()
    np.testing.assert_allclose(got["e"].astype(float)[1:], want[1:], rtol=1e-12)
    assert pd.isna(got["e"][0])


def test_spans_too_far_apart_are_refused():
    with pytest.raises(ValueError):
        ordered.ema_chunk([3, 2000], ordered.ema_reach(2000))


def test_all_indicators_match_pandas(spark, many_ranges):
    pdf = skewed(np.random.default_rng(11), big=5200, small=80)

    def reference(g):
        close = g["close"]
        delta = close.diff()
        gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta.clip(upper=0)).rolling(14).mean()
        macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
        signal = macd.ewm(span=9, adjust=False).mean()
        sd = close.rolling(20).std()
        vol = close.pct_change().rolling(20).std()
        return g.assign(
            ma20=close.rolling(20).mean(), ma50=close.rolling(50).mean(), ema20=close.ewm(span=20, adjust=False).mean(),
            rsi=100 - 100 / (1 + gain / loss), macd=macd, macd_signal=signal, macd_hist=macd - signal,
            bb_upper=close.rolling(20).mean() + 2 * sd, bb_lower=close.rolling(20).mean() - 2 * sd,
            returns=close.pct_change(), rolling_vol=vol, annualized_vol=vol * np.sqrt(252),
        )

    columns = ["ma20", "ma50", "ema20", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "returns", "rolling_vol", "annualized_vol"]
    got = collected(indicators.all_indicators(indicators.numbered(as_bars(spark, pdf))), columns)
    same(got, by_symbol(pdf, reference), columns, 1e-7)


def test_chunked_window_equals_whole_window(spark, pdf, many_ranges):
    series = indicators.numbered(as_bars(spark, pdf))
    for chunk, halo in ((5, 17), (40, 6)):
        frame = Window.partitionBy(*KEYS, "_chunk").orderBy("open_time").rowsBetween(-halo, 0)
        cut = ordered.without_halo(ordered.chunked(series, KEYS, chunk, halo).withColumn("m", F.max("close").over(frame)))
        got = collected(cut, ["m"])
        want = by_symbol(pdf, lambda g, h=halo: g.assign(m=g["close"].rolling(h + 1, min_periods=1).max()))
        same(got, want, ["m"])


@pytest.mark.parametrize("margin", [None, 0.0])
def test_quantiles_of_many_columns_match_pandas(spark, many_ranges, monkeypatch, margin):
    """Ties, NULLs, one value only, no value at all; with bounds that miss the ranks all values are ranked instead."""
    import numpy as np
    import pandas as pd

    from tidemark.operators import brackets

    if margin is not None:
        monkeypatch.setattr(brackets, "SKETCH_MARGIN", margin)
        monkeypatch.setattr(brackets, "SKETCH_ACCURACY", 20)
    r = np.random.default_rng(2)
    n = 6000
    pdf = pd.DataFrame({
        "k": r.choice(["a", "b", "c"], n, p=[0.6, 0.39, 0.01]), "plain": r.normal(size=n), "tied": r.choice([1.0, 2.0, 2.5], n, p=[0.05, 0.9, 0.05]),
        "one": 7.0, "some nulls": np.where(r.random(n) < 0.3, np.nan, r.integers(0, 50, n)), "count": r.integers(0, 10**6, n).astype(float),
    })
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame([(*row, None) for row in rows], "k string, plain double, tied double, one double, `some nulls` double, count double, none double")
    df = df.repartition(8)
    probabilities, names = [0.0, 0.1, 0.5, 0.999, 1.0], ["p0", "p10", "p50", "p999", "p100"]
    columns = ["plain", "tied", "one", "some nulls", "count"]
    for keys in (["k"], []):
        got = brackets.column_quantiles(df, keys, [*columns, "none"], probabilities, names, {"rows": F.count(F.lit(1))}).collect()
        groups = pdf.groupby("k") if keys else [((), pdf)]
        want = {(*([k] if keys else []), c): [*g[c].quantile(probabilities).tolist(), len(g)] for k, g in groups for c in columns}
        for row in got:
            key = (*[row[k] for k in keys], row["column_name"])
            values = [row[c] for c in [*names, "rows"]]
            if row["column_name"] == "none":
                assert values[:-1] == [None] * 5
            else:
                assert values == pytest.approx(want.pop(key), rel=1e-12), key
        assert not want
