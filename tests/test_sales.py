"""Sales operators on tiny tables: missing keys, ties, gaps, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, holt, sales


def lines(spark, rows):
    return spark.createDataFrame(
        [(o, dt.datetime.fromisoformat(d) if d else None, c, g, float(s), float(p)) for o, d, c, g, s, p in rows],
        "order_id long, order_date timestamp_ntz, customer_id long, region string, sales double, profit double",
    )


@pytest.fixture(scope="module")
def df(spark):
    return lines(
        spark,
        [(1, "2020-01-05", 10, "E", 100, 10), (1, "2020-01-05", 10, "W", 50, -5), (2, "2020-03-01T10:30:00", 10, None, 25, 1),
         (3, "2022-02-01", 11, "W", 50, 5), (None, None, 12, "N", 150, 0), (4, "2022-12-31T08:00:00", None, "E", 0, 0)],
    )


def test_kpis(df):
    row = sales.executive_kpis(df).first()
    assert (row["revenue"], row["orders"], row["profit"]) == (375.0, 4, 11.0)
    assert row["avg_order_value"] == pytest.approx(93.75) and row["margin_pct"] == pytest.approx(11 / 375 * 100)


def test_kpis_of_nothing(df):
    row = sales.executive_kpis(df.where("false")).first()
    assert tuple(row) == (0.0, 0, 0.0, 0.0, 0.0)


def test_growth_skips_missing_years(df):
    row = sales.revenue_growth(df).first()
    assert (row["year"], row["previous_year"]) == (2022, 2020)
    assert row["revenue_yoy"] == pytest.approx((50 - 175) / 175) and row["revenue_yoy_label"] == "-71.4%"


def test_growth_of_one_year_or_from_zero_is_null(spark, df):
    assert sales.revenue_growth(df.where("year(order_date) = 2020")).first()["revenue_yoy"] is None
    zero = lines(spark, [(1, "2020-01-01", 1, "E", 0, 0), (2, "2021-01-01", 1, "E", 5, 0)])
    assert sales.revenue_growth(zero).first()["revenue_yoy"] is None


def test_missing_keys_drop_out_and_ties_go_by_key(df):
    assert [tuple(r) for r in sales.total_by(df, "region").collect()] == [("E", 100.0), ("W", 100.0), ("N", 150.0)]
    assert [tuple(r) for r in sales.top_by(df, "region", n=2).collect()] == [("N", 150.0), ("E", 100.0)]
    counts = {r["region"]: (r["cnt"], r["share_pct"]) for r in sales.value_counts(df, "region").collect()}
    assert counts == {"E": (2, 40.0), "W": (2, 40.0), "N": (1, 20.0)}


def test_filter_end_is_midnight_and_empty_list_keeps_nothing(df):
    assert sales.filter_sales(df, "2020-01-05", "2020-03-01").count() == 2
    assert sales.filter_sales(df, "2020-01-05", None).count() == 6
    assert sales.filter_sales(df, regions=[]).count() == 0
    assert sales.filter_sales(df, regions=["W"]).count() == 2


def test_customers(df):
    rows = {r["customer_id"]: (r["orders"], r["revenue"]) for r in sales.customer_rollup(df).collect()}
    assert rows == {10: (2, 175.0), 11: (1, 50.0), 12: (0, 150.0)}
    kpi = sales.customer_kpis(df).first()
    assert kpi["repeat_rate"] == pytest.approx(1 / 3) and kpi["customers"] == 3 and kpi["avg_customer_value"] == 125
    assert [r["customer_id"] for r in sales.top_customers(df, 2).collect()] == [10, 12]
    by_name = df.select(F.col("customer_id").cast("string").alias("customer_name"), "sales")
    assert sales.customer_rollup(by_name).count() == 3


def test_quarters_fill_inner_gaps(spark):
    df = lines(spark, [(1, "2018-02-01", 1, "E", 5, 0), (2, "2018-11-30", 1, "E", 7, 0), (3, "2019-01-01", 1, "E", 9, 0)])
    got = [(r["quarter_end"].date().isoformat(), r["total_sales"]) for r in sales.quarterly_sales(df, 2018).collect()]
    assert got == [("2018-12-31", 7.0), ("2018-03-31", 5.0), ("2018-06-30", 0.0), ("2018-09-30", 0.0)]


def test_processing_days_round_down(spark):
    rows = [(dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 1, 12)), (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 4)), (None, dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "order_date timestamp_ntz, ship_date timestamp_ntz")
    assert [r["processing_days"] for r in sales.processing_days(df).collect()] == [-1, 3, None]
    bins = sales.processing_histogram(df, 4).orderBy("bin").collect()
    assert [(r["bin"], r["cnt"]) for r in bins] == [(1, 1), (4, 1)]


def test_histogram_of_one_value(spark):
    got = sales.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v", 40).collect()
    assert [(r["bin"], r["cnt"]) for r in got] == [(1, 2)]


def test_grouping_sets_equal_single_totals(df):
    got = {(r["dimension"], r["label"]): r["total"] for r in sales.grouping_sets_totals(df.withColumn("kind", F.lit("k")), ["region", "kind"]).collect()}
    assert got == {("region", "E"): 100.0, ("region", "W"): 100.0, ("region", "N"): 150.0, ("kind", "k"): 375.0}


def months(spark, rows, key="a"):
    return spark.createDataFrame([(key, dt.datetime.fromisoformat(m), float(y)) for m, y in rows], "k string, month timestamp_ntz, y double")


def test_month_gaps_count_zero(spark):
    dense = forecast.dense_months(months(spark, [("2020-01-01", 5), ("2020-04-01", 7)]), ["k"]).orderBy("month")
    assert [r["y"] for r in dense.collect()] == [5, 0, 0, 7]


@pytest.mark.parametrize("values,level,sigma", [([4], 4, 0), ([4, 8], 6, 0), ([3, 6, 9], 6, 0), ([3, 6, 9, 3], 6, 3)])
def test_moving_average_levels(spark, values, level, sigma):
    rows = [(f"2020-{i + 1:02d}-01", v) for i, v in enumerate(values)]
    row = forecast.moving_average_levels(months(spark, rows), ["k"]).first()
    assert row["level"] == pytest.approx(level) and row["sigma"] == pytest.approx(sigma)


def test_moving_average_forecast_dates(spark):
    got = forecast.moving_average_forecast(months(spark, [("2020-11-01", 3), ("2020-12-01", 5)]), ["k"], 3).orderBy("step").collect()
    assert [r["ds"] for r in got] == [dt.datetime(2021, m, 1) for m in (1, 2, 3)]
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in got)


def test_holt_follows_a_line_and_short_series_fall_back(spark):
    line = months(spark, [(f"2020-{i:02d}-01", 10 + 3 * i) for i in range(1, 13)])
    short = months(spark, [("2020-01-01", 4), ("2020-02-01", 8)], "b")
    got = forecast.holt_forecast(forecast.dense_months(line.unionByName(short), ["k"]), ["k"], 2)
    rows = {(r["k"], r["step"]): r["yhat"] for r in got.collect()}
    assert rows[("a", 1)] == pytest.approx(49, abs=1e-4) and rows[("a", 2)] == pytest.approx(52, abs=1e-4)
    assert rows[("b", 1)] == rows[("b", 2)] == 6


def test_holt_beats_the_moving_average_and_its_errors_replay(spark, small):
    from tidemark.plans.sales_plans import _monthly

    dense = _monthly(spark, small, "region")
    fits = {r["region"]: r for r in forecast.holt_levels(dense, ["region"]).collect()}
    flat = {r["region"]: r for r in forecast.moving_average_levels(dense, ["region"]).collect()}
    assert len(fits) == 5
    for region, fit in fits.items():
        assert fit["method"] == "holt" and 0 < fit["alpha"] <= 1 and 0 <= fit["beta"] <= fit["alpha"]
        assert fit["sse"] <= flat[region]["sigma"] ** 2 * fit["months"] * 2


def replayed(y, alpha, share, level, slope):
    total, errors = 0.0, []
    for value in y:
        errors.append(value - level - slope)
        old = level
        level = level + slope + alpha * errors[-1]
        slope = slope + share * (level - old - slope)
    return errors, level, slope


def best_start(y, alpha, share):
    """Least-squares start by a linear solve; errors are linear in the start."""
    import numpy as np

    base, by_level, by_slope = (np.array(replayed(v, alpha, share, l, b)[0]) for v, l, b in ((y, 0, 0), ([0] * len(y), 1, 0), ([0] * len(y), 0, 1)))
    return np.linalg.lstsq(np.column_stack([by_level, by_slope]), -base, rcond=None)[0]


@pytest.mark.parametrize("seed", range(4))
def test_holt_fit_against_a_plain_loop(spark, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    series = [3 + 2 * np.arange(n) * (seed % 2) + r.normal(0, 1 + seed, n).cumsum() * 5 for n in (4, 9, 40)] + [np.full(12, 7.0), np.zeros(6)]
    rows = spark.createDataFrame([(k, [float(v) for v in y]) for k, y in enumerate(series)], "k int, y array<double>")
    found = {row["k"]: row["f"] for row in rows.select("k", holt.fit(F.col("y")).alias("f")).collect()}
    for k, y in enumerate(series):
        fit = found[k]
        level, slope = best_start(y, fit["alpha"], fit["share"])
        errors, last, trend = replayed(y, fit["alpha"], fit["share"], level, slope)
        assert fit["sse"] == pytest.approx(np.square(errors).sum(), rel=1e-6, abs=1e-6)
        assert (fit["level"] + fit["trend"], fit["sigma"]) == pytest.approx((last + trend, np.std(errors)), rel=1e-4, abs=1e-4)
        coarse = []
        for alpha in np.linspace(0.05, 0.95, 10):
            for share in np.linspace(0, 0.9, 10):
                coarse.append(np.square(replayed(y, alpha, share, *best_start(y, alpha, share))[0]).sum())
        assert fit["sse"] <= min(coarse) * (1 + 1e-9) + 1e-9
