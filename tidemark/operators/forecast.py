"""Monthly series, moving-average and Holt forecasts, and linear price forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators import holt
from tidemark.operators.bars import KEYS
from tidemark.operators.sales import monthly_total
from tidemark.staging import stage

BAND = 1.96


def dense_months(monthly: DataFrame, keys: list[str], month: str = "month", value: str = "y") -> DataFrame:
    """Every month from the first to the last of each series; a missing month counts 0.

    The monthly totals, one row per series and month, are staged: they are read
    more than once, and the lines behind them must not be.
    """
    monthly = stage(monthly.select(*keys, month, value), "months")
    span = monthly.groupBy(*keys).agg(F.min(month).alias("_lo"), F.max(month).alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias(month))
    joined = grid.join(monthly, [*keys, month], "left")
    return joined.select(*keys, month, F.coalesce(value, F.lit(0.0)).alias(value))


def _forecast_rows(levels: DataFrame, keys: list[str], periods: int, yhat: Column) -> DataFrame:
    """Future months of each series with a band of 1.96 sigma."""
    steps = levels.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    ahead = F.add_months(F.col("last_month"), F.col("step")).cast("timestamp_ntz")
    out = steps.withColumn("ds", ahead).withColumn("yhat", yhat)
    return out.select(
        *keys,
        "step",
        "ds",
        "yhat",
        (F.col("yhat") - BAND * F.col("sigma")).alias("yhat_lower"),
        (F.col("yhat") + BAND * F.col("sigma")).alias("yhat_upper"),
    )


def moving_average_levels(dense: DataFrame, keys: list[str], value: str = "y", month: str = "month") -> DataFrame:
    """Last mean of three months (mean of all if fewer) and the spread around it, per series.

    Series are months long, so a window per series is bounded by the calendar.
    """
    frame = Window.partitionBy(*keys).orderBy(month).rowsBetween(-2, 0)
    rolled = dense.withColumn("_roll", F.when(F.count(value).over(frame) == 3, F.avg(value).over(frame)))
    return rolled.groupBy(*keys).agg(
        F.coalesce(F.max_by("_roll", F.when(F.col("_roll").isNotNull(), F.col(month))), F.avg(value)).alias("level"),
        F.coalesce(F.stddev_pop(F.col(value) - F.col("_roll")), F.lit(0.0)).alias("sigma"),
        F.max(month).alias("last_month"),
        F.max_by(value, month).alias("last_value"),
    )


def moving_average_forecast(dense: DataFrame, keys: list[str], periods: int = 30, value: str = "y") -> DataFrame:
    """Flat forecast at the last three-month mean."""
    return _forecast_rows(moving_average_levels(dense, keys, value), keys, periods, F.col("level"))


def holt_levels(dense: DataFrame, keys: list[str], value: str = "y", month: str = "month", least: int = 4) -> DataFrame:
    """Holt fit per series; series shorter than ``least`` months keep the moving-average level."""
    gathered = dense.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(month, value))).alias("_s"), F.max(month).alias("last_month"),
        F.max_by(value, month).alias("last_value"),
    )
    # One row per series costs a fit each: dealt evenly, and not coalesced by size.
    tasks = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = gathered.where(F.size("_s") >= least).repartition(tasks)
    fitted = long.select(
        *keys, "last_month", "last_value", F.size("_s").alias("months"), holt.fit(F.col("_s")[value]).alias("_f")
    )
    # Staged: the fit is an expression of many folds, and the plan must not copy it per column.
    fitted = stage(fitted, "holt-fits")
    model = fitted.select(
        *keys, "last_month", "last_value", "months", "_f.alpha", (F.col("_f.alpha") * F.col("_f.share")).alias("beta"),
        "_f.level", "_f.trend", "_f.sse", "_f.sigma", F.lit("holt").alias("method"),
    )
    short = gathered.where(F.size("_s") < least).select(*keys, F.size("_s").alias("months"))
    simple = moving_average_levels(dense, keys, value, month)
    spare = simple.join(short, keys).select(
        *keys, "last_month", "last_value", "months",
        *[F.lit(None).cast("double").alias(c) for c in ("alpha", "beta")], "level", F.lit(0.0).alias("trend"),
        F.lit(None).cast("double").alias("sse"), "sigma", F.lit("moving_average").alias("method"),
    )
    return model.unionByName(spare)


def holt_forecast(dense: DataFrame, keys: list[str], periods: int = 30, value: str = "y") -> DataFrame:
    levels = holt_levels(dense, keys, value)
    return _forecast_rows(levels, keys, periods, F.col("level") + F.col("trend") * F.col("step"))


def sales_forecast(lines: DataFrame, periods: int = 30, measure: str = "sales", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Monthly history and Holt forecast of a measure, overall or per key; horizons are in months."""
    keys = list(keys or [])
    if not keys:
        lines, keys = lines.withColumn("series", F.lit("all")), ["series"]
    dense = dense_months(monthly_total(lines, measure, keys).withColumnRenamed(measure, "y"), keys)
    return dense, holt_forecast(dense, keys, periods)


def forecast_summary(forecast: DataFrame, dense: DataFrame, keys: list[str], value: str = "y", month: str = "month") -> DataFrame:
    """Mean, highest and lowest forecast, and growth of the last one over the last month seen."""
    last = dense.groupBy(*keys).agg(F.max_by(value, month).alias("last_value"))
    sums = forecast.groupBy(*keys).agg(
        F.avg("yhat").alias("avg_forecast"),
        F.max("yhat").alias("max_forecast"),
        F.min("yhat").alias("min_forecast"),
        F.max_by("yhat", "ds").alias("_end"),
    )
    joined = sums.join(last, keys)
    growth = ratio(F.col("_end") - F.col("last_value"), F.col("last_value")) * 100
    return joined.select(*keys, "avg_forecast", "max_forecast", "min_forecast", growth.alias("growth_pct"))


def history_plus_forecast(dense: DataFrame, forecast: DataFrame, keys: list[str], value: str = "y", month: str = "month") -> DataFrame:
    """History and forecast of each series as one table."""
    past = dense.select(*keys, F.lit("history").alias("part"), F.col(month).alias("ds"), F.col(value).alias("yhat"))
    future = forecast.select(*keys, F.lit("forecast").alias("part"), "ds", "yhat", "yhat_lower", "yhat_upper")
    return past.unionByName(future, allowMissingColumns=True)


def ols_fit(series: DataFrame, value: str = "close", pos: str = "pos") -> DataFrame:
    """Straight line of ``value`` on bar number per series, with the population deviation of its residuals.

    The sums are plain aggregates, so a long series is summed by many tasks.
    """
    known = series.where(F.col(value).isNotNull())
    sums = known.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("bars"),
        F.regr_sxx(value, pos).alias("_sxx"),
        F.regr_sxy(value, pos).alias("_sxy"),
        F.regr_syy(value, pos).alias("_syy"),
        F.avg(value).alias("_my"),
        F.avg(pos).alias("_mx"),
    )
    slope = F.coalesce(ratio(F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    fitted = sums.withColumn("slope", slope)
    return fitted.select(
        *KEYS,
        "bars",
        "slope",
        (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
        F.sqrt(rest / F.col("bars")).alias("resid_std"),
    )


def ols_forecast(series: DataFrame, horizon: int = 7, value: str = "close") -> DataFrame:
    """The line continued for ``horizon`` bars, spaced like the last two bars, with a 1.96 sigma band."""
    ends = series.where(F.col("pos") >= F.col("n") - 2).groupBy(*KEYS).agg(
        F.max("open_time").alias("_last"), F.min("open_time").alias("_before")
    )
    fit = ols_fit(series, value).join(ends, KEYS)
    spacing = F.timestamp_diff("SECOND", F.col("_before"), F.col("_last"))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = steps.withColumn("ds", F.timestamp_add("SECOND", (spacing * F.col("step")).cast("int"), F.col("_last")))
    out = out.withColumn("yhat", F.col("intercept") + F.col("slope") * (F.col("bars") - 1 + F.col("step")))
    return out.select(
        *KEYS,
        "step",
        "ds",
        "yhat",
        (F.col("yhat") - BAND * F.col("resid_std")).alias("yhat_lower"),
        (F.col("yhat") + BAND * F.col("resid_std")).alias("yhat_upper"),
    )
