"""Price bars: resampling from ticks, latest bars, ticker figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BAR_LIMITS, BAR_SECONDS
from tidemark.functions.numbers import AMOUNT, as_column, ratio
from tidemark.staging import stage

KEYS = ["symbol", "bar"]
_TEN_POW_19 = "10000000000000000000BD"


def tick_order(ts: str = "ts", tick_id: str = "tick_id") -> Column:
    """Time and then id as one decimal number.

    First and last price by a struct of the two would force a sort-based
    aggregation; a decimal keeps it hash-based and still breaks ties. It is
    projected once (:func:`with_tick_order`) for all aggregates that use it.
    """
    micros = f"cast(unix_micros(cast({ts} as timestamp)) as decimal(18,0))"
    return F.expr(f"cast({micros} * {_TEN_POW_19} + {tick_id} as decimal(38,0))")


def with_tick_order(ticks: DataFrame) -> DataFrame:
    """Ticks that count for bars, with their order number in ``_ord``."""
    priced = ticks.where("price IS NOT NULL AND symbol IS NOT NULL")
    return priced.withColumn("_ord", tick_order())


def bar_start(ts: Column | str, bar: str) -> Column:
    """Start of the bar that holds ``ts``; weeks start on Monday."""
    shift = "4 days" if bar == "1w" else "0 seconds"
    return F.window(as_column(ts), f"{BAR_SECONDS[bar]} seconds", f"{BAR_SECONDS[bar]} seconds", shift)["start"]


def bar_aggregates() -> list[Column]:
    return [
        F.min_by("price", "_ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_ord").alias("close"),
        F.count("price").cast("double").alias("volume"),
        F.coalesce(F.sum(F.col("quote").cast(AMOUNT)).cast("double"), F.lit(0.0)).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
    ]


def resample(ticks: DataFrame, bar: str) -> DataFrame:
    """Ticks to bars: one shuffle of partial sums, spread by symbol and bar start."""
    out = with_tick_order(ticks).groupBy("symbol", bar_start("ts", bar).alias("open_time")).agg(*bar_aggregates())
    return out.select(
        "symbol", F.lit(bar).alias("bar"), "open_time", "open", "high", "low", "close", "volume",
        "quote_volume", "trades",
    )


def rollup(bars: DataFrame, bar: str) -> DataFrame:
    """Bars of a finer size to bars of a coarser one that they fill, with no second look at the ticks."""
    out = bars.groupBy("symbol", bar_start("open_time", bar).alias("_start")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("quote_volume").cast(AMOUNT)).cast("double").alias("quote_volume"),
        F.sum("trades").alias("trades"),
    )
    return out.select(
        "symbol", F.lit(bar).alias("bar"), F.col("_start").alias("open_time"), "open", "high", "low", "close", "volume",
        "quote_volume", "trades",
    )


def to_klines(bars: DataFrame) -> DataFrame:
    """Bars as kline records: symbol, bar and a JSON array of twelve fields."""
    start = F.unix_millis(F.col("open_time").cast("timestamp"))
    seconds = F.create_map(*[F.lit(x) for item in BAR_SECONDS.items() for x in item])[F.col("bar")]
    text = [
        start.cast("string"),
        *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
        (start + seconds * 1000 - 1).cast("string"),
        F.col("quote_volume").cast("string"),
        F.col("trades").cast("string"),
        F.lit("0"), F.lit("0"), F.lit("0"),
    ]
    return bars.select("symbol", "bar", F.to_json(F.array(*text)).alias("value"))


def latest_bars(bars: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The latest bars of each series, as many as the bar size allows.

    The filter on the largest limit lets Spark cut each series before the
    shuffle, so a long series does not travel whole. A bar size without a limit
    of its own has the largest one.
    """
    limits = limits or BAR_LIMITS
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("open_time"))
    allowed = F.try_element_at(F.create_map(*[F.lit(x) for item in limits.items() for x in item]), F.col("bar"))
    most = max(limits.values())
    ranked = bars.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= most)
    return ranked.where(F.col("_rn") <= F.coalesce(allowed, F.lit(most))).drop("_rn")


def bar_direction(df: DataFrame) -> DataFrame:
    """Whether each bar closed at or above its open, and whether its MACD histogram is not negative."""
    out = df.withColumn("is_up", F.col("close") >= F.col("open"))
    return out.withColumn("hist_up", F.col("macd_hist") >= 0) if "macd_hist" in df.columns else out


def ticker_24h(ticks: DataFrame) -> DataFrame:
    """Last price, percent change and quote volume over each symbol's last 24 hours, as ticker JSON."""
    # One row per symbol, staged so that Spark knows its size: small, it is
    # broadcast and the ticks are not shuffled. The earliest start over all
    # symbols reaches the scan as a filter.
    ends = stage(ticks.groupBy("symbol").agg(F.max("ts").alias("end")), "ends")
    start = F.col("end") - F.expr("INTERVAL 24 HOURS")
    earliest = ends.agg(F.min(start)).scalar()
    recent = ticks.where(F.col("ts") > earliest).join(ends, "symbol").where(F.col("ts") > start)
    sums = with_tick_order(recent).groupBy("symbol").agg(
        F.min_by("price", "_ord").alias("first"),
        F.max_by("price", "_ord").alias("last"),
        F.sum(F.col("quote").cast(AMOUNT)).cast("double").alias("quote"),
    )
    change = (ratio(F.col("last"), F.col("first")) - 1) * 100
    fields = F.struct(
        F.col("last").cast("string").alias("lastPrice"),
        F.round(change, 3).cast("string").alias("priceChangePercent"),
        F.col("quote").cast("string").alias("quoteVolume"),
    )
    return sums.select("symbol", F.to_json(fields).alias("value"))


def ticker_kpi(latest: DataFrame, ticker: DataFrame) -> DataFrame:
    """Price, change and volume per series; the latest bar stands in for missing ticker fields."""
    joined = latest.join(ticker, "symbol", "left")
    return joined.select(
        *KEYS,
        F.coalesce("last_price", "close").alias("price"),
        F.coalesce("change_pct", F.lit(0.0)).alias("change_pct"),
        F.coalesce("quote_volume_24h", "quote_volume").alias("volume_24h"),
    )


def latest_row(bars: DataFrame, *columns: str) -> DataFrame:
    """The last bar of each series, from one aggregation."""
    return bars.groupBy(*KEYS).agg(*[F.max_by(c, "open_time").alias(c) for c in columns])
