"""Technical indicators per series of bars.

Every function takes a frame from :func:`numbered` (positioned bars) and cuts
it with :func:`tidemark.operators.ordered.chunked`, so one long series is
worked on by many tasks. All windows of one indicator set share one
partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import VOL_ELEVATED, VOL_MODERATE
from tidemark.functions.numbers import as_column
from tidemark.operators.bars import KEYS
from tidemark.operators.ordered import (
    chunked,
    ema_after,
    ema_chunk,
    ema_columns,
    ema_reach,
    positions,
    previous_value_row,
    without_halo,
)
from tidemark.staging import stage

ROLLING_CHUNK = 4096
TRADING_DAYS = 252


def numbered(bars: DataFrame, keys: list[str] = KEYS, columns: list[str] | None = None) -> DataFrame:
    """Bars with their 0-based position (``pos``) and the series length (``n``).

    The sorted bars are staged; ``columns`` names the values worth keeping.
    """
    if columns is not None:
        bars = bars.select(*keys, "open_time", *columns)
    return positions(bars, keys, [F.col("open_time")])


def _pieces(keys: list[str] = KEYS):
    return Window.partitionBy(*keys, "_chunk").orderBy("open_time")


def rolling(value: Column | str, size: int, pieces, function=F.avg) -> Column:
    """Function over the last ``size`` rows; NULL unless all of them have a value."""
    value = as_column(value)
    frame = pieces.rowsBetween(-(size - 1), Window.currentRow)
    return F.when(F.count(value).over(frame) == size, function(value).over(frame))


# Window columns are made in steps: all columns of one step need only those of
# earlier steps, share one select and so one window operator. The helpers below
# give the columns of a step; the public functions put the steps together.


def _averages(pieces, sizes=(20, 50)) -> list[Column]:
    return [rolling("close", s, pieces).alias(f"ma{s}") for s in sizes]


def _previous_close(pieces) -> Column:
    return F.lag("close").over(pieces).alias("_before")


def _with_moves(df: DataFrame) -> DataFrame:
    """Change, its two sides, and return against the close before."""
    change = F.col("close") - F.col("_before")
    return df.select(
        "*",
        (F.try_divide("close", "_before") - 1).alias("returns"),
        F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))).alias("_up"),
        F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))).alias("_down"),
    ).drop("_before")


def _gain_and_loss(period: int, pieces) -> list[Column]:
    return [rolling("_up", period, pieces).alias("_gain"), rolling("_down", period, pieces).alias("_loss")]


def _with_rsi(df: DataFrame) -> DataFrame:
    value = 100 - 100 / (1 + F.try_divide("_gain", "_loss"))
    whole = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0).otherwise(value)
    return df.withColumn("rsi", whole).drop("_up", "_down", "_gain", "_loss")


def _spread(period: int, pieces, value: str = "close", name: str = "_sd") -> Column:
    return rolling(value, period, pieces, F.stddev_samp).alias(name)


def _with_bands(df: DataFrame, width: float) -> DataFrame:
    band = F.lit(float(width)) * F.col("_sd")
    return df.select("*", (F.col("bb_mid") + band).alias("bb_upper"), (F.col("bb_mid") - band).alias("bb_lower")).drop("_sd")


def _with_yearly(df: DataFrame, periods_per_year: int) -> DataFrame:
    return df.withColumn("annualized_vol", F.col("rolling_vol") * F.sqrt(F.lit(float(periods_per_year))))


def _with_signal(df: DataFrame, signal: int, pieces) -> DataFrame:
    out = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ema_after(out, "macd", "macd_signal", signal, pieces)
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def moving_averages(series: DataFrame, sizes=(20, 50)) -> DataFrame:
    cut = chunked(series, KEYS, ROLLING_CHUNK, max(sizes) - 1)
    return without_halo(cut.select("*", *_averages(_pieces(), sizes)))


def ema(series: DataFrame, value: str, spans: dict[str, int], chunk: int | None = None) -> DataFrame:
    """Exponential averages of ``value``, one column per span."""
    halo = max(ema_reach(s) for s in spans.values())
    chunk = chunk or ema_chunk(list(spans.values()), halo)
    return without_halo(ema_columns(chunked(series, KEYS, chunk, halo), value, spans, _pieces()).drop("_age"))


def rsi(series: DataFrame, period: int = 14) -> DataFrame:
    pieces = _pieces()
    out = _with_moves(chunked(series, KEYS, ROLLING_CHUNK, period).select("*", _previous_close(pieces)))
    return without_halo(_with_rsi(out.select("*", *_gain_and_loss(period, pieces))).drop("returns"))


def macd(series: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    pieces = _pieces()
    halo = ema_reach(max(fast, slow)) + ema_reach(signal)
    cut = chunked(series, KEYS, ema_chunk([fast, slow, signal], halo), halo)
    return without_halo(_with_signal(ema_columns(cut, "close", {"_fast": fast, "_slow": slow}, pieces), signal, pieces).drop("_age"))


def bollinger(series: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    pieces = _pieces()
    cut = chunked(series, KEYS, ROLLING_CHUNK, period - 1)
    return without_halo(_with_bands(cut.select("*", rolling("close", period, pieces).alias("bb_mid"), _spread(period, pieces)), width))


def volatility(series: DataFrame, size: int = 20, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    pieces = _pieces()
    out = _with_moves(chunked(series, KEYS, ROLLING_CHUNK, size).select("*", _previous_close(pieces)))
    out = out.select("*", _spread(size, pieces, "returns", "rolling_vol")).drop("_up", "_down")
    return without_halo(_with_yearly(out, periods_per_year))


def all_indicators(series: DataFrame, vol_window: int = 20, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Every indicator in one pass: one shuffle by (series, chunk), one sort, four window steps."""
    halo = max(ema_reach(26) + ema_reach(9), 50, vol_window + 1)
    pieces = _pieces()
    out = chunked(series, KEYS, ema_chunk([9, 12, 20, 26], halo), halo)
    before = previous_value_row("close", pieces).alias("_prev")
    out = out.select("*", *_averages(pieces), _spread(20, pieces), _previous_close(pieces), before)
    out = _with_moves(_with_bands(out.withColumn("bb_mid", F.col("ma20")), 2.0))
    second = [*_gain_and_loss(14, pieces), _spread(vol_window, pieces, "returns", "rolling_vol")]
    out = ema_columns(out, "close", {"ema20": 20, "_fast": 12, "_slow": 26}, pieces, more=second)
    out = _with_yearly(_with_rsi(out), periods_per_year)
    return without_halo(_with_signal(out, 9, pieces).drop("_age"))


def recent(series: DataFrame, size: int = 2, vol_window: int = 20) -> DataFrame:
    """The last ``size`` bars of each series and as many before them as any indicator remembers.

    Indicators of these last bars are, in double precision, those of the whole series.
    """
    reach = max(ema_reach(26) + ema_reach(9), 50, vol_window + 1)
    return series.where(F.col("pos") >= F.col("n") - (size + reach))


def returns(series: DataFrame, value: str = "close", keys: list[str] = KEYS) -> DataFrame:
    """Simple returns against the row before."""
    before = F.lag(value).over(_pieces(keys))
    return without_halo(chunked(series, keys, ROLLING_CHUNK, 1).withColumn("returns", F.try_divide(F.col(value), before) - 1))


def normalized_returns(series: DataFrame) -> DataFrame:
    """Percent change of each close since the first bar of its series.

    One row per series holds the first closes; staged, it is broadcast if it is
    small, and the bars are not shuffled by series.
    """
    first = series.where("pos = 0").select(*KEYS, F.col("close").alias("first_close"))
    joined = series.join(stage(first, "first"), KEYS)
    change = (F.try_divide("close", "first_close") - 1) * 100
    return joined.withColumn("normalized_return", change).drop("first_close")


def tail_bars(series: DataFrame, size: int = 60) -> DataFrame:
    """The last ``size`` bars of each series."""
    return series.where(F.col("pos") >= F.col("n") - size)


def volatility_change(indicators: DataFrame, lag: int = 7) -> DataFrame:
    """Change of annualised volatility in percentage points over the last ``lag`` bars.

    A series needs more than ``lag + 1`` volatility values; otherwise the change is 0.
    """
    known = indicators.where("annualized_vol IS NOT NULL").select(*KEYS, "open_time", "annualized_vol")
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("open_time"))
    last = known.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= lag + 2)
    picked = last.groupBy(*KEYS).agg(
        (F.max(F.when(F.col("_rn") == 1, F.col("annualized_vol"))) * 100).alias("latest_vol"),
        (F.max(F.when(F.col("_rn") == lag + 1, F.col("annualized_vol"))) * 100).alias("_old"),
        F.max("_rn").alias("_seen"),
    )
    before = F.when(F.col("_seen") > lag + 1, F.col("_old")).otherwise(F.col("latest_vol"))
    out = picked.withColumn("vol_change_pp", F.col("latest_vol") - before)
    return out.select(
        *KEYS,
        "latest_vol",
        "vol_change_pp",
        F.when(F.col("vol_change_pp") > 0, "increased").otherwise("decreased").alias("direction"),
        F.when(F.col("latest_vol") > 60, VOL_ELEVATED).otherwise(VOL_MODERATE).alias("outlook"),
    )
