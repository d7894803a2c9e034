"""Return alignment and correlation between instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import CORRELATION_TEXTS
from tidemark.functions.numbers import corr_of
from tidemark.functions.text import fill
from tidemark.operators.indicators import ROLLING_CHUNK
from tidemark.operators.ordered import chunked, positions, without_halo
from tidemark.staging import literal_table, stage


def aligned_returns(with_returns: DataFrame, symbols: list[str]) -> DataFrame:
    """One row per bar time at which every named symbol has a return, one column per symbol.

    A conditional aggregation in place of a self-join: one scan, one shuffle.
    """
    wanted = with_returns.where(F.col("symbol").isin(symbols) & F.col("returns").isNotNull())
    wide = wanted.groupBy("bar", "open_time").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col("returns"))).alias(s) for s in symbols]
    )
    return wide.dropna("any", subset=symbols)


def pair_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """A listed handful of pairs as a table (symbol_x, symbol_y)."""
    return literal_table(spark, pairs, ["symbol_x", "symbol_y"])


def correlation_matrix(with_returns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation of the listed pairs (symbol_x, symbol_y) per bar size, over the bars at which both have a return.

    The returns of a bar are gathered by symbol once; each listed pair then adds to its
    co-moments in the task that holds the bar, and only these are shuffled. The plan is the same for any
    number of symbols and pairs. A pair listed in both orders is computed once; a
    pair of a symbol that never trades with the other is left out, a NULL pair too.
    """
    pairs = stage(pairs.select("symbol_x", "symbol_y").dropna().distinct(), "wanted-pairs")
    first, second = F.least("symbol_x", "symbol_y"), F.greatest("symbol_x", "symbol_y")
    wanted = pairs.select(first.alias("a"), second.alias("b")).distinct()
    named = wanted.select(F.col("a").alias("symbol")).union(wanted.select("b")).distinct()
    known = with_returns.where(F.col("returns").isNotNull()).join(named, "symbol", "left_semi")
    by_time = known.groupBy("bar", "open_time").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "returns"))).alias("_of"))
    listed = wanted.agg(F.collect_list(F.struct("a", "b"))).scalar()
    each = by_time.select("bar", "_of", F.explode(listed).alias("_pair")).select(
        "bar", "_pair.a", "_pair.b", F.try_element_at("_of", F.col("_pair.a")).alias("_x"), F.try_element_at("_of", F.col("_pair.b")).alias("_y")
    )
    found = each.where("_x IS NOT NULL AND _y IS NOT NULL").groupBy("bar", "a", "b").agg(corr_of(F.col("_x"), F.col("_y")).alias("corr"))
    joined = pairs.join(found, (first == F.col("a")) & (second == F.col("b")))
    return joined.select("bar", "symbol_x", "symbol_y", "corr")


def rolling_correlation(aligned: DataFrame, a: str, b: str, size: int = 20) -> DataFrame:
    """Correlation of two return series over the last ``size`` aligned bars."""
    series = positions(aligned.select("bar", "open_time", a, b), ["bar"], [F.col("open_time")])
    frame = Window.partitionBy("bar", "_chunk").orderBy("open_time").rowsBetween(-(size - 1), Window.currentRow)
    cut = chunked(series, ["bar"], ROLLING_CHUNK, size - 1)
    value = F.when(F.count(F.lit(1)).over(frame) == size, corr_of(F.col(a), F.col(b), frame))
    return without_halo(cut.withColumn("rolling_corr", value))


def correlation_insight(rolled: DataFrame, a: str, b: str) -> DataFrame:
    """Per bar size the latest known rolling correlation (0 if none), its class and the text for it."""
    seen = F.when(F.col("rolling_corr").isNotNull(), F.col("open_time"))
    latest = rolled.groupBy("bar").agg(F.max_by("rolling_corr", seen).alias("c"))
    value = F.coalesce("c", F.lit(0.0))
    kind = F.when(value > 0.7, "high").when(value > 0.3, "moderate").otherwise("low")

    def text(name: str):
        return fill(CORRELATION_TEXTS[name][1], a=F.lit(a), b=F.lit(b))

    out = latest.select("bar", value.alias("latest_corr"), kind.alias("corr_class"))
    name = F.col("corr_class")
    return out.select(
        "*",
        F.when(name == "high", CORRELATION_TEXTS["high"][0]).when(name == "moderate", CORRELATION_TEXTS["moderate"][0])
        .otherwise(CORRELATION_TEXTS["low"][0]).alias("badge"),
        F.when(name == "high", text("high")).when(name == "moderate", text("moderate")).otherwise(text("low")).alias("insight"),
    )
