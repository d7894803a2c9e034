"""Bands with fixed edges, closed on the right; a missing value is the text 'nan'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import RISK_EDGES, RISK_LEVELS, TENURE_EDGES, TENURE_LABELS
from tidemark.functions.numbers import as_column


def risk_level(probability: Column | str) -> Column:
    p = as_column(probability)
    lowest, low, medium, high = RISK_EDGES
    return (
        F.when((p > lowest) & (p <= low), RISK_LEVELS[0])
        .when((p > low) & (p <= medium), RISK_LEVELS[1])
        .when((p > medium) & (p <= high), RISK_LEVELS[2])
        .otherwise("nan")
    )


def tenure_band(tenure: Column | str) -> Column:
    t = as_column(tenure).cast("double")
    first, second, third = TENURE_EDGES
    return (
        F.when(t <= first, TENURE_LABELS[0])
        .when(t <= second, TENURE_LABELS[1])
        .when(t <= third, TENURE_LABELS[2])
        .when(t > third, TENURE_LABELS[3])
        .otherwise("nan")
    )


def rank_band(rank: Column, n: Column, labels: list[str]) -> Column:
    """Equal-count band of 1-based rank ``rank`` among ``n`` rows.

    Band k is the smallest with (rank - 1) * q <= k * (n - 1).
    """
    q = len(labels)
    band = F.lit("nan")
    for k in range(q, 0, -1):
        band = F.when((rank - 1) * q <= F.lit(k) * (n - 1), F.lit(labels[k - 1])).otherwise(band)
    return F.when(rank.isNotNull(), band).otherwise("nan")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of equal width over [low, high]; the maximum is in the last bin."""
    step = F.floor(F.try_divide(value - low, high - low) * bins) + 1
    return F.least(F.coalesce(step, F.lit(1)), F.lit(bins)).cast("int")
