"""Display text for numbers: money, percent, volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_column


def fixed(value: Column | str, decimals: int) -> Column:
    """Fixed decimals without thousands marks, halves rounded to even."""
    return F.replace(F.format_number(as_column(value), decimals), F.lit(","), F.lit(""))


def grouped(value: Column | str, decimals: int = 0) -> Column:
    """Fixed decimals with thousands marks."""
    return F.format_number(as_column(value), decimals)


def dollars(value: Column | str, decimals: int = 0) -> Column:
    return F.concat(F.lit("$"), grouped(value, decimals))


def percent(share: Column | str, decimals: int = 1) -> Column:
    """0.123 becomes 12.3%."""
    return F.concat(fixed(as_column(share) * 100, decimals), F.lit("%"))


def signed_percent(share: Column | str, decimals: int = 1) -> Column:
    """0.123 becomes +12.3%."""
    share = as_column(share)
    sign = F.when(share >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, percent(share, decimals))


def volume_label(value: Column | str) -> Column:
    """Money with a B or M suffix from a billion or a million on."""
    value = as_column(value)
    return (
        F.when(value >= 1e9, F.concat(F.lit("$"), fixed(value / 1e9, 2), F.lit("B")))
        .when(value >= 1e6, F.concat(F.lit("$"), fixed(value / 1e6, 2), F.lit("M")))
        .otherwise(dollars(value))
    )


def fill(template: str, **parts: Column) -> Column:
    """Put columns into the {name} marks of a fixed text."""
    pieces = []
    rest = template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def letter_prefix(value: Column | str) -> Column:
    """First run of letters, NULL if there is none."""
    return F.nullif(F.regexp_extract(as_column(value), "([A-Za-z]+)", 1), F.lit(""))
