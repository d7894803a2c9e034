"""Exact quantiles of many columns from two passes over their table.

The first pass sketches all columns at once, which gives each quantile a lower and an
upper bound a thousandth of the ranks apart. The second counts, per task, the values
below each pair of bounds and equal to either, and keeps the values strictly between
them. Only these few values are ranked, by range. No column is turned into rows, so a
row is read twice and never copied. A value that many rows share is a bound
itself and is counted, not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import SKETCH_ACCURACY, SKETCH_MARGIN, quantiles, running_sums
from tidemark.staging import stage


def column_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], names: list[str], figures: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key and column: keys, column_name, ``names``, with linear interpolation between ranks.

    NULL cells and rows with a NULL key do not count; a column without a value has NULL quantiles. ``figures`` are more
    aggregates over ``df``, taken in the first pass and kept as columns of every row.
    """
    df = df.dropna(subset=keys) if keys else df
    values = {c: F.col(f"`{c}`").cast("double") for c in columns}
    points = sorted({q for p in probabilities for q in (max(p - SKETCH_MARGIN, 0.0), min(p + SKETCH_MARGIN, 1.0))})
    sketches = []
    for j, c in enumerate(columns):
        sketches += [F.approx_percentile(values[c], points, SKETCH_ACCURACY).alias(f"_q{j}"), F.min(values[c]).alias(f"_min{j}"), F.max(values[c]).alias(f"_max{j}"), F.count(values[c]).alias(f"_n{j}")]
    more = [value.alias(name) for name, value in (figures or {}).items()]
    facts = stage(df.groupBy(*keys).agg(*sketches, *more), "sketches")
    bounds = {}
    for j in range(len(columns)):
        for i, p in enumerate(probabilities):
            low, high = p - SKETCH_MARGIN, p + SKETCH_MARGIN
            bounds[j, i] = (
                F.col(f"_min{j}") if low <= 0 else F.col(f"_q{j}")[points.index(low)],
                F.col(f"_max{j}") if high >= 1 else F.col(f"_q{j}")[points.index(high)],
            )
    counted = stage(_count(df, facts, keys, columns, values, bounds), "bracketed")
    found = stage(_pick(counted, facts, keys, columns, probabilities, names, bounds), "column-quantiles")
    if found.agg(F.max("_missed")).first()[0]:  # a rank beyond the sketch's promise: all values are ranked
        return _all_ranked(df, facts, keys, columns, probabilities, names, list(figures or {}))
    return found.join(facts.select(*keys, *(figures or {})), keys).drop("_missed") if keys else _beside(found.drop("_missed"), facts, list(figures or {}))


def _beside(found: DataFrame, facts: DataFrame, figures: list[str]) -> DataFrame:
    """Add the figures of the one row of ``facts``."""
    return found.select("*", *[facts.select(f"`{name}`").scalar().alias(name) for name in figures])


def _count(df: DataFrame, facts: DataFrame, keys: list[str], columns: list[str], values: dict[str, Column], bounds: dict) -> DataFrame:
    """Per key and task: numbers of values below, at and between the bounds of each quantile, and those between."""
    wanted = [c for c in facts.columns if c.startswith(("_q", "_min", "_max"))]
    rows = df.select(*keys, *[values[c].alias(f"_v{j}") for j, c in enumerate(columns)], F.spark_partition_id().alias("_task"))
    if keys:
        rows = rows.join(facts.select(*keys, *wanted), keys)
    else:
        one = facts.select(F.struct(*wanted).alias("one")).scalar()
        rows = rows.withColumn("_one", one).select("*", "_one.*").drop("_one")
    found = []
    for (j, i), (low, high) in bounds.items():
        x = F.col(f"_v{j}")
        found += [
            F.count_if(x < low).alias(f"_below{j}_{i}"), F.count_if(x == low).alias(f"_low{j}_{i}"),
            F.count_if((x == high) & (high > low)).alias(f"_high{j}_{i}"),
            F.collect_list(F.when((x > low) & (x < high), x)).alias(f"_in{j}_{i}"),
        ]
    return rows.groupBy(*keys, "_task").agg(*found)


def _pick(counted: DataFrame, facts: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], names: list[str], bounds: dict) -> DataFrame:
    """The values at the two ranks of each quantile, and the point between them."""
    sums = []
    for j, i in bounds:
        sums += [F.sum(f"_{part}{j}_{i}").alias(f"_{part}{j}_{i}") for part in ("below", "low", "high")]
        sums.append(F.sum(F.size(f"_in{j}_{i}")).alias(f"_size{j}_{i}"))
    totals = counted.groupBy(*keys).agg(*sums)
    joined = totals.join(facts, keys) if keys else totals.crossJoin(facts)  # one row each
    slots = []
    for (j, i), (low, high) in bounds.items():
        place = F.lit(float(probabilities[i])) * (F.col(f"_n{j}") - 1)
        slots.append(F.struct(
            F.lit(columns[j]).alias("column_name"), F.lit(j).alias("_j"), F.lit(i).alias("_i"), low.alias("_at_low"), high.alias("_at_high"),
            (F.floor(place) - F.col(f"_below{j}_{i}")).alias("_first"), (F.ceil(place) - F.col(f"_below{j}_{i}")).alias("_second"),
            (place - F.floor(place)).alias("_rest"), F.col(f"_low{j}_{i}").alias("_lows"), F.col(f"_size{j}_{i}").alias("_ins"), F.col(f"_high{j}_{i}").alias("_highs"),
            (F.col(f"_n{j}") > 0).alias("_some"),
        ))
    targets = stage(joined.select(*keys, F.inline(F.array(*slots))), "ranks")
    arrays = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), F.col(f"_in{j}_{i}").alias("_in")) for j, i in bounds])
    inside = counted.select(*keys, F.inline(arrays)).select(*keys, "_j", "_i", F.explode("_in").alias("_value"))
    slot = [*keys, "_j", "_i"]
    ranked = running_sums(inside.groupBy(*slot, "_value").agg(F.count(F.lit(1)).alias("_cnt")), slot, [F.col("_value")], {"_cnt": F.col("_cnt")})
    ranked = ranked.join(targets.select(*slot, "_first", "_second", "_lows"), slot)

    def held(rank: str) -> Column:
        at = F.col(rank) - F.col("_lows")
        return F.max(F.when((F.col("_cnt_before") <= at) & (at < F.col("_cnt_before") + F.col("_cnt")), F.col("_value")))

    held_values = ranked.groupBy(*slot).agg(held("_first").alias("_held_first"), held("_second").alias("_held_second"))
    whole = targets.join(held_values, slot, "left")

    def value(rank: str) -> Column:
        r, lows, ins = F.col(rank), F.col("_lows"), F.col("_ins")
        own = F.when(r < lows, F.col("_at_low")).when(r < lows + ins, F.col(f"_held{rank}")).when(r < lows + ins + F.col("_highs"), F.col("_at_high"))
        return F.when(r >= 0, own)

    low, high = value("_first"), value("_second")
    missed = F.col("_some") & (low.isNull() | high.isNull())
    each = whole.select(*keys, "column_name", "_j", "_i", (low + (high - low) * F.col("_rest")).alias("_x"), missed.alias("_missed"))
    picks = [F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(names)]
    return each.groupBy(*keys, "column_name").agg(*picks, F.max("_missed").alias("_missed"))


def _all_ranked(df: DataFrame, facts: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], names: list[str], figures: list[str]) -> DataFrame:
    """The same from a ranking of all values, one row per cell."""
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(keys, columns, "column_name", "_value")
    found = quantiles(long, [*keys, "column_name"], "_value", probabilities, names)
    return found.join(facts.select(*keys, *figures), keys) if keys else _beside(found, facts, figures)
