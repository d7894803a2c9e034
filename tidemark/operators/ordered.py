"""Order-dependent operators that do not put one series into one task.

A plain window by series key sends a whole series to one task, and a window
without a key sends the whole table there. The operators here sort by range
instead: rows go to range partitions by (key, order), so a key that holds a
third of the table is spread over a third of the partitions. Numbers within a
partition plus one offset per (key, partition) give exact global positions and
running sums. Only the offsets, at most keys + partitions rows, are windowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id: partition in the high bits, row in the low 33


def _sorted_by_range(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stage ``df`` sorted by range, with the range number and the row number in it."""
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = ranged.withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_range", F.shiftright("_m", _ROW_BITS).cast("int"))
    ranged = ranged.withColumn("_row", F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_m")
    return stage(ranged, "ordered")


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Join the offsets of each (key, range) to its rows.

    The offsets are staged first, so Spark knows their true size: below the
    session's limit it broadcasts them and the rows need no shuffle; above, it
    joins by shuffle.
    """
    return rows.join(stage(offsets, "offsets"), [*keys, "_range"])


def positions(
    df: DataFrame, keys: list[str], order: list[Column], pos: str = "pos", total: str = "n", counted: Column | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its series and the series length.

    ``order`` must be unique within a series. Rows with a NULL key are dropped.
    ``counted`` limits the length to the rows that meet it.
    """
    if keys:
        df = df.dropna(subset=keys)
    rows = _sorted_by_range(df, keys, order)
    size = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    per_range = rows.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_row").alias("_first"), size.alias("_size")
    )
    series = Window.partitionBy(*keys)
    before = series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_range",
        (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(series).alias(total),
    )
    out = _with_offsets(rows, offsets, keys)
    return out.withColumn(pos, F.col("_row") + F.col("_shift")).drop("_range", "_row", "_shift")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """Add, per weight, ``<name>_before`` (sum over earlier rows of the series) and ``<name>_total``."""
    if keys:
        df = df.dropna(subset=keys)
    weighted = df.select("*", *[w.alias(f"_w_{name}") for name, w in weights.items()])
    rows = _sorted_by_range(weighted, keys, order)
    per_range = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    series = Window.partitionBy(*keys)
    before = series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in weights],
        *[F.sum(f"_s_{n}").over(series).alias(f"{n}_total") for n in weights],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*", *[F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in weights]
    )
    out = _with_offsets(local, offsets, keys)
    for n in weights:
        out = out.withColumn(f"{n}_before", F.col(f"_b_{n}") + F.col(f"_l_{n}"))
    scratch = [f"_{kind}_{n}" for n in weights for kind in "wbl"]
    return out.drop("_range", "_row", *scratch)


def chunked(series: DataFrame, keys: list[str], chunk: int, halo: int, pos: str = "pos", total: str = "n") -> DataFrame:
    """Cut each positioned series into chunks of ``chunk`` rows for windowing.

    Each chunk also gets copies of the ``halo`` rows before it, flagged in
    ``_halo``. A window over (keys, ``_chunk``) that looks back at most
    ``halo`` rows then sees what a window over the whole series would see.
    Drop the copies with :func:`without_halo`.
    """
    home = F.floor(F.col(pos) / chunk)
    last = F.floor(F.least(F.col(pos) + halo, F.col(total) - 1) / chunk)
    copies = series.withColumn("_chunk", F.explode(F.sequence(home, last)))
    return copies.withColumn("_halo", F.col("_chunk") > home)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_chunk", "_halo")


SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 5 / SKETCH_ACCURACY


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one row per key.

    The built-in ``percentile`` gathers all distinct values of a group in one
    task. Here a sketch first brackets each quantile. One more pass then counts
    the values inside the brackets one by one and all others by the gap they
    lie in, so what is shuffled and ranked is about a thousandth of a large
    table. Should a wanted rank lie outside its bracket, all values are counted
    and ranked. Keys and value are staged once for all passes.
    """
    known = stage(df.where(F.col(value).isNotNull()).select(*keys, value), "values")
    points = sorted({q for p in probabilities for q in (max(p - SKETCH_MARGIN, 0.0), min(p + SKETCH_MARGIN, 1.0))})
    sketched = known.groupBy(*keys).agg(
        F.approx_percentile(value, points, SKETCH_ACCURACY).alias("_q"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    sketched = stage(sketched, "brackets")
    ranked = _rank(_counts_in_brackets(known, sketched, keys, value, probabilities, points), keys, ["_slot", value])
    found = stage(_pick(ranked, keys, value, probabilities, names), "quantiles")
    if not found.agg(F.max("_missed")).first()[0]:
        return found.drop("_missed")
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_slot", F.lit(1))
    return _pick(_rank(counts, keys, [value]), keys, value, probabilities, names).drop("_missed")


def _counts_in_brackets(known, sketched, keys, value, probabilities, points) -> DataFrame:
    """Rows per (key, slot, value): odd slots are brackets, even ones the gaps around them (value NULL)."""
    lows, highs = [], []
    for p in probabilities:
        low, high = max(p - SKETCH_MARGIN, 0.0), min(p + SKETCH_MARGIN, 1.0)
        lows.append(F.col("_min") if low == 0 else F.col("_q")[points.index(low)])
        highs.append(F.col("_max") if high == 1 else F.col("_q")[points.index(high)])
    if keys:
        joined = known.join(sketched, keys)
    else:
        one = sketched.select(F.struct("_q", "_min", "_max").alias("_one")).scalar()
        joined = known.select("*", one["_q"].alias("_q"), one["_min"].alias("_min"), one["_max"].alias("_max"))
    x = F.col(value)
    passed = sum(((high < x).cast("int") for high in highs), F.lit(0))
    entered = sum(((low <= x).cast("int") for low in lows), F.lit(0))
    inside = entered > passed
    slotted = joined.select(
        *keys, (passed * 2 + F.when(inside, 1).otherwise(0)).alias("_slot"), F.when(inside, x).alias(value)
    )
    return slotted.groupBy(*keys, "_slot", value).agg(F.count(F.lit(1)).alias("_cnt"))


def _rank(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return running_sums(counts, keys, [F.col(c) for c in order], {"_cnt": F.col("_cnt")})


def _pick(ranked: DataFrame, keys: list[str], value: str, probabilities: list[float], names: list[str]) -> DataFrame:
    """Interpolate between the values at the two ranks of each probability."""
    first, size = F.col("_cnt_before"), F.col("_cnt_total")
    picks, missed = [], F.lit(False)
    for p, name in zip(probabilities, names):
        place = F.lit(float(p)) * (size - 1)
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (first <= rank) & (rank < first + F.col("_cnt"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{end}"))
            missed = missed | (hit & (F.col("_slot") % 2 == 0))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    found = ranked.groupBy(*keys).agg(*picks, F.max(missed).alias("_missed"))
    between = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in names
    ]
    return found.select(*keys, *between, "_missed")


def ema_reach(span: int) -> int:
    """Rows after which an exponential average has forgotten its start in double precision.

    The weight left is exp(-44), about 8e-20, far below half a unit in the
    last place.
    """
    return math.ceil(44 / -math.log1p(-2 / (span + 1)))


def ema_chunk(spans: list[int], halo: int) -> int:
    """Chunk length that keeps the scaling factors of the running sums in range."""
    steepest = max(-math.log1p(-2 / (s + 1)) for s in spans)
    room = int(600 / steepest) - halo
    if room < 64:
        raise ValueError(f"spans {spans} differ too much for one pass; compute them in separate calls")
    return min(room, 8192)


def ema_columns(df: DataFrame, value: str, spans: dict[str, int], window, pos: str = "pos", more: list[Column] = ()) -> DataFrame:
    """Add exponential averages of ``value``, started at its first value.

    ``window`` partitions by (keys, ``_chunk``). The recurrence is solved in
    closed form: with a_j the share kept of the old average at row j and b_j
    the weight of its value, the average is A * sum(b_j x_j / A_j), where A_j
    is the running product of the a_j. At a missing value the old average is
    kept, and its weight shrinks with the length of the gap.

    ``more`` holds other window columns to compute in the second of the three
    steps. The column ``_age`` (rows since the first value) stays in the
    result for :func:`ema_after`.
    """
    if "_prev" not in df.columns:
        df = df.withColumn("_prev", previous_value_row(value, window, pos))
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(value)
    gap = F.col(pos) - F.col("_prev")
    started = F.col("_prev").isNotNull()
    shares, weights = {}, {}
    for name, span in spans.items():
        alpha = 2.0 / (span + 1)
        step = math.log1p(-alpha)
        kept = F.exp(gap * F.lit(step))
        shares[name] = (
            F.when(x.isNull() | ~started, 0.0).when(gap == 1, F.lit(step)).otherwise(gap * F.lit(step) - F.log(kept + alpha))
        )
        weights[name] = F.when(~started, 1.0).when(gap == 1, F.lit(alpha)).otherwise(F.lit(alpha) / (kept + alpha))
    out = df.select("*", *[share.alias(f"_a_{n}") for n, share in shares.items()])
    out = out.select(
        "*",
        F.count(F.when(started, 1)).over(upto).alias("_age"),
        *[F.sum(f"_a_{n}").over(upto).alias(f"_L_{n}") for n in spans],
        *more,
    )
    out = out.select("*", *[(weights[n] * x * F.exp(-F.col(f"_L_{n}"))).alias(f"_x_{n}") for n in spans])
    out = out.select("*", *[F.sum(f"_x_{n}").over(upto).alias(f"_S_{n}") for n in spans])
    out = out.select("*", *[(F.exp(F.col(f"_L_{n}")) * F.col(f"_S_{n}")).alias(n) for n in spans])
    return out.drop("_prev", *[f"_{k}_{n}" for n in spans for k in "axLS"])


def previous_value_row(value: str, window, pos: str = "pos") -> Column:
    """Position of the last earlier row that has a value."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col(value).isNotNull(), F.col(pos)), ignorenulls=True).over(earlier)


def ema_after(df: DataFrame, value: str, name: str, span: int, window) -> DataFrame:
    """Exponential average of a column that was made from other averages.

    Such a column has no missing values after its first, so the running
    product is a power of the row's ``_age`` and one window is enough.
    """
    alpha = 2.0 / (span + 1)
    fade = F.col("_age") * F.lit(math.log1p(-alpha))
    weight = F.when(F.col("_age") == 0, 1.0).otherwise(alpha)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_x", weight * F.col(value) * F.exp(-fade))
    out = out.withColumn("_S", F.sum("_x").over(upto))
    return out.withColumn(name, F.exp(fade) * F.col("_S")).drop("_x", "_S")
