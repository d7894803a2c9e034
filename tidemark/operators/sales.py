"""Sales figures, trends, rankings and customer rollups.

All functions take sales lines (see :mod:`tidemark.sources.tables`). Sums are
partial per task before the shuffle, so a hot customer, product or region adds
no more than one row per task to it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import STATE_CODES
from tidemark.functions.bands import equal_width_bin
from tidemark.functions.numbers import AMOUNT, money_avg, money_sum, ratio
from tidemark.staging import stage
from tidemark.functions.text import dollars, grouped, percent, signed_percent
from tidemark.operators.cleaning import month_start


def filter_sales(
    df: DataFrame,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    regions: list[str] | None = None,
    categories: list[str] | None = None,
    segments: list[str] | None = None,
) -> DataFrame:
    """Closed date range and value lists; the end is midnight of its day.

    A one-ended range is no filter. An empty list keeps nothing; None keeps all.
    """
    if start is not None and end is not None:
        low, high = (F.lit(str(d)).cast("timestamp_ntz") for d in (start, end))
        df = df.where(F.col("order_date").between(low, high))
    for column, chosen in (("region", regions), ("category", categories), ("segment", segments)):
        if chosen is not None:
            df = df.where(F.col(column).isin(list(chosen)) if chosen else F.lit(False))
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()


def range_and_counts(df: DataFrame, kept) -> DataFrame:
    """First and last order date, all rows and rows that meet ``kept``, from one pass."""
    return df.agg(
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(kept).alias("filtered_rows"),
        F.date_format(F.min(F.when(kept, F.col("order_date"))), "MMM yyyy").alias("filtered_from"),
    )


def order_count(df: DataFrame):
    """Distinct orders, or rows where there is no order number."""
    return F.count_distinct("order_id") if "order_id" in df.columns else F.count(F.lit(1))


def _kpis(df: DataFrame, keys: list[str]) -> DataFrame:
    sums = df.groupBy(*keys).agg(
        money_sum("sales").alias("revenue"), order_count(df).alias("orders"), money_sum("profit").alias("profit")
    )
    return sums.select(
        *keys,
        "revenue",
        "orders",
        F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0)).alias("avg_order_value"),
        "profit",
        F.coalesce(ratio(F.col("profit"), F.col("revenue")) * 100, F.lit(0.0)).alias("margin_pct"),
    )


def executive_kpis(df: DataFrame, by: str | None = None) -> DataFrame:
    """Revenue, orders, order value, profit and margin, overall or per value of ``by``."""
    if by:
        return _kpis(df.where(F.col(by).isNotNull()), [by])
    return _kpis(df, [])


def kpi_labels(kpis: DataFrame) -> DataFrame:
    """The figures as display text."""
    return kpis.select(
        dollars("revenue").alias("total_revenue"),
        grouped("orders").alias("total_orders"),
        dollars("avg_order_value", 2).alias("avg_order_value"),
        percent(F.col("margin_pct") / 100).alias("profit_margin"),
    )


def yearly_sales(df: DataFrame) -> DataFrame:
    dated = df.where("order_date IS NOT NULL")
    return dated.groupBy(F.year("order_date").alias("year")).agg(money_sum("sales").alias("total_sales"))


def revenue_growth(df: DataFrame) -> DataFrame:
    """Growth between the last two years that have orders; no row values for a single year.

    The window runs over one row per year.
    """
    years = yearly_sales(df)
    by_year = Window.orderBy("year")
    steps = years.select(
        "year",
        F.col("total_sales").alias("revenue"),
        F.lag("year").over(by_year).alias("previous_year"),
        F.lag("total_sales").over(by_year).alias("previous_revenue"),
    )
    last = steps.orderBy(F.desc("year")).limit(1)
    growth = ratio(F.col("revenue") - F.col("previous_revenue"), F.col("previous_revenue"))
    return last.select(
        "year", "previous_year", "revenue", "previous_revenue", growth.alias("revenue_yoy"),
        signed_percent(growth).alias("revenue_yoy_label"),
    )


def monthly_total(df: DataFrame, measure: str = "sales", keys: list[str] | None = None) -> DataFrame:
    """Total of a measure per order month."""
    dated = df.dropna(subset=["order_date", *(keys or [])])
    return dated.groupBy(*(keys or []), month_start("order_date").alias("month")).agg(money_sum(measure).alias(measure))


def total_by(df: DataFrame, key: str, measure: str = "sales", descending: bool = False) -> DataFrame:
    """Total of a measure per key, ordered by it; rows without a key drop out."""
    totals = df.where(F.col(key).isNotNull()).groupBy(key).agg(money_sum(measure).alias("total"))
    return totals.orderBy(F.desc("total") if descending else F.asc("total"), key)


def top_by(df: DataFrame, key: str, measure: str = "sales", n: int = 10) -> DataFrame:
    """The ``n`` keys with the largest totals; ties go to the smaller key."""
    totals = df.where(F.col(key).isNotNull()).groupBy(key).agg(money_sum(measure).alias("total"))
    return totals.orderBy(F.desc("total"), key).limit(n)


def value_counts(df: DataFrame, key: str, share: bool = True) -> DataFrame:
    """Rows per value, most frequent first, with the percent of all counted rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    if share:
        # The counts are shuffled once; Spark reuses that shuffle for the total.
        total = counts.agg(F.sum("cnt")).scalar()
        counts = counts.withColumn("share_pct", ratio(F.col("cnt") * 100, total))
    return counts.orderBy(F.desc("cnt"), key)


def sales_by_state_code(df: DataFrame, measure: str = "sales") -> DataFrame:
    """Total per state with its postal code; places outside the lookup drop out.

    Sums first, then looks up, so the lookup runs once per state. Its 51 fixed
    entries are a map literal, which needs no join.
    """
    totals = df.where("state IS NOT NULL").groupBy("state").agg(money_sum(measure).alias("total"))
    lookup = F.create_map(*[F.lit(x) for item in STATE_CODES.items() for x in item])
    coded = totals.select("state", F.try_element_at(lookup, F.col("state")).alias("state_code"), "total")
    return coded.dropna(subset=["state_code"])


def grouping_sets_totals(df: DataFrame, dimensions: list[str], measure: str = "sales") -> DataFrame:
    """Totals by each of several dimensions from one scan."""
    columns = [F.col(d) for d in dimensions]
    sets = df.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("gid"), money_sum(measure).alias("total")
    )
    full = (1 << len(dimensions)) - 1
    which, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(dimensions):
        mine = F.col("gid") == full - (1 << (len(dimensions) - 1 - i))
        which = F.when(mine, F.lit(name)).otherwise(which)
        label = F.when(mine, F.col(name)).otherwise(label)
    return sets.select(which.alias("dimension"), label.alias("label"), "total").where("label IS NOT NULL")


def customer_rollup(df: DataFrame) -> DataFrame:
    """Distinct orders and revenue per customer; the name stands in for a missing id column."""
    key = "customer_id" if "customer_id" in df.columns else "customer_name"
    known = df.where(F.col(key).isNotNull())
    # Lines are summed per (customer, order) first, so one customer's lines are
    # spread over many tasks and the distinct count is a plain count.
    if "order_id" not in df.columns:
        return known.groupBy(key).agg(F.count("sales").alias("orders"), money_sum("sales").alias("revenue"))
    per_order = known.groupBy(key, "order_id").agg(F.sum(F.col("sales").cast(AMOUNT)).alias("s"))
    return per_order.groupBy(key).agg(
        F.count("order_id").alias("orders"), F.coalesce(F.sum("s").cast("double"), F.lit(0.0)).alias("revenue")
    )


def customer_kpis(df: DataFrame) -> DataFrame:
    """Share of customers with more than one order, mean value and number of customers."""
    return customer_rollup(df).agg(
        F.avg((F.col("orders") > 1).cast("int")).alias("repeat_rate"),
        money_avg("revenue").alias("avg_customer_value"),
        F.count(F.lit(1)).alias("customers"),
    )


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    rollup = customer_rollup(df)
    return rollup.orderBy(F.desc("revenue"), rollup.columns[0]).limit(n)


def customer_order_frequency(df: DataFrame, least: int = 1, n: int | None = 5) -> DataFrame:
    """Lines with an order number per customer, those with at least ``least``, most first."""
    keys = ["customer_id", "customer_name", "segment"]
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count("order_id").alias("total_orders"))
    out = counts.where(F.col("total_orders") >= least).orderBy(F.desc("total_orders"), "customer_id")
    return out.limit(n) if n else out


def customer_sales(df: DataFrame, n: int | None = 5) -> DataFrame:
    keys = ["customer_id", "customer_name", "segment"]
    sums = df.dropna(subset=keys).groupBy(*keys).agg(money_sum("sales").alias("total_sales"))
    out = sums.orderBy(F.desc("total_sales"), "customer_id")
    return out.limit(n) if n else out


def quarterly_sales(df: DataFrame, year: int) -> DataFrame:
    """Totals per quarter end of one year; quarters inside the span without sales count 0."""
    low, high = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    chosen = df.where((F.col("order_date") >= low) & (F.col("order_date") < high))
    start = F.date_trunc("quarter", F.col("order_date")).cast("date")
    sums = chosen.groupBy(start.alias("q")).agg(money_sum("sales").alias("total_sales"))
    span = sums.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 3 MONTHS"))).alias("q"))
    full = grid.join(sums, "q", "left")  # four rows at most
    end = F.last_day(F.add_months("q", 2)).cast("timestamp_ntz")
    out = full.select(end.alias("quarter_end"), F.coalesce("total_sales", F.lit(0.0)).alias("total_sales"))
    return out.orderBy(F.desc("total_sales"), "quarter_end")


def distinct_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    known = df.where(F.col(group).isNotNull())
    out = known.groupBy(group).agg(F.count_distinct(value).alias("total_count"))
    return out.orderBy(F.desc("total_count"), group)


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter(column).alias("distinct_values"))


def nonnull_counts(df: DataFrame, group: str) -> DataFrame:
    """Non-null cells of every other column per group."""
    known = df.where(F.col(group).isNotNull())
    return known.groupBy(group).agg(*[F.count(c).alias(c) for c in df.columns if c != group])


def processing_days(df: DataFrame) -> DataFrame:
    """Whole days from order to shipment, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", F.col("order_date"), F.col("ship_date"))
    return df.withColumn("processing_days", F.floor(micros / F.lit(86_400_000_000)).cast("int"))


def processing_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over the processing days.

    Lines are counted per day value first; the extremes and the bins come from
    that table, which is as long as the range of days. One scan.
    """
    days = processing_days(df).where("processing_days IS NOT NULL")
    counts = days.groupBy("processing_days").agg(F.count(F.lit(1)).alias("cnt"))
    every = Window.partitionBy()
    low, high = F.min("processing_days").over(every), F.max("processing_days").over(every)
    binned = counts.select(
        equal_width_bin(F.col("processing_days"), low, high, bins).alias("bin"), "cnt", low.alias("lo"), high.alias("hi")
    )
    return _bin_edges(binned, bins)


def histogram(df: DataFrame, value: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins of any column, per key if keys are named: extremes first, then one counting pass."""
    keys = list(keys or [])
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    ends = stage(known.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "extremes")
    if keys:
        marked = known.join(ends, keys)
    else:
        one = ends.select(F.struct("lo", "hi")).scalar()
        marked = known.select("v", one["lo"].alias("lo"), one["hi"].alias("hi"))
    binned = marked.select(*keys, equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), F.lit(1).alias("cnt"), "lo", "hi")
    return _bin_edges(binned, bins, keys)


def _bin_edges(binned: DataFrame, bins: int, keys: list[str] = ()) -> DataFrame:
    sums = binned.groupBy(*keys, "bin").agg(F.sum("cnt").alias("cnt"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double") / bins
    return sums.select(
        *keys,
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("lo") + width * F.col("bin")).alias("bin_to"),
        "cnt",
    )
