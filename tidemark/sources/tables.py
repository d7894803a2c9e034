"""Business views on the given parquet tables.

``sales_lines`` is one row per sold item, ``ticks`` one row per price event,
``customers`` one row per customer with the attributes the churn operators
read. Each view joins and reads only what the asked columns need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import STATE_CODES
from tidemark.functions.numbers import AMOUNT, no_nan
from tidemark.operators.scoring import churn_score

_FOREIGN_STATE = "Ontario"  # not in the map lookup, so the lookup has something to drop
_STATE_OF_NATION = sorted(STATE_CODES)[:24]

_FROM_LINE = {"order_id", "ship_date", "quantity", "sales", "profit"}
_FROM_ORDER = {"order_date", "ship_mode", "order_code", "order_status"}
_FROM_CUSTOMER = {"customer_name", "segment"}
_FROM_NATION = {"state"}
_FROM_REGION = {"region"}
_FROM_PART = {"category", "sub_category", "product_name"}
SALES_COLUMNS = [
    "order_id", "order_code", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name",
    "segment", "state", "region", "category", "sub_category", "product_name", "quantity", "sales", "profit",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_lines(spark: SparkSession, sf_dir: str, *columns: str, total: tuple[str, ...] = ()) -> DataFrame:
    """Sales lines with the asked columns (all by default).

    Measures named in ``total`` are summed exactly per part and order number, as
    far as these are needed, before any join: for totals by an attribute, sums
    are shuffled and joined instead of lines.

    Dimension keys are unique, so the left joins keep every line once and a
    dimension no column needs is left out. Catalyst picks the join types from
    table sizes: region and nation are fixed at 5 and 25 rows, the others are
    broadcast only below the session's size limit.
    """
    wanted = list(columns) or SALES_COLUMNS
    need = set(wanted)
    geo = bool(need & (_FROM_NATION | _FROM_REGION))
    customer = geo or bool(need & _FROM_CUSTOMER)
    order = customer or "customer_id" in need or bool(need & _FROM_ORDER)

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 0.9 * F.col("l_extendedprice")).alias("profit"),
    )
    if total:
        keys = ["l_partkey"] * bool(need & _FROM_PART) + ["order_id"] * order
        lines = lines.groupBy(*keys).agg(*[F.sum(F.col(m).cast(AMOUNT)).alias(m) for m in total])
    out = lines
    if need & _FROM_PART:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            F.col("p_name").alias("product_name"),
        )
        out = out.join(part, "l_partkey", "left")
    if order:
        head = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_orderpriority").alias("ship_mode"),
            order_code().alias("order_code"),
        )
        if customer:
            head = head.join(_customer_dimension(spark, sf_dir, geo), "customer_id", "left")
        out = out.join(head, "order_id", "left")
    return out.select(*wanted)


def order_code():
    """Order number with a letter prefix for two of the three order states."""
    prefix = F.when(F.col("o_orderstatus") == "O", "CA-").when(F.col("o_orderstatus") == "F", "US-").otherwise("")
    return F.concat(prefix, F.col("o_orderkey").cast("string"))


def _customer_dimension(spark: SparkSession, sf_dir: str, geo: bool) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("n_nationkey"),
    )
    if not geo:
        return customer.drop("n_nationkey")
    names = F.array(*[F.lit(s) for s in _STATE_OF_NATION])
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.col("n_regionkey").alias("r_regionkey"),
        F.coalesce(F.try_element_at(names, F.col("n_nationkey") + 1), F.lit(_FOREIGN_STATE)).alias("state"),
    )
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    places = nation.join(region, "r_regionkey", "left").drop("r_regionkey")
    return customer.join(places, "n_nationkey", "left").drop("n_nationkey")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price events: symbol, ts, tick_id, price, quote (price times units)."""
    return as_ticks(table(spark, sf_dir, "events"))


def as_ticks(events: DataFrame) -> DataFrame:
    units = F.get_json_object("props", "$.k").try_cast("double")
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("tick_id"),
        no_nan("value").alias("price"),
        (no_nan("value") * units).alias("quote"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: plan, payment, tenure, charges, tickets and a churn label.

    The plan is taken to begin with the latest order. Orders and events are
    summed per customer before the join, so a customer with very many orders
    costs no more than any other.
    """
    orders = table(spark, sf_dir, "orders")
    end = orders.agg(F.max("o_orderdate").alias("end")).scalar()
    # Latest order day and, on a tie, the larger priority digit, in one number
    # (a number keeps the aggregation hash-based).
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    latest = F.max(day * 10 + F.substring("o_orderpriority", 1, 1).cast("int"))
    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        latest.alias("latest"),
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("o_totalprice")).alias("avg_order"),
    )
    errors = (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )
    joined = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_mktsegment")
        .join(per_customer, "c_custkey", "left")
        .join(errors, "c_custkey", "left")
    )
    start = F.date_from_unix_date(F.floor(F.col("latest") / 10).cast("int"))
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    digit = F.pmod(F.col("latest"), F.lit(10))
    shaped = joined.select(
        F.col("c_custkey").alias("customerID"),
        F.greatest(months, F.lit(1)).cast("int").alias("tenure"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "Month-to-month")
        .when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "One year")
        .otherwise("Two year")
        .alias("Contract"),
        F.when(digit <= 2, "Electronic check")
        .when(digit == 3, "Credit card")
        .when(digit == 4, "Bank transfer")
        .otherwise("Mailed check")
        .alias("PaymentMethod"),
        F.round(F.col("avg_order") / 3500, 2).alias("MonthlyCharges"),
        F.coalesce("errors", F.lit(0)).cast("int").alias("SupportTickets"),
    )
    draw = F.pmod(F.col("customerID") * 7919 + 13, F.lit(1000)) / 1000.0
    return (
        shaped.withColumn("TotalCharges", F.round(F.col("MonthlyCharges") * F.col("tenure"), 2))
        .withColumn("Churn", F.when(draw < churn_score(), 1).otherwise(0))
        .select(
            "customerID", "tenure", "Contract", "PaymentMethod", "MonthlyCharges", "TotalCharges",
            "SupportTickets", "Churn",
        )
    )


DIRTY_HEADERS = [
    " customerID ", "tenure", "Contract", " Payment Method", "Monthly Charges", "Total Charges ",
    "Signup Date", "Note", "Constant", "Churn",
]


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer view as a careless text export: padding, blanks, junk, odd headers."""
    c = customers(spark, sf_dir)
    key = F.col("customerID")

    def every(n: int, k: int = 0):
        return F.pmod(key, F.lit(n)) == k

    charge = F.col("MonthlyCharges").cast("string")
    day = F.date_add(F.lit("2017-01-01").cast("date"), F.pmod(key, F.lit(365)).cast("int"))
    return c.select(
        key.cast("string").alias(DIRTY_HEADERS[0]),
        F.when(every(11), F.lit("  ")).otherwise(F.concat(F.lit("\t"), F.col("tenure").cast("string"), F.lit(" \n"))).alias(DIRTY_HEADERS[1]),
        F.when(every(13), F.lit("")).otherwise(F.col("Contract")).alias(DIRTY_HEADERS[2]),
        F.when(every(17), F.lit(None).cast("string")).otherwise(F.col("PaymentMethod")).alias(DIRTY_HEADERS[3]),
        F.when(every(19), F.lit("n/a")).when(every(23), F.lit("1d")).otherwise(charge).alias(DIRTY_HEADERS[4]),
        F.when(every(5), F.lit("1,000")).otherwise(F.col("TotalCharges").cast("string")).alias(DIRTY_HEADERS[5]),
        F.when(every(7), F.date_format(day, "dd/MM/yyyy")).when(every(7, 1), F.lit("not a date"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias(DIRTY_HEADERS[6]),
        F.when(every(3), F.lit(" \t\n")).otherwise(F.lit("called")).alias(DIRTY_HEADERS[7]),
        F.lit("same").alias(DIRTY_HEADERS[8]),
        F.when(F.col("Churn") == 1, " Yes\t").otherwise("no").alias(DIRTY_HEADERS[9]),
    )
