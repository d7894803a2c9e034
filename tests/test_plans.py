"""Physical plans: what must reach the scan, and what must not be in a plan at all."""

import re

import pytest

from __spark_entry__ import queries

QUERIES = queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_and_tables_are_read(spark, small):
    text = plan(QUERIES["sales_by_category"](spark, small))
    assert "orders.parquet" not in text and "customer.parquet" not in text
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert len(scans) == 2 and all("l_shipdate" not in s and "p_name" not in s for s in scans)


def test_filters_reach_the_scans(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["filtered_kpis"](spark, small))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = " ".join(re.findall(r"PushedFilters: \[([^\n]*)\], ReadSchema", text))
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "In(r_name" in pushed and "In(p_type" in pushed


@pytest.mark.parametrize(
    "name",
    ["all_indicators", "macd", "rolling_corr", "enrich_segments", "roc_points", "describe", "normalize_target", "charge_quartiles_by_risk",
     "customer_rollup", "exec_kpis", "top_products", "holt_forecast", "market_insights", "ticker_kpi", "sales_clean"],
)
def test_no_cross_join_and_no_window_over_the_whole_table(spark, small, name):
    text = plan(QUERIES[name](spark, small)).split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not line.rstrip().endswith("], []") and "], [], [" not in line, line


def test_bars_are_summed_before_the_shuffle_without_sorting(spark, small):
    text = plan(QUERIES["klines_typed"](spark, small))
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 2


def test_latest_bars_are_cut_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(QUERIES["klines_latest_n"](spark, small))


def test_top_k_is_not_a_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, small))


def test_totals_reuse_the_shuffle_of_the_counts(spark, small):
    df = QUERIES["ship_mode_share"](spark, small)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_a_hot_order_is_split_in_the_join(spark, small, tmp_path):
    """A third of the lines in one order: adaptive execution splits that join partition, and sums stay whole."""
    from pyspark.sql import functions as F

    from tidemark.operators import sales
    from tidemark.sources.tables import sales_lines

    folder = str(tmp_path)
    for name in ("orders", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    hot = F.when(F.pmod(F.xxhash64("l_partkey", "l_shipdate"), F.lit(3)) == 0, 3).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("long")).repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rollup = sales.customer_rollup(sales_lines(spark, folder, "customer_id", "order_id", "sales"))
        total = sum(r["revenue"] for r in rollup.collect())
        assert "skew=true" in plan(rollup)
        assert abs(total - lines.agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).first()[0]) < 0.01
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
