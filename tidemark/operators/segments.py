"""Customer segments and the tables charted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.functions.bands import rank_band, tenure_band
from tidemark.functions.numbers import no_nan, ratio, to_double
from tidemark.operators.brackets import column_quantiles
from tidemark.operators.ordered import positions
from tidemark.staging import stage


def find_column(columns: list[str], keywords: list[str]) -> str | None:
    """First keyword that is part of a column name, keywords before columns."""
    for word in keywords:
        for column in columns:
            if word in column.lower():
                return column
    return None


def as_number(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return to_double(column)
    return no_nan(F.col(column).cast("double"))


def with_rank_band(df: DataFrame, column: str, labels: list[str], id_column: str, out: str) -> DataFrame:
    """Equal-count bands of ``column``; ties rank by id, missing values get 'nan'.

    The exact global rank comes from range partitions, not from one window.
    """
    valued = df.withColumn("_v", as_number(df, column))
    known = F.col("_v").isNotNull()
    order = [F.col("_v").asc_nulls_last(), F.col(id_column)]
    ranked = positions(valued, [], order, pos="_pos", total="_n", counted=known)
    rank = F.when(known, F.col("_pos") + 1)
    return ranked.withColumn(out, rank_band(rank, F.col("_n"), labels)).drop("_pos", "_n", "_v")


def contract_segment(df: DataFrame) -> Column:
    """Contract name; a numeric renewal flag counts as renewed or not; else one standard plan."""
    if "ContractRenewal" in df.columns and not isinstance(df.schema["ContractRenewal"].dataType, T.StringType):
        return F.when(F.col("ContractRenewal").cast("double") > 0, "Renewed Contract").otherwise("No Renewal")
    column = find_column(df.columns, C.CONTRACT_KEYWORDS)
    if column:
        return F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    return F.lit("Standard Plan")


SEGMENTS = ["Tenure_Segment", "Charge_Segment", "Contract_Segment", "Payment_Segment"]


def with_segments(df: DataFrame, id_column: str = "customerID", only: list[str] | None = None) -> DataFrame:
    """Add tenure, charge, contract and payment segments, by the columns the table has.

    ``only`` names the segments to add. The charge segment (and the payment
    segment of a table with overage fees only) ranks the whole table; leave it
    out where it is not read.
    """
    asked = only or SEGMENTS
    tenure = find_column(df.columns, C.TENURE_KEYWORDS)
    charge = find_column(df.columns, C.CHARGE_KEYWORDS)
    payment = find_column(df.columns, C.PAYMENT_KEYWORDS)
    contract = contract_segment(df)
    out = df
    if "Tenure_Segment" in asked:
        out = out.withColumn("Tenure_Segment", tenure_band(as_number(df, tenure)) if tenure else F.lit("Unknown"))
    if "Contract_Segment" in asked:
        out = out.withColumn("Contract_Segment", contract)
    if "Payment_Segment" in asked:
        if payment:
            out = out.withColumn("Payment_Segment", F.coalesce(F.col(payment).cast("string"), F.lit("nan")))
        elif "OverageFee" in df.columns:
            out = with_rank_band(out, "OverageFee", C.OVERAGE_LABELS, id_column, "Payment_Segment")
        else:
            out = out.withColumn("Payment_Segment", F.lit("Digital payment"))
    if "Charge_Segment" in asked:
        if charge:
            out = with_rank_band(out, charge, C.CHARGE_LABELS, id_column, "Charge_Segment")
        else:
            out = out.withColumn("Charge_Segment", F.lit("Unknown"))
    return out.select(*df.columns, *[s for s in SEGMENTS if s in asked])


def mean_risk(segmented: DataFrame, segment: str) -> DataFrame:
    """Mean churn probability per segment and its share of the sum of means."""
    means = segmented.groupBy(segment).agg(F.avg("Churn_Probability").alias("mean_probability"))
    total = means.agg(F.sum("mean_probability")).scalar()
    return means.select(
        F.col(segment).alias("segment"), "mean_probability", ratio(F.col("mean_probability"), total).alias("share")
    )


def contract_risk_mix(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("Contract_Segment", "Risk_Level").agg(F.count(F.lit(1)).alias("customers"))


def tenure_charge_pivot(segmented: DataFrame) -> DataFrame:
    """Mean probability per cell of tenure band and charge band, 0 for an empty cell.

    Long form, with the bands that the table has, also those of missing values.
    """
    cells = segmented.groupBy("Tenure_Segment", "Charge_Segment").agg(F.avg("Churn_Probability").alias("mean_probability"))
    cells = stage(cells, "cells")
    # Every tenure band with the list of all charge bands: a handful of labels.
    charges = cells.agg(F.collect_set("Charge_Segment")).scalar()
    grid = cells.select("Tenure_Segment").distinct().withColumn("Charge_Segment", F.explode(charges))
    filled = grid.join(cells, ["Tenure_Segment", "Charge_Segment"], "left")
    return filled.select("Tenure_Segment", "Charge_Segment", F.coalesce("mean_probability", F.lit(0.0)).alias("mean_probability"))


def charge_quartiles(scored: DataFrame, charge: str = "MonthlyCharges") -> DataFrame:
    """Exact box-plot statistics of the charge per risk band."""
    found = column_quantiles(scored, ["Risk_Level"], [charge], [0.0, 0.25, 0.5, 0.75, 1.0], ["lowest", "q25", "q50", "q75", "highest"])
    return found.where("lowest IS NOT NULL").drop("column_name")
