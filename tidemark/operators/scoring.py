"""Churn scores, risk bands and the tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.bands import risk_level
from tidemark.functions.numbers import amount_of, as_column, ratio
from tidemark.staging import literal_table

SCORE_COLUMNS = ["Churn_Probability", "Predicted_Churn", "Risk_Level"]


def churn_score(
    tenure: Column | str = "tenure",
    contract: Column | str = "Contract",
    payment: Column | str = "PaymentMethod",
    charge: Column | str = "MonthlyCharges",
    tickets: Column | str = "SupportTickets",
) -> Column:
    """Transparent logistic churn probability; a missing attribute adds nothing."""

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    logit = (
        F.lit(C.SCORE_INTERCEPT)
        + points(as_column(contract) == "Month-to-month", C.SCORE_MONTH_TO_MONTH)
        + points(as_column(payment) == "Electronic check", C.SCORE_ELECTRONIC_CHECK)
        + points(as_column(charge) > C.HIGH_CHARGE, C.SCORE_HIGH_CHARGE)
        + points(as_column(tickets) >= C.MANY_TICKETS, C.SCORE_MANY_TICKETS)
        + F.coalesce(as_column(tenure).cast("double"), F.lit(0.0)) * C.SCORE_PER_TENURE_MONTH
    )
    return 1 / (1 + F.exp(-logit))


def with_scores(df: DataFrame, probability: Column, target: str | None = None) -> DataFrame:
    """Add probability, label (from one half on) and risk band; ids and target come first."""
    p = F.col("Churn_Probability")
    scored = df.withColumn("Churn_Probability", probability)
    scored = scored.withColumn("Predicted_Churn", F.when(p >= 0.5, 1).otherwise(0)).withColumn("Risk_Level", risk_level(p))
    leading = [c for c in [*C.ID_COLUMNS, target] if c in df.columns]
    rest = [c for c in df.columns if c not in leading + SCORE_COLUMNS]
    return scored.select(*leading, *SCORE_COLUMNS, *rest)


def display_columns(df: DataFrame, target: str | None = None, at_least: int = 5) -> list[str]:
    """Columns of the queue view: ids, target and scores, filled up to five from the rest."""
    known = [*C.ID_COLUMNS, target, *SCORE_COLUMNS]
    shown = [c for c in df.columns if c in known]
    missing = max(at_least - len(shown), 0)
    return shown + [c for c in df.columns if c not in shown][:missing]


def risk_queue(scored: DataFrame, levels: list[str] | None = None, floor: float = 0.0, id_column: str = "customerID") -> DataFrame:
    """Customers in the chosen bands at or above a probability, most at risk first."""
    chosen = scored.where(F.col("Risk_Level").isin(levels or C.RISK_LEVELS) & (F.col("Churn_Probability") >= floor))
    return chosen.orderBy(F.desc("Churn_Probability"), F.asc(id_column))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Customers per risk band, in band order, with zero for a band nobody is in."""
    counts = scored.groupBy("Risk_Level").agg(F.count(F.lit(1)).alias("customers"))
    domain = literal_table(scored.sparkSession, list(zip(C.RISK_LEVELS, range(3))), ["Risk_Level", "ord"])
    full = domain.join(counts, "Risk_Level", "left")  # three rows by four at most
    return full.select("ord", "Risk_Level", F.coalesce("customers", F.lit(0)).alias("customers"))


def churn_kpis(scored: DataFrame) -> DataFrame:
    """Portfolio figures with their status words, from one pass."""
    high = F.count_if(F.col("Risk_Level") == C.RISK_LEVELS[2])
    sums = scored.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("Predicted_Churn").alias("churn_rate"),
        high.alias("high_risk"),
        F.avg("Churn_Probability").alias("mean_probability"),
    )
    rate = F.col("churn_rate")
    share = ratio(F.col("high_risk"), F.greatest("customers", F.lit(1)))
    return sums.select(
        "*",
        F.when(rate > 0.28, "bad").when(rate > 0.16, "warn").otherwise("good").alias("churn_status"),
        F.when(share > 0.25, "bad").otherwise("warn").alias("risk_status"),
    )


def revenue_at_risk(scored: DataFrame, charge: str | None = "MonthlyCharges") -> DataFrame:
    """Share of high-risk customers and the monthly charges they stand for."""
    high = F.col("Risk_Level") == C.RISK_LEVELS[2]
    revenue = F.lit(None).cast("double")
    if charge in scored.columns:
        amount = F.when(high, amount_of(scored, charge))
        revenue = F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))
    return scored.agg(F.avg(high.cast("int")).alias("high_risk_rate"), revenue.alias("revenue_at_risk"))
