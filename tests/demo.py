"""Made-up customers for the tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scoring import churn_score

SEED = 42
_PAYMENTS = ["Electronic check", "Credit card", "Bank transfer", "Mailed check"]


def _uniform(key: Column, stream: int, seed: int) -> Column:
    """A number in (0, 1) from a hash of seed, stream and key; the same in any partitioning."""
    bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), key), F.lit(1 << 52))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _normal(key: Column, stream: int, seed: int) -> Column:
    u, v = _uniform(key, stream, seed), _uniform(key, stream + 1, seed)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _choice(u: Column, options: list[str], shares: list[float]) -> Column:
    out, upto = F.lit(options[-1]), 1.0
    for option, share in zip(reversed(options[:-1]), reversed(shares[:-1])):
        upto -= shares[options.index(option) + 1]
        out = F.when(u < upto, F.lit(option)).otherwise(out)
    return out


def _poisson(u: Column, mean: float, most: int) -> Column:
    """Inverse of the cumulative distribution; what lies above ``most`` counts as ``most``."""
    chances = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(most)]
    out = F.lit(most)
    for k in range(most - 1, -1, -1):
        out = F.when(u < sum(chances[: k + 1]), F.lit(k)).otherwise(out)
    return out


def synthetic_customers(keys: DataFrame, key: str = "id", seed: int = SEED) -> DataFrame:
    """One synthetic customer per key."""
    k = F.col(key)
    drawn = keys.select(
        k,
        (F.floor(_uniform(k, 1, seed) * 72) + 1).cast("int").alias("tenure"),
        F.least(F.greatest(_normal(k, 2, seed) * 22 + 72, F.lit(18.0)), F.lit(145.0)).alias("_charge"),
        _poisson(_uniform(k, 4, seed), 1.4, 8).alias("SupportTickets"),
        _choice(_uniform(k, 5, seed), ["Month-to-month", "One year", "Two year"], [0.55, 0.25, 0.20]).alias("Contract"),
        _choice(_uniform(k, 6, seed), _PAYMENTS, [0.25] * 4).alias("PaymentMethod"),
    )
    total = F.col("_charge") * F.col("tenure") + _normal(k, 7, seed) * 90
    number = k.cast("string")
    return drawn.select(
        F.concat(F.lit("CUST-"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("customerID"),
        "tenure",
        "Contract",
        "PaymentMethod",
        F.round("_charge", 2).alias("MonthlyCharges"),
        F.round(F.greatest(total, F.lit(0.0)), 2).alias("TotalCharges"),
        "SupportTickets",
        F.when(_uniform(k, 9, seed) < churn_score(charge="_charge"), 1).otherwise(0).alias("Churn"),
    )


def demo_customers(spark: SparkSession, rows: int = 2500, seed: int = SEED) -> DataFrame:
    return synthetic_customers(spark.range(rows), "id", seed)
