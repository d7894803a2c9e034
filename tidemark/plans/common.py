"""Shared pieces of the registered queries and of their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import SCORE_PER_TENURE_MONTH, STATE_CODES

DIGITS = 4


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so that sums in another order compare equal."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = DIGITS) -> str:
    """SQL rounding that never shows a negative zero."""
    return f"(ROUND({expression}, {digits}) + 0.0)"


def money(expression: str) -> str:
    return f"COALESCE(CAST(SUM(CAST({expression} AS DECIMAL(28,8))) AS DOUBLE), 0)"


def stripped(expression: str) -> str:
    return f"trim({expression}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def with_ctes(body: str, recursive: bool = False, **ctes: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"


STATE_LIST = f"[{quoted(sorted(STATE_CODES)[:24])}]"

SALES = f"""
SELECT l.l_orderkey AS order_id,
  CASE o.o_orderstatus WHEN 'O' THEN 'CA-' WHEN 'F' THEN 'US-' ELSE '' END || CAST(o.o_orderkey AS VARCHAR) AS order_code,
  o.o_orderdate AS order_date, l.l_shipdate AS ship_date, o.o_orderpriority AS ship_mode,
  c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment,
  COALESCE({STATE_LIST}[n.n_nationkey + 1], 'Ontario') AS state, g.r_name AS region,
  p.p_type AS category, p.p_brand AS sub_category, p.p_name AS product_name, l.l_quantity AS quantity,
  l.l_extendedprice * (1 - l.l_discount) AS sales,
  l.l_extendedprice * (1 - l.l_discount) - 0.9::DOUBLE * l.l_extendedprice AS profit
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region g ON g.r_regionkey = n.n_regionkey
  JOIN part p ON p.p_partkey = l.l_partkey"""

TICKS = """
SELECT event_type AS symbol, ts, event_id AS tick_id, value AS price,
  value * TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quote
FROM events WHERE value IS NOT NULL AND NOT isnan(value)"""

WIDTHS = {"1h": "1 hour", "4h": "4 hours", "1d": "1 day", "1w": "7 days"}


def bars_sql(bar: str = "1h", source: str = "ticks") -> str:
    return f"""
SELECT symbol, '{bar}' AS bar, time_bucket(INTERVAL '{WIDTHS[bar]}', ts) AS open_time,
  first(price ORDER BY ts, tick_id) AS open, MAX(price) AS high, MIN(price) AS low,
  last(price ORDER BY ts, tick_id) AS close, CAST(COUNT(price) AS DOUBLE) AS volume,
  COALESCE(CAST(SUM(CAST(quote AS DECIMAL(28,8))) AS DOUBLE), 0) AS quote_volume, COUNT(*) AS trades
FROM {source} GROUP BY ALL"""


NUMBERED = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos, COUNT(*) OVER (PARTITION BY symbol) AS n
FROM bars"""

MARKET = {"ticks": TICKS, "bars": bars_sql("1h"), "s": NUMBERED}

CUSTOMERS = f"""
SELECT *, ROUND(MonthlyCharges * tenure, 2) AS TotalCharges,
  CASE WHEN ((customerID * 7919 + 13) % 1000) / 1000.0::DOUBLE <
    1 / (1 + exp(-(-2.1::DOUBLE + CASE WHEN Contract = 'Month-to-month' THEN 1.35::DOUBLE ELSE 0 END
      + CASE WHEN PaymentMethod = 'Electronic check' THEN 0.55::DOUBLE ELSE 0 END
      + CASE WHEN MonthlyCharges > 88 THEN 0.55::DOUBLE ELSE 0 END
      + CASE WHEN SupportTickets >= 4 THEN 0.9::DOUBLE ELSE 0 END
      + COALESCE(tenure, 0) * ({SCORE_PER_TENURE_MONTH})::DOUBLE))) THEN 1 ELSE 0 END AS Churn
FROM (
  SELECT c.c_custkey AS customerID,
    CAST(GREATEST((year(e.d) - year(o.latest)) * 12 + month(e.d) - month(o.latest), 1) AS INTEGER) AS tenure,
    CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Month-to-month'
         WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN o.digit <= 2 THEN 'Electronic check' WHEN o.digit = 3 THEN 'Credit card'
         WHEN o.digit = 4 THEN 'Bank transfer' ELSE 'Mailed check' END AS PaymentMethod,
    ROUND(o.avg_order / 3500, 2) AS MonthlyCharges,
    CAST(COALESCE(t.errors, 0) AS INTEGER) AS SupportTickets
  FROM customer c
    CROSS JOIN (SELECT MAX(o_orderdate) AS d FROM orders) e
    LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS latest,
        CAST(substr(MAX(strftime(o_orderdate, '%Y%m%d') || substr(o_orderpriority, 1, 1)), 9, 1) AS INTEGER) AS digit,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS avg_order
      FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT user_id, COUNT(*) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id) t
      ON t.user_id = c.c_custkey)"""

SCORED = f"""
SELECT *, CASE WHEN Churn_Probability >= 0.5 THEN 1 ELSE 0 END AS Predicted_Churn,
  CASE WHEN Churn_Probability > -0.001 AND Churn_Probability <= 0.34 THEN 'Low Risk'
       WHEN Churn_Probability > 0.34 AND Churn_Probability <= 0.67 THEN 'Medium Risk'
       WHEN Churn_Probability > 0.67 AND Churn_Probability <= 1.001 THEN 'High Risk' ELSE 'nan' END AS Risk_Level
FROM (SELECT *, 1 / (1 + exp(-(-2.1::DOUBLE + CASE WHEN Contract = 'Month-to-month' THEN 1.35::DOUBLE ELSE 0 END
      + CASE WHEN PaymentMethod = 'Electronic check' THEN 0.55::DOUBLE ELSE 0 END
      + CASE WHEN MonthlyCharges > 88 THEN 0.55::DOUBLE ELSE 0 END
      + CASE WHEN SupportTickets >= 4 THEN 0.9::DOUBLE ELSE 0 END
      + COALESCE(tenure, 0) * ({SCORE_PER_TENURE_MONTH})::DOUBLE))) AS Churn_Probability FROM customers)"""

SEGMENTED = """
SELECT *, CASE WHEN tenure <= 12 THEN '0-12' WHEN tenure <= 36 THEN '13-36' WHEN tenure <= 72 THEN '37-72'
    WHEN tenure > 72 THEN '73+' ELSE 'nan' END AS Tenure_Segment,
  CASE WHEN MonthlyCharges IS NULL THEN 'nan' WHEN (rk - 1) * 4 <= cnt - 1 THEN 'Budget'
    WHEN (rk - 1) * 4 <= 2 * (cnt - 1) THEN 'Core' WHEN (rk - 1) * 4 <= 3 * (cnt - 1) THEN 'Premium'
    ELSE 'Enterprise' END AS Charge_Segment,
  COALESCE(Contract, 'nan') AS Contract_Segment, COALESCE(PaymentMethod, 'nan') AS Payment_Segment
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY MonthlyCharges NULLS LAST, customerID) AS rk,
    COUNT(MonthlyCharges) OVER () AS cnt FROM scored)"""

CHURN = {"customers": CUSTOMERS, "scored": SCORED}
CHURN_SEGMENTS = {**CHURN, "seg": SEGMENTED}
