"""Registered cleaning and data-quality queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import cleaning, learning, quality
from tidemark.plans.common import CUSTOMERS, quoted, r, rounded, stripped, with_ctes
from tidemark.sources.tables import dirty_customers, table

DIRTY = """
SELECT CAST(customerID AS VARCHAR) AS customerID,
  CASE WHEN customerID % 11 = 0 THEN '  ' ELSE chr(9) || CAST(tenure AS VARCHAR) || ' ' || chr(10) END AS tenure,
  CASE WHEN customerID % 13 = 0 THEN '' ELSE Contract END AS Contract,
  CASE WHEN customerID % 17 = 0 THEN NULL ELSE PaymentMethod END AS Payment_Method,
  CASE WHEN customerID % 19 = 0 THEN 'n/a' WHEN customerID % 23 = 0 THEN '1d' ELSE CAST(MonthlyCharges AS VARCHAR) END AS Monthly_Charges,
  CASE WHEN customerID % 5 = 0 THEN '1,000' ELSE CAST(TotalCharges AS VARCHAR) END AS Total_Charges,
  CASE WHEN customerID % 7 = 0 THEN strftime(day, '%d/%m/%Y') WHEN customerID % 7 = 1 THEN 'not a date'
    ELSE strftime(day, '%Y-%m-%d') END AS Signup_Date,
  CASE WHEN customerID % 3 = 0 THEN ' ' || chr(9) || chr(10) ELSE 'called' END AS Note, 'same' AS Constant,
  CASE WHEN Churn = 1 THEN ' Yes' || chr(9) ELSE 'no' END AS Churn
FROM (SELECT *, DATE '2017-01-01' + CAST(customerID % 365 AS INTEGER) AS day FROM customers)"""
TEXTS = [
    "customerID", "tenure", "Contract", "Payment_Method", "Monthly_Charges", "Total_Charges", "Signup_Date", "Note",
    "Constant", "Churn",
]
NUMBERS = {"customerID", "tenure", "Monthly_Charges"}


def _number(column: str) -> str:
    return f"CASE WHEN regexp_full_match({stripped(column)}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST({stripped(column)} AS DOUBLE) END"


BLANKED = "SELECT " + ", ".join(f"CASE WHEN {stripped(c)} = '' THEN NULL ELSE {c} END AS {c}" for c in TEXTS) + " FROM dirty"
CLEAN = "SELECT " + ", ".join(f"{_number(c)} AS {c}" if c in NUMBERS else c for c in TEXTS) + " FROM blanked"
CTES = {"customers": CUSTOMERS, "dirty": DIRTY, "blanked": BLANKED, "clean": CLEAN}


def _tidy(spark, d):
    return cleaning.tidy_headers(dirty_customers(spark, d))


def _clean(spark, d):
    return cleaning.clean_customers(dirty_customers(spark, d))


def churn_clean(spark, d):
    return rounded(_clean(spark, d))


def blank_to_null(spark, d):
    return cleaning.blank_to_null(_tidy(spark, d))


def type_promotion(spark, d):
    rates = cleaning.parse_rates(cleaning.blank_to_null(_tidy(spark, d)))
    return rounded(rates.withColumn("is_number", F.col("parse_rate") > 0.86))


def date_coerce(spark, d):
    c = _tidy(spark, d)
    return c.select(
        "customerID",
        cleaning.to_timestamp("Signup_Date").alias("month_first"),
        cleaning.to_timestamp("Signup_Date", dayfirst=True).alias("day_first"),
    )


VOTED = {"yyyy-MM-dd": "%Y-%m-%d", "MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "dd.MM.yyyy": "%d.%m.%Y"}
_SHAPES = {"yyyy-MM-dd": 1, "MM/dd/yyyy": 2, "dd/MM/yyyy": 2, "dd.MM.yyyy": 3}
_VOTES = " UNION ALL ".join(
    f"""SELECT '{f}' AS format, {k} AS place, {_SHAPES[f]} AS shape, COUNT(try_strptime(Signup_Date, '{p}')) AS parsed,
    COUNT(*) FILTER (trim(Signup_Date) <> '') AS cells FROM dirty""" for k, (f, p) in enumerate(VOTED.items())
)


def date_votes(spark, d):
    """How many cells each format reads, and which formats win."""
    return cleaning.date_votes(cleaning.tidy_headers(dirty_customers(spark, d)), ["Signup_Date"], list(VOTED)).drop("place")


def date_by_vote(spark, d):
    """Dates in two layouts, read by the formats that the cells elected."""
    df = cleaning.tidy_headers(dirty_customers(spark, d))
    formats = cleaning.elected_formats(df, ["Signup_Date"], list(VOTED))["Signup_Date"]
    return df.select("customerID", cleaning.to_timestamp("Signup_Date", formats).alias("signed_up"))


def numeric_coerce(spark, d):
    c = _tidy(spark, d)
    measures = ["Monthly_Charges", "Total_Charges", "Quantity"]
    return rounded(c.select("customerID", *[cleaning.coerce_number(c, m) for m in measures]))


def dropna_any(spark, d):
    return rounded(quality.drop_incomplete(_clean(spark, d), ["Constant", "Note"]))


def infer_target(spark, d):
    """By name in the customer table, by its two values in the line table."""
    named = cleaning.infer_target(_clean(spark, d)).select(F.lit("customers").alias("source"), "target_column")
    found = cleaning.infer_target(table(spark, d, "lineitem")).select(F.lit("lineitem").alias("source"), "target_column")
    return named.unionByName(found)


def normalize_target(spark, d):
    """Yes and no in the customer table; five event types numbered by first appearance."""
    c = cleaning.normalize_target(_clean(spark, d), "Churn", "customerID")
    e = cleaning.normalize_target(table(spark, d, "events"), "event_type", "event_id")
    first = c.select(F.lit("customers").alias("source"), F.col("customerID").cast("bigint").alias("row_key"), "target")
    return first.unionByName(e.select(F.lit("events").alias("source"), F.col("event_id").alias("row_key"), "target"))


def detect_features(spark, d):
    return cleaning.detect_features(_clean(spark, d), "Churn")


def validate_dataset(spark, d):
    """Three choices of target: a fit one, one of several classes, and one that is not there."""
    c = _clean(spark, d)
    parts = [cleaning.validate_dataset(c, t).select(F.lit(t).alias("target"), "ord", "message") for t in ("Churn", "Contract", "Gone")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_pct(spark, d):
    return rounded(quality.missing_percent(_clean(spark, d)))


_DUP = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def duplicate_rows(spark, d):
    return quality.duplicate_rows(table(spark, d, "orders").select(*_DUP))


def profile_counts(spark, d):
    return quality.profile_counts(_clean(spark, d))


def column_info(spark, d):
    return quality.column_info(_clean(spark, d)).select("column_name", "non_null")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe(spark, d):
    return rounded(quality.describe(table(spark, d, "lineitem").select(*_MEASURES)))


def impute_scale(spark, d):
    return rounded(learning.impute_and_scale(_clean(spark, d), ["tenure", "Monthly_Charges"], "customerID"))


def one_hot(spark, d):
    return rounded(learning.one_hot(_clean(spark, d), ["Contract", "Payment_Method"], "customerID"))


def _scaled(c: str) -> str:
    return f"""SELECT customerID, '{c}' AS feature, {r(f'(x - AVG(x) OVER ()) / STDDEV_POP(x) OVER ()')} AS value
    FROM (SELECT customerID, COALESCE({c}, (SELECT median({c}) FROM clean)) AS x FROM clean)"""


def _hot(c: str) -> str:
    return f"""SELECT customerID, '{c}_' || COALESCE({c}, (SELECT {c} FROM clean WHERE {c} IS NOT NULL GROUP BY {c}
      ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS feature, CAST(1 AS INTEGER) AS value FROM clean"""


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]

QUERIES = {
    "churn_clean": (
        churn_clean,
        with_ctes("SELECT " + ", ".join(f"{r(c)} AS {c}" if c in NUMBERS else c for c in TEXTS) + " FROM clean", **CTES),
    ),
    "blank_to_null": (blank_to_null, with_ctes("SELECT * FROM blanked", **CTES)),
    "type_promotion": (
        type_promotion,
        with_ctes(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {r('a')} AS parse_rate, a > 0.86 AS is_number FROM (SELECT AVG(CAST(({_number(c)}) IS NOT NULL AS INTEGER)) AS a FROM blanked)"
                for c in TEXTS
            ),
            **CTES,
        ),
    ),
    "date_coerce": (
        date_coerce,
        with_ctes(
            """SELECT customerID, COALESCE(try_strptime(Signup_Date, '%Y-%m-%d'), try_strptime(Signup_Date, '%m/%d/%Y')) AS month_first,
            COALESCE(try_strptime(Signup_Date, '%Y-%m-%d'), try_strptime(Signup_Date, '%d/%m/%Y')) AS day_first FROM dirty""",
            **CTES,
        ),
    ),
    "date_votes": (
        date_votes,
        with_ctes(
            """SELECT 'Signup_Date' AS column_name, format, parsed, cells, parsed > 0 AND ROW_NUMBER() OVER (PARTITION BY shape ORDER BY parsed DESC, place) = 1 AS elected
            FROM (""" + _VOTES + ")",
            **CTES,
        ),
    ),
    "date_by_vote": (
        date_by_vote,
        with_ctes(
            """SELECT customerID, COALESCE(try_strptime(Signup_Date, '%Y-%m-%d'), try_strptime(Signup_Date, '%d/%m/%Y')) AS signed_up FROM dirty""", **CTES
        ),
    ),
    "numeric_coerce": (
        numeric_coerce,
        with_ctes(
            f"""SELECT customerID, COALESCE({_number('Monthly_Charges')}, 0) AS Monthly_Charges,
            COALESCE({_number('Total_Charges')}, 0) AS Total_Charges, CAST(0 AS DOUBLE) AS Quantity FROM dirty""",
            **CTES,
        ),
    ),
    "dropna_any": (
        dropna_any,
        with_ctes(
            "SELECT * EXCLUDE (Constant, Note) FROM clean WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in TEXTS), **CTES
        ),
    ),
    "infer_target": (
        infer_target,
        "SELECT 'customers' AS source, 'Churn' AS target_column UNION ALL SELECT 'lineitem', arg_max(c, o) FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS o, COUNT(DISTINCT {c}) AS n FROM lineitem" for i, c in enumerate(_LINE_COLUMNS))
        + ") WHERE n = 2",
    ),
    "normalize_target": (
        normalize_target,
        with_ctes(
            f"""SELECT 'customers' AS source, CAST(customerID AS BIGINT) AS row_key,
            CASE WHEN lower({stripped('Churn')}) IN ({quoted(C.POSITIVE_WORDS)}) THEN 1 ELSE 0 END AS target FROM clean
            UNION ALL SELECT 'events', e.event_id, CAST(f.k AS INTEGER) FROM events e JOIN (SELECT event_type,
              ROW_NUMBER() OVER (ORDER BY MIN(event_id)) - 1 AS k FROM events GROUP BY event_type) f ON f.event_type = e.event_type""",
            **CTES,
        ),
    ),
    "detect_features": (
        detect_features,
        with_ctes(
            "SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name FROM ("
            + " UNION ALL ".join(
                f"SELECT {i} AS ordinal, '{c}' AS column_name, COUNT(DISTINCT {c}) AS n FROM clean"
                for i, c in enumerate(TEXTS)
                if c.lower() not in {*C.ID_LIKE_NAMES, "churn"}
            )
            + ") WHERE n > 1",
            **CTES,
        ),
    ),
    "validate_dataset": (
        validate_dataset,
        with_ctes(
            f"""SELECT target, CAST(ord AS INTEGER) AS ord, message FROM (
            SELECT 'Churn' AS target, 0 AS ord, '{C.CHECK_TWO_CLASSES}' AS message FROM clean HAVING COUNT(DISTINCT COALESCE(Churn, 'nan')) <> 2
            UNION ALL SELECT 'Contract', 0, '{C.CHECK_TWO_CLASSES}' FROM clean HAVING COUNT(DISTINCT COALESCE(Contract, 'nan')) <> 2
            UNION ALL SELECT t, 1, '{C.CHECK_ROWS}' FROM clean, (VALUES ('Churn'), ('Contract'), ('Gone')) v(t) GROUP BY t HAVING COUNT(*) < 50
            UNION ALL SELECT 'Gone', 0, '{C.CHECK_TARGET_MISSING}' UNION ALL SELECT 'Gone', 2, '{C.CHECK_FEATURES}')""",
            **CTES,
        ),
    ),
    "missing_pct": (
        missing_pct,
        with_ctes(
            "SELECT column_name, ROUND(share * 100, 2) AS missing_pct FROM ("
            + " UNION ALL ".join(f"SELECT '{c}' AS column_name, AVG(CAST({c} IS NULL AS INTEGER)) AS share FROM clean" for c in TEXTS)
            + ") WHERE share > 0",
            **CTES,
        ),
    ),
    "duplicate_rows": (
        duplicate_rows,
        f"SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM orders GROUP BY {', '.join(_DUP)})",
    ),
    "profile_counts": (
        profile_counts,
        with_ctes(
            f"""SELECT COUNT(*) AS row_count, CAST({len(TEXTS)} AS BIGINT) AS column_count, CAST({len(NUMBERS)} AS BIGINT) AS numeric_count,
            CAST({len(TEXTS) - len(NUMBERS)} AS BIGINT) AS categorical_count FROM clean""",
            **CTES,
        ),
    ),
    "column_info": (
        column_info,
        with_ctes(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS non_null FROM clean" for c in TEXTS), **CTES),
    ),
    "describe": (
        describe,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, {r(f'AVG({c})')} AS mean, {r(f'STDDEV_SAMP({c})')} AS std,
            {r(f'MIN({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
            {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'MAX({c})')} AS max FROM lineitem"""
            for c in _MEASURES
        ),
    ),
    "impute_scale": (impute_scale, with_ctes(f"{_scaled('tenure')} UNION ALL {_scaled('Monthly_Charges')}", **CTES)),
    "one_hot": (one_hot, with_ctes(f"{_hot('Contract')} UNION ALL {_hot('Payment_Method')}", **CTES)),
}
