"""Parsing, cleaning and dataset checks on hand-made cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.numbers import to_double
from tidemark.functions.text import dollars, fixed, letter_prefix, percent, signed_percent, volume_label
from tidemark.operators import cleaning, quality


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "text,value",
    [(" 12 ", 12.0), ("1,000", None), ("1d", None), ("NaN", None), ("inf", float("inf")), ("", None), ("abc", None),
     ("-.5", -0.5), ("1e3", 1000.0), ("0x1", None), ("1f", None), ("+7.", 7.0)],
)
def test_number_text(spark, text, value):
    assert one(spark, to_double(F.lit(text))) == value


@pytest.mark.parametrize(
    "text,month_first,day_first",
    [("08/11/2017", dt.datetime(2017, 8, 11), dt.datetime(2017, 11, 8)), ("16/06/2017", None, dt.datetime(2017, 6, 16)),
     ("2017-01-02", dt.datetime(2017, 1, 2), dt.datetime(2017, 1, 2)), ("junk", None, None), ("2017-13-01", None, None)],
)
def test_dates(spark, text, month_first, day_first):
    assert one(spark, cleaning.to_timestamp(F.lit(text))) == month_first
    assert one(spark, cleaning.to_timestamp(F.lit(text), dayfirst=True)) == day_first


def test_number_labels(spark):
    assert one(spark, dollars(F.lit(1234567.8))) == "$1,234,568"
    assert one(spark, percent(F.lit(0.12345))) == "12.3%"
    assert one(spark, signed_percent(F.lit(0.05))) == "+5.0%" and one(spark, signed_percent(F.lit(-0.05))) == "-5.0%"
    assert one(spark, fixed(F.lit(1234.5), 1)) == "1234.5"
    assert [one(spark, volume_label(F.lit(v))) for v in (2.5e9, 3.21e6, 1234.0)] == ["$2.50B", "$3.21M", "$1,234"]
    assert one(spark, letter_prefix(F.lit("12-AB3"))) == "AB" and one(spark, letter_prefix(F.lit("123"))) is None


def test_sales_table_gets_missing_measures_and_dates(spark):
    raw = spark.createDataFrame([("1/2/2020", "5", "x"), ("bad", None, " 7 ")], [" Order Date", "Sales", "Profit "])
    rows = cleaning.clean_sales(cleaning.trim_headers(raw)).collect()
    assert [(r["Sales"], r["Profit"], r["Quantity"]) for r in rows] == [(5.0, 0.0, 0.0), (0.0, 7.0, 0.0)]
    assert rows[0]["Order Date"] == dt.datetime(2020, 1, 2) and rows[0]["Order Month"] == dt.datetime(2020, 1, 1)
    assert rows[1]["Order Year"] is None
    assert "Order Year" not in cleaning.clean_sales(cleaning.trim_headers(raw), with_year=False).columns


def test_promotion_needs_more_than_86_percent(spark):
    rows = [("1" if i < 86 else "x", "1" if i < 87 else "x") for i in range(100)]
    got = cleaning.promote_numbers(spark.createDataFrame(rows, ["at", "above"]))
    assert dict(got.dtypes) == {"at": "string", "above": "double"}


def test_blank_cells_count_against_the_rate(spark):
    rows = [("1",)] * 80 + [("  ",)] * 20
    got = cleaning.clean_customers(spark.createDataFrame(rows, [" My Col "]))
    assert got.dtypes == [("My_Col", "string")] and got.where("My_Col IS NULL").count() == 20


def targets(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, y string")
    return [r["target"] for r in cleaning.normalize_target(df, "y", "id").orderBy("id").collect()]


def test_target_words(spark):
    assert targets(spark, ["Yes", "no ", "YES", "No"]) == [1, 0, 1, 0]
    assert targets(spark, ["Left", None, "left"]) == [1, 0, 1]  # a missing value is the second class
    assert targets(spark, ["up", "down", "up"]) == [0, 1, 0]  # no known word: by appearance
    assert targets(spark, ["yes", "true", "yes"]) == [0, 1, 0]  # both known: by appearance
    assert targets(spark, ["c", "a", "b", "c"]) == [0, 1, 2, 0]


def test_numeric_target(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 0.0), (3, None), (4, float("nan"))], "id long, y double")
    got = cleaning.normalize_target(df, "y", "id").orderBy("id").collect()
    assert [r["target"] for r in got] == [1, 0, 0, 0]


def test_target_by_name_or_last_two_valued_column(spark):
    named = spark.createDataFrame([(1, 2)], "a int, Exited int")
    assert cleaning.infer_target_column(named) == "Exited"
    rows = [(i, i % 2, "x", "u" if i % 3 else "v", i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d string, e int")
    assert cleaning.infer_target_column(df) == "d"
    assert cleaning.infer_target_column(df.select("a", "c", "e")) is None


def test_features_and_messages(spark):
    rows = [(i, "n", i % 2, i * 1.0, "Yes" if i % 4 else "No") for i in range(60)]
    df = spark.createDataFrame(rows, "CustomerID int, same string, f1 int, f2 double, Churn string")
    assert cleaning.feature_columns(df, "Churn") == ["f1", "f2"]
    assert cleaning.validate_dataset(df, "Churn").count() == 0
    short = df.limit(10).select("CustomerID", "f1", "Churn")
    assert [r["message"] for r in cleaning.validate_dataset(short, "Churn").collect()] == [C.CHECK_ROWS, C.CHECK_FEATURES]
    assert [r["message"] for r in cleaning.validate_dataset(df, "none").collect()] == [C.CHECK_TARGET_MISSING, C.CHECK_FEATURES]


def test_quality_tables(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, None), (2, None, None), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    assert quality.duplicate_rows(df).first()[0] == 2
    assert [tuple(r) for r in quality.missing_percent(df).collect()] == [("z", 80.0), ("y", 40.0)]
    assert tuple(quality.profile_counts(df).first()) == (5, 3, 2, 1)
    assert quality.drop_incomplete(df, ["z"]).collect() == [(2, "b")]
    assert {r["column_name"]: r["non_null"] for r in quality.column_info(df).collect()} == {"x": 5, "y": 3, "z": 1}


def test_describe_matches_pandas(spark):
    pdf = __import__("pandas").DataFrame({"v": [1.0, 2.0, 2.0, 9.0, 4.5], "w": [5, 1, 3, 3, 2]})
    got = quality.describe(spark.createDataFrame(pdf)).toPandas().set_index("column_name")
    want = pdf.describe().T
    assert got.loc["v"].tolist() == pytest.approx(want.loc["v"].tolist())
    assert got.loc["w"].tolist() == pytest.approx(want.loc["w"].tolist())
    rough = quality.describe(spark.createDataFrame(pdf), approximate=True).toPandas().set_index("column_name")
    assert rough.loc["v", "q50"] == 2.0


def test_random_rows_have_exact_size(spark):
    df = spark.range(1000)
    assert quality.random_rows(df, 500).distinct().count() == 500
    assert quality.random_rows(df.limit(20), 500).count() == 20


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 5), (nan, 6), (nan, 7), (1.0, 8)], "v double, w int")
    assert [tuple(r) for r in quality.missing_percent(df).collect()] == [("v", 50.0)]
    assert cleaning.feature_columns(df, "none") == ["w"]
    assert quality.describe(df).where("column_name = 'v'").first()["count"] == 2


def test_dates_vote_on_their_format(spark):
    cells = ["31/12/2020", "01/02/2020", " 13/05/2019 ", "02/28/2020", "2020-03-04", "junk", "", None]
    df = spark.createDataFrame([(c, "2020-01-01") for c in cells], "a string, b string")
    votes = {(r["column_name"], r["format"]): (r["parsed"], r["cells"], r["elected"]) for r in cleaning.date_votes(df, ["a", "b"]).collect()}
    assert votes["a", "dd/MM/yyyy"] == (3, 6, True) and votes["a", "MM/dd/yyyy"] == (2, 6, False) and votes["a", "yyyy-MM-dd"] == (1, 6, True)
    assert votes["b", "yyyy-MM-dd"] == (8, 8, True) and votes["a", "dd.MM.yyyy"][2] is False
    formats = cleaning.elected_formats(df, ["a", "b"])
    assert formats["a"][0] == "dd/MM/yyyy" and "MM/dd/yyyy" not in formats["a"]
    table = df.withColumnsRenamed({"a": "Order Date", "b": "Ship Date"})
    days = [r["Order Date"] for r in cleaning.clean_sales(table, dayfirst=None).select("Order Date").collect()]
    assert [d and (d.month, d.day) for d in days] == [(12, 31), (2, 1), (5, 13), None, (3, 4), None, None, None]
    assert cleaning.elected_formats(df.where("false"), ["a"]) == {"a": []}
