"""Cleaning of text tables: headers, dates, numbers, blanks, types, target."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.functions.numbers import as_column, no_nan, present, strip, to_double
from tidemark.operators.ordered import positions
from tidemark.staging import stage

MONTH_FIRST = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy"]
DAY_FIRST = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy"]
#: Formats that a vote decides on.
VOTED = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "M/d/yyyy", "d/M/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "yyyyMMdd"]


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def tidy_headers(df: DataFrame) -> DataFrame:
    """Strip headers and put an underscore for each inner space."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def to_timestamp(text: Column | str, formats: list[str] | None = None, dayfirst: bool = False) -> Column:
    """Text to timestamp by the first format that fits; NULL if none does."""
    chosen = formats or (DAY_FIRST if dayfirst else MONTH_FIRST)
    trimmed = strip(text)
    tries = [F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in chosen]
    return F.coalesce(*tries)


def date_votes(df: DataFrame, columns: list[str], formats: list[str] | None = None) -> DataFrame:
    """How many cells of each text column each format reads, and which formats win: column_name, format, parsed, cells, elected.

    All formats are tried in one aggregate. Formats that differ in the order of day
    and month only read the same cells, so of these the one that reads the most is elected,
    the first listed on a tie; formats of another shape are elected if they read any cell.
    """
    formats = formats or VOTED
    tried = df.agg(*[
        F.struct(
            F.count(F.when(strip(c) != "", F.lit(1))).alias("cells"),
            *[F.count(F.try_to_timestamp(strip(c), F.lit(f))).alias(f"f{i}") for i, f in enumerate(formats)],
        ).alias(f"c{k}")
        for k, c in enumerate(columns)
    ])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(f).alias("format"), F.lit(i).alias("place"), F.lit(re.sub(r"\w", "9", f)).alias("shape"),
            F.col(f"c{k}.f{i}").alias("parsed"), F.col(f"c{k}.cells").alias("cells"),
        )
        for k, c in enumerate(columns) for i, f in enumerate(formats)
    ]
    long = tried.select(F.inline(F.array(*rows)))
    best = Window.partitionBy("column_name", "shape").orderBy(F.desc("parsed"), "place")  # a row per format
    ranked = long.withColumn("elected", (F.row_number().over(best) == 1) & (F.col("parsed") > 0))
    return ranked.select("column_name", "format", "parsed", "cells", "elected", "place")


def elected_formats(df: DataFrame, columns: list[str], formats: list[str] | None = None) -> dict[str, list[str]]:
    """The elected formats of each column, the one that reads the most cells first; a row per column and format comes to the driver."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in date_votes(df, columns, formats).where("elected").orderBy(F.desc("parsed"), "place").collect():
        out[row["column_name"]].append(row["format"])
    return out


def coerce_number(df: DataFrame, name: str) -> Column:
    """A measure as double with 0 for missing or bad cells, and 0 for an absent column."""
    if name not in df.columns:
        return F.lit(0.0).alias(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = to_double(name)
    else:
        value = no_nan(F.col(name).cast("double"))
    return F.coalesce(value, F.lit(0.0)).alias(name)


def clean_sales(
    df: DataFrame,
    dates: tuple[str, ...] = ("Order Date", "Ship Date"),
    measures: tuple[str, ...] = ("Sales", "Profit", "Quantity"),
    date_formats: list[str] | None = None,
    dayfirst: bool | None = False,
    with_year: bool = True,
) -> DataFrame:
    """Sales table with parsed dates, order year and month, and three filled measures.

    Without formats and ``dayfirst`` (None), the cells of each date column vote on its formats.
    """
    out = df
    texts = [name for name in dates if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)]
    voted = elected_formats(df, texts) if texts and dayfirst is None and not date_formats else {}
    for name in texts:
        out = out.withColumn(name, to_timestamp(name, voted.get(name) or date_formats, bool(dayfirst)))
    order_date = dates[0]
    if order_date in df.columns:
        if with_year:
            out = out.withColumn("Order Year", F.year(order_date))
        out = out.withColumn("Order Month", month_start(order_date))
    others = [c for c in out.columns if c not in measures]
    return out.select(*others, *[coerce_number(df, m) for m in measures])


def month_start(date: Column | str) -> Column:
    return F.date_trunc("month", as_column(date)).cast("timestamp_ntz")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def blank_to_null(df: DataFrame) -> DataFrame:
    """Cells of white space only become NULL in every text column."""
    texts = set(_text_columns(df))
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").rlike(r"^\s*$"), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def parse_rates(df: DataFrame) -> DataFrame:
    """Share of all rows that parse as a number, per text column, from one pass."""
    texts = _text_columns(df)
    rates = df.agg(*[F.avg(to_double(c).isNotNull().cast("int")).alias(c) for c in texts])
    return rates.unpivot([], texts, "column_name", "parse_rate")


def promote_numbers(df: DataFrame, threshold: float = 0.86) -> DataFrame:
    """Text columns that parse in more than ``threshold`` of all rows become doubles.

    Reads one row of rates to learn the schema, then projects.
    """
    texts = _text_columns(df)
    if not texts:
        return df
    rates = df.agg(*[F.avg(to_double(c).isNotNull().cast("int")).alias(c) for c in texts]).first()
    numeric = {c for c in texts if (rates[c] or 0) > threshold}
    return df.select(*[to_double(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def clean_customers(df: DataFrame) -> DataFrame:
    return promote_numbers(blank_to_null(tidy_headers(df)))


def two_value_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: how many distinct non-null values, told apart as 0, 1, 2 or 3 (more than two).

    Two cheap passes, lowest and highest value and then whether anything lies
    between, in place of a distinct count that would shuffle every value.
    """
    columns = columns or df.columns
    df = df.select(*[present(df, c).alias(c) for c in columns])
    ends = [f(c).alias(f"{side}_{i}") for i, c in enumerate(columns) for side, f in (("lo", F.min), ("hi", F.max))]
    bounds = df.agg(*ends).first()
    between = []
    for i, c in enumerate(columns):
        low, high = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if low is None:
            between.append(F.lit(0).alias(c))
        elif low == high:
            between.append(F.lit(1).alias(c))
        else:
            kind = df.schema[c].dataType
            inner = (F.col(c) != F.lit(low).cast(kind)) & (F.col(c) != F.lit(high).cast(kind))
            between.append(F.when(F.coalesce(F.max(inner), F.lit(False)), 3).otherwise(2).alias(c))
    flags = df.agg(*between)
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    long = flags.unpivot([], columns, "column_name", "distinct_class")
    return long.select(order[F.col("column_name")].alias("ordinal"), "column_name", "distinct_class")


def infer_target(df: DataFrame) -> DataFrame:
    """One row with the target column: a known name if present, else the last column of two values."""
    for name in C.TARGET_NAMES:
        if name in df.columns:
            return df.sparkSession.range(1).select(F.lit(name).alias("target_column"))
    flags = two_value_flags(df).where("distinct_class = 2")
    return flags.agg(F.max_by("column_name", "ordinal").alias("target_column"))


def infer_target_column(df: DataFrame) -> str | None:
    return infer_target(df).first()["target_column"]


def detect_features(df: DataFrame, target: str) -> DataFrame:
    """Usable feature columns: not id-like, not the target, more than one value."""
    drop = {*C.ID_LIKE_NAMES, target.lower()}
    candidates = [c for c in df.columns if c.lower() not in drop]
    if not candidates:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string")
    # The lowest and highest value differ exactly if there are two values or more.
    varies = df.agg(
        *[F.coalesce(F.min(present(df, c)) < F.max(present(df, c)), F.lit(False)).alias(c) for c in candidates]
    )
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    long = varies.unpivot([], candidates, "column_name", "varies").where("varies")
    return long.select(order[F.col("column_name")].alias("ordinal"), "column_name")


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """The feature names as a list: at most one per column of the table."""
    return [r["column_name"] for r in detect_features(df, target).orderBy("ordinal").collect()]


def normalize_target(df: DataFrame, column: str, row_key: str, out: str = "target") -> DataFrame:
    """Add the target as a class number.

    Numbers: 1 above zero, else 0 (also for missing). Text: lower case and
    stripped; with exactly two values (a missing one counts as the value
    'nan'), known positive words are 1 and the other 0. Otherwise, or if both
    or neither value is a positive word, classes are numbered by first
    appearance in ``row_key`` order.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        value = F.col(column).cast("double")
        return df.withColumn(out, F.when(no_nan(value) > 0, 1).otherwise(0))
    plain = F.coalesce(F.lower(strip(column)), F.lit("nan"))
    marked = df.withColumn("_plain", plain)
    classes = marked.groupBy("_plain").agg(F.min(row_key).alias("_seen"))
    classes = classes.select(
        "_plain", "_seen", F.when(F.col("_plain").isin(C.POSITIVE_WORDS), 1).otherwise(0).alias("_word")
    )
    classes = stage(classes, "classes")  # read three times below; the table itself only once
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("_word").alias("words"))
    by_word = facts.select((F.col("n") == 2) & (F.col("words") == 1)).scalar()
    # Numbering by first appearance; positions() keeps this whole for any number of classes.
    numbered = positions(classes, [], [F.col("_seen")], pos="_code", total="_n")
    codes = numbered.select("_plain", F.when(by_word, F.col("_word")).otherwise(F.col("_code")).cast("int").alias(out))
    # Staged, so that Spark knows its size: few classes are broadcast, and the table is not shuffled by class.
    return marked.join(stage(codes, "codes"), "_plain").drop("_plain")


def validate_dataset(df: DataFrame, target: str, row_key: str | None = None) -> DataFrame:
    """The failed checks of a training table, one message per row."""
    spark = df.sparkSession
    if target not in df.columns:
        rows = df.agg(F.count(F.lit(1)).alias("rows"))
        checks = [F.lit(C.CHECK_TARGET_MISSING), F.when(F.col("rows") < 50, C.CHECK_ROWS), F.lit(C.CHECK_FEATURES)]
        return _messages(rows, checks)
    features = detect_features(df, target).agg(F.count(F.lit(1)).alias("features")).scalar()
    kind = df.schema[target].dataType
    plain = F.coalesce(F.lower(strip(target)), F.lit("nan"))
    if not isinstance(kind, T.StringType):
        plain = F.when(no_nan(F.col(target).cast("double")) > 0, "1").otherwise("0")
    # More than two classes are told from two by lowest, highest and anything between.
    flags = two_value_flags(df.select(plain.alias("t")))
    classes = flags.agg(F.max("distinct_class")).scalar()
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", features.alias("features"), classes.alias("classes"))
    checks = [
        F.when(F.col("classes") != 2, C.CHECK_TWO_CLASSES),
        F.when(F.col("rows") < 50, C.CHECK_ROWS),
        F.when(F.col("features") < 2, C.CHECK_FEATURES),
    ]
    return _messages(rows, checks)


def _messages(facts: DataFrame, checks: list[Column]) -> DataFrame:
    listed = facts.select(F.posexplode(F.array(*checks)).alias("ord", "message"))
    return listed.where("message IS NOT NULL")
