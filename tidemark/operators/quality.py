"""Data quality and profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import present
from tidemark.operators.brackets import column_quantiles


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def missing_percent(df: DataFrame) -> DataFrame:
    """Percent of missing cells per column, columns without any left out, worst first."""
    shares = df.agg(*[F.avg(present(df, c).isNull().cast("int")).alias(c) for c in df.columns])
    long = shares.unpivot([], df.columns, "column_name", "share").where("share > 0")
    out = long.select("column_name", F.round(F.col("share") * 100, 2).alias("missing_pct"))
    return out.orderBy(F.desc("missing_pct"), "column_name")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows (missing equals missing)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("cnt"))
    return groups.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_counts(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and other columns."""
    numeric = len(_numeric(df))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(numeric).cast("bigint").alias("numeric_count"),
        F.lit(len(df.columns) - numeric).cast("bigint").alias("categorical_count"),
    )


def column_info(df: DataFrame) -> DataFrame:
    """Non-null count and type of every column."""
    counts = df.agg(*[F.count(present(df, c)).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    long = counts.unpivot([], df.columns, "column_name", "non_null")
    return long.select("column_name", "non_null", kinds[F.col("column_name")].alias("data_type"))


def describe(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column.

    All columns are aggregated side by side. Quartiles are exact, from one more pass;
    ``approximate`` takes them from a sketch in the same pass.
    """
    columns = columns or _numeric(df)
    plain = df.select(*[present(df, c).cast("double").alias(c) for c in columns])
    figures = {}
    for j, c in enumerate(columns):
        x = F.col(f"`{c}`")
        for name, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            figures[f"{name}{j}"] = f(x)
    quartiles = ["q25", "q50", "q75"]
    if approximate:
        sketch = [F.approx_percentile(f"`{c}`", [0.25, 0.5, 0.75], 10_000).alias(f"q{j}") for j, c in enumerate(columns)]
        one = plain.agg(*[value.alias(name) for name, value in figures.items()], *sketch)
        picks = {j: [F.col(f"q{j}")[i].alias(n) for i, n in enumerate(quartiles)] for j in range(len(columns))}
    else:
        one = column_quantiles(plain, [], columns, [0.25, 0.5, 0.75], quartiles, figures)
        picks = {j: [F.col(n) for n in quartiles] for j in range(len(columns))}
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"count{j}").alias("count"), F.col(f"mean{j}").alias("mean"), F.col(f"std{j}").alias("std"),
            F.col(f"min{j}").alias("min"), *picks[j], F.col(f"max{j}").alias("max"),
        )
        for j, c in enumerate(columns)
    ]
    if approximate:
        return one.select(F.inline(F.array(*rows)))
    own = F.filter(F.array(*rows), lambda r: r["column_name"] == F.col("column_name"))
    return one.select(F.inline(own))


def drop_incomplete(df: DataFrame, drop_columns: list[str] | None = None) -> DataFrame:
    """Rows with every cell present; then the named columns go."""
    return df.dropna("any").drop(*(drop_columns or []))


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order (a table has no file order to rely on)."""
    return df.orderBy(*order).limit(n)


def draw_of(seed: int, *key: Column) -> Column:
    """A number from the MD5 sum of seed and row key, 52 bits: the same in any partitioning and any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")


def random_rows(df: DataFrame, n: int = 500, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """``n`` random rows without replacement (all if there are fewer); top-n per task, then merged.

    The order follows from ``key`` (all columns by default), so a run again gives the same rows.
    """
    return df.orderBy(draw_of(seed, *[F.col(c) for c in key or df.columns]), *(key or df.columns)).limit(n)
