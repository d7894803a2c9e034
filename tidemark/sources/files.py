"""CSV and JSON sources, and the export sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import KLINE_FIELDS, KLINE_NUMBERS
from tidemark.functions.numbers import to_double
from tidemark.operators.cleaning import clean_customers, clean_sales, trim_headers


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column stays text until it is cleaned."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", False).csv(path)


def read_sales_csv(spark: SparkSession, path: str, date_formats: list[str] | None = None, with_year: bool = True) -> DataFrame:
    return clean_sales(trim_headers(read_csv_text(spark, path)), date_formats=date_formats, with_year=with_year)


def standard_names(df: DataFrame) -> DataFrame:
    """Column names as the sales operators expect them: 'Sub-Category' becomes sub_category."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def load_sales(spark: SparkSession, path: str, date_formats: list[str] | None = None) -> DataFrame:
    """A sales CSV, cleaned and ready for the sales operators; without formats, the dates vote on theirs."""
    return standard_names(clean_sales(trim_headers(read_csv_text(spark, path)), date_formats=date_formats, dayfirst=None))


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_customers(read_csv_text(spark, path))


def parse_klines(records: DataFrame, value: str = "value") -> DataFrame:
    """Kline records (a JSON array of twelve positional fields per row) to typed columns.

    Prices and volumes become doubles and the two times timestamps; the last
    fields are left as they are. Other columns, such as symbol and bar, stay.
    """
    fields = F.from_json(F.col(value), T.ArrayType(T.StringType()))
    others = [c for c in records.columns if c != value]
    raw = records.select(*others, fields.alias("_f"))

    def field(i: int, name: str):
        text = F.get(F.col("_f"), i)
        if name in KLINE_NUMBERS:
            return to_double(text).alias(name)
        if name in ("open_time", "close_time"):
            return F.timestamp_millis(text.try_cast("bigint")).cast("timestamp_ntz").alias(name)
        if name == "trades":
            return text.try_cast("bigint").alias(name)
        return text.alias(name)

    return raw.select(*others, *[field(i, name) for i, name in enumerate(KLINE_FIELDS)])


def explode_kline_response(responses: DataFrame, value: str = "value") -> DataFrame:
    """A whole response (a JSON array of kline arrays) to one kline record per row."""
    others = [c for c in responses.columns if c != value]
    rows = F.from_json(F.col(value), T.ArrayType(T.ArrayType(T.StringType())))
    return responses.select(*others, F.explode(rows).alias("_row")).select(*others, F.to_json("_row").alias(value))


def read_klines(spark: SparkSession, path: str, symbol: str, bar: str) -> DataFrame:
    """Landed kline files, one kline array per line."""
    lines = spark.read.text(path).select(F.lit(symbol).alias("symbol"), F.lit(bar).alias("bar"), "value")
    return parse_klines(lines)


TICKER_SCHEMA = "struct<lastPrice:string,priceChangePercent:string,quoteVolume:string>"


def parse_ticker(records: DataFrame, value: str = "value") -> DataFrame:
    """24 h ticker objects to numbers; absent or bad fields become NULL."""
    others = [c for c in records.columns if c != value]
    parsed = records.select(*others, F.from_json(F.col(value), TICKER_SCHEMA).alias("_t"))
    return parsed.select(
        *others,
        to_double("_t.lastPrice").alias("last_price"),
        to_double("_t.priceChangePercent").alias("change_pct"),
        to_double("_t.quoteVolume").alias("quote_volume_24h"),
    )


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Export with a header, one folder per partition value if asked."""
    writer = df.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sales_table(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sales lines as the reports read them: joined once, one folder per order year.

    Later queries need no join and read only the years they ask for. Rebalancing
    keeps files even when one year or month holds most lines.
    """
    dated = lines.withColumn("order_year", F.year("order_date"))
    dated.hint("rebalance", "order_year").write.mode(mode).partitionBy("order_year").parquet(path)


def read_sales_table(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    """The stored sales lines, of the given first to last year only if asked."""
    lines = spark.read.parquet(path)
    return lines.where(F.col("order_year").between(*years)) if years else lines


def data_version(df: DataFrame) -> str:
    """A mark that changes when a file behind ``df`` is replaced or added: names, sizes and times of all of them."""
    spark, found = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()
