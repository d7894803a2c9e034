"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); a component is named by its smallest id.

    Alternating large and small stars: each round hangs all larger neighbours
    of an id, then all its smaller ones, on the smallest id it knows. A round
    is a minimum per id, combined per task, and a join of staged tables, so a
    hub with many links is split. The number of rounds grows with the
    logarithm of the longest path. Links with a NULL end are ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    links = stage(ends.filter("a IS NOT NULL AND b IS NOT NULL AND u <> v").select("u", "v").distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(least.select("u", "m")).distinct(), "small-star")
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(links.select("v", "v").distinct())
