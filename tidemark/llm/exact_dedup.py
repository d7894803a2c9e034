"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Distinct
blocks are sorted and their place in that order is their name, an integer.
Then adjacent names are paired, the distinct pairs sorted and named in turn,
until every text has one name. Two texts get the same (level, name) only if
all their blocks are the same, so no result rests on a hash.

Block contents are shuffled once, to be grouped and sorted. Names go back to
the documents by a 64-bit hash of the block; the few blocks whose hash is
shared with another content, if any, are matched by content instead. A block
of many copies is combined per task before the shuffle, and the joins that
bring names back read staged tables, so adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.drops import unused, without_rows
from tidemark.staging import stage

WHITE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 8192


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _blocks(docs: DataFrame, size: int, block_hash) -> DataFrame:
    """One row per block: the document's other columns, sha of its text, at, last, block, hash."""
    kept = [c for c in docs.columns if c != "text"]
    texts = docs.select(*kept, normalised(F.col("text")).cast("binary").alias("raw"))
    last = F.greatest(F.ceil(F.octet_length("raw") / size).cast("int") - 1, F.lit(0))
    texts = texts.select(*kept, "raw", last.alias("last"), F.sha2("raw", 256).alias("sha"))
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    rows = rows.select(*kept, "sha", "at", "last", F.substring("raw", F.col("at") * size + 1, F.lit(size)).alias("block"))
    return rows.withColumn("hash", block_hash("block"))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct keys within hash partitions; the place in that order is the name."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, at, last, name) for the staged block rows."""
    distinct = blocks.groupBy("hash", "block").agg(F.lit(1).alias("one"))
    names = stage(_numbered(distinct, ["hash", "block"]).select("hash", "name"), "block-names")
    shared = stage(names.groupBy("hash").count().filter("count > 1").select("hash"), "shared-hashes")
    plain = rows.join(names.join(shared, "hash", "left_anti"), "hash").select("row", "at", "last", "name")
    if shared.isEmpty():
        return plain
    # Different blocks under one hash: these few are matched by their bytes. Their
    # names lie below zero, apart from all others.
    clash = stage(blocks.join(shared, "hash", "left_semi"), "shared-blocks")
    numbers = stage(
        clash.groupBy("block").agg(F.lit(1).alias("one")).sortWithinPartitions("block")
        .select("block", (-F.monotonically_increasing_id() - 1).alias("name")), "shared-names",
    )
    odd = clash.join(numbers, "block").select("sha", "at", "name").distinct()
    odd = rows.join(shared, "hash", "left_semi").join(odd, ["sha", "at"])
    return plain.unionByName(odd.select("row", "at", "last", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """One row per input row: (doc_id, row, sha, level, name).

    Rows with equal (level, name) have equal normalised texts, and only those.
    ``row`` numbers the input rows, so repeated rows and NULL ids stay apart.
    """
    docs = docs.select("doc_id", "text")
    # The number of a row is fixed once it is written.
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    rows = stage(_blocks(rows, block_bytes, block_hash).drop("block"), "blocks")
    named = stage(_block_names(_blocks(docs, block_bytes, block_hash), rows), "named")
    result, level = None, 0
    while True:
        done = named.filter("last = 0").select("row", F.lit(level).alias("level"), "name")
        result = done if result is None else result.unionByName(done)
        longer = named.filter("last > 0")
        if longer.isEmpty():
            break
        named, level = _pair_names(longer), level + 1
    return stage(rows.filter("at = 0").select("doc_id", "row", "sha").join(result, "row"), "identities")


def _pair_names(named: DataFrame) -> DataFrame:
    """Pair adjacent names; a last name without a partner is paired with none."""
    side = F.col("at") % 2
    pairs = named.groupBy("row", (F.col("at") / 2).cast("int").alias("at"), (F.col("last") / 2).cast("int").alias("last")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("left"), F.max(F.when(side == 1, F.col("name"))).alias("right")
    )
    pairs = stage(pairs.withColumn("alone", F.col("right").isNull()).fillna(0, ["right"]), "pairs")
    keys = ["left", "right", "alone"]
    names = stage(_numbered(pairs.groupBy(*keys).agg(F.lit(1).alias("one")), keys).select(*keys, "name"), "pair-names")
    return stage(pairs.join(names, keys).select("row", "at", "last", "name"), "named")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns are ignored. A NULL text
    counts as empty, empty texts are equal to each other, an empty table gives
    an empty result. Of equal texts the row with the smallest doc_id is kept;
    NULL ids come last, and of rows that repeat an id exactly one is kept.
    """
    rows = identities(docs, block_bytes, block_hash)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = stage(
        rows.groupBy("level", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"), "groups",
    )
    joined = rows.join(groups, ["level", "name"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the smallest doc_id; all columns stay.

    Rows are told apart by doc_id and text, so of rows that repeat both one stays.
    """
    values = [F.col("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256)]
    groups = exact_groups(docs, block_bytes).filter("group_size > 1")
    keys = stage(
        groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .filter("NOT kept OR copies > 1"), "dropped",
    )
    single = without_rows(docs, keys.select("doc_id", "text_sha256"), values)
    repeated = keys.filter("kept").select("doc_id", "text_sha256")
    if repeated.isEmpty():
        return single
    key_id, key_sha, number = unused(docs.columns, "key_id", "key_sha", "number")
    same = [F.col(key_id).eqNullSafe(values[0]), F.col(key_sha) == values[1]]
    first = Window.partitionBy(key_id, key_sha).orderBy(*[c for c, kind in docs.dtypes if "map" not in kind])
    again = docs.join(repeated.toDF(key_id, key_sha), same).withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1)
    return single.unionByName(again.select(*docs.columns))


SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_exact_dedup": (op9_exact_dedup, SQL)}
