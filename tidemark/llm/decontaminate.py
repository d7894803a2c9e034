"""Benchmark decontamination with an FM-index per training shard.

``build_index`` cuts the documents into shards of bounded size and indexes the
word sequence of each (suffix order, wavelet matrix, sampled positions); the
index is a table. ``search_index`` looks every window of the benchmark up in
every shard by backward search, locates the occurrences, and merges the words
they cover into spans. Windows are taken in blocks of bounded size, so what a
task receives does not grow with the benchmark; each block reads the index,
not the texts. ``remove_spans`` cuts the spans out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fm_index
from tidemark.llm.drops import unused
from tidemark.llm.words import PLAIN, batches, hash_words, packed, text_bytes, text_slices, unpacked, word_spans
from tidemark.staging import stage

WINDOW_WORDS = 10
SHARD_WORDS = 1 << 20
BLOCK_WINDOWS = 50_000

_INDEX = pa.schema([
    ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
    ("firsts", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())),
    *[(name, pa.binary()) for name in fm_index.KINDS],
])
_INDEX_DDL = "rows array<long>, ids array<long>, keys array<long>, firsts array<long>, words array<long>, " + ", ".join(
    f"{name} binary" for name in fm_index.KINDS
)
_FOUND_DDL = "row long, doc_id long, text_key long, first long, words long, spans binary, hits binary"


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """One row per shard of at most ``shard_words`` words.

    A document longer than a shard goes on in the next one, which repeats the
    last ``window_words - 1`` words, so no window is cut. Every document has an
    entry, also one without words.
    """
    shard_words = max(2 * window_words, min(shard_words, fm_index.MAX_WORDS // 2))
    overlap = window_words - 1

    def shard(pieces: list[tuple]) -> pa.RecordBatch:
        parts = fm_index.build([p[5] for p in pieces])
        columns = [[[p[k] for p in pieces]] for k in range(5)]
        arrays = [pa.array(c, pa.list_(pa.int64())) for c in columns]
        arrays += [packed([parts[name]], kind) for name, kind in fm_index.KINDS.items()]
        return pa.RecordBatch.from_arrays(arrays, schema=_INDEX)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = hash_words(part.column("text"), PLAIN)
                meta = [part.column(c).to_pylist() for c in ("row", "doc_id", "text_key")]
                for k in range(part.num_rows):
                    own, first = hashes[rows[k] : rows[k + 1]], 0
                    while True:
                        take = own[first : first + shard_words]
                        if waiting and size + len(take) + 1 > shard_words:
                            yield shard(waiting)
                            waiting, size = [], 0
                        waiting.append((meta[0][k], meta[1][k], meta[2][k], first, len(own), take.copy()))
                        size += len(take) + 1
                        if first + shard_words >= len(own):
                            break
                        first += shard_words - overlap
        if waiting:
            yield shard(waiting)

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    return stage(numbered.mapInArrow(run, _INDEX_DDL), "fm-index")


def benchmark_windows(benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(window, words) per distinct window and (window, item_id) per window of an item.

    A window is ``window_words`` consecutive words of an item; an item with
    fewer words, but not none, is one window. Items without an id are ignored.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = hash_words(part.column("text"), PLAIN)
                ids, cut = [], []
                for k, item in enumerate(part.column("item_id").to_pylist()):
                    own = hashes[rows[k] : rows[k + 1]]
                    size = min(window_words, len(own))
                    for first in range(len(own) - size + 1 if size else 0):
                        ids.append(item)
                        cut.append(own[first : first + size])
                yield batches({"item_id": pa.array(ids, pa.int64()), "words": packed(cut)})

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).dropna(subset=["item_id"])
    cut = stage(items.mapInArrow(run, "item_id long, words binary").distinct(), "windows")
    distinct = cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
    distinct = stage(distinct, "distinct-windows")
    return distinct, cut.join(distinct, "words").select("window", "item_id")


def _merge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flat (start, end, start, end, ...) of the union of half-open spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.column_stack([starts[new], reach[last]]).ravel().astype(np.int64)


def _search_shards(names: np.ndarray, phrases: dict[int, tuple[np.ndarray, np.ndarray]], everything: bool):
    """A function over index rows: the documents of each shard with their spans and windows."""

    def one(row: dict) -> pa.RecordBatch:
        index = fm_index.Index({name: unpacked(row[name], kind) for name, kind in fm_index.KINDS.items()})
        starts = unpacked(row["starts"], np.int64)
        docs, begins, ends, which = [], [], [], []
        for length, (rows, words) in phrases.items():
            low, high = index.search(words)
            count = high - low
            if not count.any():
                continue
            phrase = np.repeat(rows, count)
            places = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(places)
            doc = np.searchsorted(starts, at, "right") - 1
            docs.append(doc)
            begins.append(at - starts[doc])
            ends.append(at - starts[doc] + length)
            which.append(names[phrase])
        spans, hits = [np.zeros(0, np.int64)] * len(starts), [np.zeros(0, np.int64)] * len(starts)
        if docs:
            doc, begin, end, window = map(np.concatenate, (docs, begins, ends, which))
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(starts) + 1))
            for k in np.unique(doc).tolist():
                own = order[edges[k] : edges[k + 1]]
                first = row["firsts"][k]
                spans[k], hits[k] = _merge(begin[own] + first, end[own] + first), np.unique(window[own])
        keep = np.arange(len(starts)) if everything else np.flatnonzero([len(s) > 0 for s in spans])
        return batches({
            "row": pa.array([row["rows"][k] for k in keep], pa.int64()), "doc_id": pa.array([row["ids"][k] for k in keep], pa.int64()),
            "text_key": pa.array([row["keys"][k] for k in keep], pa.int64()),
            "first": pa.array([row["firsts"][k] for k in keep], pa.int64()), "words": pa.array([row["words"][k] for k in keep], pa.int64()),
            "spans": packed([spans[k] for k in keep], np.int64), "hits": packed([hits[k] for k in keep], np.int64),
        })

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                yield one(batch.slice(k, 1).to_pylist()[0])

    return run


def search_index(index: DataFrame, distinct: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per part of a document in a shard: merged spans of hit words and the windows found in it.

    The first block answers for all documents, later blocks only for those they hit. A
    block's windows travel with its tasks, and its answers are staged before the next, so
    the driver holds one block at a time.
    """
    blocks = max(1, -(-distinct.count() // block_windows))
    numbered = distinct.withColumn("_block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = numbered.filter(F.col("_block") == block).select("window", "words").collect()
        by_length: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            by_length.setdefault(len(row.words) // 8, []).append(k)
        names = np.array([row.window for row in rows], np.int64)
        phrases = {
            length: (np.array(own), np.frombuffer(b"".join(bytes(rows[k].words) for k in own), np.uint64).reshape(len(own), length))
            for length, own in by_length.items()
        }
        part = stage(index.mapInArrow(_search_shards(names, phrases, block == 0), _FOUND_DDL), "found")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per input row: doc_id, text_key, n_words, n_hit, spans (array of start and end word), items (sorted ids as text).

    Documents need doc_id and text, the benchmark item_id and text; other
    columns are ignored. A NULL or empty text has no words and no hits. Rows
    that repeat an id, and rows without one, are answered one by one. An empty
    benchmark hits nothing; an empty table gives an empty result.
    """
    distinct, items = benchmark_windows(benchmark, window_words)
    found = search_index(build_index(docs, shard_words, window_words), distinct, block_windows)

    def spans_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            spans = []
            for parts in batch.column("parts").to_pylist():
                flat = np.concatenate([np.zeros(0, np.int64), *[unpacked(p, np.int64) for p in parts]])
                spans.append(_merge(flat[::2], flat[1::2]) if len(flat) else flat)
            sizes = pa.array([int((s[1::2] - s[::2]).sum()) for s in spans], pa.int64())
            yield batches({
                **{c: batch.column(c) for c in ("row", "doc_id", "text_key", "n_words")}, "n_hit": sizes,
                "spans": pa.array([s.reshape(-1, 2).tolist() for s in spans], pa.list_(pa.list_(pa.int64()))),
            })

    per_row = found.groupBy("row", "doc_id", "text_key").agg(
        F.max("words").alias("n_words"), F.collect_list(F.when(F.octet_length("spans") > 0, F.col("spans"))).alias("parts")
    )
    per_row = per_row.mapInArrow(spans_of, "row long, doc_id long, text_key long, n_words long, n_hit long, spans array<array<long>>")

    def windows_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hits = [unpacked(h, np.int64) for h in batch.column("hits").to_pylist()]
            rows = np.repeat(batch.column("row").to_numpy(), [len(h) for h in hits])
            yield batches({"row": pa.array(rows, pa.int64()), "window": pa.array(np.concatenate([np.zeros(0, np.int64), *hits]), pa.int64())})

    hit = found.filter(F.octet_length("hits") > 0).select("row", "hits").mapInArrow(windows_of, "row long, window long")
    per_item = hit.join(items, "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    per_item = per_item.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    joined = per_row.join(per_item, "row", "left")
    return joined.select("doc_id", "text_key", "n_words", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_spans(docs: DataFrame, report: DataFrame) -> DataFrame:
    """``docs`` with the hit words of ``report`` cut from the texts, up to the next word; all columns stay.

    Rows are matched by doc_id and text. A row that had hits and has no other
    word is dropped. ``n_chars``, if there is one, is counted anew.
    """
    columns = docs.columns
    own = unused(columns, "cut_id", "cut_key", "cut_spans", "cut_all")
    cut_id, cut_key, cut_spans, cut_all = map(F.col, own)
    found = report.filter("n_hit > 0").select("doc_id", "text_key", "spans", F.col("n_hit") == F.col("n_words"))
    cuts = stage(found.toDF(*own).dropDuplicates(own[:2]), "cuts")
    same = [cut_id.eqNullSafe(F.col("doc_id").cast("long")), cut_key == F.xxhash64("text")]
    joined = docs.join(cuts, same, "left").filter(cut_all.isNull() | ~cut_all)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, _cut)

    clean = joined.withColumn("text", F.when(cut_spans.isNull(), F.col("text")).otherwise(cut("text", cut_spans)))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(cut_spans.isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
    return clean.select(*columns)


def _cut(text, spans):
    if spans is None or text is None:
        return text
    raw = text.encode()
    _, starts, _, _ = word_spans(*text_bytes(pa.array([text])), PLAIN)
    edges, kept, last = np.append(starts, len(raw)), [], 0
    for begin, end in spans:
        kept.append(raw[last : edges[begin]])
        last = int(edges[end])
    return b"".join([*kept, raw[last:]]).decode()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items."""
    report = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
     b AS (SELECT item_id, list_filter(string_split_regex(trim(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS w
           FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
     dw AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM d),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
            FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT k FROM bw),
     ww AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM dw, sizes, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
     hit AS (SELECT doc_id, i, ww.k, item_id FROM ww JOIN bw ON ww.k = bw.k AND ww.phrase = bw.phrase),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op8_decontamination": (op8_decontamination, SQL)}
