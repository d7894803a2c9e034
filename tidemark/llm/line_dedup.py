"""Line dedup by pairwise alignment.

Documents that share a rare line are paired, each with the line's first holder, and
aligned by patience diff; blocks of common lines go from the later document.

Blocks without a rare line, and blocks that their documents' first holders do not show, are
found through runs of lines: from each line and to each line the shortest run of
consecutive lines with enough words for a block. Every document is paired with the
first holder of each of its runs that no block covers yet, however many documents
hold it, so the number of pairs is bounded by the number of lines, also for a
group of many copies. The runs in a block cover it, so no line of a block that an
earlier document has goes unpaired. These pairs are aligned in the same way;
shared runs that stand elsewhere in the alignment go too. The first holder of a
run never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.drops import unused
from tidemark.llm.words import BREAK, SPACED, batches, hash_runs, hash_spans, packed, text_bytes, text_slices, unpacked, word_spans
from tidemark.staging import stage

RARE_DOCUMENTS = 50
BLOCK_WORDS = 20

_LINES = np.arange(256, dtype=np.uint8)
_LINES[ord("\n")] = BREAK


def _line_table(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hashes, words): hash and number of words of each line that is not empty."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                data, offsets = text_bytes(part.column("text"))
                folded, starts, ends, rows = word_spans(data, offsets, _LINES)
                hashes = hash_spans(folded, starts, ends)
                first = word_spans(data, offsets, SPACED)[1]
                words = (np.searchsorted(first, ends) - np.searchsorted(first, starts)).astype(np.int32)
                spans = list(zip(rows[:-1].tolist(), rows[1:].tolist()))
                yield batches({
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "hashes": packed([hashes[a:b] for a, b in spans]),
                    "words": packed([words[a:b] for a, b in spans], np.int32),
                })

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(numbered.mapInArrow(run, "row long, doc_id long, hashes binary, words binary"), "lines")


def _runs(words: np.ndarray, rows: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after) of the shortest runs of ``block_words`` words from each line and to each line.

    ``words`` are those of the lines of all rows, ``rows`` the number of lines before each row.
    """
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    line = np.arange(len(words))
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    ends = np.maximum(np.searchsorted(before, before[:-1] + block_words), line + 1)
    starts = np.minimum(np.searchsorted(before, before[1:] - block_words, "right") - 1, line)
    onward, back = ends <= rows[owner + 1], starts >= rows[owner]
    both = np.unique(np.concatenate([np.stack([line[onward], ends[onward]]), np.stack([starts[back], line[back] + 1])], axis=1), axis=1)
    return both[0], both[1]


def _rare_pairs(lines: DataFrame, rare_documents: int) -> DataFrame:
    """(row, other, places): each document with the first holders of its rare lines; no places."""

    def distinct(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            own = [np.unique(unpacked(h)) for h in batch.column("hashes").to_pylist()]
            index = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
            flat = np.concatenate([np.zeros(0, np.uint64), *own])
            yield batches({"line": pa.array(flat.view(np.int64)), "row": batch.column("row").take(index), "doc_id": batch.column("doc_id").take(index)})

    held = lines.select("row", "doc_id", "hashes").mapInArrow(distinct, "line long, row long, doc_id long")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    rare = held.groupBy("line").agg(F.count(F.lit(1)).alias("holders"), F.min(place).alias("first"))
    rare = stage(rare.filter(F.col("holders").between(2, rare_documents)).select("line", F.col("first.row").alias("other")), "rare-lines")
    near = held.select("line", "row").join(rare, "line").filter(F.col("row") != F.col("other")).select("row", "other").distinct()
    return stage(near.withColumn("places", F.array().cast("array<struct<at:int,other_at:int,n:int>>")), "rare-pairs")


def _pairs(lines: DataFrame, found: DataFrame, block_words: int) -> DataFrame:
    """(row, other, places): each document with the first holders of its runs outside the blocks ``found``, and where these stand."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                hashes = [unpacked(h) for h in part.column("hashes").to_pylist()]
                words = [unpacked(w, np.int32) for w in part.column("words").to_pylist()]
                rows = np.concatenate([[0], np.cumsum([len(h) for h in hashes], dtype=np.int64)])
                first, after = _runs(np.concatenate([np.zeros(0, np.int32), *words]), rows, block_words)
                keys = hash_runs(np.concatenate([np.zeros(0, np.uint64), *hashes]), first, after)
                owner = np.searchsorted(rows, first, "right") - 1
                gone = np.zeros(rows[-1] + 1, np.int64)
                for low, blocks in zip(rows.tolist(), part.column("removed").to_pylist()):
                    for begin, end in blocks or ():
                        gone[low + begin + 1 : low + end + 1] = 1
                gone = np.cumsum(gone)
                index = pa.array(owner)
                yield batches({
                    "run": pa.array(keys.view(np.int64)), "row": part.column("row").take(index), "doc_id": part.column("doc_id").take(index),
                    "at": pa.array((first - rows[owner]).astype(np.int32)), "n": pa.array((after - first).astype(np.int32)),
                    "covered": pa.array(gone[after] - gone[first] == after - first),
                })

    known = lines.join(found, "row", "left")
    held = known.select("row", "doc_id", "hashes", "words", "removed").mapInArrow(run, "run long, row long, doc_id long, at int, n int, covered boolean")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")
    shared = held.groupBy("run").agg(F.count(F.lit(1)).alias("holders"), F.min(place).alias("first")).filter("holders > 1")
    shared = stage(shared.select("run", F.col("first.row").alias("other"), F.col("first.at").alias("other_at")), "shared-runs")
    near = held.filter("NOT covered").select("run", "row", "at", "n").join(shared, "run").filter(F.col("row") != F.col("other"))
    return stage(near.groupBy("row", "other").agg(F.collect_list(F.struct("at", "other_at", "n")).alias("places")), "pairs")


def _increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of values, not side by side."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for k, value in enumerate(places):
        pile = bisect_left(tops, value)
        before[k] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            at.append(k)
        else:
            tops[pile], at[pile] = value, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Common blocks (place in a, place in b, lines) of two arrays of line hashes, in order.

    Lines that both have exactly once are anchors, the longest run of them in
    the same order holds. Equal lines around anchors join them; the stretches
    between are aligned in the same way.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = []
        for part in (a[a0:a1], b[b0:b1]):
            values, first, counts = np.unique(part, return_index=True, return_counts=True)
            once.append((values[counts == 1], first[counts == 1]))
        _, in_a, in_b = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
        in_a, in_b = once[0][1][in_a] + a0, once[1][1][in_b] + b0
        order = np.argsort(in_a)
        in_a, in_b = in_a[order].tolist(), in_b[order].tolist()
        last_a, last_b = a0, b0
        kept = _increasing(in_b)
        for k in kept:
            pairs.append((in_a[k], in_b[k]))
            todo.append((last_a, in_a[k], last_b, in_b[k]))
            last_a, last_b = in_a[k] + 1, in_b[k] + 1
        if kept:
            todo.append((last_a, a1, last_b, b1))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def shared_blocks(old: np.ndarray, new: np.ndarray, words: np.ndarray, places: np.ndarray, block_words: int) -> list[tuple[int, int]]:
    """Ranges of lines of ``new`` that go: blocks of the alignment with ``old``, then shared runs it does not cover.

    ``places`` has rows of (line in new, line in old, lines).
    """
    before = np.concatenate([[0], np.cumsum(words)])
    blocks = [(j, j + n) for _, j, n in patience_blocks(old, new) if before[j + n] - before[j] >= block_words]
    gone = np.zeros(len(new), bool)
    for begin, end in blocks:
        gone[begin:end] = True
    covered = np.concatenate([[0], np.cumsum(gone)])
    at, other, n = places.T
    for j, i, count in places[covered[at + n] - covered[at] < n].tolist():
        if (old[i : i + count] == new[j : j + count]).all():
            blocks.append((j, j + count))
    return blocks


def repeated_lines(docs: DataFrame, rare_documents: int = RARE_DOCUMENTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per input row: doc_id, n_lines, n_removed, removed (ranges of line numbers that go).

    Lines are what stands between line feeds; empty ones are not counted. Of two
    documents the one with the larger doc_id is the later one; rows without an
    id come last, and rows that repeat one stand in input order. A block goes if
    it has ``block_words`` words. A line is rare if at most ``rare_documents`` documents
    hold it; what rare lines do not show, runs of lines do, without a limit of holders. Needs
    doc_id and text; other columns are ignored. A NULL or empty text has no lines.
    """
    lines = _line_table(docs)
    found = _merged(_aligned(_rare_pairs(lines, rare_documents), lines, block_words))
    rest = _aligned(_pairs(lines, found, block_words), lines, block_words)
    flat = found.select("row", F.explode("removed").alias("block"))
    removed = _merged(rest.unionByName(flat))
    whole = lines.select("row", "doc_id", (F.octet_length("hashes") / 8).cast("long").alias("n_lines")).join(removed, "row", "left")
    none = F.array().cast("array<array<long>>")
    gone = F.aggregate(F.coalesce("removed", none), F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return whole.select("doc_id", "n_lines", gone.alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def _aligned(pairs: DataFrame, lines: DataFrame, block_words: int) -> DataFrame:
    """(row, block): ranges of lines that go from a document, one row each, by its alignment with each of its partners."""
    earlier = lines.select(F.col("row").alias("other"), F.col("hashes").alias("earlier"))

    def align(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                places = part.column("places").flatten()
                places = np.stack([places.field(name).to_numpy() for name in ("at", "other_at", "n")], axis=1).astype(np.int64)
                edges = np.cumsum(part.column("places").value_lengths().to_numpy())[:-1]
                found = []
                for old, new, words, own in zip(*(part.column(c).to_pylist() for c in ("earlier", "hashes", "words")), np.split(places, edges)):
                    blocks = shared_blocks(unpacked(old), unpacked(new), unpacked(words, np.int32), own, block_words)
                    found.append(np.array(blocks, np.int64).ravel())
                counts = [len(f) // 2 for f in found]
                flat = np.concatenate([np.zeros(0, np.int64), *found])
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
                yield batches({"row": part.column("row").take(pa.array(np.repeat(np.arange(part.num_rows), counts))), "block": blocks})

    aligned = pairs.join(earlier, "other").drop("other").join(lines.select("row", "hashes", "words"), "row")
    return stage(aligned.select("row", "places", "earlier", "hashes", "words").mapInArrow(align, "row long, block array<long>"), "blocks")


def _merged(blocks: DataFrame) -> DataFrame:
    """(row, removed): the blocks of each document as ranges in order that do not touch; staged."""

    def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            merged = []
            for parts in batch.column("blocks").to_pylist():
                out: list[list[int]] = []
                for begin, end in sorted(parts):
                    if out and begin <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], end)
                    else:
                        out.append([begin, end])
                merged.append(out)
            yield batches({"row": batch.column("row"), "removed": pa.array(merged, pa.list_(pa.list_(pa.int64())))})

    per_row = blocks.groupBy("row").agg(F.collect_set("block").alias("blocks"))  # ranges of one text
    return stage(per_row.mapInArrow(merge, "row long, removed array<array<long>>"), "removed")


def without_lines(docs: DataFrame, report: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut from the texts; all columns stay. Ids must be unique."""

    @F.pandas_udf("string")
    def cut(text, removed):
        return text.combine(removed, _cut)

    own = unused(docs.columns, "cut_id", "cut_lines")
    cut_id, cut_lines = map(F.col, own)
    cuts = stage(report.filter("n_removed > 0").select("doc_id", "removed").toDF(*own), "cuts")
    joined = docs.join(cuts, cut_id == F.col("doc_id").cast("long"), "left")
    text = F.when(cut_lines.isNull(), F.col("text")).otherwise(cut("text", cut_lines))
    return joined.withColumn("text", text).select(*docs.columns)


def _cut(text, removed):
    if text is None or removed is None:
        return text
    gone = {k for begin, end in removed for k in range(begin, end)}
    kept, number = [], 0
    for line in text.split("\n"):
        if not line or number not in gone:
            kept.append(line)
        number += bool(line)
    return "\n".join(kept)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that later documents share with earlier ones."""
    report = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ranges = F.array_join(F.transform("removed", lambda r: F.concat(r[0].cast("string"), F.lit("-"), r[1].cast("string"))), ",")
    return report.select("doc_id", "n_lines", "n_removed", ranges.alias("removed_lines"))


QUERIES = {"op5_line_dedup": (op5_line_dedup, None)}
