"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are bounded by the sequence length, so the whole table is described by
one count per length. The plan is made on these counts: a list of patterns
(lengths that share a sequence) and how often each is used. Pieces then find
their place by their number among the pieces of the same length. Planning work
depends on the sequence length, not on the table; placing is one numbering by
range sort and one look-up per piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import column_tokenizer
from tidemark.llm.words import batches, packed, text_slices
from tidemark.operators.ordered import positions
from tidemark.staging import stage

SEQUENCE_TOKENS = 4096
END_TOKEN = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_token: int = END_TOKEN) -> DataFrame:
    """(row, doc_id, piece, start, length, ids) per piece of at most ``sequence_tokens`` ids.

    A document is the ids of its text and then the end token; only longer ones
    are cut. ``ids`` holds unsigned 32-bit numbers, little-endian. A NULL or
    empty text is the end token alone. ``row`` numbers the input rows, so rows
    that repeat an id, or have none, are documents of their own.
    """
    path = tokenizer or default_tokenizer()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = column_tokenizer(path)
        for batch in source:
            for part in text_slices(batch):
                ids, ends = encoder.encode(part.column("text"))
                out: dict[str, list] = {c: [] for c in ("row", "doc_id", "piece", "start", "length", "ids")}
                rows, names = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
                for k in range(part.num_rows):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_token)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), sequence_tokens)):
                        cut = own[start : start + sequence_tokens]
                        for name, value in zip(out, (rows[k], names[k], piece, start, len(cut), cut)):
                            out[name].append(value)
                kinds = {"piece": pa.int32()}
                yield batches({c: packed(v, "<u4") if c == "ids" else pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return numbered.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids binary")


class _Lengths:
    """Counts per length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, count: int) -> None:
        self.counts[length] -= count
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect_left(self.order, length))

    def largest(self, room: int, used: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``room`` of which one is left beside the ``used`` ones."""
        k = bisect_left(self.order, room + 1) - 1
        while k >= 0 and self.counts[self.order[k]] <= used.count(self.order[k]):
            k -= 1
        return self.order[k] if k >= 0 else None

    def smallest(self, count: int, used: tuple[int, ...]) -> list[int]:
        """The ``count`` smallest lengths left beside the ``used`` ones, repeats included."""
        out: list[int] = []
        for length in self.order:
            out += [length] * min(count - len(out), self.counts[length] - used.count(length))
            if len(out) == count:
                break
        return out


def _dominating(left: _Lengths, length: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``length`` that dominates every other feasible set with it, if that can be shown.

    A set dominates another if the items of the other can be split into groups,
    each no longer in total than an own item of the set (Martello and Toth).
    """
    room, used = capacity - length, (length,)
    best = left.largest(room, used)
    if best is None:
        return used
    if best == room:  # fills the sequence, so it covers any other filling
        return length, best
    least = left.smallest(3, used)
    if len(least) < 2 or least[0] + least[1] > room:  # one more item at most
        return length, best
    if len(least) == 3 and sum(least) <= room:
        return None
    # Two more items at most.
    pair = 0
    for first in reversed(left.order[: bisect_left(left.order, room)]):
        if left.counts[first] <= used.count(first):
            continue
        if 2 * first < pair:
            break
        second = left.largest(min(first, room - first), (length, first))
        if second is not None:
            pair = max(pair, first + second)
    if best >= pair:
        return length, best
    second = left.largest(room - best, (length, best))
    half = left.largest(room // 2, used)
    if second is not None and (half is None or second >= half):
        return length, best, second
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets that can be fixed, with how often, and the counts that remain)."""
    left, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for length in sorted(left.counts, reverse=True):
            while left.counts.get(length) and (found := _dominating(left, length, capacity)):
                # Taking items only removes alternatives, so the set dominates while its own items last.
                times = min(left.counts[x] // found.count(x) for x in set(found))
                for x in found:
                    left.take(x, times)
                fixed.append((found, times))
                changed = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for all items of a length and all open sequences of a pattern at once."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = defaultdict(list)

    def put(pattern: tuple[int, ...], room: int, times: int) -> None:
        if not times:
            return
        if not open_[room]:
            insort(rooms, room)
        open_[room].append([pattern, times])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                put((length,) * each, capacity - each * length, todo // each)
                if rest := todo % each:
                    put((length,) * rest, capacity - rest * length, 1)
                break
            room = rooms[k]
            group = open_[room][-1]
            each = min(room // length, todo)
            times = min(group[1], todo // each)
            todo -= each * times
            group[1] -= times
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            put(group[0] + (length,) * each, room - each * length, times)
    return [(pattern, times) for groups in open_.values() for pattern, times in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, and how often each is used."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first number, sequence of that number, and place, of each run of pieces."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(column, np.int64) for column in zip(*own)) for length, own in runs.items()}


def place(parts: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces that have row, piece and length."""
    parts = stage(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(counts, sequence_tokens))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for own in np.unique(length).tolist():
                rows = np.flatnonzero(length == own)
                first, base, at = places[own]
                found = np.searchsorted(first, number[rows], "right") - 1
                sequence[rows], offset[rows] = base[found] + number[rows] - first[found], at[found]
            yield batches({"row": batch.column("row"), "piece": batch.column("piece"), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    numbered = positions(parts.select("row", "piece", "length"), ["length"], [F.col("row"), F.col("piece")], pos="number")
    placed = numbered.select("row", "piece", "length", "number").mapInArrow(run, "row long, piece int, sequence_id long, offset long")
    return parts.join(placed, ["row", "piece"])


def pack(
    docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_token: int = END_TOKEN,
    columns: dict[str, Column] | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, sequence_id, offset and ``columns`` made from ``ids``, by default the ids.

    ``docs`` needs doc_id and text; other columns are ignored. An empty table
    gives an empty result. Every piece is placed once, sequences have no gaps,
    and the same pieces give the same number of sequences.
    """
    columns = columns or {"ids": F.col("ids")}
    cut = pieces(docs, tokenizer, sequence_tokens, end_token)
    cut = cut.select("row", "doc_id", "piece", "start", "length", *[c.alias(name) for name, c in columns.items()])
    return place(cut, sequence_tokens).drop("row")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = pack(docs, columns={"ids_crc32": F.crc32("ids")})
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op10_packing": (op10_packing, None)}
