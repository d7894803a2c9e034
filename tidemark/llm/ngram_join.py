"""Jaccard join of documents on word n-grams, size-aware and heavy-light.

Sets are ordered by one global order of the n-grams: common ones last, the rest
by hash. Two sets of ``s`` and ``t`` n-grams that reach the threshold share an
n-gram among the first ``s - ceil(0.8 s) + 1`` of one and the like of the other,
and two n-grams among one more.

* Small sets enumerate the subsets of two n-grams of that head: a link between
  two small sets shows as an equal subset.
* Large sets scan the inverted lists of the single n-grams of the head. Small
  sets near the boundary are in these lists too, so no link across it is lost.
* The boundary is the size at which enumerating costs more rows than scanning,
  from the number of sets and the length of their lists per size.

Equal sets are one set from the start. In each list all sets are first compared
with one of them, the best partner of each by shared entries. Components of the
links found this way settle most lists; then pairs of sets that share a list but
not a component meet at the entries that may be their first shared one, are filtered by
exact bounds and verified. One bound is what their parity sketches show: near copies of one text that differ too much
from each other leave the join there. So a group of near copies costs one comparison
each, no pair between components is left out, and no list is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.drops import without_rows
from tidemark.llm.graph import components
from tidemark.llm.sketches import SKETCH, members, parity_sketches, sketches_allow
from tidemark.llm.words import SPACED, batches, hash_words, mix, packed, row_shingles, text_slices, unpacked
from tidemark.staging import stage

WORDS = 5
PERCENT = 80
#: Sets up to this size may be small; the cost decides how many of them are.
SMALL_SIZES = 64
#: Number of slots in which common n-grams are marked; more slots mark fewer rare ones by accident.
SLOT_BITS = 22
#: At most so many slots are marked, those that are common in most stretches of text.
MARKED = 1 << 18
#: An n-gram is common if it is in so many documents of one stretch of text.
COMMON = 4
STRETCH_WORDS = 4_000_000

# A list's key: bit 62 for subsets, bit 61 for common n-grams, 56 bits of hash,
# and five bits for the part of a common n-gram's list.
PART_BITS = 5
COMMON_BIT, _SUBSET_BIT = 1 << 61, 1 << 62


def _need(percent: int, size: int) -> int:
    """Fewest shared n-grams of a set of ``size`` with any partner."""
    return -(-percent * size // 100)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _sets(part: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return list(row_shingles(*hash_words(part.column("text"), SPACED), words))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _statistics(docs: DataFrame, words: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(bit per slot of common n-grams, per small size: sets, partners in their lists)."""

    def flush(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(sets)
        found, counts = np.unique(flat, return_counts=True)
        slots = slot_of(found[counts >= COMMON])
        yield batches({"kind": pa.array(np.zeros(len(slots), np.int32)), "key": pa.array(slots), "n": pa.array(np.ones(len(slots), np.int64)), "m": pa.array(np.ones(len(slots), np.int64))})
        small = [s for s in sets if 0 < len(s) <= SMALL_SIZES]
        if small:
            sizes = np.array([len(s) for s in small], np.int64)
            partners = np.array([int((counts[np.searchsorted(found, s)] - 1).sum()) for s in small], np.int64)
            yield batches({"kind": pa.array(np.ones(len(small), np.int32)), "key": pa.array(sizes), "n": pa.array(np.ones(len(small), np.int64)), "m": pa.array(partners)})
        yield batches({"kind": pa.array([2], pa.int32()), "key": pa.array([0], pa.int64()), "n": pa.array([1], pa.int64()), "m": pa.array([1], pa.int64())})

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in source:
            for part in text_slices(batch):
                own = _sets(part, words)
                waiting += own
                size += sum(map(len, own))
                if size >= STRETCH_WORDS:
                    yield from flush(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from flush(waiting)

    seen = _texts(docs).mapInArrow(run, "kind int, key long, n long, m long")
    rows = stage(seen.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "statistics")
    marks = np.zeros(1 << SLOT_BITS, bool)
    slots = rows.filter("kind = 0").orderBy(F.desc("n"), "key").limit(MARKED).select("key").toArrow()
    marks[slots.column(0).to_numpy()] = True
    # One row per small size, and one.
    others = rows.filter("kind > 0").collect()
    stretches = max([row.n for row in others if row.kind == 2], default=1)
    sizes = {row.key: (row.n, row.m * stretches) for row in others if row.kind == 1}
    return np.packbits(marks), sizes


def common_ngrams(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Packed bits: the slots of common n-grams."""
    return _statistics(docs, words)[0]


def small_boundary(sizes: dict[int, tuple[int, int]], percent: int = PERCENT) -> int:
    """Sets below the returned size enumerate subsets; the others scan lists.

    Cost in rows: a small set makes one per subset of two n-grams of its head.
    A scanned set makes one per n-gram of its head and meets the partners in
    their lists. Small sets within reach of a large one are listed as well.
    """
    def subsets(size: int) -> float:
        head = size - _need(percent, size) + 2
        return sizes.get(size, (0, 0))[0] * head * (head - 1) / 2

    def scans(size: int) -> float:
        n, partners = sizes.get(size, (0, 0))
        head = size - _need(percent, size) + 1
        return n * head + partners * head / size

    def cost(boundary: int) -> float:
        near = _need(percent, boundary)
        return sum(subsets(s) for s in range(1, boundary)) + sum(scans(s) for s in range(near, SMALL_SIZES + 1))

    return min(range(4, SMALL_SIZES + 1), key=cost)


def _heads(docs: DataFrame, marks: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, head, sketch): size, 128-bit mark, first n-grams in global order and parity sketch of each set.

    A head entry is the place of the n-gram in the global order, the key of its list.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(marks).astype(bool)
        for batch in source:
            for part in text_slices(batch):
                sets = _sets(part, words)
                heads, marks_a, marks_b = [], [], []
                sketches = parity_sketches(sets)
                for own in sets:
                    marks_a.append(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))
                    marks_b.append(np.add.reduce(mix(own * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))).view(np.int64))
                    place = own >> np.uint64(3 + PART_BITS) << np.uint64(PART_BITS)
                    place[common[slot_of(own)]] |= np.uint64(COMMON_BIT)
                    size = len(own)
                    head = size - _need(percent, size) + 2 if size else 0
                    heads.append(np.sort(np.partition(place, head - 1)[:head]) if 0 < head < size else np.sort(place))
                yield batches({
                    "doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sig_a": pa.array(marks_a, pa.int64()), "sig_b": pa.array(marks_b, pa.int64()), "head": packed(heads),
                    **{name: pa.array(sketches[:, k]) for k, name in enumerate(SKETCH)},
                })

    sketch = ", ".join(f"{name} long" for name in SKETCH)
    return _texts(docs).mapInArrow(run, f"doc_id long, n long, sig_a long, sig_b long, head binary, {sketch}")


def _entries(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(key, id) per list entry of a set and per subset of a small one."""
    near = _need(percent, boundary)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys, counts = [np.zeros(0, np.uint64)], []
                for size, name, raw in zip(*(part.column(c).to_pylist() for c in ("n", "id", "head"))):
                    head, before = unpacked(raw), len(keys)
                    if size >= near:
                        single = head[: size - _need(percent, size) + 1].copy()
                        single[single >= COMMON_BIT] |= np.uint64(hash(name) * 0x9E3779B1 >> 7 & (1 << PART_BITS) - 1)
                        keys.append(single)
                    if size < boundary and len(head) > 1:
                        pair = np.array(list(combinations(range(len(head)), 2)))
                        subset = mix(head[pair[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + head[pair[:, 1]])
                        keys.append(subset >> np.uint64(3) | np.uint64(_SUBSET_BIT))
                    counts.append(sum(map(len, keys[before:])))
                index = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield batches({"key": pa.array(np.concatenate(keys).view(np.int64)), "id": part.column("id").take(index)})

    return sets.select("id", "n", "head").mapInArrow(run, "key long, id long")


def _sizes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, p, last): size of the set and of its listed head, and the head's last place in the global order."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes = batch.column("n").to_pylist()
            listed = [n - _need(percent, n) + 1 for n in sizes]
            last = [int(unpacked(raw)[p - 1]) for p, raw in zip(listed, batch.column("head").to_pylist())]
            yield batches({"id": batch.column("id"), "n": batch.column("n"), "p": pa.array(listed, pa.int64()), "last": pa.array(last, pa.int64())})

    return stage(sets.select("id", "n", "head").mapInArrow(run, "id long, n long, p long, last long"), "sizes")


def _fits(a: str, b: str, percent: int) -> str:
    """Two sizes can belong to one link."""
    return f"(100 * {a}n >= {percent} * {b}n AND 100 * {b}n >= {percent} * {a}n)"


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose sets reach the threshold, counted exactly."""
    pairs = stage(pairs.select("a", "b"), "pairs")
    wanted = stage(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_id"), "wanted")

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                yield batches({"id": part.column("doc_id"), "grams": packed(_sets(part, words))})

    texts = _texts(docs).join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
    grams = stage(texts.mapInArrow(sets, "id long, grams binary"), "grams")

    def check(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                links = []
                for left, right in zip(part.column("left"), part.column("right")):
                    left, right = unpacked(left.as_buffer()), unpacked(right.as_buffer())
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    links.append(100 * both >= percent * (len(left) + len(right) - both))
                yield part.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    joined = pairs.join(grams.toDF("a", "left"), "a").join(grams.toDF("b", "right"), "b")
    return stage(joined.mapInArrow(check, "a long, b long"), "verified")


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id.

    Documents link when 100 * shared >= percent * united n-grams. ``docs`` needs
    doc_id and text; other columns are ignored. A text with fewer words than an
    n-gram, but not none, has its whole sequence as the one n-gram; a NULL or
    empty text has no n-gram, links with nothing and is its own component. Of
    rows that repeat a doc_id, links of one hold for all, as they are one
    document; a row without doc_id links with nothing and has no component.
    """
    marks, sizes = _statistics(docs, words)
    heads = stage(_heads(docs, marks, words, percent), "heads")
    boundary = small_boundary(sizes, percent)
    same = ["n", "sig_a", "sig_b"]
    filled = heads.filter("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    firsts = stage(filled.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "firsts")
    equal = stage(filled.select("id", *same).join(firsts, same).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), "equal")
    sets = filled.join(equal.select(F.col("b").alias("id")), "id", "left_anti")

    found = components(equal.unionByName(_near_links(docs, sets, boundary, words, percent)))
    return heads.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _near_links(docs: DataFrame, sets: DataFrame, boundary: int, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different sets that connect all that links connect."""
    sizes = _sizes(sets, percent)
    common = F.col("key").bitwiseAND(COMMON_BIT | _SUBSET_BIT) == COMMON_BIT
    whole = F.when(common, F.shiftleft(F.shiftright("key", PART_BITS), PART_BITS)).otherwise(F.col("key"))
    in_list = Window.partitionBy("key").orderBy("id")
    entries = _entries(sets, boundary, percent).select(
        "key", "id", F.lag("id").over(in_list).alias("before"), F.lead("id").over(in_list).alias("next")
    )
    shared = stage(entries.filter(F.col("before").isNotNull() | F.col("next").isNotNull() | common).select("key", "id"), "lists")

    # The hub of a list is the set that shares most entries: of a group of near
    # copies the least edited one, which most others link to. Lists of common
    # n-grams may be long: a hub in each part, then a hub among these.
    own = stage(shared.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "shared-entries")
    best_first = [F.desc("own"), F.col("id")]
    ranked = shared.join(own, "id").withColumn("hub", F.first("id").over(Window.partitionBy("key").orderBy(*best_first)))
    ranked = stage(ranked, "hubs")
    heads = ranked.filter((F.col("hub") == F.col("id")) & common).withColumn("whole", whole)
    heads = heads.select("id", F.first("id").over(Window.partitionBy("whole").orderBy(*best_first)).alias("hub"))
    near = ranked.select("id", "hub").unionByName(heads).filter("hub <> id")
    per_pair = near.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("both"))
    of_hub = sizes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))
    per_pair = per_pair.join(sizes.select("id", "n", "p"), "id").join(of_hub, "hub").filter(_fits("", "hub_", percent))
    # A hub that shares few entries of the head is no likely link; the second step decides on it.
    best = per_pair.filter("2 * both >= p").groupBy("id").agg(F.max(F.struct("both", "hub")).alias("best"))
    first = _verified(best.select(F.col("best.hub").alias("a"), F.col("id").alias("b")), docs, words, percent)

    names = stage(components(first), "components")
    left = shared.select(whole.alias("key"), "id").join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = stage(left, "list-components")
    marks = {**members(), "low": F.min("component"), "high": F.max("component")}
    mixed = left.groupBy("key").agg(*[value.alias(name) for name, value in marks.items()]).filter("low <> high")
    # Lists with the same members are joined once, with their number.
    alike = mixed.groupBy("members", "mark_a", "mark_b", (F.col("key") >= _SUBSET_BIT).alias("subset"))
    mixed = stage(alike.agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("lists")).select("key", "lists", "members"), "mixed-lists")
    # Of a set's entries in these lists, those in short lists come first. Here a pair shares
    # at most as many as either set has, and of its first shared entry no more than the rest stand behind it.
    own = Window.partitionBy("id", F.col("key") >= _SUBSET_BIT)  # the entries of one set
    in_order = own.orderBy("members", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.join(mixed, "key").select("*", F.sum("lists").over(own).alias("met"), (F.sum("lists").over(in_order) - F.col("lists")).alias("ahead"))
    left = stage(left.drop("members", "lists").join(sizes, "id").join(sets.select("id", *SKETCH), "id"), "mixed-entries")
    a, b = left.alias("a"), left.alias("b")
    # Of the set whose head ends first, all entries up to there are known.
    rest = F.when(F.col("a.last") <= F.col("b.last"), F.col("a.n") - F.col("a.p")).otherwise(F.col("b.n") - F.col("b.p"))
    least = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent)) - rest
    subset = F.col("a.key") >= _SUBSET_BIT
    first_shared = subset | ((F.col("a.ahead") + least <= F.col("a.met")) & (F.col("b.ahead") + least <= F.col("b.met")))
    apart = (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    possible = F.expr(_fits("a.", "b.", percent)) & first_shared & sketches_allow("a.", "b.", percent)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & possible)
    second = _verified(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), docs, words, percent)
    return first.unionByName(second)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component; all columns stay.

    Rows without doc_id stay, and so do all rows that repeat a kept doc_id.
    """
    found = similar_sets(docs, words, percent).filter("doc_id <> component_id")
    dropped = stage(found.select("doc_id").distinct(), "near-copies")
    return without_rows(docs, dropped, [F.col("doc_id").cast("long")])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked by five-word shingles."""
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
           FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE len(w) > 0),
     z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.reach) AS component_id
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op3_ngram_jaccard_join": (op3_ngram_jaccard_join, SQL)}
