"""Substring dedup by MinHash banding of paragraphs.

A passage may repeat anywhere, so every stretch of ``paragraph_words`` words is
a paragraph. Each band has one hash function; the band's value of a paragraph is
the least hash of its five-word shingles. Neighbouring paragraphs mostly have
the same value, so a text gives one row per change of it, about one per 24 words
and band. Common shingles come last in the hash order, so boilerplate does not
fill the bands.

Paragraphs that collide in a band are compared with the first holder of the
value, which takes one row per paragraph however many copies there are. Each
pair of documents is verified once: along the diagonals of its collisions, and
by the exact Jaccard similarity of the spans found. The first holder need not
share the passage, so collisions that no verified span covers are then compared
with all earlier holders of the value, at all their places. Most of these only
share a few words by chance: a sketch of the shingles within a paragraph's reach
bounds from above what the paragraphs around two places can share, and a pair
that it rules out is not verified. Spans that repeat an earlier document's go;
linked spans form clusters, the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.drops import unused
from tidemark.llm.graph import components
from tidemark.llm.ngram_join import COMMON_BIT, PART_BITS, common_ngrams, slot_of
from tidemark.llm.words import SPACED, batches, hash_words, mix, packed, text_bytes, text_slices, unpacked, windows, word_spans
from tidemark.staging import stage

PARAGRAPH_WORDS = 51
SHINGLE_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Bits of a sketch of the shingles around a place, and its columns of 64 bits each.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands of one row each that find a paragraph of the given similarity with the given chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def _texts(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every window of ``size`` places."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def _band_rows(docs: DataFrame, marks: np.ndarray, words: int, bands: int) -> DataFrame:
    """(key, doc_id, at): per text and band the values of its paragraphs and where their shingle stands."""
    size = words - SHINGLE_WORDS + 1

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(marks).astype(bool)
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = hash_words(part.column("text"), SPACED)
                grams = windows(hashes, SHINGLE_WORDS)
                if len(grams) < size:
                    continue
                owner = np.repeat(np.arange(part.num_rows), np.diff(rows))
                whole = owner[: len(grams) - size + 1] == owner[words - 1 :]
                often = common[slot_of(grams)]
                names = part.column("doc_id").to_numpy()
                keys, docs_, at = [], [], []
                for band in range(bands):
                    value = mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (band + 1) & (1 << 64) - 1)) >> np.uint64(3 + PART_BITS) << np.uint64(PART_BITS)
                    value[often] |= np.uint64(COMMON_BIT)
                    least = _least(value, size)
                    new = whole.copy()
                    new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (owner[1 : len(whole)] != owner[: len(whole) - 1])
                    first = np.flatnonzero(new)
                    place = np.concatenate([np.zeros(0, np.int64), *[
                        own + (value[own[:, None] + np.arange(size)] == least[own][:, None]).argmax(axis=1)
                        for own in np.array_split(first, max(1, len(first) // 50_000))
                    ]])
                    key, doc = least[first], names[owner[first]]
                    often_first = key >= COMMON_BIT
                    key[often_first] |= mix(doc[often_first].astype(np.uint64)) & np.uint64((1 << PART_BITS) - 1)
                    keys.append(key)
                    docs_.append(doc)
                    at.append(place - rows[owner[first]])
                yield batches({
                    "key": pa.array(np.concatenate(keys).view(np.int64)), "doc_id": pa.array(np.concatenate(docs_), pa.int64()),
                    "at": pa.array(np.concatenate(at).astype(np.int32)),
                })

    return docs.mapInArrow(run, "key long, doc_id long, at int")


def _paired(pairs: DataFrame) -> DataFrame:
    """(doc_id, other, places): pairs of documents with the places of their collisions."""
    place = F.collect_set(F.struct("at", "other_at"))
    return stage(pairs.groupBy("doc_id", "other").agg(place.alias("places")), "pairs")


def _colliding(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that collide, but for a value's first; pairs of documents with first holders)."""
    common = F.col("key") >= COMMON_BIT
    value = Window.partitionBy("key").orderBy("doc_id", "at")
    hubs = rows.select("*", F.first("doc_id").over(value).alias("other"), F.first("at").over(value).alias("other_at"))
    apart = F.col("doc_id") != F.col("other")
    first = (F.col("at") == F.col("other_at")) & ~apart
    kept = stage(hubs.filter(~first | common), "collisions")
    # The value of a common shingle is dealt out in parts: their first holders meet here.
    whole = Window.partitionBy("whole").orderBy("doc_id", "at")
    heads = kept.filter(first).select("doc_id", "at", F.shiftright("key", PART_BITS).alias("whole"))
    heads = heads.select("doc_id", "at", F.first("doc_id").over(whole).alias("other"), F.first("at").over(whole).alias("other_at"))
    pairs = kept.select("doc_id", "at", "other", "other_at").unionByName(heads).filter("doc_id <> other")
    return kept, _paired(pairs)


def around(grams: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketch, spare, repeats) of the shingles up to ``reach`` places before and after each place of a text.

    A sketch has the bit of each distinct shingle; ``spare`` is how many of them
    share a bit, ``repeats`` how many places repeat a shingle. A place beyond the
    text has all bits: it rules nothing out.
    """
    inside = at < len(grams)
    spots = np.where(inside, at, 0)[:, None] + np.arange(-reach, reach + 1)
    known = (spots >= 0) & (spots < len(grams))
    own = grams[np.clip(spots, 0, len(grams) - 1)] if len(grams) else np.zeros(spots.shape, np.uint64)
    own = np.sort(np.where(known, own, own[:, reach : reach + 1]), axis=1)
    distinct = 1 + (own[:, 1:] != own[:, :-1]).sum(axis=1)
    bits = np.zeros((len(at), SKETCH_BITS), bool)
    bits[np.arange(len(at))[:, None], (own & np.uint64(SKETCH_BITS - 1)).astype(np.int64)] = True
    spare, repeats = distinct - bits.sum(axis=1), known.sum(axis=1) - distinct
    bits[~inside] = True
    return np.packbits(bits, axis=1).view("<i8"), np.where(inside, spare, 2 * reach + 1), np.where(inside, repeats, 0)


def _surroundings(known: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """``places`` (whole, doc_id, at, open) with what ``around`` gives for each of them."""
    reach = words - SHINGLE_WORDS
    fields = ("whole", "at", "open")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc, own, spots in zip(batch.column("id").to_pylist(), batch.column("words"), batch.column("spots")):
                grams = windows(unpacked(own.as_buffer(), np.uint32).astype(np.uint64), SHINGLE_WORDS)
                for first in range(0, len(spots.values), 2000):
                    part = spots.values.slice(first, 2000)
                    sketch, spare, repeats = around(grams, part.field("at").to_numpy().astype(np.int64), reach)
                    yield batches({
                        **{name: part.field(name) for name in fields}, "doc_id": pa.array(np.full(len(part), doc, np.int64)),
                        **{name: pa.array(np.ascontiguousarray(sketch[:, k])) for k, name in enumerate(SKETCH)},
                        "spare": pa.array(spare.astype(np.int32)), "repeats": pa.array(repeats.astype(np.int32)),
                    })

    lists = places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct(*fields)).alias("spots"))
    joined = known.hint("merge").join(lists, "id").select("id", "words", "spots")
    kinds = ", ".join(f"{name} long" for name in SKETCH)
    return stage(joined.mapInArrow(run, f"whole long, at int, open boolean, doc_id long, {kinds}, spare int, repeats int"), "surroundings")


def _may_link(words: int, similarity: float) -> Column:
    """Whether stretches of a paragraph's length around two places may reach the similarity, for all that their sketches show.

    Two such stretches share at least ``similarity / (1 + similarity)`` of the sum of
    their distinct shingles, of which each has one less per repeat. No more are
    shared than common bits, and shingles that share a bit with another.
    """
    size = words - SHINGLE_WORDS + 1
    common = " + ".join(f"bit_count({name} & _{name})" for name in SKETCH)
    need = 4 * size * similarity / (1 + similarity) - 1e-6
    return F.expr(f"2 * ({common} + least(spare, _spare)) + repeats + _repeats >= {need}D")


def _uncovered(known: DataFrame, kept: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs of documents as above: collisions outside the verified spans with all earlier holders of the value that may link there."""
    held = kept.select(F.shiftright("key", PART_BITS).alias("whole"), "doc_id", "at")
    span = links.select(F.col("doc_id").alias("_id"), "start", (F.col("start") + F.col("n_words")).alias("end")).distinct()
    inside = (F.col("doc_id") == F.col("_id")) & (F.col("at") >= F.col("start")) & (F.col("at") + SHINGLE_WORDS <= F.col("end"))
    left = stage(held.join(span, inside, "left_anti"), "uncovered")
    met = held.join(left.select("whole").distinct(), "whole", "left_semi")
    places = left.withColumn("open", F.lit(True)).unionByName(met.withColumn("open", F.lit(False)))
    places = places.groupBy("whole", "doc_id", "at").agg(F.max("open").alias("open"))
    found = _surroundings(known, places, words)
    names = {"doc_id": "other", "at": "other_at"}
    earlier = found.select("whole", *[F.col(c).alias(names.get(c, f"_{c}")) for c in found.columns if c not in ("whole", "open")])
    pairs = found.filter("open").join(earlier, "whole").filter("other < doc_id").filter(_may_link(words, similarity))
    return _paired(pairs.select("doc_id", "at", "other", "other_at"))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b))
    return both / max(1, len(np.union1d(a, b)))


def common_spans(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]], words: int, similarity: float) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of similar spans through colliding places.

    Along each diagonal, runs of windows whose shingles agree in place; then
    windows around places that no run covers, for words put in or left out.
    """
    found: list[tuple[int, int, int]] = []
    size = words - SHINGLE_WORDS + 1
    need = math.ceil(2 * size * similarity / (1 + similarity) - 1e-9)
    diagonals: dict[int, list[int]] = {}
    for at, other in places:
        diagonals.setdefault(at - other, []).append(at)
    grams_a, grams_b = windows(a, SHINGLE_WORDS), windows(b, SHINGLE_WORDS)
    for shift, ats in diagonals.items():
        low, high = max(0, shift), min(len(grams_a), len(grams_b) + shift)
        equal = grams_a[low:high] == grams_b[low - shift : high - shift]
        same = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero(same[size:] - same[:-size] >= need) if len(same) > size else np.zeros(0, np.int64)
        covered = []
        if len(good):
            cuts = np.flatnonzero(np.diff(good) > words)
            for first, last in zip(good[np.append(0, cuts + 1)], good[np.append(cuts, len(good) - 1)] + size):
                places = np.flatnonzero(equal[first:last]) + first + low  # a run of windows ends with its last equal shingle
                start, end = int(places[0]), int(places[-1]) + 1
                if _jaccard(grams_a[start:end], grams_b[start - shift : end - shift]) >= similarity:
                    covered.append((start, end + SHINGLE_WORDS - 1))
        for at in sorted(set(ats)):
            if any(start <= at < end for start, end in covered):
                continue
            for before in (0, size // 2, size - 1):
                start = min(max(at - before, low), high - size)
                if start >= low and _jaccard(grams_a[start : start + size], grams_b[start - shift : start - shift + size]) >= similarity:
                    covered.append((start, start + words))
                    break
        found += [(start, start - shift, end - start) for start, end in covered]
    return found


def _sequences(docs: DataFrame, kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, size, words): the word hashes of all documents that collide, read once for all comparisons."""
    named = kept.select(F.col("doc_id").alias("id")).union(pairs.select("doc_id")).union(pairs.select("other"))
    wanted = stage(named.distinct(), "wanted")

    def sequences(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = hash_words(part.column("text"), SPACED)
                own = [hashes[a:b].astype(np.uint32) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
                yield batches({"id": part.column("doc_id"), "size": pa.array(np.diff(rows), pa.int64()), "words": packed(own, np.uint32)})

    # Merge joins, here and below: the same plan for any number of documents that collide.
    texts = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    return stage(texts.mapInArrow(sequences, "id long, size long, words binary"), "sequences")


def _links(known: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, start, other, other_start, n_words) of verified spans."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other document only the stretch that the text can reach along its diagonals."""
        for batch in source:
            kept, shifts = [], []
            for size, places, other in zip(batch.column("size").to_pylist(), batch.column("places").to_pylist(), batch.column("b")):
                starts = [p["other_at"] - p["at"] for p in places]
                low = max(0, min(starts))
                kept.append(unpacked(other.as_buffer(), np.uint32)[low : max(starts) + size])
                shifts.append(low)
            yield batches({**{c: batch.column(c) for c in ("doc_id", "other", "places")}, "shift": pa.array(shifts, pa.int64()), "b": packed(kept, np.uint32)})

    def verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for first in range(0, batch.num_rows, 200):
                part, out = batch.slice(first, 200), []
                for doc, other, places, shift, a, b in zip(*(part.column(c) for c in ("doc_id", "other", "places", "shift", "a", "b"))):
                    shift, (a, b) = shift.as_py(), (unpacked(x.as_buffer(), np.uint32).astype(np.uint64) for x in (a, b))
                    spots = [(p["at"], p["other_at"] - shift) for p in places.as_py()]
                    for start, other_start, count in common_spans(a, b, spots, words, similarity):
                        out.append((doc.as_py(), start, other.as_py(), other_start + shift, count))
                yield batches({name: pa.array([row[k] for row in out], pa.int64()) for k, name in enumerate(("doc_id", "start", "other", "other_start", "n_words"))})

    near = pairs.join(known.select(F.col("id").alias("doc_id"), "size").hint("merge"), "doc_id")
    near = near.join(known.select(F.col("id").alias("other"), F.col("words").alias("b")).hint("merge"), "other")
    near = near.select("doc_id", "other", "places", "size", "b").mapInArrow(
        cut, "doc_id long, other long, places array<struct<at:int,other_at:int>>, shift long, b binary"
    )
    joined = near.join(known.select(F.col("id").alias("doc_id"), F.col("words").alias("a")).hint("merge"), "doc_id")
    return stage(joined.mapInArrow(verify, "doc_id long, start long, other long, other_start long, n_words long"), "links")


def repeated_passages(docs: DataFrame, words: int = PARAGRAPH_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per removed span: doc_id, start, n_words, kept_in, cluster_id.

    Start and length count words between white space. A span goes if a document
    with a smaller doc_id, ``kept_in``, has a span that reaches the similarity;
    overlapping spans of a document are one, with the smallest such document.
    Documents without such a span, among them NULL, empty and short texts, have
    no row. Needs doc_id and text; other columns are ignored. Rows without
    doc_id are ignored; rows that repeat one are one document.
    """
    texts = _texts(docs)
    rows = _band_rows(texts, common_ngrams(texts, SHINGLE_WORDS), words, tuned_bands(similarity, recall))
    kept, pairs = _colliding(rows)
    known = _sequences(texts, kept, pairs)
    links = _links(known, pairs, words, similarity)
    links = links.union(_links(known, _uncovered(known, kept, links, words, similarity), words, similarity))

    # Clusters link stretches of the length of a paragraph.
    def node(doc: str, start: str, k: Column) -> Column:
        return F.xxhash64(F.col(doc), F.floor(F.col(start) / words) + k)

    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / words).cast("int")))
    ends = links.select("*", steps.alias("k")).select(node("doc_id", "start", F.col("k")).alias("a"), node("other", "other_start", F.col("k")).alias("b"))
    clusters = stage(components(ends), "clusters")

    order = Window.partitionBy("doc_id").orderBy("start", "n_words")
    reach = F.max(F.col("start") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = links.select("*", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    spans = spans.withColumn("number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "number").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("n_words")) - F.min("start")).alias("n_words"), F.min("other").alias("kept_in")
    )
    named = merged.withColumn("id", node("doc_id", "start", F.lit(0))).join(clusters, "id", "left")
    return named.select("doc_id", "start", "n_words", "kept_in", F.col("component").alias("cluster_id"))


def without_passages(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """``docs`` with the removed spans cut from the texts, up to the next word; all columns stay."""

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, _cut)

    span = F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))
    own = unused(docs.columns, "cut_id", "cut_spans")
    cut_id, cut_spans = map(F.col, own)
    cuts = stage(removals.groupBy("doc_id").agg(F.sort_array(F.collect_list(span))).toDF(*own), "cuts")
    joined = docs.join(cuts, cut_id == F.col("doc_id").cast("long"), "left")
    text = F.when(cut_spans.isNull(), F.col("text")).otherwise(cut("text", F.transform(cut_spans, lambda s: F.array(s["start"], s["end"]))))
    return joined.withColumn("text", text).select(*docs.columns)


def _cut(text, spans):
    if text is None or spans is None:
        return text
    raw = text.encode()
    _, starts, _, _ = word_spans(*text_bytes(pa.array([text])), SPACED)
    edges, kept, last = np.append(starts, len(raw)), [], 0
    for begin, end in spans:
        kept.append(raw[last : edges[begin]])
        last = int(edges[end])
    return b"".join([*kept, raw[last:]]).decode()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_substring_dedup": (op1_substring_dedup, None)}
