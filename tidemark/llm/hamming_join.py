"""Near duplicates by a Hamming join of b-bit MinHash signatures over several indexes.

A document's set of word pairs gives a signature of 80 symbols of 8 bits, each from
one minimum over the set. Two sets of similarity ``s`` differ in a symbol with
probability ``1 - s``: in 16 of 80 at 0.8, with a deviation of 3.6.

* Signatures are cut into 16 chunks of five symbols. Two signatures that differ in
  31 symbols or fewer must have a chunk in which they differ in one symbol or
  none, or else there would be two differences in each chunk. Of each chunk every choice of
  one symbol to leave out makes an index key of the other four. So all
  pairs within the threshold meet under a key, whatever their differences.
* Documents that meet form a list per key. Each document is first compared with one of the
  first documents of its lists, the one it meets most often. Only lists that
  hold several components after that are joined with themselves, once for all lists of the same members; a pair comes out of this
  join if it is of two components, within the sizes and the distance, and if the sets' parity sketches
  do not show that they differ too much, which they never show of a link.
* Links are confirmed on the full sets.

The threshold lies 4.3 deviations above the expected distance of the least similar link, which
leaves out one in 100,000 of such pairs and fewer of all others.

Equal sets are one from the start. Signatures and lists are staged tables, and lists are split
like any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.sketches import SKETCH, members, parity_sketches, sketches_allow
from tidemark.llm.words import SPACED, batches, hash_words, mix, packed, row_shingles, text_slices, unpacked
from tidemark.staging import stage

WORDS = 2
PERCENT = 80
CHUNKS = 16
CHUNK_SYMBOLS = 5
ERRORS = 1  # symbols of a chunk that may differ
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Signatures that differ in more symbols may share no key.
DISTANCE = CHUNKS * (ERRORS + 1) - 1

_NUMBERS = np.random.Generator(np.random.PCG64(80132)).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS_OF_SIGNATURE = [f"w{k}" for k in range(SYMBOLS // 8)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(part: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return list(row_shingles(*hash_words(part.column("text"), SPACED), words))


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols per set, all zero for an empty one."""
    out = np.zeros((len(sets), SYMBOLS), np.uint8)
    filled = np.flatnonzero([len(s) for s in sets])
    if len(filled):
        flat = np.concatenate([sets[k] for k in filled])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in filled])[:-1]])
        for k, number in enumerate(_NUMBERS):
            least = np.minimum.reduceat(flat * number, starts)
            out[filled, k] = (mix(least ^ number) & np.uint64(0xFF)).astype(np.uint8)
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per input row: doc_id, n (size of the set), mark_a, mark_b (128 bits that name the set), signature and parity sketch as 64-bit words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                sets = _sets(part, words)
                marks = [[np.add.reduce(mix(s * np.uint64(a) + np.uint64(b))).view(np.int64) for s in sets]
                         for a, b in ((0x2545F4914F6CDD1D, 1), (0x9E3779B97F4A7C15, 7))]
                columns, sketches = signatures_of(sets).view("<i8"), parity_sketches(sets)
                yield batches({
                    "doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "mark_a": pa.array(marks[0], pa.int64()), "mark_b": pa.array(marks[1], pa.int64()),
                    **{name: pa.array(columns[:, k]) for k, name in enumerate(_WORDS_OF_SIGNATURE)},
                    **{name: pa.array(sketches[:, k]) for k, name in enumerate(SKETCH)},
                })

    ddl = "doc_id long, n long, mark_a long, mark_b long, " + ", ".join(f"{name} long" for name in [*_WORDS_OF_SIGNATURE, *SKETCH])
    return _texts(docs).mapInArrow(run, ddl)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """The keys of each signature: per chunk and choice of symbols to leave out, the number of both and the symbols left."""
    symbols = symbols.reshape(len(symbols), CHUNKS, CHUNK_SYMBOLS).astype(np.int64)
    kept = list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS))
    out = np.empty((len(symbols), CHUNKS, len(kept)), np.int64)
    for choice, places in enumerate(kept):
        value = np.arange(CHUNKS, dtype=np.int64) * len(kept) + choice
        for place in places:
            value = value << 8 | symbols[:, :, place]
        out[:, :, choice] = value
    return out.reshape(len(symbols), -1)


def _entries(sets: DataFrame) -> DataFrame:
    """(key, id) per key of a set."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                symbols = np.column_stack([part.column(name).to_numpy(zero_copy_only=False) for name in _WORDS_OF_SIGNATURE])
                keys = index_keys(np.ascontiguousarray(symbols, "<i8").view(np.uint8).reshape(part.num_rows, SYMBOLS))
                index = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield batches({"key": pa.array(keys.ravel()), "id": part.column("id").take(index)})

    return sets.select("id", *_WORDS_OF_SIGNATURE).mapInArrow(run, "key long, id long")


def distance(a: str, b: str) -> Column:
    """Number of symbols in which two signatures differ; ``a`` and ``b`` are prefixes of their columns."""

    def differing(name: str) -> str:
        x = f"({a}{name} ^ {b}{name})"
        x = f"(({x} | shiftrightunsigned({x}, 4)) & {0x0F0F0F0F0F0F0F0F}L)"
        x = f"(({x} | shiftrightunsigned({x}, 2)) & {0x0303030303030303}L)"
        return f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {0x0101010101010101}L)"

    return F.expr(" + ".join(differing(name) for name in _WORDS_OF_SIGNATURE))


def _possible(percent: int) -> Column:
    """Sets a and b may link: their sizes fit, their signatures are within the distance, their sketches allow it."""
    fit = F.expr(f"100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n")
    return fit & (distance("a.", "b.") <= DISTANCE) & sketches_allow("a.", "b.", percent)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of documents whose full sets reach the threshold."""
    wanted = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                yield batches({"id": part.column("doc_id"), "grams": packed(_sets(part, words))})

    # A merge join, the same plan for any number of pairs.
    texts = _texts(docs).join(wanted.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
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

    joined = pairs.select("a", "b").join(grams.toDF("b", "right").hint("merge"), "b").join(grams.toDF("a", "left").hint("merge"), "a")
    return stage(joined.select("a", "b", "left", "right").mapInArrow(check, "a long, b long"), "confirmed")


def _near_links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different sets that connect all that links connect."""
    entries = _entries(sets)
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("key", "hub")
    lists = stage(entries.join(hubs.hint("merge"), "key"), "lists")

    met = lists.filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("met"))
    best = stage(met.groupBy("id").agg(F.max(F.struct("met", (-F.col("hub")).alias("low"))).alias("best")).select("id", (-F.col("best.low")).alias("hub")), "best")
    a, b = sets.alias("a"), sets.alias("b")
    near = best.join(a, F.col("hub") == F.col("a.id")).join(b, best["id"] == F.col("b.id"))
    near = near.filter(_possible(percent))
    first = confirmed(stage(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), "first-pairs"), docs, words, percent)

    names = stage(components(first), "names")
    named = lists.select("key", "id").join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = stage(named, "named-lists")
    marks = {**members(), "low": F.min("component"), "high": F.max("component")}
    mixed = named.groupBy("key").agg(*[value.alias(name) for name, value in marks.items()]).filter("low <> high")
    # Lists with the same members are joined once.
    mixed = stage(mixed.groupBy("members", "mark_a", "mark_b").agg(F.min("key").alias("key")).select("key"), "mixed")
    left = stage(named.join(mixed, "key", "left_semi").join(sets.drop("mark_a", "mark_b"), "id"), "mixed-lists")
    a, b = left.alias("a"), left.alias("b")
    apart = (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _possible(percent))
    pairs = stage(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "second-pairs")
    # Stars of the first components in place of their links: fewer rounds later.
    stars = names.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return stars.unionByName(confirmed(pairs, docs, words, percent))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * shared >= percent * united runs of ``words`` words, and
    ``component_id`` is the smallest doc_id that links reach; that document is kept. ``docs``
    needs doc_id and text; other columns are ignored. A text with fewer words, but
    not none, has its whole sequence as the one run; a NULL or empty text has
    none, links with nothing and is kept. Rows that repeat a doc_id are one document:
    what links with one of them is linked with all. A row without doc_id links with nothing, has no
    component and is kept. The index holds every pair within the distance for which the
    signature is laid out, for 80 percent and more.
    """
    made = stage(signatures(docs, words), "signatures")
    same = ["n", "mark_a", "mark_b"]
    filled = made.filter("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    firsts = filled.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").drop("last")
    equal = stage(filled.select("id", *same).join(stage(firsts, "firsts"), same).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")), "equal")
    # So small a set links with equal ones only: one run more or less is below the threshold.
    larger = filled.filter(f"100 * n >= {percent} * (n + 1)")
    sets = stage(larger.dropDuplicates(["id", *same]).join(equal.select(F.col("b").alias("id")), "id", "left_anti"), "sets")
    found = components(equal.unionByName(_near_links(docs, sets, words, percent)))
    own = F.coalesce("component", "doc_id")
    return made.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked by word pairs."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') AS g
           FROM d, unnest(range(1, len(w) - least(len(w), 2) + 2)) AS r(i) WHERE len(w) > 0),
     z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     o AS (SELECT s.doc_id, g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY held, g) AS place
           FROM s JOIN z USING (doc_id) JOIN (SELECT g, count(*) AS held FROM s GROUP BY g) USING (g)),
     h AS (SELECT * FROM o WHERE place <= n - ceil(0.8 * n) + 1),
     c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
     p AS (SELECT a, b, count(*) AS shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
     u AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     l AS MATERIALIZED (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
     r AS (SELECT doc_id AS id, doc_id AS reach FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op13_minhash_near_dedup": (op13_minhash_near_dedup, SQL)}
