"""Fill-in-the-middle rows, cut by arithmetic on whole 64-bit words of UTF-8.

A text is a row of units: white space with the word behind it, or white space at
the end. The bytes of all texts of a slice are viewed as 64-bit words, eight
bytes at a time:

* Sums and masks without carries between bytes set the top bit of each byte that
  is white space, and from these of each byte that ends a unit.
* ``bitwise_count`` gives the ends per word, a running sum the ends before each.
* The word that holds the k-th end is found in the running sum by binary search,
  the byte in it by clearing lower ends.

Characters are counted the same way, by the bytes that begin one. Ids alone
decide where and how a text is cut, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import batches, text_bytes, text_slices

SEED = 42
PERCENT = 50  # of the documents that are cut
PERCENT_SPM = 80  # of these, those with the suffix first
MARKS = ["<P>", "<S>", "<M>"]

_U = np.uint64
_TOPS, _ONES = _U(0x8080808080808080), _U(0x0101010101010101)
_REST = ~_TOPS


def _at_least(low: np.ndarray, value: int) -> np.ndarray:
    """Top bits of the bytes whose lower seven bits, given in ``low``, are ``value`` or more."""
    return low + _ONES * _U(0x80 - value)


def white_space(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that is a space or in 09 to 0D."""
    low = words & _REST
    not_space = (low ^ (_ONES * _U(0x20))) + _REST
    return (~not_space | (_at_least(low, 0x09) & ~_at_least(low, 0x0E))) & ~words & _TOPS


def unit_ends(words: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Top bit of each byte that ends a unit; ``lasts`` are the places of the last bytes of the texts."""
    space = white_space(words)
    after = space >> _U(8)
    after[:-1] |= space[1:] << _U(56)
    ends = ~space & after & _TOPS
    ends.view(np.uint8)[lasts] = 0x80
    return ends


def char_starts(words: np.ndarray) -> np.ndarray:
    """Top bit of each byte that begins a character."""
    return ~(words & ~(words << _U(1))) & _TOPS


class Ranks:
    """Number of marked bytes before a place, and the place of the k-th one."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        word, byte = places >> 3, (places & 7).astype(np.uint64)
        own = np.append(self.marks, _U(0))[word]
        return self.before[word] + np.bitwise_count(own & ((_U(1) << (byte * _U(8))) - _U(1)))

    def select(self, count: np.ndarray) -> np.ndarray:
        """Place of the marked byte with that number, from 1."""
        word = np.searchsorted(self.before, count, "left") - 1
        own, left = self.marks[word], count - self.before[word]
        for _ in range(7):
            own = np.where(left > 1, own & (own - _U(1)), own)
            left = left - 1
        lowest = own & (~own + _U(1))
        return word * 8 + (np.bitwise_count(lowest - _U(1)) >> 3)


def word_view(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words; what fills the last word is zero."""
    out = np.zeros(-(-len(data) // 8) + 1, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out.astype(np.uint64, copy=False)


def _draw(seed: int, doc_id: Column, number: int) -> Column:
    """The ``number``-th group of eight hex digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, percent_spm: int = PERCENT_SPM) -> DataFrame:
    """Per input row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``form`` is ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or
    ``spm`` (suffix, prefix, middle). Needs doc_id and text; other columns are
    ignored. A NULL text counts as empty; empty texts and texts that hold a mark
    stay plain. Rows that repeat an id draw the same numbers; a row without id
    draws those of an empty one. Texts are cut whole, whatever their length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = text == ""
    for mark in MARKS:
        held = held | text.contains(mark)
    h1, h2, h3, h4 = (_draw(seed, F.col("doc_id"), k) for k in range(1, 5))
    form = F.when(held | (h3 % 100 >= percent), "plain").when(h4 % 100 < percent_spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                yield _cut(part)

    fields = "n long, form string, prefix_chars long, middle_chars long, output string"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}")


def _cut(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(part.column("text"))
    words = word_view(data)
    starts, stops = offsets[:-1], offsets[1:]
    ends = Ranks(unit_ends(words, stops[stops > starts] - 1))
    chars = Ranks(char_starts(words))
    before = ends.rank(starts)
    n = ends.rank(stops) - before
    cuts = np.sort(np.stack([part.column(h).to_numpy(zero_copy_only=False) % (n + 1) for h in ("h1", "h2")]), axis=0)
    places = np.empty((4, len(n)), np.int64)
    places[0], places[3] = starts, stops
    for k in range(2):
        places[k + 1] = starts
        some = cuts[k] > 0
        places[k + 1, some] = ends.select(before[some] + cuts[k, some]) + 1
    counts = chars.rank(places.ravel()).reshape(4, -1)
    forms = part.column("form").to_pylist()
    raw, out = data.tobytes(), []
    for form, (a, b, c, d) in zip(forms, places.T.tolist()):
        prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
        if form == "plain":
            out.append(raw[a:d])
        elif form == "psm":
            out.append(b"".join([b"<P>", prefix, b"<S>", suffix, b"<M>", middle]))
        else:
            out.append(b"".join([b"<S>", suffix, b"<P>", prefix, b"<M>", middle]))
    plain = np.array([form == "plain" for form in forms], bool)
    return batches({
        "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "form": part.column("form"),
        "prefix_chars": pa.array(counts[1] - counts[0], pa.int64(), mask=plain),
        "middle_chars": pa.array(counts[2] - counts[1], pa.int64(), mask=plain),
        "output": pa.array(out, pa.binary()).cast(pa.string()),
    })


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of.

    A cut text holds no mark, so the output splits at its own three marks only.
    """
    parts = F.split(output, "<[PSM]>", -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their form, with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, t, len(units) AS n, form, array_to_string(units[1 : a], '') AS prefix,
                  array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {"op12_fill_in_middle": (op12_fill_in_middle, SQL)}
