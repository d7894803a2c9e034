"""Toxic passages as maximum-scoring segments of token log-odds.

1. Learn: in how many toxic and clean texts each token occurs gives its log-odds
   with an informative Dirichlet prior (the prior follows the token's overall
   frequency) and their standard error. Tokens are words and their first letters,
   so that inflected forms count as one. A word scores the best log-odds of its
   tokens that stand out; all other words cost a little, so scores drift
   downwards in clean text.
2. Search: one linear scan per text finds all maximal scoring segments (Ruzzo
   and Tompa), none of which can be made better by a change of its ends.
3. Calibrate: in clean text of ``n`` words the best score follows an extreme-value
   law with rate ``lambda`` and constant ``K`` (Karlin and Altschul), fitted to
   the segments of all clean learning rows. The evidence of a text is the sum of ``lambda * score - ln(K n)``
   over its segments beyond that law, and a logistic curve fitted to the labels
   of all learning rows turns it into a probability.

Tokens are counted by their whole 64-bit hash, so none shares the weight of
another; tasks receive the weights of those that stand out, which takes several
toxic texts each. Counts cover all learning rows; texts of a label with
the same words in the same order count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.drops import unused
from tidemark.llm.words import PLAIN, batches, hash_prefixes, hash_runs, hash_spans, hash_words, text_bytes, text_slices, word_spans
from tidemark.staging import stage

PRIOR_SHARE = 0.1  # weight of the prior, as a share of all counts
MIN_Z = 3.5  # log-odds in standard errors from which a token counts
MIN_ODDS = 3.0  # and the log-odds themselves
DRIFT = 0.1  # cost of a word that does not stand out
STEMS = (4, 5, 6)  # first characters of a word that are tokens too
THRESHOLD = 0.3
MARK_BITS = 22  # first bits of a hash by which most words without a weight are told at once
COUNTED = 4_000_000  # tokens that a task counts at a time


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of the tokens with a weight
    weights: np.ndarray
    rate: float = 1.0  # lambda
    constant: float = 1.0  # K
    slope: float = 0.0
    intercept: float = -20.0


def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each word and its stems, one row per kind of token; words before each row)."""
    folded, starts, ends, rows = word_spans(*text_bytes(part.column("text")), PLAIN)
    hashes = hash_prefixes(folded, starts, ends, STEMS)
    hashes[1:] ^= np.uint64(0xA24BAED4963EE407)  # a stem is not the word of the same letters
    return hashes, rows


def _distinct_words(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(distinct words of each text with a space after each, hash of all its words in order)."""
    folded, starts, ends, rows = word_spans(*text_bytes(part.column("text")), PLAIN)
    hashes = hash_spans(folded, starts, ends)
    kept = [a + np.sort(np.unique(hashes[a:b], return_index=True)[1]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
    flat = np.concatenate([np.zeros(0, np.int64), *kept])
    sizes = (ends - starts)[flat]
    after = np.cumsum(sizes + 1)
    out = np.full(int(sizes.sum()) + len(flat), 0x20, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(after - sizes - 1, sizes) + within] = folded[np.repeat(starts[flat], sizes) + within]
    offsets = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum([len(k) for k in kept])])].astype(np.int32)
    words = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(offsets), pa.py_buffer(out))
    return words, hash_runs(hashes, rows[:-1], rows[1:])


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of all sets, how many sets have each); ``sets`` is emptied to hold its values once."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    sets.clear()
    flat.sort()
    first = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=first[1:])
    first = np.flatnonzero(first)
    return flat[first], np.diff(first, append=len(flat))


def _weights_of(model_tokens: np.ndarray, weights: np.ndarray, hashes: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Weight of each token, 0 for those without one; ``marked`` tells which first bits the model's tokens have."""
    out = np.zeros(hashes.shape, np.float32)
    if len(model_tokens):
        some = np.nonzero(marked[hashes >> np.uint64(64 - MARK_BITS)])
        own = hashes[some]
        place = np.minimum(np.searchsorted(model_tokens, own), len(model_tokens) - 1)
        out[some] = np.where(model_tokens[place] == own, weights[place], 0)
    return out


def _labels(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, toxic, clean): number of toxic and clean learning texts, copies aside, with a token."""

    def marked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = hash_words(part.column("text"), PLAIN)
                yield batches({"doc_id": part.column("doc_id"), "same": pa.array(hash_runs(hashes, rows[:-1], rows[1:]).view(np.int64))})

    def distinct(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                words, same = _distinct_words(part)
                yield batches({"doc_id": part.column("doc_id"), "same": pa.array(same.view(np.int64)), "text": words})

    def flush(waiting: tuple[list[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        seen = [_counted(sets) for sets in waiting]
        tokens = np.union1d(seen[0][0], seen[1][0])
        clean, toxic = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        for (own, times), column in zip(seen, (clean, toxic)):
            column[np.searchsorted(tokens, own)] = times
        for start in range(0, len(tokens), 100_000):
            end = start + 100_000
            yield batches({"token": pa.array(tokens[start:end].view(np.int64)), "toxic": pa.array(toxic[start:end]), "clean": pa.array(clean[start:end], pa.int64())})

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = ([], []), 0
        for batch in source:
            for part in text_slices(batch):
                hashes, rows = _tokens(part)
                for label, a, b in zip(part.column("toxic").to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
                    waiting[label].append(np.unique(hashes[:, a:b]))
                    size += len(waiting[label][-1])
                if size >= COUNTED:
                    yield from flush(waiting)
                    waiting, size = ([], []), 0
        if size:
            yield from flush(waiting)

    learning = _texts(docs).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = _labels(labels).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    # Ids decide which text of a label stands for its copies; words follow for these ids only.
    # Merge joins: the same plan for any number of labels.
    ids = learning.mapInArrow(marked, "doc_id long, same long").join(known.hint("merge"), "doc_id")
    one = stage(ids.groupBy("same", "toxic").agg(F.min("doc_id").alias("doc_id")), "learning-texts")
    sets = learning.mapInArrow(distinct, "doc_id long, same long, text string").join(one.hint("merge"), ["doc_id", "same"])
    texts = sets.groupBy("doc_id", "same", "toxic").agg(F.first("text").alias("text"))  # a repeated row counts once
    counted = texts.select("toxic", "text").mapInArrow(count, "token long, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_weights(docs: DataFrame, labels: DataFrame) -> Model:
    """Log-odds of the tokens that stand out."""
    counts = stage(token_counts(docs, labels), "token-counts")
    total = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not total[0] or not total[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    mass = PRIOR_SHARE * (total[0] + total[1])
    prior = (F.col("toxic") + F.col("clean")) * PRIOR_SHARE

    def odds(seen: str, sum_: int) -> Column:
        own = F.col(seen) + prior
        return F.log(own / (F.lit(float(sum_)) + mass - own))

    weighted = counts.select(
        "token", (odds("toxic", total[0]) - odds("clean", total[1])).alias("weight"),
        F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("error"),
    )
    kept = weighted.filter((F.col("weight") >= MIN_ODDS) & (F.col("weight") >= MIN_Z * F.col("error"))).toArrow()  # the model
    tokens, weights = kept.column("token").to_numpy().view(np.uint64), kept.column("weight").to_numpy()
    order = np.argsort(tokens)
    return Model(tokens[order], weights[order])


def maximal_segments(sums: np.ndarray, gains: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's scan.

    ``sums`` are running sums, one more than scores; ``gains`` the places of positive scores.
    """
    open_: list[tuple[float, float, int, int]] = []  # (sum before, sum after, start, end)
    for place, low, high in zip(gains.tolist(), sums[gains].tolist(), sums[gains + 1].tolist()):
        start = place
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= low:
                j -= 1
            if j < 0 or open_[j][1] >= high:
                open_.append((low, high, start, place + 1))
                break
            low, start = open_[j][0], open_[j][2]
            del open_[j:]
    return [(start, end, high - low) for low, high, start, end in open_]


def _scanner(model: Model):
    """A function from texts to (number of words, maximal segments) of each."""
    tokens, weights, tables = model.tokens, model.weights, {}

    def scan(part: pa.RecordBatch) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        if not tables:  # once per task
            tables["marked"] = np.zeros(1 << MARK_BITS, bool)
            tables["marked"][tokens >> np.uint64(64 - MARK_BITS)] = True
        hashes, rows = _tokens(part)
        scores = _weights_of(tokens, weights, hashes, tables["marked"]).max(axis=0, initial=-np.inf).astype(np.float64) - DRIFT
        gains = np.flatnonzero(scores > 0)
        edges = np.searchsorted(gains, rows)
        found = []
        for k in range(part.num_rows):
            own = gains[edges[k] : edges[k + 1]]
            if not len(own):
                found.append([])
                continue
            sums = np.concatenate([[0.0], np.cumsum(scores[rows[k] : rows[k + 1]])])
            found.append(maximal_segments(sums, own - rows[k]))
        return np.diff(rows), found

    return scan


def find_segments(docs: DataFrame, model: Model) -> DataFrame:
    """Per input row: doc_id, text_key, n_words, starts, ends, scores of its maximal segments."""
    scan = _scanner(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch):
                n_words, found = scan(part)
                yield batches({
                    "doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_words": pa.array(n_words, pa.int64()),
                    **{name: pa.array([[s[c] for s in own] for own in found], pa.list_(kind)) for c, (name, kind) in enumerate(
                        (("starts", pa.int64()), ("ends", pa.int64()), ("scores", pa.float64())))},
                })

    ddl = "doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, scores array<double>"
    return _texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, ddl)


def _evidence(model: Model, n_words: Column, scores: Column) -> Column:
    """Sum of lambda * score - ln(K n) over the segments beyond the law, or the best one's distance below it."""
    level = F.log(F.lit(model.constant) * F.greatest(n_words, F.lit(1)))
    excess = F.transform(scores, lambda s: s * model.rate - level)
    beyond = F.aggregate(F.filter(excess, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    best = F.coalesce(F.array_max(excess), -level)
    return F.when(best > 0, beyond).otherwise(best)


def _score(model: Model, n_words: Column, scores: Column) -> Column:
    return 1 / (1 + F.exp(-(_evidence(model, n_words, scores) * model.slope + model.intercept)))


def _logistic(x: np.ndarray, hits: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of a slightly shrunken logistic curve through binned counts, by Newton steps."""
    beta = np.array([0.0, math.log((hits.sum() + 0.5) / (totals.sum() - hits.sum() + 0.5))])
    design = np.column_stack([x, np.ones(len(x))])
    shrink = np.diag([1e-2, 1e-4])
    loss = lambda b: float(totals @ np.logaddexp(0, design @ b) - hits @ (design @ b) + b @ shrink @ b / 2)
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        slope = design.T @ (hits - totals * chance) - shrink @ beta
        move = np.linalg.solve(design.T @ (design * (totals * chance * (1 - chance))[:, None]) + shrink, slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * move) > loss(beta):
            size /= 2
        beta = beta + size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def calibrate(model: Model, segments: DataFrame, labels: DataFrame) -> Model:
    """Fit ``lambda`` and ``K`` to the segments of clean learning rows and the logistic curve to all learning rows."""
    known = stage(segments.join(_labels(labels), "doc_id").select("doc_id", "toxic", "n_words", "scores"), "calibration")
    clean = known.filter("toxic = 0")
    seen = clean.agg(
        F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.size("scores")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)), F.lit(0.0)),
    ).first()
    # n words have K n exp(-lambda score) segments from a score on; rate 1 holds for log-odds
    # and stands for two segments before any is seen.
    model.rate = (seen[1] + 2) / (seen[2] + 2)
    model.constant = min(1.0, (seen[1] + 0.5) / (seen[0] + 1))
    # One row per half unit of evidence within fixed limits.
    step = F.round(F.greatest(F.least(_evidence(model, F.col("n_words"), F.col("scores")), F.lit(200.0)), F.lit(-50.0)) * 2) / 2
    bins = known.groupBy(step.alias("x")).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    if bins:
        x, hits, totals = (np.array([row[c] for row in bins], float) for c in range(3))
        model.slope, model.intercept = _logistic(x, hits, totals)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per input row: doc_id, held_out, text_key, score, predicted, evidence, passages.

    Learns from the labels of documents that are not held out and scores every
    row by its text alone. ``passages`` are the significant toxic segments as
    (start, end, score, evalue), in words. Needs doc_id and text, and labels with
    doc_id and toxic; other columns are ignored. A NULL or empty text has no
    segment and gets the score of no evidence; rows without doc_id are scored
    but not learned from; a doc_id labelled twice is toxic if one label says so.
    Without toxic or without clean labels no token has a weight and all rows get
    one low score.
    """
    model = learn_weights(docs, labels)
    segments = stage(find_segments(docs, model), "segments")
    model = calibrate(model, segments, labels)
    columns = F.col("n_words"), F.col("scores")
    score = _score(model, *columns)
    law = F.lit(model.constant) * F.greatest(F.col("n_words"), F.lit(1))
    passages = F.filter(
        F.transform(
            F.arrays_zip("starts", "ends", "scores"),
            lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end"), s["scores"].alias("score"), (law * F.exp(-model.rate * s["scores"])).alias("evalue")),
        ),
        lambda s: s["evalue"] < 1,
    )
    return segments.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_key", score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"), _evidence(model, *columns).alias("evidence"), passages.alias("passages"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay.

    With the fitted model each text is judged where it is read, so no text is
    shuffled to meet its decision.
    """
    model = learn_weights(docs, labels)
    learning = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    model = calibrate(model, find_segments(learning, model), labels)
    scan = _scanner(model)

    @F.arrow_udf("struct<n_words: long, scores: array<double>>")
    def found(text: pa.Array) -> pa.Array:
        parts = []
        for part in text_slices(batches({"text": text})):
            n_words, segments = scan(part)
            scores = pa.array([[s[2] for s in own] for own in segments], pa.list_(pa.float64()))
            parts.append(pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), scores], ["n_words", "scores"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("scores", pa.list_(pa.float64()))]))

    segments, = unused(docs.columns, "segments")
    judged = docs.withColumn(segments, found(F.col("text").cast("string")))
    toxic = _score(model, F.col(segments)["n_words"], F.col(segments)["scores"]) >= THRESHOLD
    return judged.filter(~toxic).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored as the toxic label marks it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return score_documents(docs, labels).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES = {"op2_toxicity": (op2_toxicity, None)}
