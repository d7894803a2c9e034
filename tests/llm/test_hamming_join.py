import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import ODD_TEXTS, edited, empty, prose, table
from tidemark.llm import hamming_join
from tidemark.llm.hamming_join import DISTANCE, SYMBOLS, confirmed, distance, index_keys, near_duplicates, signatures, signatures_of


def pairs_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(pairs_of(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(linked(a, b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((i, len(pairs_of(t)), root(i), root(i) == i) for i, t in rows)


def family(seed, sizes=(2, 3, 4, 5, 6, 9, 12, 20, 40, 80, 200)):
    out = []
    for k, size in enumerate(sizes):
        base = prose(seed * 100 + k, size)
        out += [base, base.upper(), base + " tail", "head " + base, edited(base, 1, seed), edited(base, max(1, size // 30), seed + 1), edited(base, max(1, size // 12), 7)]
        words = base.split(" ")
        out += [" ".join(words[: int(len(words) * 0.9)]), " ".join(words + words[:3]), " ".join(words[: int(len(words) * 0.8)])]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    boiler = prose(99, 25)
    texts = family(seed) + [boiler + " " + prose(500 + k, 12) for k in range(20)] + ODD_TEXTS[:8] + ["a b c", "a  B c", "a\0b", "a b", "b a", "a", "A"]
    got = near_duplicates(table(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_large_groups_and_a_pair_in_all(spark):
    base, other = prose(11, 120), prose(12, 60)
    texts = [edited(base, 1 + k % 9, k) for k in range(400)] + [other] * 150 + ["common pair " + prose(3000 + k, k % 7) for k in range(200)]
    got = near_duplicates(table(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


def test_repeated_and_missing_ids(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(5, a), (5, b), (7, b), (9, a + " end"), (2, c), (2, c), (4, c), (None, c), (None, None)]
    got = near_duplicates(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    known = sorted(tuple(r) for r in got if r.doc_id is not None)
    assert known == brute([(i, t) for i, t in rows if i is not None])
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (39, None, True)]
    assert near_duplicates(empty(spark)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    r = np.random.default_rng(4)
    for differ in [0, 1, 16, DISTANCE - 1, DISTANCE]:
        one = r.integers(0, 256, (300, SYMBOLS), dtype=np.uint8)
        two = one.copy()
        for row in two:
            places = r.permutation(SYMBOLS)[:differ]
            row[places] ^= r.integers(1, 256, differ, dtype=np.uint8)
        assert all(set(a) & set(b) for a, b in zip(index_keys(one).tolist(), index_keys(two).tolist()))
    # The worst case: as many differences as may be, dealt evenly over the chunks.
    two = one.copy().reshape(-1, hamming_join.CHUNKS, hamming_join.CHUNK_SYMBOLS)
    two[:, 1:, :2] ^= 1
    two[:, 0, 0] ^= 1
    assert int((two.reshape(one.shape) != one).sum(axis=1)[0]) == DISTANCE
    assert all(set(a) & set(b) for a, b in zip(index_keys(one).tolist(), index_keys(two.reshape(one.shape)).tolist()))


def test_distance_counts_symbols(spark):
    r = np.random.default_rng(5)
    one = r.integers(0, 256, (50, SYMBOLS), dtype=np.uint8)
    two = np.where(r.random(one.shape) < 0.3, r.integers(0, 256, one.shape, dtype=np.uint8), one)
    names = hamming_join._WORDS_OF_SIGNATURE
    rows = [(k, *a, *b) for k, (a, b) in enumerate(zip(one.view("<i8").tolist(), two.view("<i8").tolist()))]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{p}{n} long" for p in "ab" for n in names))
    got = {row.k: row.d for row in df.select("k", distance("a", "b").alias("d")).collect()}
    assert [got[k] for k in range(50)] == (one != two).sum(axis=1).tolist()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(6)
    differ = []
    for _ in range(300):
        shared, own = r.integers(0, 2**63, 400, dtype=np.uint64), r.integers(0, 2**63, (2, 50), dtype=np.uint64)
        a, b = signatures_of([np.unique(np.concatenate([shared, o])) for o in own])
        differ.append(int((a != b).sum()))
    # Similarity 0.8: 16 of 80 symbols, deviation 3.6.
    assert abs(np.mean(differ) - 16) < 0.8 and max(differ) <= DISTANCE and 3 < np.std(differ) < 4.3


def test_links_are_confirmed_on_full_sets(spark):
    texts = [prose(1, 50), prose(1, 50) + " x", prose(2, 50)]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert [tuple(r) for r in confirmed(pairs, table(spark, texts)).collect()] == [(0, 1)]
    sizes = {r.doc_id: r.n for r in signatures(table(spark, texts)).select("doc_id", F.col("n")).collect()}
    assert sizes == {0: 49, 1: 50, 2: 49}
