import re

import numpy as np
import pytest

from tests.llm.fixtures import ODD_TEXTS, edited, empty, prose, table
from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import keep_first, similar_sets, small_boundary
from tidemark.llm.sketches import parity_sketch


def grams(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def family(seed, sizes=(6, 7, 8, 9, 12, 20, 40, 80, 200)):
    out = []
    for k, size in enumerate(sizes):
        base = prose(seed * 100 + k, size)
        out += [base, base.upper(), base + " tail", "head " + base, edited(base, 1, seed), edited(base, max(1, size // 60), seed + 1), edited(base, max(1, size // 20), 7)]
        words = base.split(" ")
        out += [" ".join(words[: int(len(words) * 0.9)]), " ".join(words + words[:3]), " ".join(words[: int(len(words) * 0.8)])]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    boiler = prose(99, 25)
    texts = family(seed) + [boiler + " " + prose(500 + k, 30) for k in range(12)] + ODD_TEXTS[:8] + ["a b c", "a  B c", "a b", "a b c d e", "a b c d f"]
    got = similar_sets(table(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("boundary", [4, 20, 64])
def test_every_boundary_gives_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(ngram_join, "small_boundary", lambda *_: boundary)
    texts = family(4)
    assert sorted(map(tuple, similar_sets(table(spark, texts)).collect())) == brute(list(enumerate(texts)))


def test_common_ngrams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 1)
    texts = family(5, (8, 20, 60)) + [edited(prose(7, 80), 1, k) for k in range(60)]
    assert sorted(map(tuple, similar_sets(table(spark, texts)).collect())) == brute(list(enumerate(texts)))


def test_large_group_of_near_copies(spark):
    base = prose(11, 120)
    texts = [edited(base, 1, k) for k in range(300)] + [prose(1000 + k, 50) for k in range(30)]
    got = {r.doc_id: r.component_id for r in similar_sets(table(spark, texts)).collect()}
    want = {i: c for i, _, c in brute(list(enumerate(texts)))}
    assert got == want


def test_ids(spark):
    base = prose(12, 40)
    docs = table(spark, [base, base, base, prose(13, 40), None], [3, 3, None, 4, None])
    got = sorted(similar_sets(docs).collect(), key=repr)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (3, 3), (4, 4)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert keep_first(docs).count() == 5
    assert keep_first(table(spark, [base, base + " end", "other"])).count() == 2


def test_empty_table(spark):
    assert similar_sets(empty(spark)).count() == 0
    assert keep_first(empty(spark)).count() == 0


def test_boundary_follows_the_cost():
    assert small_boundary({}) == 4
    rare = {s: (10, 0) for s in range(4, 65)}
    crowded = {s: (10, 10**6) for s in range(4, 65)}
    assert small_boundary(rare) <= small_boundary(crowded)


def test_sketches_never_show_more_than_the_difference():
    r = np.random.default_rng(3)
    for shared, own in [(0, 0), (1, 1), (50, 5), (300, 60), (2000, 900)]:
        both = r.integers(0, 2**63, shared, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, own, dtype=np.uint64)])) for _ in range(2))
        shown = int(np.bitwise_count((parity_sketch(a) ^ parity_sketch(b)).view(np.uint64)).sum())
        assert shown <= len(np.setxor1d(a, b)) and (own > 5 or shown >= 2 * own - 2)


def test_near_copies_that_do_not_link(spark):
    """Copies of one text, each with so many changes of its own that they link with nothing or with few."""
    base = prose(21, 90)
    texts = [base] + [edited(base, 4 + k % 3, k) for k in range(250)] + [edited(edited(base, 5, 900 + k // 2), k % 2, k) for k in range(60)]
    assert sorted(map(tuple, similar_sets(table(spark, texts)).collect())) == brute(list(enumerate(texts)))
