import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import ODD_TEXTS, prose
from tidemark.llm.graph import components
from tidemark.llm.words import PLAIN, SPACED, hash_runs, hash_words, row_shingles, text_slices


def brute(links):
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(k, k + 1) for k in range(60)], [(k + 1, k) for k in random.Random(1).sample(range(80), 80)], [(0, k) for k in range(1, 200)],
    [(200, k) for k in range(200)], [tuple(random.Random(s).sample(range(100), 2)) for s in range(70)], [(1, 2), (1, 2), (2, 1), (2, 3)],
])
def test_components(spark, links):
    got = components(spark.createDataFrame([*links, (5000, 5000), (None, 1)], "a long, b long")).collect()
    assert {r.id: r.component for r in got if r.id < 5000} == brute(links) and len({r.id for r in got}) == len(got)


def test_equal_words_have_equal_hashes():
    texts = pa.array(ODD_TEXTS + [prose(1, 30000) + " end", "A b", "a B", "ab"])
    for table, split in ((SPACED, str.split),):
        hashes, rows = hash_words(texts, table)
        words = [w for t in texts.to_pylist() for w in "".join(c.lower() if c.isascii() else c for c in t or "").split(None)]
        assert len(hashes) == len(words)
        seen = {}
        for word, value in zip(words, hashes.tolist()):
            assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)
    assert len(hash_words(pa.array(["a-b c_d é1"]), PLAIN)[0]) == 5


def test_rows_without_words_anywhere():
    for empty in (None, "", " ", "..."):
        for place in range(4):
            texts = ["a b", "c", "a b"]
            texts.insert(place, empty)
            hashes, rows = hash_words(pa.array(texts, pa.string()), PLAIN)
            runs = hash_runs(hashes, rows[:-1], rows[1:]).tolist()
            own = runs.pop(place)
            assert runs[0] == runs[2] != runs[1] and own not in runs
    hashes, rows = hash_words(pa.array(["", None]), PLAIN)
    assert len(hash_runs(hashes, rows[:-1], rows[1:])) == 2


def test_nul_belongs_to_a_word():
    hashes, rows = hash_words(pa.array(["a\0b c", "a b c", "\0"]), SPACED)
    assert rows.tolist() == [0, 2, 5, 6] and len(set(hashes.tolist())) == 5
    assert len(hash_words(pa.array(["a\0b"]), PLAIN)[0]) == 2


def test_long_words_and_slices():
    texts = ["y" * 1_200_000 + " z", "y" * 1_200_000, "z"] * 2
    hashes, rows = hash_words(pa.array(texts), SPACED)
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] and rows.tolist() == [0, 2, 3, 4, 6, 7, 8]
    batch = pa.RecordBatch.from_pydict({"text": texts + [None, ""]})
    parts = list(text_slices(batch, limit=1_000_000))
    assert sum(p.num_rows for p in parts) == 8 and len(parts) > 1
    assert np.concatenate([hash_words(p.column("text"), SPACED)[0] for p in parts]).tolist() == hashes.tolist()


def test_shingles_of_short_rows():
    hashes, rows = hash_words(pa.array(["a b", "a b c d e", "", "a b c d e a b c d e", "a"]), SPACED)
    assert [len(s) for s in row_shingles(hashes, rows, 5)] == [1, 1, 0, 5, 1]
