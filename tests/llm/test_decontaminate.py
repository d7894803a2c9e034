import random
import re

import numpy as np
import pytest

from tests.llm.fixtures import ODD_TEXTS, empty, prose, table
from tidemark.llm import fm_index
from tidemark.llm.decontaminate import contamination, remove_spans

ITEMS = [(1, prose(21, 40)), (2, prose(22, 10)), (10, "short Item here"), (3, prose(21, 40)), (4, None), (5, "..."), (None, prose(23, 20)), (2, prose(24, 12))]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, size=10):
    cut = set()
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        if item is not None and k:
            cut |= {(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1)}
    out = []
    for doc, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        places = {}
        for k in {len(c) for _, c in cut}:
            for i in range(len(w) - k + 1):
                places.setdefault(tuple(w[i : i + k]), []).append(i)
        for item, c in cut:
            for i in places.get(c, ()):
                hit |= set(range(i, i + len(c)))
                found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def documents():
    one, two = prose(21, 40), prose(24, 12)
    inside = prose(30, 50).split(" ")
    return ODD_TEXTS + [
        one, one.upper(), " ".join(inside[:20] + one.split(" ")[5:25] + inside[20:]), ", ".join(two.split(" ")), "a SHORT item, here!",
        " ".join(one.split(" ")[:9]), one + " " + one, prose(22, 10) + "\n\n" + prose(22, 10), prose(23, 20), prose(1, 5000) + " " + one + " " + prose(2, 3000),
    ]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string")


@pytest.mark.parametrize("shard,block", [(1 << 20, 50_000), (64, 50_000), (500, 7)])
def test_matches_brute_force(spark, shard, block):
    texts = documents()
    got = contamination(table(spark, texts), benchmark(spark), shard_words=shard, block_windows=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == brute(texts, ITEMS)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_hit


def test_removal(spark):
    docs = table(spark, documents())
    clean = remove_spans(docs, contamination(docs, benchmark(spark)))
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    want = brute(documents(), ITEMS)
    assert set(texts) == {d for d, n, hit, _ in want if not hit or hit < n}
    for doc, n, hit, _ in want:
        if doc in texts:
            assert len(words(texts[doc])) == n - hit
            if not hit:
                assert texts[doc] == documents()[doc]


def test_ids_and_empty_tables(spark):
    one = prose(21, 40)
    docs = table(spark, [one, one, None, one], [3, 3, None, None])
    got = contamination(docs, benchmark(spark)).collect()
    assert sorted(r.n_hit for r in got) == [0, 40, 40, 40]
    assert contamination(empty(spark), benchmark(spark)).count() == 0
    nothing = contamination(docs, benchmark(spark).limit(0)).collect()
    assert [r.n_hit for r in nothing] == [0] * 4


def test_index_against_plain_search():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 40, r.integers(0, 50)).astype(np.uint64) for _ in range(200)]
    docs += docs[:30] + [np.full(300, 7, np.uint64)] * 2
    index = fm_index.Index(fm_index.build(docs))
    text = np.concatenate([np.append(d.astype(np.int64), -1) for d in docs])
    for size in (1, 2, 5):
        phrases = np.array([d[i : i + size] for d in docs for i in range(len(d) - size + 1)][::7] + [np.full(size, 99)], np.uint64)
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases.astype(np.int64), low, high):
            runs = np.lib.stride_tricks.sliding_window_view(text, size)
            assert sorted(index.locate(np.arange(a, b)).tolist()) == np.flatnonzero((runs == phrase).all(axis=1)).tolist()


def test_suffix_order():
    for seed in range(20):
        s = random.Random(seed).choices([1, 2, 3], k=200) + [0]
        order = fm_index.suffix_order(np.array(s, np.uint32))
        assert order.tolist() == sorted(range(201), key=lambda i: s[i:])
