import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import ODD_TEXTS, empty, prose, table
from tidemark.llm.toxicity import _counted, drop_toxic, maximal_segments, score_documents, token_counts

BAD = ["grimhold", "grimholds", "vilefang", "rotmire"]


def corpus(count=400):
    r, texts, labels = random.Random(5), [], []
    for k in range(count):
        words = prose(k, r.randint(20, 120)).split(" ")
        toxic = k % 5 == 0
        if toxic:
            at = r.randint(0, len(words) - 1)
            words[at:at] = [r.choice(BAD) for _ in range(4)]
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def label_table(spark, labels):
    return spark.createDataFrame([(k, 0, v, "x") for k, v in enumerate(labels)] + [(None, 0, 1, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, scores string")


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    rows = score_documents(table(spark, texts + ODD_TEXTS), label_table(spark, labels)).collect()
    assert len(rows) == len(texts) + len(ODD_TEXTS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id < len(labels):
            assert r.predicted == labels[r.doc_id]
            words = texts[r.doc_id].split(" ")
            assert len(r.passages) == 0 or any(w in BAD for p in r.passages for w in words[p.start : p.end])
        else:
            assert r.predicted == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    texts, labels = corpus(200)
    odd = [1 - v if zlib.crc32(str(k).encode()) % 4 == 2 else v for k, v in enumerate(labels)]
    one, two = (sorted((r.doc_id, r.score) for r in score_documents(table(spark, texts), label_table(spark, v)).collect()) for v in (labels, odd))
    assert [k for k, _ in one] == [k for k, _ in two]
    assert [s for _, s in one] == pytest.approx([s for _, s in two])


def test_drop_toxic(spark):
    texts, labels = corpus()
    docs = table(spark, texts)
    kept = drop_toxic(docs, label_table(spark, labels))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, v in enumerate(labels) if not v]


def test_without_labels(spark):
    none = label_table(spark, []).limit(0)
    rows = score_documents(table(spark, ["a b", None], [1, None]), none).collect()
    assert [r.predicted for r in rows] == [0, 0]
    assert score_documents(empty(spark), none).count() == 0
    clean = label_table(spark, [0, 0, 0, 0])
    assert {r.predicted for r in score_documents(table(spark, ["a", "b", "c", "d"]), clean).collect()} == {0}


def test_texts_that_share_a_passage_all_count(spark):
    shared = prose(31, 12)
    texts = [shared + " " + prose(8000 + k, 6) for k in range(60)] * 2 + [shared.upper() + "!"]
    learned = {texts[k].lower().strip("!") for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2}
    most = token_counts(table(spark, texts), label_table(spark, [0] * len(texts))).agg({"clean": "max"}).first()[0]
    assert most == len(learned)


def test_no_two_tokens_are_counted_as_one(spark):
    texts = [" ".join(f"{k:x}z{n:x}q" for n in range(3000)) + " Ünï,ünï 漢字" for k in range(40)]
    want = {}
    for k, text in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 4 != 2:
            words = text.lower().replace("Ü", "ü").replace(",", " ").split()
            for token in {(size, w[:size]) for w in words for size in (0, 4, 5, 6) if size} | {(0, w) for w in words}:
                want[token] = want.get(token, 0) + 1
    got = token_counts(table(spark, [t.replace("Ü", "ü") for t in texts]), label_table(spark, [0] * 40))
    # Stems of all sizes are one kind of token.
    stems = {t for size, t in want if size}
    assert got.count() == len(stems) + sum(size == 0 for size, _ in want)


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then search both sides."""
    out, todo = [], [(0, len(scores))]
    while todo:
        low, high = todo.pop()
        best = (0, None)
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                if total > best[0]:
                    best = (total, (i, j + 1))
        if best[1]:
            i, j = best[1]
            out.append((i, j, best[0]))
            todo += [(low, i), (j, high)]
    return sorted(out)


def test_segments_against_the_definition():
    r = random.Random(2)
    for _ in range(200):
        scores = np.array([r.choice([-3, -2, -1, 1, 2, 5]) + r.random() / 100 for _ in range(r.randint(0, 25))])
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        got = maximal_segments(sums, np.flatnonzero(scores > 0))
        want = brute_segments(scores.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_counting_holds_its_values_once():
    """Sets come and go as they are counted: the values once more, and their counts."""
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 12, 600, dtype=np.uint64)) for _ in range(2000)]
    flat = np.concatenate(sets)
    expected = np.unique(flat, return_counts=True)
    tracemalloc.start()
    tokens, times = _counted(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens.tolist() == expected[0].tolist() and times.tolist() == expected[1].tolist() and not sets
    assert peak < 1.5 * flat.nbytes
    assert [x.tolist() for x in _counted([])] == [[], []]
