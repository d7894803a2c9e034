import random

import numpy as np
import pytest

from tests.llm.fixtures import ODD_TEXTS, empty, prose, table
from tidemark.llm.line_dedup import BLOCK_WORDS, patience_blocks, repeated_lines, without_lines

LINES = [prose(700 + k, 12) for k in range(60)]


def texts_of(spark, texts, **more):
    docs = table(spark, texts)
    report = repeated_lines(docs, **more)
    return {r.doc_id: r for r in report.collect()}, {r.doc_id: r.text for r in without_lines(docs, report).collect()}


def test_blocks_go_from_the_later_document(spark):
    a, b = "\n".join(LINES[:10]), "\n".join([LINES[20], *LINES[2:6], LINES[21], LINES[8], LINES[22]])
    report, clean = texts_of(spark, [a, b, a, LINES[30]])
    assert clean[0] == a and report[0].n_removed == 0
    assert clean[1] == "\n".join([LINES[20], LINES[21], LINES[8], LINES[22]]) and [list(r) for r in report[1].removed] == [[1, 5]]
    assert clean[2] == "" and report[2].n_removed == 10
    assert clean[3] == LINES[30]


def test_every_line_keeps_its_first_holder(spark):
    r = random.Random(4)
    texts = ["\n".join(r.choices(LINES, k=r.randint(0, 12))) for _ in range(60)]
    _, clean = texts_of(spark, texts, block_words=1, rare_documents=1000)
    for line in LINES:
        holders = [k for k, t in enumerate(texts) if line in t.split("\n")]
        if holders:
            assert line in clean[holders[0]].split("\n")
    for k, t in enumerate(texts):
        left = iter(t.split("\n"))
        assert all(line in left for line in clean[k].split("\n") if line)


def test_hot_line_and_large_group(spark):
    texts = [LINES[0] + "\n" + prose(5000 + k, 12) for k in range(200)] + ["\n".join(LINES[10:14])] * 200
    report, clean = texts_of(spark, texts)
    assert all(report[k].n_removed == 0 for k in range(201)) and all(report[k].n_removed == 4 for k in range(201, 400))
    report, _ = texts_of(spark, texts, block_words=10)
    assert report[0].n_removed == 0 and all(report[k].n_removed == 1 for k in range(1, 200))


def brute_removed(texts, block_words):
    """Per text the lines in runs of ``block_words`` words that an earlier text has too."""
    lines = [t.split("\n") for t in texts]
    out = []
    for k, new in enumerate(lines):
        gone = set()
        for old in lines[:k]:
            for i in range(len(old)):
                for j in range(len(new)):
                    n = 0
                    while i + n < len(old) and j + n < len(new) and old[i + n] == new[j + n]:
                        n += 1
                    if sum(len(line.split()) for line in new[j : j + n]) >= block_words:
                        gone |= set(range(j, j + n))
        out.append(gone)
    return out


def test_default_against_brute_force(spark):
    r = random.Random(9)
    lines = [prose(900 + k, r.choice([1, 4, 9, 12, 25])) for k in range(40)]
    texts = []
    for k in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            at = r.randint(0, 35)
            parts += lines[at : at + r.randint(1, 5)] + [prose(20_000 + 10 * k + len(parts), 5)]
        texts.append("\n".join(parts))
    report, _ = texts_of(spark, texts)
    for k, gone in enumerate(brute_removed(texts, BLOCK_WORDS)):
        assert {line for begin, end in report[k].removed for line in range(begin, end)} == gone


def test_hot_block_in_a_document_with_a_near_copy(spark):
    block = LINES[10:14]
    texts = ["\n".join([*block, prose(6000 + k, 12)]) for k in range(70)]
    texts += ["\n".join([*block, LINES[0], prose(7000 + k, 12)]) for k in range(2)]  # share a line that nobody else has
    report, _ = texts_of(spark, texts)
    assert report[0].n_removed == 0 and all(report[k].n_removed >= 4 for k in range(1, 72))


def test_block_of_lines_first_held_apart(spark):
    report, _ = texts_of(spark, [LINES[0], LINES[1], "\n".join(LINES[:2]), "\n".join([LINES[5], *LINES[:2]])])
    assert [report[k].n_removed for k in range(4)] == [0, 0, 0, 2]


def test_odd_texts_ids_and_empty(spark):
    report, clean = texts_of(spark, ODD_TEXTS + ["\n\n" + LINES[0] + "\n\n\n" + LINES[1], LINES[0] + "\n" + LINES[1] + "\n"])
    n = len(ODD_TEXTS)
    assert [clean[k] for k in range(n)] == ODD_TEXTS
    assert report[n].n_lines == 2 and report[n + 1].n_removed == 2 and clean[n + 1] == ""
    both = "\n".join(LINES[:3])
    rows = repeated_lines(table(spark, [both, both, both], [None, 5, 5])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (False, 3), (True, 3)]
    assert repeated_lines(empty(spark)).count() == 0


def test_patience_blocks_are_common_and_in_order():
    r = random.Random(1)
    for _ in range(300):
        a, b = (np.array(r.choices(range(12), k=r.randint(0, 20)), np.uint64) for _ in range(2))
        last = (0, 0)
        for i, j, n in patience_blocks(a, b):
            assert i >= last[0] and j >= last[1] and (a[i : i + n] == b[j : j + n]).all()
            last = (i + n, j + n)
    one = np.arange(50, dtype=np.uint64)
    assert patience_blocks(one, np.delete(one, [10, 30])) == [(0, 0, 10), (11, 10, 19), (31, 29, 19)]


@pytest.mark.parametrize("rare", [0, 2, 50])
def test_rare_lines_and_runs_complete_each_other(spark, rare):
    """Whatever counts as rare, the same lines go from texts whose common lines stand in one order."""
    r = random.Random(8)
    shared = [[prose(7000 + 10 * k + j, 8) for j in range(4)] for k in range(6)]
    texts = []
    for k in range(60):
        own = [prose(8000 + 10 * k + j, 7) for j in range(3)]
        texts.append("\n".join([own[0], *shared[k % 6], own[1], *(shared[5] if k % 4 == 0 and k % 6 != 5 else []), own[2]]))
    r.shuffle(texts)
    whole = {row.doc_id: row.removed for row in repeated_lines(table(spark, texts), rare_documents=10**6).collect()}
    assert {row.doc_id: row.removed for row in repeated_lines(table(spark, texts), rare_documents=rare).collect()} == whole
    assert sum(map(len, whole.values())) > 50
