import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tests.llm.fixtures import ODD_TEXTS, prose
from tidemark.llm.fill_middle import Ranks, char_starts, fill_in_middle, restored, unit_ends, white_space, word_view

UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACES = [0x20, *range(0x09, 0x0E)]


def brute(doc_id, text):
    text, units = text or "", UNITS.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_text(seed):
    r = random.Random(seed)
    letters = "ab \t\n\x0b\x0c\r\x00\x08\x0e\x1f!\x7f\x85\xa0éß漢😀 ﻿<>PSM"
    return "".join(r.choice(letters) for _ in range(r.randint(0, 40)))


def test_every_byte_value():
    data = np.array([*range(256)] * 3, np.uint8)
    marks = white_space(word_view(data)).view(np.uint8)[: len(data)]
    assert set(marks.tolist()) == {0, 0x80} and set(data[marks > 0].tolist()) == set(SPACES)
    starts = char_starts(word_view(data)).view(np.uint8)[: len(data)]
    assert set(data[starts == 0].tolist()) == set(range(0x80, 0xC0))


@pytest.mark.parametrize("seed", range(40))
def test_ends_and_ranks(seed):
    text = odd_text(seed) * 3
    raw = text.encode()
    marks = unit_ends(word_view(np.frombuffer(raw, np.uint8)), np.array([len(raw) - 1] if raw else [], np.int64))
    places = np.cumsum([len(u.encode()) for u in UNITS.findall(text)], dtype=np.int64) - 1
    ranks = Ranks(marks)
    assert ranks.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()
    assert ranks.rank(np.arange(len(raw) + 1)).tolist() == [int((places < k).sum()) for k in range(len(raw) + 1)]


def check(spark, texts, ids):
    made = fill_in_middle(fixtures.table(spark, texts, ids))
    rows = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.back) for r in rows)
    want = [(i, t or "", *brute(i, t)) for i, t in zip(ids, texts)]
    assert got == sorted((i is None, i or 0, n, form, a or 0, b or 0, out, text) for i, text, n, form, a, b, out in want)
    return {r.form for r in rows}


def test_against_brute_force(spark):
    texts = [*ODD_TEXTS, *[odd_text(k) for k in range(400)], prose(1, 3000) + "\n", "a <P> b", "<", "<S", "P>", " <M", "é" * 9, prose(2, 40) + "<S"]
    assert check(spark, texts, [*range(len(texts))]) == {"plain", "psm", "spm"}
    assert check(spark, texts, [k + 9000 for k in range(len(texts))]) == {"plain", "psm", "spm"}


def test_ties_repeated_rows_and_nulls(spark):
    check(spark, ["a b c", "a b c", "a b c", None, ""] * 2, [None, None, 7, 7, 8] * 2)
    assert fill_in_middle(fixtures.empty(spark)).count() == 0
