import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import ODD_TEXTS, empty, prose, table
from tidemark.llm.packing import best_fit, default_tokenizer, pack, plan, reduce_by_dominance
from tidemark.llm.tokens import column_tokenizer

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ODD_TEXTS + [prose(3, 2000), prose(4, 10), "it's <|endoftext|> <|ENDOFTEXT|> don't", "don’t — naïve Ünder × ÷ İstanbul Σας", "a\x1cb\x85c\u00a0d"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_library():
    ids, ends = column_tokenizer(PATH).encode(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in TEXTS]


def test_encoding_holds_few_bytes_per_byte_of_text():
    coder, texts = column_tokenizer(PATH), pa.array([prose(k, 400) for k in range(400)])
    size = sum(len(t.as_py()) for t in texts)
    coder.encode(texts)
    tracemalloc.start()
    coder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * size  # 28 before arrays were let go early, 23.5 since


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("abZÉé'’.!0 9\n<|>", max_size=40)), max_size=6))
def test_any_text(texts):
    ids, ends = column_tokenizer(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = column_tokenizer(path)
    assert coder.merges is None
    ids, ends = coder.encode(pa.array(["a b", None, "Ünï"]))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("a b", "", "Ünï")]


def check_packing(rows, texts, size):
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in enumerate(texts):
        ids = np.array([*ids_of(text), 1], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(math.ceil(len(ids) / size)))
        for r in own:
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes()
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("size", [64, 4096])
def test_round_trip(spark, size):
    texts = TEXTS + [prose(50 + k, k % 30) for k in range(120)]
    used = check_packing(pack(table(spark, texts), sequence_tokens=size).collect(), texts, size)
    assert used <= math.ceil(sum(len(ids_of(t)) + 1 for t in texts) / size * 1.1) + 1


def test_ids_and_empty_table(spark):
    rows = pack(table(spark, ["a", "a", None, "b"], [1, 1, None, None])).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert pack(empty(spark)).count() == 0


def test_one_hot_length(spark):
    rows = pack(table(spark, ["same text"] * 500), sequence_tokens=10, columns={"crc": F.crc32("ids")}).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500 and len({r.crc for r in rows}) == 1


def optimum(items, size):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                left = list(rooms)
                left.remove(room)
                go(k + 1, [*left, room - items[k]])
        go(k + 1, [*rooms, size - items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_dominance_keeps_an_optimum(items):
    fixed, rest = reduce_by_dominance(dict(Counter(items)), 20)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sum(times for _, times in fixed) + (optimum(left, 20) if left else 0) == optimum(items, 20)


@pytest.mark.parametrize("low,high", [(1, 100), (26, 60), (34, 100), (1, 30)])
def test_plan_uses_every_item_once(low, high):
    r = random.Random(low)
    counts = Counter(r.randint(low, high) for _ in range(3000))
    used = Counter()
    for pattern, times in plan(dict(counts), 100):
        assert sum(pattern) <= 100 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in plan(dict(counts), 100)) <= sum(t for _, t in best_fit(dict(counts), 100))
