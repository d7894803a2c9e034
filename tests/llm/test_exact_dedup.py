import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import ODD_TEXTS, empty, prose, table
from tidemark.llm.exact_dedup import exact_groups, keep_first


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        out.append((i, min(same), len(same), i == min(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


TEXTS = ODD_TEXTS + [prose(1, 30000), prose(1, 29999), "Two words", "a b", "a b", "a\tb", prose(1, 30000) + " end"]


def test_matches_brute_force(spark):
    got = exact_groups(table(spark, TEXTS)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(TEXTS)))


def test_small_blocks_and_colliding_hashes(spark):
    rows = [(i, prose(i % 7, 5 + i % 3)) for i in range(60)]
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(5))
    got = exact_groups(table(spark, [t for _, t in rows]), block_bytes=7, block_hash=weak).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_null_and_repeated_ids(spark):
    docs = table(spark, ["a", "a", "a", "b", "b", "c"], [5, 5, None, None, None, 7])
    got = exact_groups(docs).collect()
    assert sorted(r.group_size for r in got) == [1, 2, 2, 3, 3, 3]
    assert sorted((r.keep_id is None, r.keep_id or 0) for r in got if r.kept) == [(False, 5), (False, 7), (True, 0)]
    kept = keep_first(docs).collect()
    assert sorted(r.text for r in kept) == ["a", "b", "c"] and keep_first(docs).columns == docs.columns


def test_one_hot_group(spark):
    docs = table(spark, ["same text"] * 300 + [f"own {i}" for i in range(100)])
    got = exact_groups(docs).collect()
    assert sum(r.kept for r in got) == 101 and max(r.group_size for r in got) == 300


def test_empty_table(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert keep_first(empty(spark)).count() == 0
