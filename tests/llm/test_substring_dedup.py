import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import ODD_TEXTS, edited, empty, prose, table
from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import SHINGLE_WORDS, around, common_spans, repeated_passages, tuned_bands, without_passages
from tidemark.llm.words import windows


def inside(seed, passage, words=120):
    host = prose(40_000 + seed, words).split(" ")
    at = random.Random(seed).randint(0, words)
    return " ".join(host[:at] + [passage] + host[at:]), at


def removed(spark, texts, **more):
    out = {}
    for r in repeated_passages(table(spark, texts), **more).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.n_words, r.kept_in, r.cluster_id))
    return out


def test_planted_passages(spark):
    passages = [prose(900 + k, 52 + 7 * k) for k in range(12)]
    texts, at = zip(*[inside(k, passages[k % 12]) for k in range(48)])
    got = removed(spark, list(texts) + [prose(k, 150) for k in range(2000, 2040)] + ODD_TEXTS)
    assert set(got) == set(range(12, 48))
    for k in range(12, 48):
        start, count, kept, _ = got[k][0]
        assert len(got[k]) == 1 and kept == k % 12
        assert abs(start - at[k]) <= 5 and abs(count - (52 + 7 * (k % 12))) <= 10
    clusters = {k: got[k][0][3] for k in got}
    assert len(set(clusters.values())) == 12 and all(clusters[k] == clusters[k % 12 + 12] for k in clusters)


def test_recall_of_near_passages(spark):
    texts = []
    for k in range(60):
        base = prose(3000 + k, 120)
        texts += [base, edited(base, 1, k)]
    got = removed(spark, texts)
    assert len(got) >= 0.95 * 60 and all(k % 2 for k in got)


def test_first_holders_without_the_passage(spark):
    passages = [prose(6000 + k, 51) for k in range(12)]
    hosts = []
    for passage in passages:
        words = passage.split(" ")
        for k in range(47):  # each shingle first stands in an unrelated text that has few others
            filler = [f"zz{len(hosts)}"] * 25
            hosts.append(" ".join(filler + words[k : k + 5] + filler))
    got = removed(spark, hosts + passages + passages)
    assert set(got) == set(range(len(hosts) + 12, len(hosts) + 24))
    assert all(got[k][0][2] == k - 12 for k in got)


def test_short_repeats_stay(spark):
    boiler = prose(77, 30)
    assert removed(spark, [inside(k, boiler)[0] for k in range(60)]) == {}


def test_large_group_and_text(spark):
    passage = prose(55, 80)
    texts = [passage] * 150 + [inside(k, passage, 40)[0] for k in range(150)]
    docs = table(spark, texts)
    report = repeated_passages(docs)
    assert sorted({r.doc_id for r in report.collect()}) == list(range(1, 300))
    clean = without_passages(docs, report)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert len(r.text.split()) <= (80 if r.doc_id == 0 else 50)


def test_ids_and_empty(spark):
    one = prose(5, 100)
    assert [r.doc_id for r in repeated_passages(table(spark, [one, one, one, one], [2, 2, None, 9])).collect()] == [9]
    assert repeated_passages(empty(spark)).count() == 0
    assert repeated_passages(table(spark, [None, "", "short"])).count() == 0


def test_bands():
    assert tuned_bands(0.8, 0.99) == 3 and tuned_bands(0.5, 0.99) == 7


def test_spans_with_an_inserted_word():
    import numpy as np

    a = np.arange(1000, 1100, dtype=np.uint64)
    b = np.insert(a, 50, 7)
    spans = common_spans(a, b, [(10, 10), (60, 61)], 51, 0.8)
    assert {s - o for s, o, _ in spans} <= {0, -1} and spans


def pairs_made(monkeypatch):
    """Rows of each table of pairs, in the order they are made."""
    rows, own = [], substring_dedup._paired

    def counted(pairs):
        out = own(pairs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "_paired", counted)
    return rows


def test_chance_collisions_are_not_verified(spark, monkeypatch):
    rows = pairs_made(monkeypatch)
    shared = [prose(8800 + k, 12) for k in range(4)]
    texts = [inside(9000 + k, shared[k % 4], 50)[0] for k in range(120)]
    docs = table(spark, texts).repartitionByRange(40, "doc_id")  # no shingle is common in a stretch
    assert repeated_passages(docs).count() == 0
    monkeypatch.setattr(substring_dedup, "_may_link", lambda *_: F.lit(True))
    assert repeated_passages(docs).count() == 0
    first, kept, _, every = rows
    assert kept == 0 < first < every


def test_sketches_keep_near_places():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 60, 51, dtype=np.uint64)
    for kind in range(4):
        near = [words, np.delete(words, 30), np.insert(words, 30, 9), np.where(np.arange(51) == 30, 9, words).astype(np.uint64)][kind]
        a, b = (windows(np.concatenate([rng.integers(1, 1 << 60, 60, dtype=np.uint64), x, rng.integers(1, 1 << 60, 60, dtype=np.uint64)]), SHINGLE_WORDS) for x in (words, near))
        for at in (60, 70, 84):  # the same shingle of both
            (sa, spare_a, rep_a), (sb, spare_b, rep_b) = (around(x, np.array([at]), 46) for x in (a, b))
            common = int(np.bitwise_count((sa & sb).view(np.uint64)).sum())
            assert 2 * (common + min(spare_a[0], spare_b[0])) + rep_a[0] + rep_b[0] >= 4 * 47 * 0.8 / 1.8
    far = windows(rng.integers(1, 1 << 60, 200, dtype=np.uint64), SHINGLE_WORDS)
    (sa, spare_a, _), (sb, spare_b, _) = around(a, np.array([80]), 46), around(far, np.array([80]), 46)
    assert 2 * (int(np.bitwise_count((sa & sb).view(np.uint64)).sum()) + min(spare_a[0], spare_b[0])) < 4 * 47 * 0.8 / 1.8


def test_sketches_of_odd_places():
    none, one = np.zeros(0, np.uint64), np.full(100, 7, np.uint64)
    for grams, at in ((none, 0), (one, 100)):  # beyond the text: nothing is ruled out
        sketch, spare, _ = around(grams, np.array([at]), 46)
        assert (sketch == -1).all() and spare[0] == 93
    sketch, spare, repeats = around(one, np.array([0, 50]), 46)
    assert np.bitwise_count(sketch.view(np.uint64)).sum(axis=1).tolist() == [1, 1]
    assert spare.tolist() == [0, 0] and repeats.tolist() == [46, 92]


def test_shuffle_files_go_with_the_write(spark):
    from tidemark.staging import CLEAN_UP, stage

    def files():
        left = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {left.apply(k).getName() for k in range(left.size()) if left.apply(k).getName().endswith(".data")}

    before, setting = files(), spark.conf.get(CLEAN_UP, None)
    rows = spark.range(1000).repartition(7).groupBy((F.col("id") % 50).alias("k")).count()
    assert stage(rows).count() == 50
    wanted = time.time() + 20
    while len(files() - before) > 1 and time.time() < wanted:  # the count's own shuffle may be left
        time.sleep(0.2)
    assert len(files() - before) <= 1
    assert spark.conf.get(CLEAN_UP, None) == setting
