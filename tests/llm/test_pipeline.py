import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures
from tests.llm.fixtures import edited, prose
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_groups
from tidemark.llm import decontaminate
from tidemark.staging import stage

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r, texts, labels = random.Random(1), [], []
    item = prose(9001, 30)
    for k in range(240):
        text = prose(k, 80)
        if k % 6 == 0:
            words = text.split(" ")
            words[20:20] = r.choices(["grimhold", "vilefang", "rotmire"], k=5)
            text = " ".join(words)
        texts.append(text)
        labels.append((k, 0, int(k % 6 == 0)))
    texts += [texts[1], texts[1] + " ", edited(texts[2], 1, 1), texts[3] + " " + item + " " + texts[4], item, None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(9002, 12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, item


def test_stages_against_brute_force(spark, folder):
    path, texts, item = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, path), "test")
        assert out.columns == docs.columns
        kept[name], docs = {r.doc_id: r.text for r in out.collect()}, out
    clean, single, apart, cut = kept.values()
    assert set(clean) == {k for k in range(len(texts)) if k >= 240 or k % 6}
    by_text = {}
    for k, t in sorted(clean.items()):
        by_text.setdefault(" ".join((t or "").split(" ")) if t and t.strip() == t else (t or ""), k)
    assert 240 not in single and 246 not in single and 245 in single
    groups = brute_groups(sorted(single.items()))
    assert set(apart) == {i for i, _, c in groups if i == c} and 242 not in apart
    hits = {list(apart)[d]: (n, hit) for d, n, hit, _ in brute_hits(list(apart.values()), [(1, item), (2, prose(9002, 12))])}
    assert set(cut) == {k for k, (n, hit) in hits.items() if not hit or hit < n} and 244 not in cut
    assert all(item not in (t or "") for t in cut.values()) and cut[243] == texts[3] + " " + texts[4]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sorted({r.doc_id for r in rows}) == sorted(cut)


def test_run_is_all_stages(spark, folder):
    path = folder[0]
    rows = corpus_pipeline.run(spark, path)
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert rows.count() > 150


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and decontaminate.WINDOW_WORDS == 10


def test_odd_texts_and_clashing_names(spark, folder, tmp_path):
    """Texts without words at any place of a slice, NULLs, and columns named like the operators' own."""
    path = folder[0]
    texts = [None, "", " ", "...", prose(1, 80), "", prose(2, 80), prose(2, 80), None, "\n", edited(prose(3, 80), 1), prose(3, 80), ""]
    docs = fixtures.table(spark, texts, [None, *range(len(texts) - 2), 3])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} >= {3, 5} and len({r.sequence_id for r in rows}) == 1
    out = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, out, str(tmp_path))
        assert out.columns == docs.columns and out.filter("_id <> '_id' OR n <> 'n' OR key0 <> 'key0'").count() == 0
    nothing = fixtures.empty(spark)
    for _, step in corpus_pipeline.STAGES[:-1]:
        nothing = step(spark, nothing, path)
        assert nothing.columns == docs.columns and nothing.count() == 0


@pytest.mark.parametrize("step", [step for _, step in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_long_texts_in_small_batches(spark, folder, step):
    """Stages run one by one on a bare session; 500 texts of 20 KB were one batch of 10 MB for Python."""
    path = folder[0]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    step(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    docs = spark.range(0, 500, 1, 1).select(F.expr("repeat('abcd ', 4000)").alias("text"))
    sizes = docs.mapInArrow(lambda source: (pa.record_batch({"n": pa.array([b.nbytes])}) for b in source), "n long").collect()
    assert sum(r.n for r in sizes) > 10_000_000 and max(r.n for r in sizes) < 3_000_000
