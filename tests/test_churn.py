"""Bands, segments, evaluation and models on small tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.bands import rank_band, risk_level, tenure_band
from tests.demo import demo_customers
from tidemark.operators import attribution, evaluation, insights, learning, scoring, segments
from tidemark.plans import model_plans


def test_risk_bands_close_on_the_right(spark):
    values = [0.34, 0.3400001, 0.67, 0.68, 0.0, 1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double").select("i", risk_level("p").alias("b"))
    low, mid, high = C.RISK_LEVELS
    assert [r["b"] for r in df.orderBy("i").collect()] == [low, mid, mid, high, low, high, "nan"]


def test_tenure_bands(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (12.5,), (36.0,), (72.0,), (73.0,), (None,)], "t double")
    assert [r[0] for r in df.select(tenure_band("t")).collect()] == ["0-12", "0-12", "13-36", "13-36", "37-72", "73+", "nan"]


@pytest.mark.parametrize("labels", [C.CHARGE_LABELS, C.OVERAGE_LABELS])
def test_rank_bands_equal_quantile_cut(spark, labels):
    q = len(labels)
    sizes = list(range(5, 300)) if q == 4 else list(range(5, 300, 7))
    rows = [(n, r) for n in sizes for r in range(1, n + 1)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["n", "r"]))
    got = df.select("n", "r", rank_band(F.col("r"), F.col("n"), labels).alias("b")).toPandas()
    if q == 4:
        for n, g in got.groupby("n"):
            g = g.sort_values("r")
            want = pd.qcut(g["r"].astype(float), q=q, labels=labels).astype(str)
            assert (g["b"].to_numpy() == want.to_numpy()).all(), n
    sizes_per_band = got.groupby(["n", "b"]).size().groupby("n")
    assert (sizes_per_band.max() - sizes_per_band.min() <= 2).all()


def test_charge_bands_rank_ties_by_id_and_skip_missing(spark, many_ranges):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"customerID": rng.permutation(400), "MonthlyCharges": rng.integers(0, 20, 400) * 1.0})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(1000, None)], "customerID long, MonthlyCharges double"))
    got = segments.with_segments(df).toPandas().set_index("customerID")
    ordered = pdf.sort_values("customerID")
    want = pd.qcut(ordered["MonthlyCharges"].rank(method="first"), q=4, labels=C.CHARGE_LABELS).astype(str)
    want.index = ordered["customerID"]
    assert (got["Charge_Segment"].loc[want.index] == want).all()
    assert got["Charge_Segment"].loc[1000] == "nan"
    assert set(got["Tenure_Segment"]) == {"Unknown"} and set(got["Contract_Segment"]) == {"Standard Plan"}
    assert set(got["Payment_Segment"]) == {"Digital payment"}


def test_contract_flag_and_keywords(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id int, ContractRenewal int")
    assert [r[0] for r in df.orderBy("id").select(segments.contract_segment(df)).collect()] == ["Renewed Contract", "No Renewal"]
    assert segments.find_column(["Total_Charges", "MonthlyCharge"], C.CHARGE_KEYWORDS) == "MonthlyCharge"
    assert segments.find_column(["a"], ["b"]) is None


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, i % 2, [0.9, 0.2, 0.9, 0.5, 0.4, 0.95, 0.1, 0.5][i], 50.0 + i, 10 * i, "c", "p") for i in range(8)]
    df = spark.createDataFrame(rows, "customerID int, y int, p double, MonthlyCharges double, tenure int, Contract string, PaymentMethod string")
    return scoring.with_scores(df, F.col("p"), "y")


def test_score_columns_come_first(scored):
    assert scored.columns[:5] == ["customerID", "y", "Churn_Probability", "Predicted_Churn", "Risk_Level"]
    assert scoring.display_columns(scored, "y") == scored.columns[:5]
    assert len(scoring.display_columns(scored.drop("y"), "y")) == 5


def test_queue_and_distribution(scored):
    queue = scoring.risk_queue(scored, ["High Risk"], 0.9).collect()
    assert [r["customerID"] for r in queue] == [5, 0, 2]
    none = scoring.risk_distribution(scored.where("Risk_Level = 'High Risk'")).orderBy("ord").collect()
    assert [(r["Risk_Level"], r["customers"]) for r in none] == [("Low Risk", 0), ("Medium Risk", 0), ("High Risk", 3)]


def test_kpis_and_revenue(scored):
    kpi = scoring.churn_kpis(scored).first()
    assert (kpi["customers"], kpi["high_risk"], kpi["churn_status"], kpi["risk_status"]) == (8, 3, "bad", "bad")
    risk = scoring.revenue_at_risk(scored).first()
    assert risk["high_risk_rate"] == 3 / 8 and risk["revenue_at_risk"] == 50 + 52 + 55
    assert scoring.revenue_at_risk(scored.drop("MonthlyCharges")).first()["revenue_at_risk"] is None


def test_area_counts_ties_half(scored):
    rows = scored.select("y", "Churn_Probability").toPandas()
    pairs = [(a > b) + 0.5 * (a == b) for a in rows.loc[rows.y == 1, "Churn_Probability"] for b in rows.loc[rows.y == 0, "Churn_Probability"]]
    assert evaluation.roc_auc(scored, "y", "Churn_Probability").first()["roc_auc"] == pytest.approx(np.mean(pairs))
    points = evaluation.roc_points(scored, "y", "Churn_Probability").orderBy(F.desc("threshold")).collect()
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (0.0, 0.0) and (points[-2]["fpr"], points[-2]["tpr"]) == (1.0, 1.0) and len(points) == 7


def test_metrics_with_no_positive_prediction(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert tuple(evaluation.classification_metrics(df, "y", "p").first()) == (0.5, 0.0, 0.0, 0.0)
    assert evaluation.report(df, "y", "p").where("class = 'accuracy'").first()["support"] == 0.5


def test_insight_texts(scored):
    rows = insights.business_insights(segments.with_segments(scored)).orderBy("ord").collect()
    assert [r["title"] for r in rows] == ["Retention Queue", "Tenure Signal", "Contract Exposure", "Payment Pattern"]
    assert rows[0]["body"].startswith("37.5% of customers")
    summary = insights.executive_summary(scored).orderBy("ord").collect()
    assert summary[3]["body"] == "Estimated monthly revenue at risk is $157."
    assert "will activate" in insights.executive_summary(scored.drop("MonthlyCharges")).orderBy("ord").collect()[3]["body"]


def test_driver_sentence(spark):
    df = spark.createDataFrame([("a_b", 0.5), ("c", 0.3), ("d", 0.1), ("e", 0.05)], "feature string, importance double")
    assert "portfolio are a b, c, d. " in insights.driver_text(df).first()[0]
    assert insights.driver_text(df.where("false")).first()[0] == C.DRIVERS_NONE


@pytest.fixture(scope="module")
def demo(spark):
    return demo_customers(spark, 2500).persist()


def test_split_is_stratified_and_stable(demo):
    first = learning.stratified_split(demo, "Churn", "customerID", 0.25)
    pdf = first.select("customerID", "Churn", "split").toPandas()
    for _, g in pdf.groupby("Churn"):
        assert abs((g["split"] == "test").mean() - 0.25) < 1 / len(g) + 1e-9
    other = learning.stratified_split(demo.repartition(5), "Churn", "customerID", 0.25).select("customerID", "split").toPandas()
    assert pdf.set_index("customerID")["split"].sort_index().equals(other.set_index("customerID")["split"].sort_index())


def test_preparation_matches_plain_numbers(spark):
    rows = [(1, 1.0, "a"), (2, None, "b"), (3, 4.0, None), (4, 7.0, "b"), (5, 2.0, "a")]
    df = spark.createDataFrame(rows, "id int, v double, c string")
    prep = learning.prepare(df, ["v", "c"])
    filled = np.array([1, 3, 4, 7, 2.0])
    assert prep.numeric["v"] == (3.0, pytest.approx(filled.mean()), pytest.approx(filled.std()))
    assert prep.categorical["c"] == ("a", 2) and prep.width == 3
    assert [r["feature"] for r in prep.names().orderBy("number").collect()] == ["v", "c_a", "c_b"]
    unknown = spark.createDataFrame([(9, 3.0, "z")], "id int, v double, c string")
    assert learning.featurize(unknown, prep).first()["features"].toArray().tolist()[1:] == [0.0, 0.0]


@pytest.mark.parametrize("choice", ["boosted", "forest"])
def test_model_learns_and_attributions_add_up(spark, demo, choice):
    model = learning.train_churn_model(demo, "Churn", "customerID", choice, trees=12)
    metrics = model.metrics().first()
    assert metrics["roc_auc"] > 0.65 and metrics["train_rows"] + metrics["test_rows"] == 2500
    scored = model.scored()
    assert scored.count() == 2500 and scored.where("Risk_Level = 'nan'").count() == 0
    assert model.importance(3).count() == 3
    names = {r["feature"]: r["number"] for r in model.prep.names().collect()}
    got = {names[r["feature"]]: r["importance"] for r in model.importance(1000).collect()}
    np.testing.assert_allclose([got[k] for k in range(len(got))], model.model.featureImportances.toArray(), atol=1e-12)
    walked = model.node_scores().toPandas()
    np.testing.assert_allclose(walked["by_nodes"], walked["probability"], atol=1e-12)
    base = attribution.base_value(model.leaves()).first()["base"]
    found = {r["customerID"]: sum(r["attributions"]) + base for r in attribution.model_attributions(model).collect()}
    assert len(found) == 2500
    for name, p in zip(walked["customerID"], walked["probability"]):
        assert found[name] == pytest.approx(np.log(p / (1 - p)) if choice == "boosted" else p, abs=1e-9)
    top = attribution.mean_abs_attribution(model, rows=100, top=5).collect()
    assert len(top) == 5 and top[0]["mean_abs"] >= top[-1]["mean_abs"] > 0


def test_attribution_matches_enumeration(spark, demo):
    """Shapley values by the definition, over all feature subsets of one small tree."""
    from itertools import combinations
    from math import factorial

    model = learning.train_churn_model(demo, "Churn", "customerID", "boosted", trees=1)
    leaves = model.leaves().collect()
    some = model.featured().limit(4).persist()
    x = np.array([r["features"].toArray() for r in some.collect()])
    used = sorted({f for leaf in leaves for f in leaf["feature"]})

    def worth(row, known):
        total = 0.0
        for leaf in leaves:
            term = leaf["value"]
            for f, low, high, share in zip(leaf["feature"], leaf["low"], leaf["high"], leaf["share"]):
                term *= float(low < row[f] <= high) if f in known else share
            total += term
        return total

    by_id = {r["customerID"]: r["attributions"] for r in attribution.model_attributions(model, some.drop("features")).collect()}
    got = np.array([by_id[r["customerID"]] for r in some.collect()])
    n = len(used)
    for r, row in enumerate(x):
        for f in used:
            rest = [u for u in used if u != f]
            value = sum(
                factorial(k) * factorial(n - k - 1) / factorial(n) * (worth(row, {*s, f}) - worth(row, set(s)))
                for k in range(n)
                for s in combinations(rest, k)
            )
            assert got[r, f] == pytest.approx(value, abs=1e-9)


def test_collinear_points_drop_across_chunks(spark, monkeypatch, many_ranges):
    import random

    monkeypatch.setattr(evaluation, "TURN_CHUNK", 3)
    r = random.Random(4)
    rows = [(int(r.random() < 0.5), k / 50) for k in range(50) for _ in range(1 + (k % 7 == 0))] + [(1, None)]
    df = spark.createDataFrame(rows, "y int, p double")
    whole = [tuple(x)[1:3] for x in evaluation.roc_points(df, "y", "p").orderBy("fp", "tp").collect()]
    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(whole, whole[1:])]
    want = [whole[0], whole[1], *[p for p, a, b in zip(whole[2:], steps[1:], steps[2:]) if a != b], whole[-1]]
    got = [tuple(x)[1:3] for x in evaluation.roc_points(df, "y", "p", drop_collinear=True).orderBy("fp", "tp").collect()]
    assert got == want and len(got) < len(whole)


def test_a_column_of_many_values(spark):
    """Category values are numbered in a table: forty thousand of them are one more join and a sparse vector."""
    rows = spark.range(80_000).select(F.col("id"), F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(40_000)).cast("string")).alias("c"), F.col("id").cast("double").alias("x"))
    prep = learning.prepare(rows, ["x", "c"])
    assert prep.categorical["c"][1] == 40_000 and prep.width == 40_001 and prep.names().count() == 40_001
    some = learning.featurize(rows.where("id < 3"), prep).collect()
    names = {r["number"]: r["feature"] for r in prep.names().collect()}
    for row in some:
        cells = row["features"]
        assert cells.size == 40_001 and [names[int(i)] for i in cells.indices if i > 0] == [f"c_{row['c']}"]


def test_training_reads_its_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    rows = spark.createDataFrame([(i, float(i % 7), i % 3 % 2) for i in range(60)], "customerID long, x double, Churn int")
    learning.train_churn_model(rows.withColumn("x", counted("x")), "Churn", "customerID", "boosted", trees=1)
    assert read.value == 60


def test_blocks_of_rows_and_trees_give_the_models_probability(spark, demo, monkeypatch):
    """Rows that repeat stay apart, over several blocks of both."""
    monkeypatch.setattr(learning.trees, "TREES_PER_BLOCK", 2)
    monkeypatch.setattr(learning.trees, "ROWS_PER_BLOCK", 100)
    model = learning.train_churn_model(demo.limit(300), "Churn", "customerID", "forest", trees=5)
    model.data = model.data.union(model.data)
    plan = model.node_scores()._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence(" not in plan  # no interpreted walk per row and tree
    walked = model.node_scores().toPandas()
    assert len(walked) == 600 and walked.groupby("customerID").size().eq(2).all()
    np.testing.assert_allclose(walked["by_nodes"], walked["probability"], atol=1e-12)


def test_scoring_runs_on_all_cores(spark, demo):
    model = learning.train_churn_model(demo, "Churn", "customerID", "forest", trees=2)
    alike = ["customerID", "split", "Churn_Probability", "Predicted_Churn", "Risk_Level"]
    wanted = learning.with_scores(
        model.model.transform(model.featured()), learning.vector_to_array(F.col("probability"))[1], "Churn"
    ).select(alike).toPandas()
    model.data = model.data.coalesce(1)
    scored = model.scored()
    assert scored.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = scored.select(alike).toPandas()
    pd.testing.assert_frame_equal(*(t.sort_values("customerID", ignore_index=True) for t in (found, wanted)))


def test_both_models_share_one_preparation(spark, small, monkeypatch):
    made, few = [], learning.classifier
    prepare = learning.prepare
    monkeypatch.setattr(learning, "prepare", lambda *a: made.append(1) or prepare(*a))
    monkeypatch.setattr(learning, "classifier", lambda choice, label, _, weight: few(choice, label, 3, weight))
    monkeypatch.setattr(model_plans, "_FITTED", {})
    found = model_plans.score_agreement(spark, small).toPandas()
    assert len(made) == 1 and found["agrees"].all()
    assert found.groupby("model")["customerID"].nunique().tolist() == [len(found) // 2] * 2
    model_plans.importance_agreement(spark, small)
    assert len(made) == 1


def test_training_rows_lie_in_partitions_for_all_cores(spark, monkeypatch):
    parts = {}

    class Learner:
        def fit(self, ready):
            parts[choice] = ready.rdd.glom().map(len).collect()

    monkeypatch.setattr(learning, "classifier", lambda *_: Learner())
    rows = spark.range(6000).select(F.col("id").alias("customerID"), (F.col("id") % 7).alias("x"), (F.col("id") % 3 % 2).cast("int").alias("Churn")).coalesce(1)
    for choice in ("boosted", "forest"):
        learning.train_churn_model(rows, "Churn", "customerID", choice)
    train = sum(parts["boosted"])
    assert len(parts["boosted"]) == 1 and sum(parts["forest"]) == train
    assert len(parts["forest"]) == min(spark.sparkContext.defaultParallelism, train // 1000) > 1
    assert max(parts["forest"]) <= 1.1 * min(parts["forest"])


def test_a_forest_keeps_the_node_of_each_row():
    assert learning.classifier("forest", "Churn").getCacheNodeIds()


def test_shapley_works_in_small_arrays():
    rng = np.random.default_rng(5)
    leaves = {"feature": np.array([[0, 1, 2]] * 4096), "low": np.full((4096, 3), -1.0), "high": rng.random((4096, 3)), "share": np.full((4096, 3), 0.5), "value": rng.random(4096)}
    x, out = rng.random((512, 3)), np.zeros((512, 3))
    tracemalloc.start()
    attribution.shapley(x, leaves, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = (x[:, None] > leaves["low"]) & (x[:, None] <= leaves["high"])
    whole = (known.all(axis=2) - 0.125) @ leaves["value"]
    assert np.allclose(out.sum(axis=1), whole) and peak < 8e6


def _small_blocks(spark, monkeypatch, demo, choice, rows=40):
    """A model with rows that come three times, in blocks so small that Spark would broadcast any of them."""
    for name, size in (("ROWS_PER_BLOCK", 10), ("TREES_PER_BLOCK", 2), ("MODEL_BLOCKS_PER_PART", 2), ("ROW_BLOCKS_PER_PART", 1)):
        monkeypatch.setattr(learning.trees, name, size)
    model = learning.train_churn_model(demo, "Churn", "customerID", choice, trees=5)
    model.data = model.data.limit(rows).repartition(1).crossJoin(spark.range(3).select(F.col("id").alias("copy"))).drop("copy")
    return model


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("choice", ["boosted", "forest"])
def test_walked_blocks_stay_off_the_driver(spark, demo, monkeypatch, choice):
    """Copies of row blocks are not broadcast, however small their files: on six times sf0.1 they overran the driver."""
    scores = _small_blocks(spark, monkeypatch, demo, choice).node_scores()
    assert "CartesianProduct" in _plan(scores) and "Broadcast" not in _plan(scores)
    walked = scores.toPandas()
    assert len(walked) == 120
    np.testing.assert_allclose(walked["by_nodes"], walked["probability"], atol=1e-12)
    assert _small_blocks(spark, monkeypatch, demo, choice, 0).node_scores().count() == 0


def test_a_forest_is_not_saved_as_a_whole(spark, demo, monkeypatch):
    """Its nodes become a table by a few trees at a time, equal to that of the model saved at once."""
    monkeypatch.setattr(learning.trees, "SAVED_AT_ONCE", 300)
    model = learning.train_churn_model(demo, "Churn", "customerID", "forest", trees=11).model
    path = learning.trees.new_path(spark, "whole")
    model.save(path)
    monkeypatch.setattr(type(model), "save", lambda *_: pytest.fail("all nodes at once"))
    found = learning.trees.node_table(spark, model)
    assert dict(found.dtypes)["tree"] == "int" and found.count() == model.totalNumNodes
    names = ["treeID", "id", "leftChild", "rightChild", "gain"]
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(*names, F.col("split.featureIndex"))
    wanted = {(r[0], r[1]): tuple(r)[2:] for r in saved.collect()}
    assert {(r["tree"], r["node"]): (r["left"], r["right"], r["gain"], r["feature"]) for r in found.collect()} == wanted


@pytest.mark.parametrize("choice", ["boosted", "forest"])
def test_attributed_blocks_stay_off_the_driver(spark, demo, monkeypatch, choice):
    monkeypatch.setattr(attribution, "ROWS_PER_BLOCK", 10)
    monkeypatch.setattr(attribution, "LEAVES_PER_BLOCK", 7)
    model = _small_blocks(spark, monkeypatch, demo, choice)
    found = attribution.model_attributions(model)
    assert "CartesianProduct" in _plan(found) and "Broadcast" not in _plan(found)
    base = attribution.base_value(model.leaves()).first()["base"]
    sums = pd.DataFrame([(r["customerID"], sum(r["attributions"]) + base) for r in found.collect()], columns=["customerID", "value"])
    assert len(sums) == 120
    p = model.node_scores().toPandas().groupby("customerID")["probability"].first()
    wanted = np.log(p / (1 - p)) if choice == "boosted" else p
    np.testing.assert_allclose(sums["value"], wanted.loc[sums["customerID"]], atol=1e-9)


def test_attributions_without_rows_or_leaves(spark, demo):
    model = learning.train_churn_model(demo, "Churn", "customerID", "boosted", trees=2)
    assert attribution.model_attributions(model, model.data.where("false")).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "customerID long, x array<double>")
    assert attribution.attributions(rows, model.leaves().where("false"), "customerID", 2).collect() == [(1, [0.0, 0.0])]
