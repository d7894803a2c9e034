"""Registered model queries. SQL confirms what does not depend on the learner, and that tables read from a model agree with it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from tidemark.constants import DRIVERS_TEXT
from tidemark.operators import attribution, evaluation, insights, learning
from tidemark.plans.common import CUSTOMERS, rounded, with_ctes
from tidemark.sources.files import data_version
from tidemark.sources.tables import customers

TARGET, KEY = "Churn", "customerID"
CHOICES = ("boosted", "forest")
_FITTED: dict[tuple, learning.TrainingData | learning.ChurnModel] = {}


def training(spark, sf_dir: str) -> tuple[tuple, learning.TrainingData]:
    """The prepared customers of a folder, with their key: made once per application and version of its files, for all models."""
    table = customers(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, data_version(table))
    if key not in _FITTED:
        _FITTED[key] = learning.training_data(table, TARGET, KEY)
    return key, _FITTED[key]


def trained(spark, sf_dir: str, choice: str) -> learning.ChurnModel:
    """The model of the customers of a folder, fitted once per application and version of its files."""
    key, rows = training(spark, sf_dir)
    if (*key, choice) not in _FITTED:
        _FITTED[(*key, choice)] = learning.fit_churn_model(rows, choice)
    return _FITTED[(*key, choice)]


def trained_both(spark, sf_dir: str) -> list[learning.ChurnModel]:
    """Both models, fitted side by side: boosting is many short jobs in a row that leave most cores to the forest."""
    training(spark, sf_dir)
    fit = inheritable_thread_target(spark)(lambda choice: trained(spark, sf_dir, choice))
    with ThreadPoolExecutor(len(CHOICES)) as pool:
        return list(pool.map(fit, CHOICES))


def stratified_split(spark, d):
    return learning.stratified_split(customers(spark, d), TARGET, KEY).select(KEY, TARGET, "split")


def gbt_metrics(spark, d):
    return rounded(trained(spark, d, "boosted").metrics())


def rf_metrics(spark, d):
    return rounded(trained(spark, d, "forest").metrics())


def scored_customers(spark, d):
    return rounded(trained(spark, d, "forest").scored())


def feature_importance(spark, d):
    return rounded(trained(spark, d, "boosted").importance())


def mean_abs_attribution(spark, d):
    """Attribution over all customers."""
    return rounded(attribution.mean_abs_attribution(trained(spark, d, "boosted")))


def driver_text(spark, d):
    return insights.driver_text(trained(spark, d, "boosted").importance())


def driver_text_of_rates(spark, d):
    """The sentence for features weighed by how far churn rates differ between their values."""
    data = customers(spark, d)
    rates = data.unpivot([TARGET], _TEXTS, "feature", "value").groupBy("feature", "value").agg(F.avg(TARGET).alias("rate"))
    gaps = rates.groupBy("feature").agg((F.max("rate") - F.min("rate")).alias("importance"))
    return insights.driver_text(gaps)


def model_report(spark, d):
    return rounded(evaluation.report(trained(spark, d, "forest").test_scores(), TARGET, "Predicted_Churn"))


def split_shares(spark, d):
    """Rows and test share per class of the stratified split."""
    return stratified_split(spark, d).groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg((F.col("split") == "test").cast("int")), 2).alias("test_share")
    )


def _prepared(spark, d) -> tuple:
    """Customers with their split, and the preparation learned on the training rows."""
    data = learning.stratified_split(customers(spark, d), TARGET, KEY)
    columns = [c for c in data.columns if c not in (KEY, TARGET, "split")]
    return data, learning.prepare(data.where("split = 'train'"), columns)


def feature_vectors(spark, d):
    """The cells other than zero of every customer's feature vector."""
    data, prep = _prepared(spark, d)
    cells = learning.featurize(data, prep).select(KEY, F.posexplode(learning.vector_to_array("features")).alias("number", "value"))
    return rounded(cells.where("value <> 0").join(prep.names(), "number").select(KEY, "number", "feature", "value"))


def class_weights(spark, d):
    """Weight per class of the training rows."""
    train = learning.stratified_split(customers(spark, d), TARGET, KEY).where("split = 'train'")
    return rounded(learning.class_weights(train, TARGET))


def fitted_models(spark, d):
    """Per model: rows it learned from and is tested on, its size, and whether held-out customers are told apart."""
    parts = []
    for choice, model in zip(CHOICES, trained_both(spark, d)):
        per_tree = model.nodes().groupBy("tree").agg(F.count_if(F.col("left") < 0).alias("leaves"), F.count(F.lit(1)).alias("nodes"))
        size = per_tree.agg(F.count(F.lit(1)).alias("trees"), F.bool_and(F.col("nodes") == 2 * F.col("leaves") - 1).alias("binary_trees"))
        shown = model.metrics().select("train_rows", "test_rows", (F.col("roc_auc") > 0.55).alias("tells_apart"))
        parts.append(size.crossJoin(shown).withColumn("model", F.lit(choice)))  # one row each
    return parts[0].unionByName(parts[1])


def _agreement(spark, d, column):
    parts = [column(model).withColumn("model", F.lit(choice)) for choice, model in zip(CHOICES, trained_both(spark, d))]
    return parts[0].unionByName(parts[1])


def score_agreement(spark, d):
    """Per customer and model, whether a walk through the node table gives the model's probability."""
    return _agreement(spark, d, lambda m: m.node_scores().select(KEY, (F.abs(F.col("probability") - F.col("by_nodes")) <= 1e-9).alias("agrees")))


def importance_agreement(spark, d):
    """Per feature and model, whether the gains in the node table give the model's importance."""

    def column(m):
        own = [(k, float(v)) for k, v in enumerate(m.model.featureImportances.toArray())]  # one per cell of the vector
        wanted = m.data.sparkSession.createDataFrame(own, "number int, wanted double").join(m.prep.names(), "number")
        found = m.importance(m.prep.width)
        return wanted.join(found, "feature").select("feature", (F.abs(F.col("wanted") - F.col("importance")) <= 1e-9).alias("agrees"))

    return _agreement(spark, d, column)


def attribution_agreement(spark, d):
    """Per customer and model, whether all attributions and the base value add up to the model's value."""

    def column(m):
        base = attribution.base_value(m.leaves()).scalar()
        whole = F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x) + base
        p = F.col("probability")
        value = F.log(p / (1 - p)) if m.boosted else p
        joined = attribution.model_attributions(m).join(m.node_scores(), KEY)
        return joined.select(KEY, (F.abs(whole - value) <= 1e-6).alias("agrees"))

    return _agreement(spark, d, column)


_SPLIT = {
    "customers": CUSTOMERS,
    "drawn": f"""SELECT *,
      CAST(('0x' || substr(md5('{learning.SEED}|' || customerID), 1, 13))::BIGINT AS DOUBLE) AS draw FROM customers""",
    "split": """SELECT d.*, CASE WHEN draw <= cut THEN 'test' ELSE 'train' END AS split
      FROM drawn d JOIN (SELECT Churn, quantile_cont(draw, 0.25) AS cut FROM drawn GROUP BY Churn) c ON c.Churn = d.Churn""",
    "train": "SELECT * FROM split WHERE split = 'train'",
}
_NUMBERS = ["tenure", "MonthlyCharges", "TotalCharges", "SupportTickets"]
_TEXTS = ["Contract", "PaymentMethod"]
_CELLS = {
    **_SPLIT,
    "facts": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, AVG(v) AS mean, stddev_pop(v) AS std, any_value(m) AS median
        FROM (SELECT COALESCE({c}, m)::DOUBLE AS v, m FROM train, (SELECT median({c}) AS m FROM train))""" for c in _NUMBERS
    ),
    "known": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {c} AS value, COUNT(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY {c}""" for c in _TEXTS
    ),
    "names": f"""SELECT feature, NULL AS value, feature AS name, list_position({_NUMBERS!r}, feature) - 1 AS number FROM facts
      UNION ALL SELECT feature, value, feature || '_' || value, {len(_NUMBERS)} - 1 + ROW_NUMBER() OVER (ORDER BY list_position({_TEXTS!r}, feature), value) FROM known""",
    "cells": " UNION ALL ".join(
        [f"""SELECT customerID, f.feature AS feature, NULL AS value,
          (COALESCE({c}, f.median) - f.mean) / CASE WHEN f.std > 0 THEN f.std ELSE 1 END AS cell FROM split, facts f WHERE f.feature = '{c}'""" for c in _NUMBERS]
        + [f"""SELECT customerID, '{c}', COALESCE({c}, (SELECT value FROM known WHERE feature = '{c}' ORDER BY n DESC, value LIMIT 1)), 1.0::DOUBLE
          FROM split""" for c in _TEXTS]
    ),
}
_MODELS = "(SELECT unnest(['boosted', 'forest']) AS model)"

QUERIES = {
    "stratified_split": (stratified_split, with_ctes("SELECT customerID, Churn, split FROM split", **_SPLIT)),
    "split_shares": (
        split_shares,
        with_ctes(
            "SELECT Churn, COUNT(*) AS customers, ROUND(AVG(CAST(split = 'test' AS INTEGER)), 2) AS test_share FROM split GROUP BY Churn",
            **_SPLIT,
        ),
    ),
    "feature_vectors": (
        feature_vectors,
        with_ctes(
            """SELECT customerID, CAST(n.number AS INTEGER) AS number, n.name AS feature, (ROUND(cell, 4) + 0.0) AS value FROM cells c
            JOIN names n ON n.feature = c.feature AND n.value IS NOT DISTINCT FROM c.value WHERE cell <> 0""",
            **_CELLS,
        ),
    ),
    "class_weights": (
        class_weights,
        with_ctes("SELECT Churn, ROUND(SUM(COUNT(*)) OVER () / COUNT(*) OVER () / COUNT(*), 4) AS weight FROM train GROUP BY Churn", **_SPLIT),
    ),
    "fitted_models": (
        fitted_models,
        with_ctes(
            f"""SELECT model, CASE model WHEN 'boosted' THEN 260 ELSE 340 END::BIGINT AS trees, TRUE AS binary_trees, train_rows, test_rows, TRUE AS tells_apart
            FROM {_MODELS}, (SELECT COUNT(*) FILTER (split = 'train') AS train_rows, COUNT(*) FILTER (split = 'test') AS test_rows FROM split)""",
            **_SPLIT,
        ),
    ),
    "score_agreement": (score_agreement, with_ctes(f"SELECT customerID, model, TRUE AS agrees FROM customers, {_MODELS}", customers=CUSTOMERS)),
    "importance_agreement": (importance_agreement, with_ctes(f"SELECT name AS feature, model, TRUE AS agrees FROM names, {_MODELS}", **_CELLS)),
    "attribution_agreement": (attribution_agreement, with_ctes(f"SELECT customerID, model, TRUE AS agrees FROM customers, {_MODELS}", customers=CUSTOMERS)),
    "rf_metrics": (rf_metrics, None),
    "scored_customers": (scored_customers, None),
    "model_report": (model_report, None),
    "gbt_metrics": (gbt_metrics, None),
    "feature_importance": (feature_importance, None),
    "driver_text": (driver_text, None),
    "mean_abs_attribution": (mean_abs_attribution, None),
    "driver_text_of_rates": (
        driver_text_of_rates,
        with_ctes(
            "SELECT replace('" + DRIVERS_TEXT.replace("'", "''") + """', '{features}', list_aggregate(list(replace(feature, '_', ' ') ORDER BY gap DESC, feature), 'string_agg', ', ')) AS interpretation
            FROM (SELECT feature, MAX(rate) - MIN(rate) AS gap FROM rates GROUP BY feature)""",
            customers=CUSTOMERS,
            rates=" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, AVG(Churn) AS rate FROM customers GROUP BY {c}" for c in _TEXTS),
        ),
    ),
}
