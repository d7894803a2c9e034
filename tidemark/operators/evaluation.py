"""Classifier evaluation: confusion, report, ROC curve and area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.ordered import chunked, positions, running_sums, without_halo

TURN_CHUNK = 10_000


def _cells(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """The four cells of the 2 x 2 table, from one pass."""
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Number of classes and size of the smallest: a split is stratified for two classes of two rows or more."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    sums = sizes.agg(F.count(F.lit(1)).alias("classes"), F.min("cnt").alias("smallest"))
    return sums.select("*", ((F.col("classes") == 2) & (F.col("smallest") >= 2)).alias("stratify"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _precision_recall_f1(hit: Column, wrongly: Column, missed: Column):
    precision = _or_zero(ratio(hit, hit + wrongly))
    recall = _or_zero(ratio(hit, hit + missed))
    f1 = _or_zero(ratio(2 * hit, 2 * hit + wrongly + missed))
    return precision, recall, f1


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows (actual, predicted, customers) of the 2 x 2 table."""
    names = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("customers"))
            for n, (a, p) in names.items()
        ]
    )
    return _cells(df, label, predicted).select(F.inline(cells))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a divisor is zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _precision_recall_f1(tp, fp, fn)
    return _cells(df, label, predicted).select(
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
    )


def report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per-class figures with macro and weighted means; accuracy fills its whole row."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    zero = (*_precision_recall_f1(tn, fn, fp), tn + fp)
    one = (*_precision_recall_f1(tp, fp, fn), tp + fn)
    total = zero[3] + one[3]
    accuracy = ratio(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    lines = [
        ("0", *zero), ("1", *one), ("accuracy", accuracy, accuracy, accuracy, accuracy),
        ("macro avg", *macro, total), ("weighted avg", *weighted, total),
    ]
    fields = ["precision", "recall", "f1_score", "support"]
    rows = F.array(
        *[F.struct(F.lit(name).alias("class"), *[v.alias(f) for f, v in zip(fields, values)]) for name, *values in lines]
    )
    return _cells(df, label, predicted).select(F.inline(rows))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with the counts at higher scores."""
    groups = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_sums(groups, [], [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def _turning_points(groups: DataFrame) -> DataFrame:
    """Of scores in order, the highest, the lowest, and those after which the curve changes its step.

    A score's neighbour below may lie in another range: scores are numbered by
    range and windowed in chunks that carry the row before.
    """
    ranked = positions(groups, [], [F.col("score")], pos="_pos", total="_scores")
    cut = chunked(ranked, [], TURN_CHUNK, 1, "_pos", "_scores")
    below = Window.partitionBy("_chunk").orderBy("_pos")
    turns = (F.lag("pos").over(below) != F.col("pos")) | (F.lag("neg").over(below) != F.col("neg"))
    ends = (F.col("_pos") == 0) | (F.col("_pos") == F.col("_scores") - 1)
    marked = without_halo(cut.withColumn("_kept", ends | F.coalesce(turns, F.lit(False))))
    return marked.where("_kept").drop("_kept", "_pos", "_scores")


def roc_points(df: DataFrame, label: str, score: str, drop_collinear: bool = False) -> DataFrame:
    """ROC curve: the start (0, 0), and one point per distinct score (rows at or above it count as positive).

    The start has no threshold. ``drop_collinear`` leaves out the points from which the
    curve goes on as it came, by the same number of rows of both classes; the curve stays the same.
    """
    g = _by_score(df, label, score)
    if drop_collinear:
        g = _turning_points(g)
    tp, fp = F.col("tp_before") + F.col("pos"), F.col("fp_before") + F.col("neg")
    points = g.select(
        F.col("score").alias("threshold"),
        fp.alias("fp"),
        tp.alias("tp"),
        ratio(fp, F.col("fp_total")).alias("fpr"),
        ratio(tp, F.col("tp_total")).alias("tpr"),
    )
    start = {"threshold": None, "fp": 0, "tp": 0, "fpr": 0.0, "tpr": 0.0}
    kinds = dict(points.dtypes)
    first = df.sparkSession.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in start.items()])
    return first.unionByName(points)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve as the chance that a positive outranks a negative, ties counting half."""
    g = _by_score(df, label, score)
    won = F.col("pos") * (F.col("fp_total") - F.col("fp_before") - F.col("neg")) + F.col("pos") * F.col("neg") / 2
    area = ratio(F.sum(won.cast("decimal(38,1)")), F.max(F.col("tp_total").cast("double") * F.col("fp_total")))
    return g.agg(area.alias("roc_auc"), F.max("tp_total").alias("positives"), F.max("fp_total").alias("negatives"))
