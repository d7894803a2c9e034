"""Feature preparation, tree models, scoring and importance on Spark ML."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluation, trees
from tidemark.operators.cleaning import feature_columns, normalize_target
from tidemark.operators.ordered import positions, quantiles
from tidemark.operators.quality import draw_of
from tidemark.operators.scoring import with_scores
from tidemark.staging import literal_table, stage

SEED = 42
# Training rows of a partition, least and most: a boosted model is many short jobs, a forest keeps a number per row and tree.
PARTITION_ROWS = {"boosted": (20_000, 500_000), "forest": (1_000, 100_000)}


def stratified_split(df: DataFrame, label: str, id_column: str, test_share: float = 0.25, seed: int = SEED) -> DataFrame:
    """Add ``split`` ('train' or 'test'), each class split by the same share.

    Each row draws a number from the MD5 sum of seed and id, so the split does not
    depend on partitions and survives a re-run. Rows below the class's exact
    quantile of draws are the test rows. Without two classes of two rows or
    more, the split is over all rows.
    """
    draw = draw_of(seed, F.col(id_column))
    drawn = df.withColumn("_draw", draw)
    stratify = evaluation.class_balance(df, label).first()["stratify"]
    drawn = drawn.withColumn("_stratum", F.col(label).cast("int") if stratify else F.lit(0))
    cuts = quantiles(drawn, ["_stratum"], "_draw", [test_share], ["_cut"])
    marked = drawn.join(cuts, "_stratum")
    split = F.when(F.col("_draw") <= F.col("_cut"), "test").otherwise("train")
    return marked.withColumn("split", split).drop("_draw", "_stratum", "_cut")


@dataclass
class Preparation:
    """Values learned from the training rows for one feature table.

    Category values stay in a staged table; the driver holds a few numbers per column.
    """

    numeric: dict[str, tuple[float, float, float]]  # median, mean, deviation
    categorical: dict[str, tuple[str, int]]  # most frequent value, number of known values
    values: DataFrame  # feature, value, place: known category values, numbered per column

    @property
    def width(self) -> int:
        """Number of cells of a feature vector."""
        return len(self.numeric) + sum(size for _, size in self.categorical.values())

    def starts(self) -> dict[str, int]:
        """The first cell of each text column."""
        out, upto = {}, len(self.numeric)
        for c, (_, size) in self.categorical.items():
            out[c] = upto
            upto += size
        return out

    def names(self) -> DataFrame:
        """(number, feature): the name of each cell of a feature vector."""
        spark = self.values.sparkSession
        out = [literal_table(spark, list(enumerate(self.numeric)), ["number", "feature"])] if self.numeric else []
        for c, start in self.starts().items():
            own = self.values.where(F.col("feature") == c)
            out.append(own.select((F.col("place") + start).cast("int").alias("number"), F.concat_ws("_", "feature", "value").alias("feature")))
        return functools.reduce(DataFrame.unionByName, out)


def impute_and_scale(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Median for missing numbers, then zero mean and unit population deviation, in long form."""
    long = df.select(id_column, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [id_column], columns, "feature", "value"
    )
    facts = numeric_facts(long)
    joined = long.join(facts, "feature")
    filled = F.coalesce("value", "median")
    scaled = F.when(F.col("std") > 0, (filled - F.col("mean")) / F.col("std")).otherwise(filled - F.col("mean"))
    return joined.select(id_column, "feature", scaled.alias("value"))


def numeric_facts(long: DataFrame) -> DataFrame:
    """Exact median, and mean and population deviation after filling, per feature of a long table."""
    medians = quantiles(long, ["feature"], "value", [0.5], ["median"])
    filled = long.join(medians, "feature")
    value = F.coalesce("value", "median")
    return filled.groupBy("feature").agg(
        F.max("median").alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """The most frequent value per feature, the smaller one on a tie."""
    best = F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value")))
    return counts.groupBy("feature").agg(best["value"].alias("fill"))


def one_hot(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Indicator cells that are 1, in long form (feature 'column_value'); all others are 0.

    The sparse form keeps one row per cell whatever the number of values.
    """
    fills = most_frequent(category_counts(df, columns))
    long = df.select(id_column, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [id_column], columns, "feature", "value"
    )
    joined = long.join(fills, "feature")
    name = F.concat_ws("_", "feature", F.coalesce("value", "fill"))
    return joined.select(id_column, name.alias("feature"), F.lit(1).alias("value"))


def prepare(train: DataFrame, columns: list[str]) -> Preparation:
    """Learn fills, scales and known values from the training rows.

    What comes to the driver is one row per feature. Known category values are
    numbered in their order by range, and staged.
    """
    kinds = {f.name: f.dataType for f in train.schema.fields}
    numbers = [c for c in columns if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    texts = [c for c in columns if c not in numbers]
    numeric, categorical = {}, {}
    if numbers:
        long = train.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "feature", "value")
        found = {r["feature"]: r for r in numeric_facts(long).collect()}
        numeric = {c: (found[c]["median"], found[c]["mean"], found[c]["std"]) for c in numbers if c in found}
    values = train.sparkSession.createDataFrame([], "feature string, value string, place long")
    if texts:
        counts = stage(category_counts(train, texts), "categories")
        numbered = positions(counts.select("feature", "value"), ["feature"], [F.col("value")], pos="place", total="size")
        values = stage(numbered.select("feature", "value", "place", "size"), "category-places")
        facts = most_frequent(counts).join(values.groupBy("feature").agg(F.max("size").alias("size")), "feature")
        found = {r["feature"]: (r["fill"], r["size"]) for r in facts.collect()}
        categorical = {c: found[c] for c in texts if c in found}
    return Preparation(numeric, categorical, values.select("feature", "value", "place"))


def featurize(df: DataFrame, prep: Preparation, out: str = "features") -> DataFrame:
    """Add the feature vector; unknown category values give zeros only.

    Category values get their numbers by a join with the staged table, which Spark
    broadcasts or not by its size, and become sparse cells by an encoder. The
    encoder has one number more, for unknown values, and drops it.
    """
    scaled, inputs, scratch = [], [], []
    for i, (c, (median, mean, std)) in enumerate(prep.numeric.items()):
        filled = F.coalesce(F.col(c).cast("double"), F.lit(median))
        scaled.append(((filled - mean) / (std if std else 1.0)).alias(f"_n{i}"))
        inputs.append(f"_n{i}")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(f"_t{i}") for i, (c, (fill, _)) in enumerate(prep.categorical.items())]
    wide = df.select("*", *scaled, *texts)
    for i, (c, (_, size)) in enumerate(prep.categorical.items()):
        places = prep.values.where(F.col("feature") == c).select(F.col("value").alias(f"_t{i}"), F.col("place").alias(f"_p{i}"))
        wide = wide.join(places, f"_t{i}", "left")
        # The encoder reads the number of values from the column's attributes, not from the rows.
        nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
        index = F.coalesce(f"_p{i}", F.lit(size)).cast("double").alias(f"_i{i}", metadata=nominal)
        wide = wide.select("*", index)
        scratch += [f"_t{i}", f"_p{i}", f"_i{i}"]
    if prep.categorical:
        count = len(prep.categorical)
        encoder = OneHotEncoder(inputCols=[f"_i{i}" for i in range(count)], outputCols=[f"_h{i}" for i in range(count)])
        wide = encoder.fit(wide).transform(wide)
        inputs += encoder.getOutputCols()
    assembled = VectorAssembler(inputCols=inputs, outputCol=out).transform(wide).drop(*inputs, *scratch)
    # Without the column attributes every feature is a plain number to the trees.
    others = [c for c in df.columns if c != out]
    return assembled.select(*others, F.col(out).alias(out, metadata={}))


def classifier(choice: str, label: str, trees: int | None = None, weight: str | None = None):
    """Boosted trees ('boosted') or a random forest ('forest')."""
    if choice == "boosted":
        return GBTClassifier(
            labelCol=label, maxIter=trees or 260, maxDepth=4, stepSize=0.055, subsamplingRate=0.88,
            featureSubsetStrategy="0.88", seed=SEED, checkpointInterval=20,
        )
    forest = RandomForestClassifier(
        labelCol=label, numTrees=trees or 340, maxDepth=12, minInstancesPerNode=3, seed=SEED, maxMemoryInMB=512,
        cacheNodeIds=True, checkpointInterval=-1,  # rows keep their node of each tree: no level walks the trees from the root
    )
    return forest.setWeightCol(weight) if weight else forest


def spread(df: DataFrame, rows: int, least: int, most: int | None = None) -> DataFrame:
    """``df`` of so many rows in partitions for all cores, of ``least`` rows or more each and about ``most`` at most; a small table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, rows // least), -(-rows // most) if most else 0)
    return df.repartition(parts) if parts > 1 else df


@dataclass
class ChurnModel:
    """A fitted model with all the tables read from it."""

    model: object
    prep: Preparation
    target: str
    id_column: str
    data: DataFrame  # cleaned rows with ``split``
    staged: dict = field(default_factory=dict)  # tables read from the model, made once

    @property
    def boosted(self) -> bool:
        return trees.is_boosted(self.model)

    def featured(self, data: DataFrame | None = None) -> DataFrame:
        return featurize(self.data if data is None else data, self.prep)

    def nodes(self) -> DataFrame:
        """The model as a table of nodes."""
        if "nodes" not in self.staged:
            self.staged["nodes"] = trees.node_table(self.data.sparkSession, self.model)
        return self.staged["nodes"]

    def leaves(self) -> DataFrame:
        """The model as a table of leaf paths."""
        if "leaves" not in self.staged:
            self.staged["leaves"] = trees.leaf_table(self.nodes(), self.boosted)
        return self.staged["leaves"]

    def walked(self) -> DataFrame:
        """The rows on all cores: walking the trees takes much longer than reading the few bytes of a row."""
        return spread(self.data, self.data.count(), 200)

    def node_scores(self) -> DataFrame:
        """(id, probability, by_nodes): the model's probability, and the one walked through the node table."""
        raw = self.model.transform(self.featured(self.walked())).select(
            self.id_column, vector_to_array("features").alias("x"), vector_to_array(F.col("probability"))[1].alias("probability")
        )
        depth = max(tree.depth for tree in self.model.trees)
        return trees.probabilities(raw, self.nodes(), self.boosted, depth, "x", "by_nodes").select(self.id_column, "probability", "by_nodes")

    def scored(self) -> DataFrame:
        """All rows (training rows too, told apart by ``split``) with probability, label and band."""
        raw = self.model.transform(self.featured(self.walked()))
        p = vector_to_array(F.col("probability"))[1]
        kept = raw.withColumn("_p", p).drop("features", "rawPrediction", "probability", "prediction")
        return with_scores(kept, F.col("_p"), self.target).drop("_p")

    def test_scores(self) -> DataFrame:
        return self.scored().where("split = 'test'")

    def metrics(self) -> DataFrame:
        """Hold-out metrics with the size of both parts."""
        test = self.test_scores().select(self.target, "Churn_Probability", "Predicted_Churn")
        test = stage(test, "test-scores")  # the trees are walked once for all metrics
        base = evaluation.classification_metrics(test, self.target, "Predicted_Churn")
        auc = evaluation.roc_auc(test, self.target, "Churn_Probability").select("roc_auc").scalar()
        sizes = self.data.agg(
            F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows")
        )
        return base.select("*", auc.alias("roc_auc"), *[sizes.select(c).scalar().alias(c) for c in sizes.columns])

    def importance(self, top: int = 20) -> DataFrame:
        """Features by importance, from the gains of the node table; features without a split have 0."""
        found = self.prep.names().join(trees.gains(self.nodes(), self.boosted), "number", "left")
        out = found.select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        return out.orderBy(F.desc("importance"), "feature").limit(top)


def class_weights(train: DataFrame, target: str) -> DataFrame:
    """(class, weight): weights that give every class the same sum, one on average."""
    sizes = train.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    mean = sizes.agg((F.sum("n") / F.count(F.lit(1))).alias("mean")).scalar()
    return sizes.select(target, (mean / F.col("n")).alias("weight"))


@dataclass
class TrainingData:
    """Cleaned and split rows with the preparation learned from them, for any number of models."""

    data: DataFrame  # cleaned rows with ``split``
    prep: Preparation
    target: str
    id_column: str


def training_data(df: DataFrame, target: str, id_column: str | None = None, test_share: float = 0.25) -> TrainingData:
    """Number the target's classes, split, and learn the preparation on the training rows.

    A table without an id column gets a staged ``row_id``.
    """
    if id_column is None:
        id_column = "row_id"
        df = stage(df.withColumn(id_column, F.monotonically_increasing_id()), "rows")
    source = df.persist()  # numbering the classes and splitting read the rows many times
    df = normalize_target(df, target, id_column, "_target")
    df = df.select(*[F.col("_target").alias(c) if c == target else F.col(c) for c in df.columns if c != "_target"])
    features = [c for c in feature_columns(df, target) if c != id_column]
    # Staged: training, scoring and evaluation read the same rows, and the source only once.
    try:
        data = stage(stratified_split(df, target, id_column, test_share), "training")
    finally:
        source.unpersist()
    return TrainingData(data, prepare(data.where("split = 'train'"), features), target, id_column)


def fit_churn_model(rows: TrainingData, choice: str = "boosted", balance: bool = True, trees: int | None = None) -> ChurnModel:
    """A model of prepared rows. ``balance`` weighs the classes equally in the forest; boosted trees are unweighted."""
    target, id_column, train = rows.target, rows.id_column, rows.data.where("split = 'train'")
    ready = featurize(train, rows.prep).select(id_column, "features", F.col(target).cast("double").alias(target))
    weight = None
    if choice == "forest" and balance:
        weight = "_weight"
        per_class = stage(class_weights(train, target), "class-weights")
        ready = ready.join(per_class.select(F.col(target).cast("double").alias(target), F.col("weight").alias(weight)), target)
    # In the order of ids: the learners' samples follow the places of the rows, which must not depend on what arrives first.
    ready = spread(ready, train.count(), *PARTITION_ROWS[choice]).sortWithinPartitions(id_column).drop(id_column).persist()
    try:
        model = classifier(choice, target, trees, weight).fit(ready)
    finally:
        ready.unpersist()
    return ChurnModel(model, rows.prep, target, id_column, rows.data)


def train_churn_model(
    df: DataFrame, target: str, id_column: str | None = None, choice: str = "boosted", test_share: float = 0.25,
    balance: bool = True, trees: int | None = None,
) -> ChurnModel:
    """Number the target's classes, split, learn the preparation on the training rows, and fit."""
    return fit_churn_model(training_data(df, target, id_column, test_share), choice, balance, trees)
