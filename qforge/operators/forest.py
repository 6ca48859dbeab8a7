"""Random-forest defect classifier (M3, M5, M11, M12, M14) on Spark ML.

Training is Spark ML's distributed level-wise tree growth: each level is
one pass over the cached, scaled training rows with per-partition
sufficient statistics merged by a shuffle bounded by (#nodes x #bins).
Scaling is the fitted population-std scaler of ``split``; it is kept
with the model so scoring a new table (or a parameter grid) applies
exactly the training transform.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions.columns import col
from qforge.operators.forest_nodes import NodeForest, nodes_of
from qforge.operators.split import ScalerModel, fit_scaler, stratified_split

SPARK_MAX_DEPTH = 30
#: Rows times trees of a task in fitting: Spark keeps about 13 bytes for each (a bootstrap count and a node number).
ROW_TREES_PER_TASK = 10_000_000


@dataclass
class ForestModel:
    features: list[str]
    label: str
    scaler: ScalerModel
    pipeline: PipelineModel
    n_train_rows: int | None = None       # rows the trees were fitted on

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.select("*", *_scaled_columns(self.scaler, self.features))

    def score(self, df: DataFrame, prob_col: str = "y_score", pred_col: str = "y_pred") -> DataFrame:
        """Add P(class 1) and the argmax prediction; drop model columns."""
        out = self.pipeline.transform(self._scaled(df))
        keep = [c for c in df.columns]
        return out.select(
            *[col(c) for c in keep],
            # a model that never saw class 1 has one-element probabilities: P(1) = 0
            F.coalesce(F.try_element_at(vector_to_array(F.col("probability")), F.lit(2)),
                       F.lit(0.0)).alias(prob_col),
            F.col("prediction").cast("int").alias(pred_col))

    def importance(self, top_n: int | None = None) -> DataFrame:
        """Gini importance per feature, descending (optionally top N)."""
        rf = self.pipeline.stages[-1]
        imp = rf.featureImportances.toArray().tolist()
        spark = SparkSession.getActiveSession()
        df = spark.createDataFrame(list(zip(self.features, [float(v) for v in imp])),
                                   "feature string, importance double")
        df = df.orderBy(F.desc("importance"), "feature")
        return df.limit(top_n) if top_n else df

    def as_nodes(self, path: str | None = None) -> NodeForest:
        """The same forest as a table of nodes."""
        spark, rf = SparkSession.getActiveSession(), self.pipeline.stages[-1]
        return NodeForest(self.features, self.label, self.scaler, nodes_of(spark, rf, path), rf.getNumTrees, self.n_train_rows)

    def save(self, path: str) -> None:
        """Spark ML model plus the scaler and feature list."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        meta = {"features": self.features, "label": self.label,
                "scaler": {c: list(v) for c, v in self.scaler.stats.items()}, "n_train_rows": self.n_train_rows}
        spark.createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel | NodeForest":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        if meta.get("kind") == "nodes":
            return NodeForest.load(spark, path)
        scaler = ScalerModel({c: tuple(v) for c, v in meta["scaler"].items()})
        return ForestModel(meta["features"], meta["label"], scaler, PipelineModel.load(f"{path}/pipeline"),
                           meta.get("n_train_rows"))


def _scaled_columns(scaler: ScalerModel, features: list[str]) -> list[Column]:
    scaled = scaler.columns()
    return [scaled[f].alias(f"__s{i}") for i, f in enumerate(features)]


def fit_forest(train: DataFrame, features: list[str], label: str, n_trees: int = 200,
               max_depth: int | None = None, min_leaf: int = 1, seed: int = 42,
               max_bins: int = 128, subset: str | None = None, partitions: int | None = None,
               min_samples_split: int = 2) -> ForestModel | NodeForest:
    """M3: gini trees on bootstrap samples; features per split = int(sqrt(k)).

    ``max_depth=None`` means as deep as Spark allows (30). The scaler and every tree see all rows, whatever
    their number; the model records it. Rows are dealt evenly over the cores, or over as many tasks as
    ``ROW_TREES_PER_TASK`` asks for, since the splits of a file may leave them all in one. Bagging is seeded per
    partition: ``partitions`` fixes their number where the model must not depend on the cores. With ``min_samples_split`` above 2, splits of fewer drawn rows
    are pruned to leaves and the result is a ``NodeForest``, which has the same uses.
    """
    scaler = fit_scaler(train, features)
    n_rows = train.count()
    scaled_names = [f"__s{i}" for i in range(len(features))]       # whatever the columns are called
    k = subset or str(max(1, int(math.sqrt(len(features)))))
    rf = RandomForestClassifier(
        featuresCol="__features", labelCol="__label", numTrees=n_trees,
        maxDepth=min(max_depth or SPARK_MAX_DEPTH, SPARK_MAX_DEPTH), maxBins=max_bins,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=k, impurity="gini",
        bootstrap=True, seed=seed, cacheNodeIds=True, maxMemoryInMB=512)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=scaled_names, outputCol="__features",
                                            handleInvalid="error"), rf])
    data = train.select(*_scaled_columns(scaler, features), col(label).cast("double").alias("__label"))
    # a level reads a task's rows with their state in every tree; the number of splits says nothing of the rows in them
    slots = max(train.sparkSession.sparkContext.defaultParallelism, -(-n_rows * n_trees // ROW_TREES_PER_TASK))
    data = data.repartition(partitions or slots)
    data = data.persist()
    try:
        model = pipe.fit(data)
    finally:
        data.unpersist()
    fitted = ForestModel(list(features), label, scaler, model, n_rows)
    return fitted.as_nodes().pruned(min_samples_split) if min_samples_split > 2 else fitted


def grid_scorer(model: ForestModel, prob_col: str = "p_defect"):
    """A scorer for ``region.estimate_safe_region``."""
    def score(grid: DataFrame) -> DataFrame:
        return model.score(grid, prob_col=prob_col, pred_col="__pred").drop("__pred")
    return score


@dataclass
class TrainResult:
    model: ForestModel
    test_scored: DataFrame
    evaluation: DataFrame
    split_sizes: DataFrame


def train_and_evaluate(df: DataFrame, features: list[str], target: str, key: str,
                       test_size: float = 0.2, n_trees: int = 200, seed: int = 42,
                       max_depth: int | None = None, min_samples_split: int = 2, scored_path: str | None = None) -> TrainResult:
    """M5: exact stratified split -> scaler + forest on train -> hard-label evaluation on test.

    With ``scored_path`` the scored test rows are written there once and read back for the evaluation.
    """
    from qforge.operators.metrics import eval_hard
    train, test = stratified_split(df, target, key, test_size, seed)
    model = fit_forest(train, features, target, n_trees=n_trees, max_depth=max_depth, seed=seed,
                       min_samples_split=min_samples_split)
    scored = model.score(test)
    if scored_path:
        scored.write.mode("overwrite").parquet(scored_path)
        scored = df.sparkSession.read.parquet(scored_path)
    return TrainResult(model, scored, eval_hard(scored, target, "y_pred"), _sizes(train, test))


def _sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Split sizes (two counts) as a one-row table."""
    spark = train.sparkSession
    return spark.createDataFrame([(train.count(), test.count())], "train_size long, test_size long")
