"""A random forest as a table of nodes (M3 ``min_samples_split``, M11, M12, M14).

One row a node: (tree, node, depth, feature, threshold, left, right, n, counts, gain). The table is read from the stored
form of the fitted model and is a model of its own: it can be pruned, scores rows, gives the importances and is saved as Parquet.

* Pruning: a split of fewer than ``min_samples_split`` drawn rows becomes a leaf. Rows of a node never outnumber its parent's, so a node
  stays if it is a root or its parent remains a split: one join of nodes with their parents.
* Scoring: up to ``MAX_NODES`` nodes (30 bytes each) travel to every executor as arrays and rows are routed in place. A larger
  forest stays a table: rows meet the nodes of one depth after the other in joins, whose hot first levels are few nodes and broadcast.
* Importance: gain times weighted rows by tree and feature, each tree and then the whole brought to sum 1.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qforge.functions.columns import col
from qforge.operators.split import ScalerModel
from qforge.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not hold this package

MAX_NODES, MAX_LEVEL = 2_000_000, 100_000

NODES = ("tree int, node int, depth int, feature int, threshold double, left int, right int, n long, "
         "counts array<double>, gain double")


def _with_depth(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth of the nodes of one tree (children have larger numbers than their parents)."""
    pdf = pdf.sort_values("node", ignore_index=True)
    depth = np.zeros(len(pdf), np.int32)
    for i, (left, right) in enumerate(zip(pdf["left"].tolist(), pdf["right"].tolist())):
        if left >= 0:
            depth[left] = depth[right] = depth[i] + 1
    return pdf.assign(depth=depth)


def nodes_of(spark: SparkSession, forest, path: str | None = None) -> DataFrame:
    """Node table of a fitted Spark ML forest, written to ``path`` (default: the shared scratch folder)."""
    out = path or scratch_path(spark, "forest-nodes")
    forest.write().overwrite().save(f"{out}-model")
    d = F.col("nodeData")
    flat = spark.read.parquet(f"{out}-model/data").select(
        F.col("treeID").alias("tree"), d["id"].alias("node"), F.lit(0).alias("depth"), d["split"]["featureIndex"].alias("feature"),
        F.try_element_at(d["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"), d["leftChild"].alias("left"),
        d["rightChild"].alias("right"), d["rawCount"].alias("n"), d["impurityStats"].alias("counts"), d["gain"].alias("gain"))
    flat.groupBy("tree").applyInPandas(_with_depth, NODES).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def prune(nodes: DataFrame, min_samples_split: int) -> DataFrame:
    """Splits of fewer rows than the bound become leaves, and what was below them goes."""
    splits = nodes.where((F.col("left") >= 0) & (F.col("n") >= min_samples_split))
    kept = splits.select("tree", F.explode(F.array("left", "right")).alias("node"))
    stay = nodes.where("node = 0").unionByName(nodes.join(kept, ["tree", "node"], "left_semi"))
    leaf = F.col("n") < min_samples_split
    return stay.withColumns({"left": F.when(leaf, -1).otherwise(F.col("left")), "right": F.when(leaf, -1).otherwise(F.col("right")),
                             "feature": F.when(leaf, -1).otherwise(F.col("feature")), "gain": F.when(leaf, -1.0).otherwise(F.col("gain")),
                             "threshold": F.when(leaf, None).otherwise(F.col("threshold"))})


@dataclass
class _Arrays:
    """Nodes of all trees one after the other; children are positions, a leaf's are -1."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees of the class shares of the leaves that rows reach."""
        total = np.zeros((len(x), self.share.shape[1]))
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at, live = np.full(len(x), root), rows
            while len(live):
                here = at[live]
                live, here = live[self.left[here] >= 0], here[self.left[here] >= 0]
                goes = x[live, self.feature[here]] <= self.threshold[here]
                at[live] = np.where(goes, self.left[here], self.right[here])
            total += self.share[at]
        return total


@dataclass
class NodeForest:
    """Same uses as ``forest.ForestModel``: score, importance, save."""
    features: list[str]
    label: str
    scaler: ScalerModel
    nodes: DataFrame
    n_trees: int
    n_train_rows: int | None = None
    min_samples_split: int = 2

    def pruned(self, min_samples_split: int, path: str | None = None) -> "NodeForest":
        """The forest without splits of fewer rows, its table written anew."""
        spark = self.nodes.sparkSession
        out = path or scratch_path(spark, "forest-pruned")
        prune(self.nodes, min_samples_split).write.mode("overwrite").parquet(out)
        return replace(self, nodes=spark.read.parquet(out), min_samples_split=min_samples_split)

    def _arrays(self) -> _Arrays:
        rows = self.nodes.orderBy("tree", "node").select("tree", "node", "feature", "threshold", "left", "right", "counts").toPandas()
        tree, node = rows["tree"].to_numpy(), rows["node"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        place = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), node.tolist()))}
        to = lambda c: np.array([place[(t, n)] if n >= 0 else -1 for t, n in zip(tree.tolist(), rows[c].tolist())], np.int32)
        counts = np.array(rows["counts"].tolist())
        return _Arrays(begin, rows["feature"].to_numpy(np.int32), rows["threshold"].to_numpy(np.float64), to("left"), to("right"),
                       counts / counts.sum(axis=1, keepdims=True))

    def score(self, df: DataFrame, prob_col: str = "y_score", pred_col: str = "y_pred") -> DataFrame:
        """Add P(class 1) and the argmax prediction. A missing feature raises."""
        scaled = df.select("*", *[e.alias(f"__s{i}") for i, e in enumerate(self.scaler.columns()[c] for c in self.features)])
        if self.nodes.count() > MAX_NODES:
            return self._score_by_joins(df, scaled, prob_col, pred_col)
        arrays, k, width = df.sparkSession.sparkContext.broadcast(self._arrays()), self.n_trees, len(self.features)
        schema = T.StructType([*df.schema.fields, T.StructField(prob_col, T.DoubleType()), T.StructField(pred_col, T.IntegerType())])

        def run(batches):
            for b in batches:
                own, x = b.columns[:-width], np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns[-width:]], axis=1)
                if np.isnan(x).any():
                    raise ValueError("a feature to score is missing")
                v = arrays.value.votes(x) / k
                p = v[:, 1] if v.shape[1] > 1 else np.zeros(len(v))
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(v.argmax(axis=1).astype(np.int32))], names=schema.fieldNames())
        return scaled.toDF(*[f"c{i}" for i in range(len(scaled.columns))]).mapInArrow(run, schema)     # names with dots do not pass

    def _score_by_joins(self, df: DataFrame, scaled: DataFrame, prob_col: str, pred_col: str) -> DataFrame:
        width = len(self.features)
        numbered = scaled.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
        bad = F.exists("x", lambda v: v.isNull())
        x = F.array(*[F.col(f"__s{i}") for i in range(width)])
        at = numbered.select("__row", x.alias("x")).where(F.when(bad, F.raise_error(F.lit("a feature to score is missing")).cast("boolean")).otherwise(True))
        at = at.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1)))).withColumn("node", F.lit(0))
        sizes = {r["depth"]: r["count"] for r in self.nodes.groupBy("depth").count().collect()}      # a row a level
        leaves = None
        for depth in range(max(sizes) + 1):
            level = self.nodes.where(F.col("depth") == depth).select("tree", "node", "feature", "threshold", "left", "right", "counts")
            met = at.join(F.broadcast(level) if sizes[depth] <= MAX_LEVEL else level, ["tree", "node"])
            total = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b)
            done = met.where("left < 0").select("__row", F.transform("counts", lambda c: c / total).alias("share"))
            leaves = done if leaves is None else leaves.unionByName(done)
            goes = F.element_at("x", F.col("feature") + 1) <= F.col("threshold")
            at = met.where("left >= 0").select("__row", "x", "tree", F.when(goes, F.col("left")).otherwise(F.col("right")).alias("node"))
            if depth % 4 == 3:                            # short lineage, and no level is computed again for each one below
                at, leaves = at.checkpoint(), leaves.checkpoint()
        classes = self.nodes.select(F.max(F.size("counts")).alias("k")).first()["k"]
        votes = leaves.groupBy("__row").agg(*[F.sum(F.element_at("share", i + 1)).alias(f"__v{i}") for i in range(classes)])
        best = F.array_position(F.array(*[F.col(f"__v{i}") for i in range(classes)]), F.greatest(*[F.col(f"__v{i}") for i in range(classes)])
                                if classes > 1 else F.col("__v0")) - 1
        p = F.col("__v1") / self.n_trees if classes > 1 else F.lit(0.0)
        return numbered.join(votes, "__row").select(*[col(c) for c in df.columns], p.alias(prob_col), best.cast("int").alias(pred_col))

    def importance(self, top_n: int | None = None) -> DataFrame:
        """Gini importance per feature, descending (optionally top N); 0 for features that split nothing."""
        weight = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b) * F.col("gain")
        by = self.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(weight).alias("w"))
        whole = by.groupBy("tree").agg(F.sum("w").alias("all"))
        share = by.join(whole, "tree").where("all > 0").groupBy("feature").agg(F.sum(F.col("w") / F.col("all")).alias("w"))
        names = self.nodes.sparkSession.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        total = share.agg(F.sum("w").alias("all")).first()["all"] or 0.0
        out = names.join(F.broadcast(share), "feature", "left").select(                           # a row a feature
            F.col("name").alias("feature"), (F.coalesce("w", F.lit(0.0)) / F.lit(total if total else 1.0)).alias("importance"))
        out = out.orderBy(F.desc("importance"), "feature")
        return out.limit(top_n) if top_n else out

    def save(self, path: str) -> None:
        """Node table, scaler and feature list."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"kind": "nodes", "features": self.features, "label": self.label, "scaler": {c: list(v) for c, v in self.scaler.stats.items()},
                "n_trees": self.n_trees, "n_train_rows": self.n_train_rows, "min_samples_split": self.min_samples_split}
        spark = self.nodes.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NodeForest":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return NodeForest(meta["features"], meta["label"], ScalerModel({c: tuple(v) for c, v in meta["scaler"].items()}),
                          spark.read.parquet(f"{path}/nodes"), meta["n_trees"], meta["n_train_rows"], meta["min_samples_split"])
