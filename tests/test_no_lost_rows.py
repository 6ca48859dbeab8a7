"""Metrics raise on rows they cannot place; the split works without a key and with equal rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qforge.operators import metrics as M, split as S


@pytest.mark.parametrize("rows", [[(0, 0, .1), (2, 1, .5)], [(0, 0, .1), (None, 1, .9)]])
@pytest.mark.parametrize("fn", [M.confusion_matrix, M.eval_hard, M.metrics_table, M.roc_curve, M.pr_curve])
def test_foreign_or_null_labels_raise(spark, rows, fn):
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    with pytest.raises(PySparkException):
        fn(df).collect()


def test_null_class_raises(spark):
    df = spark.createDataFrame([(0, 0), (1, None)], "label int, prediction int")
    with pytest.raises(Exception, match="is null"):
        M.classification_report(df).collect()


@pytest.mark.parametrize("key", [None, "v"])
def test_split_of_equal_rows(spark, monkeypatch, key):
    monkeypatch.setattr(S, "COPIES_PER_TASK", 20)
    df = spark.range(400).select(F.when(F.col("id") < 240, 7).otherwise(F.col("id")).alias("v"),
                                 (F.col("id") % 4 == 0).cast("int").alias("y"))
    train, test = S.stratified_split(df, "y", key, 0.2, 3)
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 60, 1: 20}
    both = train.unionByName(test)
    assert both.count() == 400 and both.exceptAll(df).count() == 0


def test_null_labels_raise(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, None)], "id int, y int")
    with pytest.raises(ValueError, match="no label"):
        S.stratified_split(df, "y")
