"""Sensor-shaped views over the driver's generated tables.

The generated ``events`` table has no sensor columns, so the canonical
sensor table is derived from it by a fixed rule (the defect label is a
rule over two features, so a model has signal to learn). These views are
plain projections: Catalyst prunes the scan to the columns they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENSOR_FEATURES = ["temp", "humid", "press"]
SENSOR_LABEL = "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(col: str = "props"):
    return F.get_json_object(F.col(col), "$.k").cast("int")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, temp, humid, press (double), error (int 0/1); no nulls."""
    ev = table(spark, sf_dir, "events")
    k = _k()
    return ev.select(
        F.col("event_id"),
        F.col("value").alias("temp"),
        k.cast("double").alias("humid"),
        F.col("user_id").cast("double").alias("press"),
        F.when((F.col("value") > 60) & (k > 40), 1).otherwise(0).alias("error"),
    )


def sensor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sensor`` with missing temp / humid injected on a fixed id rule."""
    s = sensor(spark, sf_dir)
    return s.select(
        "event_id",
        F.when(F.col("event_id") % 37 == 0, F.lit(None).cast("double")).otherwise(F.col("temp")).alias("temp"),
        F.when(F.col("event_id") % 53 == 0, F.lit(None).cast("double")).otherwise(F.col("humid")).alias("humid"),
        "press", "error",
    )


def closed_form_score(temp, humid):
    """Deterministic defect score in [0, 1] used as a stand-in scorer."""
    return F.least(temp / F.lit(120.0), F.lit(1.0)) * F.lit(0.6) + humid / F.lit(99.0) * F.lit(0.4)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, score, prediction: a scored test set without a model."""
    s = sensor(spark, sf_dir)
    score = F.floor(closed_form_score(F.col("temp"), F.col("humid")) * F.lit(200.0)) / F.lit(200.0)
    return s.select(
        "event_id",
        F.col("error").alias("label"),
        score.alias("score"),
        F.when(score > 0.5, 1).otherwise(0).alias("prediction"),
    )
