"""Full pipeline (P2) over CSV files derived from the small tables; model persistence."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from qforge.operators import forest as FO
from qforge.operators import split as S
from qforge.plans import pipeline as P
from qforge.sources import fixture_files as FF
from qforge.sources import testdata as td


def test_full_pipeline(spark, tmp_path):
    data = FF.write_sensor_csvs(spark, SF_SMALL, str(tmp_path / "csv"))
    out = str(tmp_path / "out")
    row = P.run_full_pipeline(spark, data, out, num_files=None, n_trees=10, max_depth=8).first()
    assert row.status == "success"
    assert row.original_rows == 1000
    assert 0 < row.cleaned_rows <= row.original_rows
    assert row.original_rows - row.cleaned_rows == row.removed_rows
    assert row.n_total_points == 4000
    for name in ["combined", "cleaned", "clean_summary", "quality_indices", "eda_report", "test_predictions",
                 "metrics", "roc_curve", "pr_curve", "feature_importance", "safe_region", "confusion_named",
                 "classification_report", "confusion_matrix", "score_table"]:
        assert P.read_result(spark, out, name).count() >= 1, name
    for name in ["describe", "histogram", "correlation", "boxplot", "label_distribution", "label_summary"]:
        assert P.read_result(spark, out, f"eda/{name}").count() >= 1, name
    js = P.read_result(spark, out, "safe_region_json", fmt="json").first()["result"]
    assert '"n_total_points":4000' in js
    fi = P.read_result(spark, out, "feature_importance").agg(F.sum("importance")).first()[0]
    assert abs(fi - 1.0) < 1e-9
    # cleaned rows are a subset of the combined rows
    comb = P.read_result(spark, out, "combined")
    cl = P.read_result(spark, out, "cleaned")
    assert cl.join(comb, "_row_id", "left_anti").count() == 0


def test_model_roundtrip(spark, tmp_path):
    train, test = S.stratified_split(td.sensor(spark, SF_SMALL), "error", "event_id")
    m = FO.fit_forest(train, ["temp", "humid", "press"], "error", n_trees=5, max_depth=5)
    m.save(str(tmp_path / "m"))
    m2 = FO.ForestModel.load(spark, str(tmp_path / "m"))
    a = {r.event_id: r.y_score for r in m.score(test).collect()}
    b = {r.event_id: r.y_score for r in m2.score(test).collect()}
    assert a == b
    assert all(0.0 <= v <= 1.0 for v in a.values())


def test_train_and_evaluate_and_region(spark):
    import json
    from qforge.operators import region as R
    df = td.sensor(spark, SF_SMALL)
    res = FO.train_and_evaluate(df, ["temp", "humid", "press"], "error", "event_id", n_trees=5, max_depth=6)
    sizes = res.split_sizes.first()
    assert (sizes.train_size, sizes.test_size) == (800, 200)
    ev = res.evaluation.first()
    assert 0.5 <= ev.accuracy <= 1.0
    scorer = FO.grid_scorer(res.model)
    reg = R.analyze_safe_region(df, scorer, ["temp", "humid", "press"], {"temp": 4, "humid": 3, "press": 2},
                                threshold=1.01, bounds="minmax").first()
    assert reg.status == "success" and reg.n_safe_points == reg.n_total_points == 24
    mm = df.agg(F.min("temp"), F.max("temp")).first()
    assert (reg.temp_min, reg.temp_max) == (mm[0], mm[1])
    b3 = {"temp": (0.0, 1.0), "humid": (0.0, 1.0), "press": (0.0, 1.0)}
    none = R.estimate_safe_region(spark, scorer, b3, {"temp": 3, "humid": 2, "press": 2}, threshold=0.0)
    js = json.loads(R.safe_region_json(none, list(b3)).first().result)
    assert js["status"] == "no_safe_region"


def test_single_class_training(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("temp"), (F.col("id") * 2.0).alias("humid"),
                                F.lit(1.0).alias("press"), F.lit(0).alias("error"))
    m = FO.fit_forest(df, ["temp", "humid", "press"], "error", n_trees=3, max_depth=3)
    out = m.score(df).agg(F.max("y_score"), F.max("y_pred")).first()
    assert tuple(out) == (0.0, 0)
