"""End-to-end pipelines (P1 merge, P2 full analysis) and result tables (K1-K4).

Stage boundaries are written tables in a version of the output's result set (``results``; the output folder defaults
to a unique folder below ``spark.checkpoint.dir``): every stage reads what earlier ones wrote, which cuts the
lineage (a lost executor recomputes from the last written table, not from the CSV files), lets each stage scan columnar
Parquet with pruning, and lets a rerun go on where a lost driver stopped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions.stats import ColumnStats, column_stats
from qforge.operators import clean as C
from qforge.operators import eda as E
from qforge.operators import forest as FO
from qforge.operators import metrics as M
from qforge.operators import quality as Q
from qforge.operators import region as R
from qforge.plans.results import ResultSet, Run
from qforge.session import path_exists, scratch_path
from qforge.sources import csv_ingest as CI
from qforge.sources import manifest as MF

ROW_ID = "_row_id"


@dataclass
class MergeResult:
    combined: DataFrame
    summary: DataFrame
    file_summary: DataFrame
    path: str | None


def _exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)


def merge_sensor_files(spark: SparkSession, data_dir: str, num_files: int | None = 2,
                       output_dir: str | None = None, multiline: bool = False) -> MergeResult:
    """Manifest -> latest N sensor files -> one typed table (+ K1 landing).

    ``num_files=None`` takes every sensor file. The landed table gets a
    persistent row id, so later seeded steps (the split) are repeatable.
    """
    if not _exists(spark, data_dir):
        raise FileNotFoundError(f"data folder not found: {data_dir}")
    sensors = MF.sensor_files(MF.file_manifest(spark, data_dir))
    ordered = sensors.orderBy(F.desc("modified"), F.asc("path"))
    all_paths = [r["path"] for r in ordered.select("path").collect()]  # one row per file
    if not all_paths:
        raise ValueError("no sensor CSV files in the data folder")
    chosen = all_paths if num_files is None else all_paths[:num_files]
    infos = CI.inspect_files(spark, all_paths)            # one detection pass serves S8 and S9
    if multiline:                                          # records may span lines: count them
        infos = CI.count_records(spark, infos)
    chosen_set = set(chosen)
    chosen_infos = [i for i in infos if i.path in chosen_set]
    path = None
    if output_dir:
        path = f"{output_dir}/combined"
        combined = CI.land_csv_files(spark, chosen, path, infos=chosen_infos, row_id=ROW_ID, multiline=multiline)
    else:
        combined = CI.read_csv_files(spark, chosen, infos=chosen_infos, multiline=multiline)
    n_rows = combined.count()
    n_cols = len([c for c in combined.columns if c != ROW_ID])
    summary = spark.createDataFrame(
        [(len(all_paths), len(chosen), n_rows, n_cols, sum(i.rows for i in infos), path)],
        "sensor_file_count long, processed_file_count long, combined_rows long, combined_cols long, "
        "all_files_rows long, output_path string")
    return MergeResult(combined, summary, CI.file_summary(spark, infos), path)


def write_result(df: DataFrame, output_dir: str, name: str, fmt: str = "parquet") -> str:
    """K3: a result table as a new version of itself; readers see the old one until the new one is complete."""
    return ResultSet(df.sparkSession, output_dir).write(df, name, fmt)


def read_result(spark: SparkSession, output_dir: str, name: str, fmt: str | None = None) -> DataFrame:
    """K4: a result table of the last complete version; a missing one is an error."""
    return ResultSet(spark, output_dir).read(name, fmt)


def run_full_pipeline(spark: SparkSession, data_dir: str, output_dir: str | None = None,
                      features: list[str] | None = None, target: str = "error",
                      num_files: int | None = 2, prob_threshold: float = 0.05,
                      n_trees: int = 200, max_depth: int | None = None, seed: int = 42,
                      test_size: float = 0.2, grid_sizes: dict | None = None,
                      missing_method: str = "drop", outlier_threshold: float = 3.0,
                      multiline: bool = False, min_samples_split: int = 2, resume: bool = True) -> DataFrame:
    """Merge -> clean -> quality -> EDA -> train -> evaluate -> safe region.

    Returns one summary row. Every stage writes its tables to a version of the result set at ``output_dir`` and leaves a mark;
    all tables become visible together at the end. A rerun with the same files (path, size, time) and
    parameters goes on after the last finished stage unless ``resume`` is off. Errors are raised, not returned.
    """
    features = features or ["temp", "humid", "press"]
    grid_sizes = grid_sizes or {f: R.DEFAULT_SIZES.get(f, 10) for f in features}
    out = output_dir or scratch_path(spark, "pipeline")
    if not _exists(spark, data_dir):
        raise FileNotFoundError(f"data folder not found: {data_dir}")
    inputs = sorted((r["path"], r["length"], str(r["modified"])) for r in MF.file_manifest(spark, data_dir).collect())     # a row a file
    run = Run(ResultSet(spark, out), [inputs, features, target, num_files, prob_threshold, n_trees, max_depth, seed, test_size, grid_sizes,
                                      missing_method, outlier_threshold, multiline, min_samples_split], fresh=not resume)

    def merge() -> None:
        merged = merge_sensor_files(spark, data_dir, num_files, run.folder, multiline)
        run.note("combined")
        run.write(merged.summary, "merge_summary")
        run.write(merged.file_summary, "file_summary")

    def clean() -> None:
        # missing values are judged on the data columns, not the row id (observed metrics on the write would save the
        # counter scan, but an Observation leaves the session unable to serialise Spark ML's scoring closures)
        combined = run.read("combined")
        data_cols = [c for c in combined.columns if c != ROW_ID]
        cleaning = C.clean(combined, features, missing_method, outlier_threshold, subset=data_cols)
        run.write(cleaning.cleaned, "cleaned")
        run.write(cleaning.summary, "clean_summary")

    def quality() -> None:
        # one statistics pass serves quality, EDA and the region bounds
        cleaned = run.read("cleaned")
        st = column_stats(cleaned, features, (0.05, 0.25, 0.5, 0.75, 0.95))
        run.write(spark.createDataFrame([(st.to_json(),)], "stats string"), "column_stats")
        run.write(Q.quality_summary(run.write(Q.quality_indices(cleaned, features, stats=st), "quality_indices")), "quality_summary")

    def stats() -> ColumnStats:
        return ColumnStats.from_json(run.read("column_stats").first()["stats"])

    def eda() -> None:
        cleaned, st = run.read("cleaned"), stats()
        written = {name: run.write(table, f"eda/{name}") for name, table in E.eda_tables(cleaned, features, target, stats=st).items()}
        run.write(E.eda_long(written, target), "eda_report")             # reshaped, no rescan
        run.write(E.data_summary(cleaned.drop(ROW_ID), features, stats=st), "data_summary")

    def train() -> None:
        data = C.select_features(run.read("cleaned"), [ROW_ID, *features], target)
        made = FO.train_and_evaluate(data, features, target, ROW_ID, test_size, n_trees, seed, max_depth, min_samples_split,
                                     scored_path=run.path("test_scored"))
        made.model.save(run.path("model"))
        run.note("test_scored")
        run.write(made.test_scored.select(F.col(target).alias("y_true"), "y_pred", "y_score"), "test_predictions")
        run.write(made.evaluation, "eval_hard")
        run.write(made.split_sizes, "split_sizes")
        run.write(made.model.importance(), "feature_importance")

    def evaluate() -> None:
        preds = run.read("test_predictions")
        # distinct scores with running totals: grouped once, shared by every curve metric
        table = run.write(M.score_table(preds, "y_true", "y_score"), "score_table")
        run.write(M.metrics_table(preds, "y_true", "y_pred", "y_score", table=table, model="RandomForest"), "metrics")
        run.write(M.classification_report(preds, "y_true", "y_pred"), "classification_report")
        run.write(M.confusion_matrix(preds, "y_true", "y_pred"), "confusion_matrix")
        run.write(M.confusion_named(preds, "y_true", "y_pred"), "confusion_named")
        run.write(M.roc_curve(preds, "y_true", "y_score", table=table), "roc_curve")
        run.write(M.pr_curve(preds, "y_true", "y_score", table=table), "pr_curve")

    def region() -> None:
        model = FO.ForestModel.load(spark, run.path("model"))
        bounds = R.feature_bounds(run.read("cleaned"), features, "quantile", stats=stats())
        found = run.write(R.estimate_safe_region(spark, FO.grid_scorer(model), bounds, grid_sizes, prob_threshold), "safe_region")
        run.write(R.safe_region_json(found, features), "safe_region_json", fmt="json")

    for work in (merge, clean, quality, eda, train, evaluate, region):
        run.stage(work.__name__, work)
    run.commit()

    first = lambda name: run.read(name).first()
    cs, h, reg, sizes = first("clean_summary"), first("eval_hard"), first("safe_region"), first("split_sizes")
    dqi = first("quality_summary")["overall_dqi"]
    metrics = {r["metric"]: r["value"] for r in run.read("metrics").collect()}  # bounded: 12 rows
    row = ("success", cs["original_rows"], cs["final_rows"], cs["total_removed_rows"], dqi, sizes["train_size"], sizes["test_size"],
           h["accuracy"], h["precision"], h["recall"], h["f1_score"], h["auc_hard"],
           metrics.get("roc_auc"), reg["status"], reg["n_safe_points"], reg["n_total_points"],
           reg["safe_ratio"], out, len(run.skipped))
    return spark.createDataFrame([row], (
        "status string, original_rows long, cleaned_rows long, removed_rows long, overall_dqi double, train_rows long, test_rows long, "
        "accuracy double, precision double, recall double, f1_score double, auc_hard double, roc_auc double, "
        "safe_region_status string, n_safe_points long, n_total_points long, safe_ratio double, output_dir string, stages_skipped int"))
