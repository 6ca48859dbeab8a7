"""Classifier evaluation on a scored table.

Inputs are plain columns (label, prediction, score), so every metric
works on any scorer's output, model or not.

Curves: rows are first grouped by distinct score (map-side combined),
then cumulative true/false positive counts come from
``running_totals`` - range buckets plus a broadcast-free offset literal -
so no step funnels the table into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col
from qforge.functions.running import running_totals


# ---------------------------------------------------------------- M6
def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction",
                     weight: str | None = None) -> DataFrame:
    """One row: tn, fp, fn, tp (absent cells are 0).

    A label or prediction that is null or not 0 / 1 raises: such rows belong to no cell.
    ``weight`` names a column with the number of rows each row stands for.
    """
    y, p = col(label), col(pred)
    w = F.lit(1).cast("long") if weight is None else col(weight)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = df.agg(*[F.coalesce(F.sum(F.when((y == a) & (p == b), w)), F.lit(0)).alias(c) for c, (a, b) in cells.items()],
                    F.coalesce(F.sum(w), F.lit(0)).alias("n"))
    left = F.col("n") - F.col("tn") - F.col("fp") - F.col("fn") - F.col("tp")
    fail = F.raise_error(F.concat(left.cast("string"), F.lit(" rows have a label or prediction that is not 0 or 1")))
    return counts.select(*[F.when(left == 0, F.col(c)).otherwise(fail).alias(c) for c in cells])


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows true_0 / true_1 (truth) x columns pred_0 / pred_1 (prediction)."""
    cc = confusion_counts(df, label, pred)
    return cc.select(F.inline(F.array(
        F.struct(F.lit("true_0").alias("actual"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit("true_1").alias("actual"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")),
    )))


def confusion_named(df: DataFrame, label: str = "label", pred: str = "prediction", weight: str | None = None) -> DataFrame:
    """The published names of the four cells."""
    # The published names of the four cells.
    return confusion_counts(df, label, pred, weight).select(
        F.col("tn").alias("normal_to_normal"), F.col("fp").alias("normal_to_defect"),
        F.col("fn").alias("defect_to_normal"), F.col("tp").alias("defect_to_defect"))


# ---------------------------------------------------------------- M7
def _div0(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (the zero-division rule of the report)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def per_class_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """class, tp, support (true count), predicted (predicted count); any k classes.

    Grouped counts by (label, prediction) - at most k^2 rows - are split
    into per-class contributions and summed again. A null label or
    prediction raises.
    """
    fail = F.raise_error(F.lit("a label or prediction is null"))
    pairs = (df.groupBy(col(label).alias("y"), col(pred).alias("p"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select(F.coalesce("y", fail).alias("y"), F.coalesce("p", fail).alias("p"), "n"))
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    contrib = pairs.select(F.inline(F.array(
        F.struct(y.alias("class"), F.when(y == p, n).otherwise(0).alias("tp"),
                 n.alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(p.alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), n.alias("predicted")),
    )))
    return contrib.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                        F.sum("predicted").alias("predicted"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision / recall / f1 / support, accuracy, macro and weighted avg.

    Columns: class_label, precision, recall, f1_score, support (double).
    The accuracy row carries the accuracy in f1_score and the total in
    support. f1 = 2 tp / (support + predicted), 0 when undefined.
    """
    pc = per_class_counts(df, label, pred).select(
        F.col("class").cast("string").alias("class_label"),
        _div0(F.col("tp"), F.col("predicted")).alias("precision"),
        _div0(F.col("tp"), F.col("support")).alias("recall"),
        _div0(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1_score"),
        F.col("support").cast("double").alias("support"),
        F.col("tp"))
    tot = F.sum("support")
    summary = pc.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        _div0(F.sum(F.col("precision") * F.col("support")), tot).alias("wp"),
        _div0(F.sum(F.col("recall") * F.col("support")), tot).alias("wr"),
        _div0(F.sum(F.col("f1_score") * F.col("support")), tot).alias("wf"),
        _div0(F.sum("tp"), tot).alias("acc"), tot.alias("n"))
    rows = summary.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class_label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class_label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class_label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), F.col("n").alias("support")),
    )))
    return pc.drop("tp").unionByName(rows)


# ---------------------------------------------------------------- curves
def scored_counts(df: DataFrame, label: str = "label", pred: str = "prediction", score: str = "score") -> DataFrame:
    """label, prediction, score, n: the scored rows grouped (map-side combined) and written once to the shared
    checkpoint folder, so that a model scores each row a single time however many metrics follow."""
    return (df.groupBy(col(label).alias("label"), col(pred).alias("prediction"), as_double(score).alias("score"))
            .agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True))


def score_table(df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """Distinct scores descending with positives / negatives at each, plus running sums.

    The grouped table (one row per distinct score) is checkpointed once, so
    the input is scanned a single time however many passes follow. A label
    that is not 0 / 1 or a missing score (null or NaN) raises. ``weight`` names
    a column with the number of rows each row stands for.
    """
    y, sc = col(label), as_double(score)
    known = F.coalesce(F.when(y.isin(0, 1), sc), F.raise_error(F.lit("a label is not 0 or 1, or a score is missing")))
    w = F.lit(1).cast("long") if weight is None else col(weight)
    grouped = (df.groupBy(known.alias("score"))
                 .agg(*[F.sum(F.when(y == v, w).otherwise(F.lit(0).cast("long"))).alias(c) for c, v in (("tp", 1), ("fp", 0))]))
    return running_totals(grouped, "score", ["tp", "fp"], descending=True, with_next=True)


def _totals(table: DataFrame) -> tuple[int, int]:
    """Positives and negatives, from the (small) distinct-score table."""
    row = table.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n")).first()
    return int(row["p"] or 0), int(row["n"] or 0)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              drop_intermediate: bool = True, table: DataFrame | None = None) -> DataFrame:
    """threshold, fpr, tpr: starts at (0, 0) with threshold +inf, scores descending.

    With ``drop_intermediate`` a point is dropped when it is collinear with
    its neighbours (the counts at the next distinct score equal its own);
    the first and last points are always kept.
    """
    t = score_table(df, label, score) if table is None else table
    pos, neg = _totals(t)
    pts = t
    if drop_intermediate:
        # first point: running sums equal its own counts; last point: no next
        first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
        keep = (first | F.col("next_tp").isNull()
                | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp")))
        pts = t.where(keep)
    body = pts.select(F.col("score").alias("threshold"),
                      F.try_divide(F.col("cum_fp").cast("double"), F.lit(float(neg))).alias("fpr"),
                      F.try_divide(F.col("cum_tp").cast("double"), F.lit(float(pos))).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if neg == 0:
        start = start.withColumn("fpr", F.lit(None).cast("double"))
    if pos == 0:
        start = start.withColumn("tpr", F.lit(None).cast("double"))
    return start.unionByName(body)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             table: DataFrame | None = None) -> DataFrame:
    """threshold, precision, recall in ascending threshold order, ending at (1, 0)."""
    t = score_table(df, label, score) if table is None else table
    pos, _ = _totals(t)
    prec = _div0(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    rec = (F.col("cum_tp") / F.lit(float(pos))) if pos > 0 else F.lit(1.0)
    body = t.select(F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def auc_ap(df: DataFrame, label: str = "label", score: str = "score",
           table: DataFrame | None = None) -> DataFrame:
    """One row: roc_auc (exact, ties as half) and average precision (step sum).

    NULL when only one class is present.
    """
    t = score_table(df, label, score) if table is None else table
    return t.agg(
        F.try_divide(F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0))),
                     (F.sum("tp") * F.sum("fp")).cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("tp") * (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))),
                     F.sum("tp").cast("double")).alias("average_precision"),
    )


# ---------------------------------------------------------------- M4 / M8
def eval_hard(df: DataFrame, label: str = "label", pred: str = "prediction", digits: int = 4) -> DataFrame:
    """accuracy, precision, recall, f1 (class 1) and auc_hard = (TPR + TNR) / 2."""
    cc = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    tpr = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    tnr = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    return cc.select(
        F.round(_div0(tp + tn, n), digits).alias("accuracy"),
        F.round(_div0(tp, tp + fp), digits).alias("precision"),
        F.round(_div0(tp, tp + fn), digits).alias("recall"),
        F.round(_div0(tp * 2, tp * 2 + fp + fn), digits).alias("f1_score"),
        F.round(F.when(tpr.isNotNull() & tnr.isNotNull(), (tpr + tnr) / 2.0), digits).alias("auc_hard"),
    )


def metrics_table(df: DataFrame, label: str = "label", pred: str = "prediction",
                  score: str = "score", table: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Long (metric, value) table of the headline test metrics.

    With ``model`` a row ``model`` holds that name in a further column ``text`` (NULL in the others). Without ``table`` the scored rows are read once: ``scored_counts`` feeds the cells and the curve sums.
    """
    if table is None:
        df = scored_counts(df, label, pred, score)
        cc, table = confusion_counts(df, "label", "prediction", "n"), score_table(df, "label", "score", "n")
    else:
        cc = confusion_counts(df, label, pred)
    aa = auc_ap(df, label, score, table=table).first()
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    d = lambda e: e.cast("double")
    tpr = _div0(tp, tp + fn)
    tnr = _div0(tn, tn + fp)
    # The published metric names, and the 1e-12 that keeps specificity finite.
    items = [
        ("accuracy", _div0(tp + tn, tn + fp + fn + tp)),
        ("precision", _div0(tp, tp + fp)),
        ("recall", tpr),
        ("f1_score", _div0(tp * 2, tp * 2 + fp + fn)),
        ("roc_auc", F.lit(aa["roc_auc"]).cast("double")),
        ("avg_precision_AP", F.lit(aa["average_precision"]).cast("double")),
        ("balanced_accuracy", (tpr + tnr) / 2.0),
        ("specificity", d(tn) / (d(tn + fp) + F.lit(1e-12))),
        ("n_test_samples", d(tn + fp + fn + tp)),
        ("n_positive", d(tp + fn)),
        ("n_negative", d(tn + fp)),
    ]
    out = cc.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in items])))
    if model is None:
        return out
    name = out.sparkSession.range(1).select(F.lit("model").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(model).alias("text"))
    return name.unionByName(out.withColumn("text", F.lit(None).cast("string")))


def model_report(scored: DataFrame, importance: DataFrame | None, label: str = "label",
                 pred: str = "prediction", score: str | None = "score") -> DataFrame:
    """Feature importance + confusion cells + ROC points as one long table."""
    parts = []
    if score is not None:
        scored = scored_counts(scored, label, pred, score)
        label, pred, score = "label", "prediction", "score"
    weight = None if score is None else "n"
    if importance is not None:
        parts.append(importance.select(F.lit("feature_importance").alias("section"),
                                       F.col("feature").alias("key"), F.col("importance").alias("value")))
    cm = confusion_named(scored, label, pred, weight)
    parts.append(cm.select(F.inline(F.array(*[
        F.struct(F.lit("confusion").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
        for c in cm.columns]))))
    if score is not None:
        table = score_table(scored, label, score, weight)
        aa = auc_ap(scored, label, score, table=table)
        parts.append(aa.select(F.lit("roc").alias("section"), F.lit("roc_auc").alias("key"),
                               F.col("roc_auc").alias("value")))
        curve = roc_curve(scored, label, score, table=table)
        # a point's key is its threshold; the value of each section is one coordinate
        for axis in ("fpr", "tpr"):
            parts.append(curve.select(F.lit(f"roc_{axis}").alias("section"), F.col("threshold").cast("string").alias("key"),
                                      F.col(axis).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
