"""Golden classification report and metric edge cases."""

import pytest
from pyspark.sql import functions as F

from qforge.operators import metrics as M

GOLDEN = {
    "0": (0.9941245593419507, 1.0, 0.9970536240424278, 1692.0),
    "1": (1.0, 0.9757281553398058, 0.9877149877149877, 412.0),
    "macro avg": (0.9970622796709754, 0.9878640776699029, 0.9923843058787077, 2104.0),
    "weighted avg": (0.9952750733871579, 0.9952471482889734, 0.9952249557121496, 2104.0),
}


def golden_frame(spark):
    # tn=1692, fp=0, fn=10, tp=402, generated by Spark from counts
    cells = spark.createDataFrame([(0, 0, 1692), (1, 0, 10), (1, 1, 402)], "label int, prediction int, n int")
    return cells.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")).alias("k"))


def test_golden_report(spark):
    rep = {r["class_label"]: r for r in M.classification_report(golden_frame(spark)).collect()}
    for k, (p, r, f, s) in GOLDEN.items():
        assert rep[k]["precision"] == pytest.approx(p, abs=1e-15)
        assert rep[k]["recall"] == pytest.approx(r, abs=1e-15)
        assert rep[k]["f1_score"] == pytest.approx(f, abs=1e-15)
        assert rep[k]["support"] == s
    assert rep["accuracy"]["f1_score"] == pytest.approx(0.9952471482889734, abs=1e-15)


def test_confusion_named(spark):
    row = M.confusion_named(golden_frame(spark)).first()
    assert (row.normal_to_normal, row.normal_to_defect, row.defect_to_normal, row.defect_to_defect) == (1692, 0, 10, 402)


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2), (1, 1, 0.7)], "label int, prediction int, score double")
    row = M.auc_ap(df).first()
    assert row.roc_auc is None
    cm = {r.actual: (r.pred_0, r.pred_1) for r in M.confusion_matrix(df).collect()}
    assert cm == {"true_0": (0, 0), "true_1": (1, 2)}


def test_auc_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), 0, round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert M.auc_ap(df).first().roc_auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_curves_monotone_and_bucketed(spark):
    import random
    from qforge.functions import running
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), 0, rnd.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    whole = M.roc_curve(df).collect()
    # force the multi-bucket path of the running totals
    orig = running.running_totals
    try:
        M.running_totals = lambda *a, **k: orig(*a, **dict(k, buckets=17))
        split = M.roc_curve(df).collect()
        ap_split = M.auc_ap(df).first()
    finally:
        M.running_totals = orig
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split))
    assert ap_split.roc_auc == pytest.approx(M.auc_ap(df).first().roc_auc, abs=1e-12)
    pts = sorted((r.fpr, r.tpr) for r in whole)
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    assert all(b[1] >= a[1] for a, b in zip(pts, pts[1:]))


def test_report_three_classes(spark):
    import random
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), rnd.choice("abcd")) for _ in range(500)]
    df = spark.createDataFrame(rows, "label string, prediction string")
    rep = {r.class_label: r for r in M.classification_report(df).collect()}
    classes = sorted({x for pair in rows for x in pair})
    f1s, sup = [], []
    for c in classes:
        tp = sum(1 for y, p in rows if y == c and p == c)
        pred = sum(1 for _, p in rows if p == c)
        true = sum(1 for y, _ in rows if y == c)
        prec = tp / pred if pred else 0.0
        rec = tp / true if true else 0.0
        f1 = 2 * tp / (true + pred) if (true + pred) else 0.0
        assert rep[c].precision == pytest.approx(prec) and rep[c].recall == pytest.approx(rec)
        assert rep[c].f1_score == pytest.approx(f1) and rep[c].support == true
        f1s.append(f1)
        sup.append(true)
    assert rep["macro avg"].f1_score == pytest.approx(sum(f1s) / len(f1s))
    assert rep["weighted avg"].f1_score == pytest.approx(sum(f * s for f, s in zip(f1s, sup)) / sum(sup))
    assert rep["accuracy"].f1_score == pytest.approx(sum(1 for y, p in rows if y == p) / len(rows))
