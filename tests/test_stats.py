"""Distributed order statistics, running totals, split, cleaning edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from qforge.functions.order_stats import exact_quantiles, order_statistics
from qforge.functions.running import running_totals
from qforge.operators import clean as C
from qforge.operators import eda as E
from qforge.operators import quality as Q
from qforge.operators import split as S


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False),
                          st.none()), min_size=0, max_size=300))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0], small=8, bins=16)["x"]
    clean = [v for v in values if v is not None]
    if not clean:
        assert got == [None] * 7
        return
    want = np.quantile(np.array(clean), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0], method="linear")
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


def test_order_statistics_skewed(spark):
    # a third of all rows share one value: resolved without enumerating them
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") / 7.0).alias("x"))
    xs = sorted(r.x for r in df.collect())
    res = order_statistics(df, {"x": F.col("x")}, {"x": [0, 999, 1000, 1500, 2999]}, bins=8, small=4)
    for k in [0, 999, 1000, 1500, 2999]:
        assert res["x"][k].value == xs[k]
        assert res["x"][k].n_less == sum(1 for v in xs if v < xs[k])


def test_running_totals_buckets(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(500).astype(float)
    vals = rng.integers(0, 5, 500)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, vals)], "k double, v long")
    out = running_totals(df, "k", ["v"], descending=True, with_next=True, buckets=13)
    got = {r.k: (r.cum_v, r.next_v) for r in out.collect()}
    order = np.argsort(-keys)
    cum = np.cumsum(vals[order])
    for i, idx in enumerate(order):
        nxt = int(vals[order[i + 1]]) if i + 1 < len(order) else None
        assert got[keys[idx]] == (int(cum[i]), nxt)


def test_split_quotas(spark):
    assert S.class_quotas({0: 8203, 1: 1797}, 2000) == {0: 1641, 1: 359}
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    train, test = S.stratified_split(df, "y", "id", 0.25, 7)
    assert test.count() == 250 and train.count() == 750
    assert dict(test.groupBy("y").count().collect()) == {0: 225, 1: 25}
    assert test.join(train, "id").count() == 0
    with pytest.raises(ValueError):
        S.stratified_split(spark.range(10).select("id", F.when(F.col("id") == 0, 1).otherwise(0).alias("y")),
                           "y", "id")


def test_constant_column_removes_all_rows(spark):
    df = spark.range(20).select(F.lit(3.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert C.zscore_filter(df, ["a", "b"]).count() == 0
    assert C.zscore_filter(df, ["b"]).count() == 20


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a double, b double")
    qi = {r.column: r for r in Q.quality_indices(empty, ["a", "b"]).collect()}
    assert qi["a"].CQI == 0.0 and qi["a"].valid_range == "[nan, nan]"
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    qi = {r.column: r for r in Q.quality_indices(nulls, ["a", "b"]).collect()}
    assert qi["a"].CQI == 0.0 and qi["a"].VQI == 0.0
    assert qi["b"].CQI == 100.0
    assert E.boxplot_stats(nulls, ["a"]).count() == 0
    assert C.fill_missing_mean(nulls).where("a is null").count() == 2


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(10, 2000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r["count"] for r in E.histogram(df, ["x"], 30).orderBy("bin").collect()]
    want, _ = np.histogram(x, bins=30)
    assert got == want.tolist()
    const = spark.createDataFrame([(2.0,)] * 5, "x double")
    h = E.histogram(const, ["x"], 30).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 5 and h[0].bin_lo == 1.5 and h[-1].bin_hi == 2.5


def test_label_summary_counts_null(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (1,)], "error int")
    s = E.label_summary(df).first()
    assert (s.total, s.normal_count, s.error_count, s.error_rate) == (4, 1, 2, 50.0)
    assert [tuple(r) for r in E.label_distribution(df).collect()] == [(0, 1), (1, 2)]


def test_name_collision_raises():
    from qforge.functions.names import normalize_name, normalize_names
    assert normalize_name(" Temp (C) ") == "temp__c_"
    assert normalize_names(["온도", "습도"]) == ["temp", "humid"]
    with pytest.raises(ValueError):
        normalize_names(["온도", "temp"])


def test_quality_approx_distinct(spark):
    df = spark.range(5000).select((F.col("id") % 1000).cast("double").alias("x"))
    exact = Q.quality_indices(df, ["x"]).first().UQI
    approx = Q.quality_indices(df, ["x"], distinct="approx").first().UQI
    assert exact == 20.0 and abs(approx - exact) / exact < 0.05


def test_one_row_table(spark):
    df = spark.createDataFrame([(1.5, 2.0, 0)], "a double, b double, error int")
    assert C.zscore_filter(df, ["a", "b"]).count() == 0          # std 0 -> z undefined
    d = E.describe_numeric(df, ["a"]).first()
    assert (d["count"], d.mean, d.std, d.p25, d.p75) == (1, 1.5, None, 1.5, 1.5)
    q = Q.quality_indices(df, ["a"]).first()
    assert (q.CQI, q.UQI, q.VQI, q.valid_range) == (100.0, 100.0, 100.0, "[1.50, 1.50]")


def test_histogram_counts_cover_non_null(spark):
    df = spark.range(997).select(F.when(F.col("id") % 11 == 0, None).otherwise(F.sqrt("id")).alias("x"))
    h = E.histogram(df, ["x"], 30)
    assert h.agg(F.sum("count")).first()[0] == df.where("x is not null").count()
    assert h.count() == 30


def test_quantiles_with_infinities(spark):
    vals = [float("-inf"), -3.0, 0.5, 2.0, 7.0, 11.0, float("inf"), float("inf")] * 700
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.3, 0.5, 0.7, 1.0], small=8, bins=16)["x"]
    xs = sorted(vals)
    n = len(xs)
    for p, g in zip([0.0, 0.3, 0.5, 0.7, 1.0], got):
        h = (n - 1) * p
        lo, hi = xs[int(np.floor(h))], xs[int(np.ceil(h))]
        want = lo if lo == hi else lo + (hi - lo) * (h - np.floor(h))
        assert g == want or (np.isnan(want) and np.isnan(g))
    with pytest.raises(ValueError):
        E.histogram(df, ["x"], 30).collect()


def test_eda_report_awkward_columns(spark):
    df = spark.createDataFrame([(None, 2.0, float(i), i % 2 if i < 9 else None) for i in range(10)],
                               "a double, b double, c double, error int")
    rep = E.eda_report(df, ["a", "b", "c"], "error")
    sections = {r.section for r in rep.collect()}
    assert sections == {"describe", "histogram", "correlation", "boxplot", "label", "label_summary"}
    hist = E.histogram(df, ["a", "b", "c"], 30)
    assert {r.column for r in hist.collect()} == {"b", "c"}          # all-null column has no bins
    corr = {(r.x, r.y): r.corr for r in E.correlation(df, ["a", "b", "c"]).collect()}
    assert corr[("b", "b")] is None and corr[("a", "c")] is None and corr[("c", "c")] == 1.0
    box = {r.column for r in E.boxplot_stats(df, ["a", "b", "c"]).collect()}
    assert box == {"b", "c"}
    summ = E.label_summary(df, "error").first()
    assert (summ.total, summ.normal_count, summ.error_count) == (10, 5, 4)


def test_empty_table_everywhere(spark):
    from qforge.operators import metrics as M
    from qforge.operators import region as R
    empty = spark.createDataFrame([], "temp double, humid double, error int")
    cols = ["temp", "humid"]
    assert E.describe_numeric(empty, cols).first()["count"] == 0
    assert E.histogram(empty, cols).count() == 0
    assert E.boxplot_stats(empty, cols).count() == 0
    assert E.eda_report(empty, cols, "error").where("section = 'label_summary'").count() == 4
    s = C.clean_summary(empty, cols)
    assert s.first().final_rows == 0 and s.first().outlier_removal_rate == 0.0
    scored = spark.createDataFrame([], "label int, prediction int, score double")
    assert M.confusion_counts(scored).first().tp == 0
    assert M.auc_ap(scored).first().roc_auc is None
    assert M.roc_curve(scored).count() == 1
    assert M.pr_curve(scored).count() == 1
    assert M.classification_report(scored).where("class_label = 'accuracy'").count() == 1
    reg = R.safe_region(spark.createDataFrame([], "temp double, p_defect double"), ["temp"], "p_defect", 0.5).first()
    assert reg.status == "no_safe_region" and reg.n_total_points == 0


def test_running_totals_ascending(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(300).astype(float)
    vals = rng.integers(0, 7, 300)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, vals)], "k double, v long")
    out = running_totals(df, "k", ["v"], descending=False, with_next=True, buckets=12)
    got = {r.k: (r.cum_v, r.next_v) for r in out.collect()}
    order = np.argsort(keys)
    cum = np.cumsum(vals[order])
    for i, idx in enumerate(order):
        nxt = int(vals[order[i + 1]]) if i + 1 < len(order) else None
        assert got[keys[idx]] == (int(cum[i]), nxt)


def test_quantiles_many_columns_small_budget(spark, monkeypatch):
    import qforge.functions.order_stats as OS
    monkeypatch.setattr(OS, "PASS_BUDGET", 200)
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 12)).round(3)
    cols = [f"c{j}" for j in range(12)]
    df = spark.createDataFrame([tuple(float(x) for x in row) for row in data], ", ".join(f"{c} double" for c in cols))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = exact_quantiles(df, cols, probs)
    for j, c in enumerate(cols):
        assert np.allclose(got[c], np.quantile(data[:, j], probs, method="linear"), rtol=0, atol=1e-12)


def test_distinct_of_large_integers(spark):
    """Integers above 2^53 that differ are different values."""
    from qforge.operators import quality as Q
    df = spark.range(100).selectExpr(f"id + {2 ** 53} AS x")
    assert Q.quality_indices(df, ["x"]).first()["UQI"] == 100.0
