"""Registered queries: one per operator of the inventory, each with its oracle.

Every query reads the given tables (through the sensor views) so its work
grows with them. Floating results whose last digits depend on summation
order are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.operators import clean as C
from qforge.operators import eda as E
from qforge.operators import metrics as M
from qforge.operators import quality as Q
from qforge.operators import region as R
from qforge.operators import split as S
from qforge.plans import pipeline as P
from qforge.plans.sql_fixtures import (FEATURES, SCORE_EXPR, SCORED, SENSOR, SENSOR_RAW, ci,
                                       spark_round, union_all, with_)
from qforge.sources import csv_ingest as CI
from qforge.sources import fixture_files as FF
from qforge.sources import manifest as MF
from qforge.sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

USER_RANGES = {"temp": (0.0, 100.0), "humid": (10.0, 90.0), "press": (0.0, 140.0)}
REGION_THRESHOLD = 0.3


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = spark_round(sql)
        return fn
    return deco


def r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# ============================================================ cleaning
SQL_MISSING = with_(SENSOR, SENSOR_RAW) + union_all([
    f"SELECT '{c}' AS column_name, {ci(c + ' IS NULL')} AS missing_count FROM sensor_raw"
    for c in ["event_id", "temp", "humid", "press", "error"]])


@register("missing_counts", SQL_MISSING)
def q_missing_counts(spark, sf):
    return C.missing_counts(td.sensor_raw(spark, sf))


SQL_DROP = with_(SENSOR, SENSOR_RAW) + (
    "SELECT * FROM sensor_raw WHERE event_id IS NOT NULL AND temp IS NOT NULL AND humid IS NOT NULL"
    " AND press IS NOT NULL AND error IS NOT NULL")


@register("drop_missing", SQL_DROP)
def q_drop_missing(spark, sf):
    return C.drop_missing(td.sensor_raw(spark, sf))


SQL_FILL = with_(SENSOR, SENSOR_RAW, "m AS (SELECT avg(temp) AS mt, avg(humid) AS mh FROM sensor_raw)") + (
    "SELECT event_id, round(coalesce(temp, mt), 6) AS temp, round(coalesce(humid, mh), 6) AS humid,"
    " press, error FROM sensor_raw, m")


@register("fill_missing_mean", SQL_FILL)
def q_fill_missing_mean(spark, sf):
    return r6(C.fill_missing_mean(td.sensor_raw(spark, sf)), ["temp", "humid"])


def _z_sql(src: str, cols: list[str] = FEATURES, t: float = 3.0) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    cond = " AND ".join(f"abs(({c} - m_{c}) / nullif(s_{c}, 0)) < {t}" for c in cols)
    return f"zs AS (SELECT {stats} FROM {src}),\nzkept AS (SELECT {src}.* FROM {src}, zs WHERE {cond})"


SQL_DROPPED = ("dropped AS (SELECT * FROM sensor_raw WHERE temp IS NOT NULL AND humid IS NOT NULL"
               " AND press IS NOT NULL AND error IS NOT NULL AND event_id IS NOT NULL)")

SQL_ZSCORE = with_(SENSOR, SENSOR_RAW, SQL_DROPPED, _z_sql("dropped")) + "SELECT * FROM zkept"


@register("zscore_filter", SQL_ZSCORE)
def q_zscore_filter(spark, sf):
    return C.zscore_filter(C.drop_missing(td.sensor_raw(spark, sf)), FEATURES, 3.0)


SQL_CLEAN_SUMMARY = with_(SENSOR, SENSOR_RAW, SQL_DROPPED, _z_sql("dropped")) + """
SELECT 'drop' AS missing_method, CAST(3.0 AS DOUBLE) AS outlier_threshold,
       o.n AS original_rows, o.miss AS missing_before, CAST(0 AS BIGINT) AS missing_after,
       d.n AS rows_after_missing, o.n - d.n AS removed_missing_rows, d.n - z.n AS removed_outlier_rows,
       round(coalesce((d.n - z.n) * 100.0 / nullif(d.n, 0), 0.0), 2) AS outlier_removal_rate,
       z.n AS final_rows, o.n - z.n AS total_removed_rows
FROM (SELECT count(*) AS n,
             CAST(count_if(event_id IS NULL) + count_if(temp IS NULL) + count_if(humid IS NULL)
                  + count_if(press IS NULL) + count_if(error IS NULL) AS BIGINT) AS miss FROM sensor_raw) o,
     (SELECT count(*) AS n FROM dropped) d,
     (SELECT count(*) AS n FROM zkept) z"""


@register("clean_summary", SQL_CLEAN_SUMMARY)
def q_clean_summary(spark, sf):
    return C.clean_summary(td.sensor_raw(spark, sf), FEATURES, "drop", 3.0)


# ============================================================ quality (A1-A4)
def _qi_sql(src: str, ranges: dict | None = None, cols: list[str] = FEATURES) -> str:
    parts = []
    for c in cols:
        if ranges and c in ranges:
            lo, hi = ranges[c]
            bounds = f"(SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi)"
        else:
            bounds = (f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
                      f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}))")
        parts.append(f"""SELECT '{c}' AS column,
  round(CASE WHEN n > 0 THEN (1.0 - (n - nn) / n) * 100.0 ELSE 0.0 END, 2) AS CQI,
  round(CASE WHEN n > 0 THEN d / n * 100.0 ELSE 0.0 END, 2) AS UQI,
  round(CASE WHEN n > 0 THEN v / n * 100.0 ELSE 0.0 END, 2) AS VQI,
  round(CASE WHEN n > 0 THEN ((1.0 - (n - nn) / n) * 100.0 + v / n * 100.0) / 2.0 ELSE 0.0 END, 2) AS DQI,
  printf('[%.2f, %.2f]', lo, hi) AS valid_range
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count({c}) AS DOUBLE) AS nn,
             CAST(count(DISTINCT {c}) AS DOUBLE) AS d,
             CAST(count_if({c} BETWEEN b.lo AND b.hi) AS DOUBLE) AS v, any_value(b.lo) AS lo, any_value(b.hi) AS hi
      FROM {src}, {bounds} b)""")
    return union_all(parts)


SQL_QI = with_(SENSOR, SENSOR_RAW) + _qi_sql("sensor_raw")


@register("quality_indices", SQL_QI)
def q_quality_indices(spark, sf):
    return Q.quality_indices(td.sensor_raw(spark, sf), FEATURES)


SQL_QI_RANGES = with_(SENSOR, SENSOR_RAW) + _qi_sql("sensor_raw", USER_RANGES)


@register("quality_indices_ranges", SQL_QI_RANGES)
def q_quality_indices_ranges(spark, sf):
    return Q.quality_indices(td.sensor_raw(spark, sf), FEATURES, USER_RANGES)


SQL_QSUM = with_(SENSOR, SENSOR_RAW, f"qi AS ({_qi_sql('sensor_raw')})") + (
    "SELECT round(avg(CQI), 2) AS avg_cqi, round(avg(UQI), 2) AS avg_uqi, round(avg(VQI), 2) AS avg_vqi,"
    " round(avg(DQI), 2) AS avg_dqi, round(avg(DQI), 2) AS overall_dqi FROM qi")


@register("quality_summary", SQL_QSUM)
def q_quality_summary(spark, sf):
    return Q.quality_summary(Q.quality_indices(td.sensor_raw(spark, sf), FEATURES))


def _grade(x: str) -> str:
    return (f"CASE WHEN {x} >= 90 THEN 'Excellent' WHEN {x} >= 75 THEN 'Good' "
            f"WHEN {x} >= 60 THEN 'Fair' ELSE 'Poor' END")


SQL_QREPORT = with_(SENSOR, SENSOR_RAW, f"qi AS ({_qi_sql('sensor_raw')})") + f"""
SELECT scope, "column", CQI, UQI, VQI, DQI, grade,
       (SELECT count(*) FROM sensor_raw) AS total_rows, CAST(3 AS INTEGER) AS columns_evaluated
FROM (
  SELECT 'column' AS scope, "column", CQI, UQI, VQI, DQI, {_grade('DQI')} AS grade FROM qi
  UNION ALL
  SELECT 'overall', CAST(NULL AS VARCHAR), round(avg(CQI), 2), round(avg(UQI), 2), round(avg(VQI), 2),
         round(avg(DQI), 2), {_grade('round(avg(DQI), 2)')} FROM qi) t"""


@register("quality_report", SQL_QREPORT)
def q_quality_report(spark, sf):
    return Q.quality_report(td.sensor_raw(spark, sf), FEATURES)


# ============================================================ EDA (A5-A10)
def _describe_sql(src: str, cols: list[str] = FEATURES) -> str:
    return union_all([f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 3) AS mean,
  round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS p25,
  round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75, round(max({c}), 3) AS max
FROM {src}""" for c in cols])


SQL_DESCRIBE = with_(SENSOR) + _describe_sql("sensor")


@register("describe_numeric", SQL_DESCRIBE)
def q_describe_numeric(spark, sf):
    return E.describe_numeric(td.sensor(spark, sf), FEATURES)


def _hist_sql(src: str, bins: int = 30, cols: list[str] = FEATURES) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column, CAST(b.i AS INTEGER) AS bin,
  round(b.i * r.step + r.lo, 6) AS bin_lo,
  round(CASE WHEN b.i + 1 >= {bins} THEN r.hi ELSE (b.i + 1) * r.step + r.lo END, 6) AS bin_hi,
  CAST(coalesce(h.cnt, 0) AS BIGINT) AS count
FROM range({bins}) b(i)
CROSS JOIN (SELECT lo, hi, (hi - lo) / {bins}.0 AS step, {bins}.0 / (hi - lo) AS norm FROM
            (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
                    CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi
             FROM {src})) r
LEFT JOIN (
  SELECT b2, count(*) AS cnt FROM (
    SELECT CASE WHEN x >= (CASE WHEN b1 + 1 >= {bins} THEN hi ELSE (b1 + 1) * step + lo END)
                     AND b1 <> {bins - 1} THEN b1 + 1 ELSE b1 END AS b2
    FROM (
      SELECT x, lo, hi, step,
             CASE WHEN x < (CASE WHEN b0 >= {bins} THEN hi ELSE b0 * step + lo END) THEN b0 - 1 ELSE b0 END AS b1
      FROM (
        SELECT s.{c} AS x, lo, hi, step, least(CAST(floor((s.{c} - lo) * norm) AS BIGINT), {bins - 1}) AS b0
        FROM {src} s,
             (SELECT lo, hi, (hi - lo) / {bins}.0 AS step, {bins}.0 / (hi - lo) AS norm FROM
               (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
                       CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi
                FROM {src})) p
        WHERE s.{c} IS NOT NULL)))
  GROUP BY b2) h ON h.b2 = b.i""")
    return union_all(parts)


SQL_HIST = with_(SENSOR) + _hist_sql("sensor")


@register("histogram", SQL_HIST)
def q_histogram(spark, sf):
    return r6(E.histogram(td.sensor(spark, sf), FEATURES), ["bin_lo", "bin_hi"])


def _corr_sql(src: str, cols: list[str] = FEATURES) -> str:
    return union_all([f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM {src}"
                      for a in cols for b in cols])


SQL_CORR = with_(SENSOR) + _corr_sql("sensor")


@register("correlation", SQL_CORR)
def q_correlation(spark, sf):
    return E.correlation(td.sensor(spark, sf), FEATURES)


def _box_sql(src: str, cols: list[str] = FEATURES) -> str:
    return union_all([f"""SELECT '{c}' AS column, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr,
  round(least(coalesce(min(CASE WHEN s.{c} >= q1 - 1.5 * (q3 - q1) THEN s.{c} END), q1), q1), 6) AS whisker_low,
  round(greatest(coalesce(max(CASE WHEN s.{c} <= q3 + 1.5 * (q3 - q1) THEN s.{c} END), q3), q3), 6) AS whisker_high,
  {ci(f's.{c} < q1 - 1.5 * (q3 - q1) OR s.{c} > q3 + 1.5 * (q3 - q1)')} AS n_outliers
FROM {src} s, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
                      quantile_cont({c}, 0.75) AS q3 FROM {src}) q
GROUP BY q1, med, q3""" for c in cols])


SQL_BOX = with_(SENSOR) + _box_sql("sensor")


@register("boxplot_stats", SQL_BOX)
def q_boxplot_stats(spark, sf):
    return E.boxplot_stats(td.sensor(spark, sf), FEATURES)


SQL_LABELS = with_(SENSOR) + "SELECT error AS label, count(*) AS count FROM sensor WHERE error IS NOT NULL GROUP BY error"


@register("label_distribution", SQL_LABELS)
def q_label_distribution(spark, sf):
    return E.label_distribution(td.sensor(spark, sf), "error")


SQL_LABEL_SUMMARY = with_(SENSOR) + f"""
SELECT n AS total, n0 AS normal_count, n1 AS error_count,
       round(coalesce(n1 * 100.0 / nullif(n, 0), 0.0), 2) AS error_rate
FROM (SELECT count(*) AS n, {ci('error = 0')} AS n0, {ci('error = 1')} AS n1 FROM sensor)"""


@register("label_summary", SQL_LABEL_SUMMARY)
def q_label_summary(spark, sf):
    return E.label_summary(td.sensor(spark, sf), "error")


def _eda_sql() -> str:
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    bstats = ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    desc = union_all([f"SELECT 'describe' AS section, \"column\", '{s}' AS stat, CAST({s} AS DOUBLE) AS value FROM d"
                      for s in stats])
    box = union_all([f"SELECT 'boxplot', \"column\", '{s}', CAST({s} AS DOUBLE) FROM bx" for s in bstats])
    lsum = union_all([f"SELECT 'label_summary', 'error', '{s}', CAST({s} AS DOUBLE) FROM ls"
                      for s in ["total", "normal_count", "error_count", "error_rate"]])
    return (with_(SENSOR, f"d AS ({_describe_sql('sensor')})", f"h AS ({_hist_sql('sensor')})",
                  f"c AS ({_corr_sql('sensor')})", f"bx AS ({_box_sql('sensor')})",
                  "lb AS (SELECT error AS label, count(*) AS count FROM sensor WHERE error IS NOT NULL GROUP BY error)",
                  f"ls AS (SELECT n AS total, n0 AS normal_count, "
                  f"n1 AS error_count, round(coalesce(n1 * 100.0 / nullif(n, 0), 0.0), 2) AS error_rate FROM "
                  f"(SELECT count(*) AS n, {ci('error = 0')} AS n0, {ci('error = 1')} AS n1 FROM sensor))")
            + union_all([desc,
                         "SELECT 'histogram', \"column\", printf('bin_%02d', bin), CAST(count AS DOUBLE) FROM h",
                         "SELECT 'correlation', x, y, corr FROM c",
                         box,
                         "SELECT 'label', 'error', CAST(label AS VARCHAR), CAST(count AS DOUBLE) FROM lb",
                         lsum]))


@register("eda_report", _eda_sql())
def q_eda_report(spark, sf):
    return E.eda_report(td.sensor(spark, sf), FEATURES, "error")


# ============================================================ split / scale (M1, M2)
SPLIT_CTES = [
    "cc AS (SELECT error, count(*) AS n FROM sensor GROUP BY error)",
    "tt AS (SELECT sum(n) AS tot, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt FROM cc)",
    "fl AS (SELECT error, n, n / tot * nt AS cont, floor(n / tot * nt) AS f, nt FROM cc, tt)",
    "qq AS (SELECT error, CAST(f + CASE WHEN row_number() OVER (ORDER BY cont - f DESC, error) <= "
    "nt - (SELECT sum(f) FROM fl) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)",
    "ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.error ORDER BY md5(concat(s.event_id, ':42'))) AS rn "
    "FROM sensor s)",
    "test AS (SELECT r.* EXCLUDE (rn) FROM ranked r JOIN qq ON r.error = qq.error WHERE r.rn <= qq.quota)",
    "train AS (SELECT r.* EXCLUDE (rn) FROM ranked r JOIN qq ON r.error = qq.error WHERE r.rn > qq.quota)",
]

SQL_SPLIT = with_(SENSOR, *SPLIT_CTES) + "SELECT event_id, error FROM test"


@register("stratified_split", SQL_SPLIT)
def q_stratified_split(spark, sf):
    _, test = S.stratified_split(td.sensor(spark, sf), "error", "event_id", 0.2, 42)
    return test.select("event_id", "error")


SQL_SCALE = with_(SENSOR, *SPLIT_CTES, "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
    for c in FEATURES) + " FROM train)") + (
    "SELECT event_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES)
    + " FROM test, st")


@register("standard_scale", SQL_SCALE)
def q_standard_scale(spark, sf):
    train, test = S.stratified_split(td.sensor(spark, sf), "error", "event_id", 0.2, 42)
    scaler = S.fit_scaler(train, FEATURES)
    return r6(scaler.transform(test.select("event_id", *FEATURES)), FEATURES)


# ============================================================ metrics
SQL_CM = with_(SENSOR, SCORED) + f"""
SELECT 'true_0' AS actual, {ci('label = 0 AND prediction = 0')} AS pred_0, {ci('label = 0 AND prediction = 1')} AS pred_1 FROM scored
UNION ALL
SELECT 'true_1', {ci('label = 1 AND prediction = 0')}, {ci('label = 1 AND prediction = 1')} FROM scored"""


@register("confusion_matrix", SQL_CM)
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(td.scored(spark, sf))


SQL_REPORT = with_(SENSOR, SCORED,
                   "p AS (SELECT label AS y, prediction AS p, count(*) AS n FROM scored "
                   "WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY 1, 2)",
                   "c AS (SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(sup) AS DOUBLE) AS sup, "
                   "CAST(sum(pr) AS DOUBLE) AS pr FROM (SELECT y AS cls, CASE WHEN y = p THEN n ELSE 0 END AS tp, "
                   "n AS sup, 0 AS pr FROM p UNION ALL SELECT p, 0, 0, n FROM p) GROUP BY cls)",
                   "pc AS (SELECT CAST(cls AS VARCHAR) AS class_label, coalesce(tp / nullif(pr, 0), 0.0) AS precision, "
                   "coalesce(tp / nullif(sup, 0), 0.0) AS recall, coalesce(2 * tp / nullif(sup + pr, 0), 0.0) AS f1_score, "
                   "sup AS support, tp FROM c)") + """
SELECT class_label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM pc
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support) FROM pc
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), sum(support) FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1_score * support) / sum(support), 6), sum(support) FROM pc"""


@register("classification_report", SQL_REPORT)
def q_classification_report(spark, sf):
    return r6(M.classification_report(td.scored(spark, sf)), ["precision", "recall", "f1_score"])


SQL_CURVE_BASE = [
    "g AS (SELECT score, count_if(label = 1) AS tp, count_if(label = 0) AS fp FROM scored "
    "WHERE label IN (0, 1) AND score IS NOT NULL GROUP BY score)",
    "cu AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp, "
    "lead(tp) OVER (ORDER BY score DESC) AS ntp, lead(fp) OVER (ORDER BY score DESC) AS nfp FROM g)",
    "tot AS (SELECT CAST(sum(tp) AS DOUBLE) AS P, CAST(sum(fp) AS DOUBLE) AS N FROM g)",
]

SQL_ROC = with_(SENSOR, SCORED, *SQL_CURVE_BASE) + """
SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr
UNION ALL
SELECT score, round(cfp / N, 6), round(ctp / P, 6) FROM cu, tot
WHERE (ctp = tp AND cfp = fp) OR ntp IS NULL OR ntp <> tp OR nfp <> fp"""


@register("roc_curve", SQL_ROC)
def q_roc_curve(spark, sf):
    return r6(M.roc_curve(td.scored(spark, sf)), ["fpr", "tpr"])


SQL_PR = with_(SENSOR, SCORED, *SQL_CURVE_BASE) + """
SELECT score AS threshold, round(coalesce(ctp / nullif(ctp + cfp, 0), 0.0), 6) AS precision, round(ctp / P, 6) AS recall
FROM cu, tot
UNION ALL
SELECT CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)"""


@register("pr_curve", SQL_PR)
def q_pr_curve(spark, sf):
    return r6(M.pr_curve(td.scored(spark, sf)), ["precision", "recall"])


SQL_AUC = with_(SENSOR, SCORED, *SQL_CURVE_BASE) + """
SELECT round(sum(fp * (ctp - tp / 2.0)) / nullif(sum(tp) * sum(fp), 0), 6) AS roc_auc,
       round(sum(tp * (ctp / (ctp + cfp))) / nullif(sum(tp), 0), 6) AS average_precision
FROM cu"""


@register("roc_auc_ap", SQL_AUC)
def q_roc_auc_ap(spark, sf):
    return r6(M.auc_ap(td.scored(spark, sf)), ["roc_auc", "average_precision"])


SQL_HARD = with_(SENSOR, SCORED) + f"""
SELECT round((tp + tn) / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1_score,
       round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2.0, 4) AS auc_hard
FROM (SELECT CAST({ci('label = 0 AND prediction = 0')} AS DOUBLE) AS tn,
             CAST({ci('label = 0 AND prediction = 1')} AS DOUBLE) AS fp,
             CAST({ci('label = 1 AND prediction = 0')} AS DOUBLE) AS fn,
             CAST({ci('label = 1 AND prediction = 1')} AS DOUBLE) AS tp,
             CAST(count(*) AS DOUBLE) AS n FROM scored)"""


@register("eval_hard", SQL_HARD)
def q_eval_hard(spark, sf):
    return M.eval_hard(td.scored(spark, sf))


SQL_METRICS = with_(SENSOR, SCORED, *SQL_CURVE_BASE,
                    "aa AS (SELECT sum(fp * (ctp - tp / 2.0)) / nullif(sum(tp) * sum(fp), 0) AS auc, "
                    "sum(tp * (ctp / (ctp + cfp))) / nullif(sum(tp), 0) AS ap FROM cu)",
                    f"cm AS (SELECT CAST({ci('label = 0 AND prediction = 0')} AS DOUBLE) AS tn, "
                    f"CAST({ci('label = 0 AND prediction = 1')} AS DOUBLE) AS fp, "
                    f"CAST({ci('label = 1 AND prediction = 0')} AS DOUBLE) AS fn, "
                    f"CAST({ci('label = 1 AND prediction = 1')} AS DOUBLE) AS tp FROM scored)") + union_all([
    f"SELECT '{k}' AS metric, round({v}, 6) AS value FROM cm, aa" for k, v in [
        ("accuracy", "(tp + tn) / (tn + fp + fn + tp)"),
        ("precision", "coalesce(tp / nullif(tp + fp, 0), 0.0)"),
        ("recall", "coalesce(tp / nullif(tp + fn, 0), 0.0)"),
        ("f1_score", "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"),
        ("roc_auc", "auc"), ("avg_precision_AP", "ap"),
        ("balanced_accuracy", "(coalesce(tp / nullif(tp + fn, 0), 0.0) + coalesce(tn / nullif(tn + fp, 0), 0.0)) / 2.0"),
        ("specificity", "tn / (tn + fp + 1e-12)"),
        ("n_test_samples", "tn + fp + fn + tp"), ("n_positive", "tp + fn"), ("n_negative", "tn + fp")]])


@register("metrics_table", SQL_METRICS)
def q_metrics_table(spark, sf):
    return r6(M.metrics_table(td.scored(spark, sf)), ["value"])


# ============================================================ safe region
def _grid_sql(bounds_sql: str, sizes=(20, 20, 10)) -> str:
    nt, nh, np_ = sizes
    total = nt * nh * np_

    def lin(i: str, c: str, n: int) -> str:
        return (f"CASE WHEN {i} = {n - 1} THEN hi_{c} ELSE {i} * ((hi_{c} - lo_{c}) / {n - 1}.0) + lo_{c} END")
    return (f"bnd AS ({bounds_sql}),\n"
            f"grid AS (SELECT i AS point_id, {lin(f'(i // {nh * np_}) % {nt}', 'temp', nt)} AS temp, "
            f"{lin(f'(i // {np_}) % {nh}', 'humid', nh)} AS humid, {lin(f'i % {np_}', 'press', np_)} AS press "
            f"FROM range({total}) r(i), bnd)")


BOUNDS_Q = ("SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}"
                                  for c in FEATURES) + " FROM sensor")
BOUNDS_MM = "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES) + " FROM sensor"

SQL_GRID = with_(SENSOR, _grid_sql(BOUNDS_Q)) + (
    "SELECT point_id, round(temp, 6) AS temp, round(humid, 6) AS humid, round(press, 6) AS press FROM grid")


@register("param_grid", SQL_GRID)
def q_param_grid(spark, sf):
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    return r6(R.param_grid(spark, b, R.DEFAULT_SIZES), FEATURES)


def _region_sql(bounds_sql: str, thr: float) -> str:
    mm = ", ".join(f"round(min(CASE WHEN p < {thr} THEN {c} END), 6) AS {c}_min, "
                   f"round(max(CASE WHEN p < {thr} THEN {c} END), 6) AS {c}_max" for c in FEATURES)
    return with_(SENSOR, _grid_sql(bounds_sql), f"sg AS (SELECT *, {SCORE_EXPR} AS p FROM grid)") + f"""
SELECT CASE WHEN ns > 0 THEN 'success' ELSE 'no_safe_region' END AS status, CAST({thr} AS DOUBLE) AS prob_threshold,
       {", ".join(f"{c}_min, {c}_max" for c in FEATURES)}, ns AS n_safe_points, nt AS n_total_points,
       round(coalesce(ns * 100.0 / nullif(nt, 0), 0.0), 2) AS safe_ratio
FROM (SELECT {mm}, {ci(f'p < {thr}')} AS ns, count(*) AS nt FROM sg)"""


def _closed_form_scorer(grid: DataFrame) -> DataFrame:
    return grid.withColumn("p_defect", td.closed_form_score(F.col("temp"), F.col("humid")))


def _region_cols():
    return [f"{c}_{e}" for c in FEATURES for e in ("min", "max")]


@register("safe_region", _region_sql(BOUNDS_Q, REGION_THRESHOLD))
def q_safe_region(spark, sf):
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    return r6(R.estimate_safe_region(spark, _closed_form_scorer, b, R.DEFAULT_SIZES, REGION_THRESHOLD),
              _region_cols())


@register("safe_region_minmax", _region_sql(BOUNDS_MM, REGION_THRESHOLD))
def q_safe_region_minmax(spark, sf):
    return r6(R.analyze_safe_region(td.sensor(spark, sf), _closed_form_scorer, FEATURES, R.DEFAULT_SIZES,
                                    REGION_THRESHOLD, bounds="minmax"), _region_cols())


@register("safe_region_none", _region_sql(BOUNDS_Q, 0.0))
def q_safe_region_none(spark, sf):
    """A threshold no point can meet: the explicit no-region status row."""
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    return r6(R.estimate_safe_region(spark, _closed_form_scorer, b, R.DEFAULT_SIZES, 0.0), _region_cols())


# ============================================================ ingest

_CSV_CACHE: dict[tuple, str] = {}


def sensor_csv_folder(spark: SparkSession, sf: str) -> str:
    """CSV files derived from the sf tables, written once per session and sf."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CSV_CACHE or not P._exists(spark, _CSV_CACHE[key]):
        _CSV_CACHE[key] = FF.write_sensor_csvs(spark, sf)
    return _CSV_CACHE[key]


def _sensor_paths(spark, sf):
    data = sensor_csv_folder(spark, sf)
    # bounded: one row per file
    return [r["path"] for r in MF.sensor_files(MF.file_manifest(spark, data)).select("path").collect()]


VARIANT_SQL = "CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END"
NOTE_SQL = "'" + FF.NOTE_TEXT + "'"

SQL_CSV_READ = with_(SENSOR, SENSOR_RAW) + (
    "SELECT event_id, temp, humid, press, CAST(error AS BIGINT) AS error, "
    f"CASE WHEN event_id % 5 = 2 THEN {NOTE_SQL} END AS \"비고\" FROM sensor_raw")


@register("csv_encoding_read", SQL_CSV_READ)
def q_csv_encoding_read(spark, sf):
    """UTF-8, UTF-8+BOM, CP949 and NA-token files (one extra column in one file) -> one table."""
    return CI.read_csv_files(spark, _sensor_paths(spark, sf))


SQL_FILE_SUMMARY = with_(SENSOR, SENSOR_RAW) + f"""
SELECT {VARIANT_SQL} AS variant, count(*) AS rows,
       CAST(max(CASE WHEN event_id % 5 = 2 THEN 6 ELSE 5 END) AS BIGINT) AS cols
FROM sensor_raw GROUP BY 1
UNION ALL SELECT 'f', CAST(0 AS BIGINT), CAST(5 AS BIGINT)"""


@register("file_summary", SQL_FILE_SUMMARY)
def q_file_summary(spark, sf):
    """Per-file rows / columns of every sensor file, rolled up per file group."""
    infos = CI.inspect_files(spark, _sensor_paths(spark, sf))
    fs = CI.file_summary(spark, infos)
    return (fs.groupBy(FF.variant_of(F.col("file_name")).alias("variant"))
              .agg(F.sum("rows").alias("rows"), F.max("cols").alias("cols")))


SQL_LATEST = "SELECT * FROM (VALUES ('f-000.csv', 1), ('e-000.csv', 2)) t(file_name, recency_rank)"


@register("latest_files", SQL_LATEST)
def q_latest_files(spark, sf):
    """The 2 most recently modified sensor files (error-log files excluded)."""
    data = sensor_csv_folder(spark, sf)
    top = MF.latest_files(MF.sensor_files(MF.file_manifest(spark, data)), 2).select("file_name").collect()
    return spark.createDataFrame([(r["file_name"], i) for i, r in enumerate(top, start=1)],
                                 "file_name string, recency_rank int")


SQL_INGEST_REPORT = with_(SENSOR, SENSOR_RAW) + f"""
SELECT {VARIANT_SQL} AS variant, 'success' AS status, CAST(NULL AS VARCHAR) AS error, count(*) AS rows,
       CAST(max(CASE WHEN event_id % 5 = 2 THEN 6 ELSE 5 END) AS BIGINT) AS cols
FROM sensor_raw GROUP BY 1
UNION ALL SELECT 'Error_log', 'success', NULL, count(*), CAST(5 AS BIGINT) FROM sensor_raw WHERE event_id % 5 = 0
UNION ALL SELECT 'f', 'success', NULL, CAST(0 AS BIGINT), CAST(5 AS BIGINT)
UNION ALL SELECT 'notes', 'failed', 'only CSV files are accepted', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"""


@register("ingest_report", SQL_INGEST_REPORT)
def q_ingest_report(spark, sf):
    """Batch upload of every file in the folder (a non-CSV file included)."""
    data = sensor_csv_folder(spark, sf)
    paths = [r["path"] for r in MF.file_manifest(spark, data, "*").select("path").collect()]  # bounded: per file
    rep = CI.require_success(CI.ingest_report(spark, paths))
    return (rep.groupBy(FF.variant_of(F.col("file_name")).alias("variant"), "status", "error")
               .agg(F.sum("rows").alias("rows"), F.max("cols").alias("cols")))


SQL_SENSOR_INFO = "SELECT CAST(6 AS BIGINT) AS sensor_file_count, ['a-000.csv', 'b-000.csv', 'c-000.csv', 'd-000.csv', 'e-000.csv', 'f-000.csv'] AS sensor_files"


@register("sensor_file_info", None)
def q_sensor_file_info(spark, sf):
    """Count and names of the sensor files (names depend on the writer's part count)."""
    return MF.sensor_file_info(spark, sensor_csv_folder(spark, sf))


def _profile_sql() -> str:
    types = {"event_id": "bigint", "temp": "double", "humid": "double", "press": "double", "error": "int"}
    parts = []
    for c, t in types.items():
        parts.append(f"""SELECT (SELECT count(*) FROM sensor_raw) AS n_rows, 5 AS n_cols, '{c}' AS column,
  '{t}' AS dtype, {ci(c + ' IS NULL')} AS null_count, count({c}) AS count,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max,
  CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM sensor_raw""")
    return with_(SENSOR, SENSOR_RAW) + union_all(parts)


@register("dataset_profile", _profile_sql())
def q_dataset_profile(spark, sf):
    return CI.dataset_profile(td.sensor_raw(spark, sf))


SQL_MERGE = with_(SENSOR) + """
SELECT event_id, temp, CASE WHEN event_id % 2 = 0 THEN humid END AS humid,
       CASE WHEN event_id % 2 = 1 THEN press END AS press, error,
       CASE WHEN event_id % 2 = 1 THEN 'line-' || CAST(event_id % 7 AS VARCHAR) END AS line
FROM sensor"""


@register("merge_union", SQL_MERGE)
def q_merge_union(spark, sf):
    """UNION ALL by name of two frames with different columns."""
    s = td.sensor(spark, sf)
    even = s.where(F.col("event_id") % 2 == 0).select("event_id", "temp", "humid", "error")
    odd = s.where(F.col("event_id") % 2 == 1).select(
        "event_id", "temp", "press", "error",
        F.concat(F.lit("line-"), (F.col("event_id") % 7).cast("string")).alias("line"))
    return CI.union_by_name([even, odd])


SQL_NORMALIZE = with_(SENSOR) + (
    "SELECT event_id, temp, humid, press AS pressure_kpa, error, temp AS temp__c_ FROM sensor")


@register("normalize_rename", SQL_NORMALIZE)
def q_normalize_rename(spark, sf):
    """Raw headers -> normalised names -> canonical sensor names (unit names stay)."""
    from qforge.functions.names import normalize_names
    s = td.sensor(spark, sf).select("event_id", "temp", "humid", "press", "error", F.col("temp").alias("t2"))
    raw = ["Event-ID", "온도", " 습도 ", "Pressure kPa", "불량여부", "Temp (C)"]
    return s.toDF(*normalize_names(raw))


SQL_MERGE_FILES = with_(SENSOR, SENSOR_RAW) + """
SELECT CAST(6 AS BIGINT) AS file_groups, true AS all_processed, count(*) AS combined_rows, CAST(6 AS BIGINT) AS combined_cols,
       count(*) AS all_files_rows FROM sensor_raw"""


@register("merge_sensor_files", SQL_MERGE_FILES)
def q_merge_sensor_files(spark, sf):
    """P1 over every sensor file: counts of the landed combined table."""
    from qforge.session import scratch_path
    res = P.merge_sensor_files(spark, sensor_csv_folder(spark, sf), None, scratch_path(spark, "merge"))
    groups = res.file_summary.agg(F.count_distinct(FF.variant_of(F.col("file_name"))).alias("n")).first()["n"]      # however many part files
    return res.summary.select(F.lit(groups).cast("long").alias("file_groups"), (F.col("sensor_file_count") == F.col("processed_file_count")).alias("all_processed"),
                              "combined_rows", "combined_cols", "all_files_rows")


# ============================================================ forest (M3, M5, M11-M14) - rows-only
_FOREST_CACHE: dict[tuple, object] = {}
FOREST_TREES = 200


def trained_forest(spark: SparkSession, sf: str):
    """The forest of the sensor table's stratified split, trained once per session and sf."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOREST_CACHE:
        from qforge.operators import forest as FO
        train, test = S.stratified_split(td.sensor(spark, sf), "error", "event_id", 0.2, 42)
        model = FO.fit_forest(train, FEATURES, "error", n_trees=FOREST_TREES, seed=42)
        _FOREST_CACHE[key] = (model, test)
    return _FOREST_CACHE[key]


@register("rf_predictions")
def q_rf_predictions(spark, sf):
    model, test = trained_forest(spark, sf)
    return model.score(test).select("event_id", F.col("error").alias("y_true"), "y_pred", "y_score")


@register("feature_importance")
def q_feature_importance(spark, sf):
    model, _ = trained_forest(spark, sf)
    return model.importance()


@register("rf_metrics")
def q_rf_metrics(spark, sf):
    model, test = trained_forest(spark, sf)
    return M.metrics_table(model.score(test), "error", "y_pred", "y_score")


SQL_FOREST_NODES = with_(SENSOR, *SPLIT_CTES) + (
    "SELECT count(*) AS n_rows, true AS same_scores, true AS same_predictions, true AS same_importance, true AS whole_trees FROM test")


@register("forest_nodes", SQL_FOREST_NODES)
def q_forest_nodes(spark, sf):
    """The forest as a table of nodes gives the scores, predictions and importances of the fitted model to 1e-9."""
    model, test = trained_forest(spark, sf)
    table = model.as_nodes()
    both = table.score(model.score(test), "p_nodes", "y_nodes").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.abs(F.col("p_nodes") - F.col("y_score")) <= 1e-9).alias("same_scores"),
        F.bool_and((F.col("y_nodes") == F.col("y_pred")) | (F.abs(F.col("y_score") - 0.5) <= 1e-9)).alias("same_predictions"))
    ours, theirs = ({r["feature"]: r["importance"] for r in m.importance().collect()} for m in (table, model))      # a row a feature
    split, leaf = F.count_if(F.col("left") >= 0), F.count_if(F.col("left") < 0)
    whole = table.nodes.groupBy("tree").agg((leaf == split + 1).alias("whole")).agg(F.bool_and("whole")).first()[0]
    return both.withColumn("same_importance", F.lit(all(abs(ours[f] - v) <= 1e-9 for f, v in theirs.items()))).withColumn("whole_trees", F.lit(whole))


SQL_FOREST_MIN = with_(SENSOR, *SPLIT_CTES) + (
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS small_splits, true AS pruned, true AS whole_trees, true AS uncut_rows_equal FROM test")
MIN_SAMPLES_SPLIT = 40


@register("forest_min_split", SQL_FOREST_MIN)
def q_forest_min_split(spark, sf):
    """No split of fewer rows than ``min_samples_split``, and unchanged scores wherever no tree was cut on a row's way (M3)."""
    model, test = trained_forest(spark, sf)
    table = model.as_nodes()
    small = table.pruned(MIN_SAMPLES_SPLIT)
    same = table.pruned(2)                                 # every split has two rows at least: nothing is cut
    scored = same.score(table.score(test, "p_table", "y_table"), "p_same", "y_same")
    rows = small.score(scored, "p_small", "y_small").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("p_same") == F.col("p_table")).alias("uncut_rows_equal"))
    split, leaf = F.count_if(F.col("left") >= 0), F.count_if(F.col("left") < 0)
    whole = small.nodes.groupBy("tree").agg((leaf == split + 1).alias("whole")).agg(F.bool_and("whole")).first()[0]
    few = small.nodes.where((F.col("left") >= 0) & (F.col("n") < MIN_SAMPLES_SPLIT)).count()
    return rows.select("n_rows", F.lit(few).cast("long").alias("small_splits"), F.lit(small.nodes.count() < table.nodes.count()).alias("pruned"),
                       F.lit(whole).alias("whole_trees"), "uncut_rows_equal")


@register("model_report")
def q_model_report(spark, sf):
    model, test = trained_forest(spark, sf)
    return M.model_report(model.score(test), model.importance(), "error", "y_pred", "y_score")


@register("safe_region_rf")
def q_safe_region_rf(spark, sf):
    from qforge.operators import forest as FO
    model, _ = trained_forest(spark, sf)
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    return R.estimate_safe_region(spark, FO.grid_scorer(model), b, R.DEFAULT_SIZES, 0.05)


@register("full_analysis")
def q_full_analysis(spark, sf):
    """P2 over every sensor file derived from the sf tables."""
    return P.run_full_pipeline(spark, sensor_csv_folder(spark, sf), num_files=None).drop("output_dir")


# ============================================================ streaming landing
SQL_STREAM = with_(SENSOR, SENSOR_RAW) + (
    "SELECT event_id, temp, humid, press, CAST(error AS BIGINT) AS error, "
    f"CASE WHEN event_id % 5 = 2 THEN {NOTE_SQL} END AS \"비고\" FROM sensor_raw")


@register("stream_landing", SQL_STREAM)
def q_stream_landing(spark, sf):
    """File-stream landing (available-now trigger): one stream per file layout, one table."""
    from qforge.session import scratch_path
    from qforge.streaming import start_landing
    folder = sensor_csv_folder(spark, sf)
    out = scratch_path(spark, "landing")
    layouts = {"utf8": f"{folder}/[abdef]-*.csv", "cp949": f"{folder}/c-*.csv"}
    for name, files in layouts.items():
        q = start_landing(spark, files, out, checkpoint=f"{out}/_checkpoint_{name}", available_now=True,
                          stream_name=name)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    rows = spark.read.option("mergeSchema", True).parquet(f"{out}/rows")
    return rows.select("event_id", "temp", "humid", "press", "error", "비고")


# ============================================================ more semantics: NULLs, fill, thresholds
SQL_CORR_RAW = with_(SENSOR, SENSOR_RAW) + _corr_sql("sensor_raw")


@register("correlation_raw", SQL_CORR_RAW)
def q_correlation_raw(spark, sf):
    """Pairwise-complete correlation: a pair skips rows with a NULL in either column."""
    return E.correlation(td.sensor_raw(spark, sf), FEATURES)


SQL_HIST_RAW = with_(SENSOR, SENSOR_RAW) + _hist_sql("sensor_raw")


@register("histogram_raw", SQL_HIST_RAW)
def q_histogram_raw(spark, sf):
    return r6(E.histogram(td.sensor_raw(spark, sf), FEATURES), ["bin_lo", "bin_hi"])


SQL_BOX_RAW = with_(SENSOR, SENSOR_RAW) + _box_sql("sensor_raw")


@register("boxplot_stats_raw", SQL_BOX_RAW)
def q_boxplot_stats_raw(spark, sf):
    return E.boxplot_stats(td.sensor_raw(spark, sf), FEATURES)


SQL_Z25 = with_(SENSOR, _z_sql("sensor", FEATURES, 2.5)) + "SELECT * FROM zkept"


@register("zscore_filter_t25", SQL_Z25)
def q_zscore_filter_t25(spark, sf):
    return C.zscore_filter(td.sensor(spark, sf), FEATURES, 2.5)


SQL_CLEAN_FILL = with_(
    SENSOR, SENSOR_RAW,
    "m AS (SELECT avg(temp) AS mt, avg(humid) AS mh FROM sensor_raw)",
    "filled AS (SELECT event_id, coalesce(temp, mt) AS temp, coalesce(humid, mh) AS humid, press, error "
    "FROM sensor_raw, m)",
    _z_sql("filled")) + """
SELECT 'fill' AS missing_method, CAST(3.0 AS DOUBLE) AS outlier_threshold,
       o.n AS original_rows, o.miss AS missing_before, CAST(0 AS BIGINT) AS missing_after,
       o.n AS rows_after_missing, CAST(0 AS BIGINT) AS removed_missing_rows, o.n - z.n AS removed_outlier_rows,
       round(coalesce((o.n - z.n) * 100.0 / nullif(o.n, 0), 0.0), 2) AS outlier_removal_rate,
       z.n AS final_rows, o.n - z.n AS total_removed_rows
FROM (SELECT count(*) AS n,
             CAST(count_if(temp IS NULL) + count_if(humid IS NULL) AS BIGINT) AS miss FROM sensor_raw) o,
     (SELECT count(*) AS n FROM zkept) z"""


@register("clean_summary_fill", SQL_CLEAN_FILL)
def q_clean_summary_fill(spark, sf):
    """Mean fill instead of drop, then the z-score filter on the filled data."""
    return C.clean_summary(td.sensor_raw(spark, sf), FEATURES, "fill", 3.0)


# ============================================================ the same operators on a wider table
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark, sf):
    return td.table(spark, sf, "lineitem")


@register("lineitem_quality", _qi_sql("lineitem", None, LINE_COLS))
def q_lineitem_quality(spark, sf):
    """Quality indices of the order-line measures (any numeric columns work)."""
    return Q.quality_indices(_lineitem(spark, sf), LINE_COLS)


@register("lineitem_describe", _describe_sql("lineitem", LINE_COLS))
def q_lineitem_describe(spark, sf):
    return E.describe_numeric(_lineitem(spark, sf), LINE_COLS)


@register("lineitem_boxplot", _box_sql("lineitem", LINE_COLS))
def q_lineitem_boxplot(spark, sf):
    return E.boxplot_stats(_lineitem(spark, sf), LINE_COLS)


@register("lineitem_histogram", _hist_sql("lineitem", 30, LINE_COLS))
def q_lineitem_histogram(spark, sf):
    return r6(E.histogram(_lineitem(spark, sf), LINE_COLS), ["bin_lo", "bin_hi"])


@register("lineitem_correlation", _corr_sql("lineitem", LINE_COLS))
def q_lineitem_correlation(spark, sf):
    return E.correlation(_lineitem(spark, sf), LINE_COLS)


WIDE_BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey % 100", "l_suppkey % 50", "l_orderkey % 97"]
#: 64 mixtures of measures with missing values in different rows, a constant column, and one that is missing throughout.
WIDE = {f"w{k}": f"CASE WHEN (l_orderkey + {k}) % 11 <> 0 THEN CAST({WIDE_BASE[k % 8]} AS DOUBLE) * {1 + k // 8} "
                 f"+ CAST({WIDE_BASE[(3 * k + 1) % 8]} AS DOUBLE) * {k % 5} END" for k in range(64)}
WIDE |= {"same": "CAST(7.25 AS DOUBLE)", "gone": "CAST(NULL AS DOUBLE)"}


def _corr_wide_sql() -> str:
    names = list(WIDE)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return (with_("w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in WIDE.items()) + " FROM lineitem)",
                  "c AS (SELECT " + ", ".join(f'{"CAST(NULL AS DOUBLE)" if {a, b} & {"same", "gone"} else f"round(corr({a}, {b}), 6)"} AS "{a}-{b}"'
                                                  for a, b in pairs) + " FROM w)",
                  "u AS (SELECT * FROM c UNPIVOT INCLUDE NULLS (corr FOR pair IN (COLUMNS(*))))",
                  "s AS (SELECT split_part(pair, '-', 1) AS x, split_part(pair, '-', 2) AS y, corr FROM u)")
            + "SELECT x, y, corr FROM s UNION ALL SELECT y AS x, x AS y, corr FROM s WHERE x <> y")


@register("correlation_wide", _corr_wide_sql())
def q_correlation_wide(spark, sf):
    """Correlations of 66 columns with missing values (A7): sums of blocks, a plan that grows with the columns only."""
    wide = td.table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE.items()])
    return E.correlation(wide, list(WIDE))


@register("lineitem_label_distribution",
          "SELECT l_returnflag AS label, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_lineitem_label_distribution(spark, sf):
    """Label counts of a text label column."""
    return E.label_distribution(_lineitem(spark, sf), "l_returnflag")


@register("lineitem_zscore", with_(_z_sql("lineitem", LINE_COLS, 3.0)) + "SELECT * FROM zkept")
def q_lineitem_zscore(spark, sf):
    return C.zscore_filter(_lineitem(spark, sf), LINE_COLS, 3.0)


def _split_ctes(src: str, label: str, key_sql: str, test_size: float = 0.2, seed: int = 42) -> list[str]:
    return [
        f"cc AS (SELECT {label} AS y, count(*) AS n FROM {src} WHERE {label} IS NOT NULL GROUP BY 1)",
        f"tt AS (SELECT sum(n) AS tot, CAST(ceil({test_size} * sum(n)) AS BIGINT) AS nt FROM cc)",
        "fl AS (SELECT y, n, n / tot * nt AS cont, floor(n / tot * nt) AS f, nt FROM cc, tt)",
        "qq AS (SELECT y, CAST(f + CASE WHEN row_number() OVER (ORDER BY cont - f DESC, y) <= "
        "nt - (SELECT sum(f) FROM fl) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)",
        f"ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.{label} "
        f"ORDER BY md5(concat({key_sql}, ':{seed}'))) AS rn FROM {src} s WHERE s.{label} IS NOT NULL)",
        f"test AS (SELECT r.* EXCLUDE (rn) FROM ranked r JOIN qq ON r.{label} = qq.y WHERE r.rn <= qq.quota)",
    ]


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_SPLIT_LINE = with_(*_split_ctes("lineitem", "l_returnflag", "concat_ws('-', " + ", ".join(LINE_KEY) + ")")) + (
    "SELECT " + ", ".join(LINE_KEY) + ", l_returnflag FROM test")


@register("stratified_split_lineitem", SQL_SPLIT_LINE)
def q_stratified_split_lineitem(spark, sf):
    """Exact stratified test set over three text classes; the row key is composite."""
    key = F.concat_ws("-", *LINE_KEY)
    _, test = S.stratified_split(_lineitem(spark, sf), "l_returnflag", key, 0.2, 42)
    return test.select(*LINE_KEY, "l_returnflag")


@register("safe_region_json")
def q_safe_region_json(spark, sf):
    """R6 result shape: the nested JSON document (rows-only: JSON number text is engine-specific)."""
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    region = R.estimate_safe_region(spark, _closed_form_scorer, b, R.DEFAULT_SIZES, REGION_THRESHOLD)
    return R.safe_region_json(region, FEATURES)


@register("dataset_preview", with_(SENSOR, SENSOR_RAW) + "SELECT * FROM sensor_raw ORDER BY event_id LIMIT 5")
def q_dataset_preview(spark, sf):
    """S10 preview: the first five rows (by event id)."""
    return CI.preview(td.sensor_raw(spark, sf), 5, ["event_id"])


SQL_SPLIT_TRAIN = with_(SENSOR, *SPLIT_CTES) + "SELECT event_id, error FROM train"


@register("stratified_split_train", SQL_SPLIT_TRAIN)
def q_stratified_split_train(spark, sf):
    """The training side of the exact split: every row not drawn for the test set."""
    train, _ = S.stratified_split(td.sensor(spark, sf), "error", "event_id", 0.2, 42)
    return train.select("event_id", "error")


SQL_SPLIT_NOKEY = with_(*_split_ctes("lineitem", "l_returnflag", "''")[:4]) + (
    "SELECT l_returnflag, any_value(quota) AS n_test, count(*) - any_value(quota) AS n_train, "
    "CAST(sum(l_linenumber) AS BIGINT) AS line_sum FROM lineitem JOIN qq ON l_returnflag = qq.y GROUP BY 1")


@register("stratified_split_nokey", SQL_SPLIT_NOKEY)
def q_stratified_split_nokey(spark, sf):
    """The split of a table without a key and with many equal rows: exact sizes per class, and no row lost or doubled."""
    rows = _lineitem(spark, sf).select("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    train, test = S.stratified_split(rows, "l_returnflag", None, 0.2, 42)
    sides = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return sides.groupBy("l_returnflag").agg(
        F.sum("t").alias("n_test"), F.sum(1 - F.col("t")).alias("n_train"), F.sum("l_linenumber").alias("line_sum"))


# ============================================================ dialect, exact integers, points, read-back
SQL_QUOTED = """
SELECT o_orderkey, 'say "' || o_orderpriority || '", then \\' || chr(10) || ' and ' || o_orderstatus || ',' AS note
FROM orders"""


@register("csv_quoted_text", SQL_QUOTED)
def q_csv_quoted_text(spark, sf):
    """Texts with quotes, commas, backslashes and line breaks, written as CSV and read back."""
    from qforge.session import scratch_path
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then \\\n and '), "o_orderstatus", F.lit(","))
    out = scratch_path(spark, "quoted")
    (td.table(spark, sf, "orders").select("o_orderkey", note.alias("note")).write
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(out))
    paths = [r["path"] for r in MF.file_manifest(spark, out).select("path").collect()]  # bounded: per file
    return CI.read_csv_files(spark, paths)


SQL_QUOTED_SPLIT = """
SELECT doc_id, sha256(text) AS text_sha256, source, CAST(true AS BOOLEAN) AS many_tasks FROM documents"""


@register("csv_quoted_split", SQL_QUOTED_SPLIT)
def q_csv_quoted_split(spark, sf):
    """Whole texts with line breaks, written as CSV and read back by blocks far smaller than a file."""
    from qforge.session import scratch_path
    from qforge.sources import csv_records as REC
    out = scratch_path(spark, "quoted-split")
    (td.table(spark, sf, "documents").select("doc_id", "text", "source").write
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{out}/csv"))
    files = MF.file_manifest(spark, f"{out}/csv").select("path", "length").collect()  # bounded: per file
    paths = [r["path"] for r in files]
    conf = {"spark.sql.files.maxPartitionBytes": max(1 << 16, sum(r["length"] for r in files) // 64), "spark.sql.files.openCostInBytes": 1 << 14}
    before = {k: spark.conf.get(k) for k in conf}
    try:                                                   # read and written here, as the block size is the session's
        for k, v in conf.items():
            spark.conf.set(k, v)
        blocks = REC.block_effects(spark, paths).groupBy("path").count().agg(F.min("count").alias("n")).first()["n"]
        CI.read_csv_files(spark, paths).write.parquet(f"{out}/rows")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(f"{out}/rows").select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), "source", F.lit(blocks > 1).alias("many_tasks"))


BIG = 9007199254740993          # 2^53 + 1
SQL_QI_BIG = with_(f"big AS (SELECT {BIG} + event_id AS big_id FROM events)") + _qi_sql("big", {"big_id": (0.0, 1e16)}, ["big_id"])


@register("quality_indices_bigint", SQL_QI_BIG)
def q_quality_indices_bigint(spark, sf):
    """Neighbouring 64-bit integers beyond 2^53 stay distinct (A1)."""
    ids = td.table(spark, sf, "events").select((F.col("event_id") + F.lit(BIG).cast("long")).alias("big_id"))
    return Q.quality_indices(ids, ["big_id"], {"big_id": (0.0, 1e16)})


SQL_SAFE_POINTS = with_(SENSOR, _grid_sql(BOUNDS_Q), f"sg AS (SELECT *, {SCORE_EXPR} AS p FROM grid)") + (
    "SELECT round(temp, 6) AS temp, round(humid, 6) AS humid, round(press, 6) AS press, round(p, 6) AS p_defect "
    f"FROM sg WHERE p < {REGION_THRESHOLD}")


@register("safe_points", SQL_SAFE_POINTS)
def q_safe_points(spark, sf):
    """The grid points below the threshold, next to their summary row."""
    b = R.feature_bounds(td.sensor(spark, sf), FEATURES, "quantile")
    grid = _closed_form_scorer(R.param_grid(spark, b, R.DEFAULT_SIZES))
    return r6(R.safe_points(grid, FEATURES, threshold=REGION_THRESHOLD), [*FEATURES, "p_defect"])


SQL_AUC_LINE = with_("scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
                     "l_extendedprice AS score FROM lineitem)", *SQL_CURVE_BASE) + """
SELECT round(sum(fp * (ctp - tp / 2.0)) / nullif(sum(tp) * sum(fp), 0), 6) AS roc_auc,
       round(sum(tp * (ctp / (ctp + cfp))) / nullif(sum(tp), 0), 6) AS average_precision
FROM cu"""


@register("roc_auc_ap_lineitem", SQL_AUC_LINE)
def q_roc_auc_ap_lineitem(spark, sf):
    """Curve sums over many distinct scores, cut into key ranges."""
    rows = _lineitem(spark, sf).select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                                       F.col("l_extendedprice").alias("score"))
    return r6(M.auc_ap(rows), ["roc_auc", "average_precision"])


@register("result_readback", with_(SENSOR, SENSOR_RAW) + (
    "SELECT * FROM sensor_raw WHERE temp IS NOT NULL AND humid IS NOT NULL"))
def q_result_readback(spark, sf):
    """A cleaned table written as a result and read back (K2-K4)."""
    from qforge.session import scratch_path
    out = scratch_path(spark, "results")
    P.write_result(C.drop_missing(td.sensor_raw(spark, sf)), out, "cleaned")
    return P.read_result(spark, out, "cleaned")


SQL_UPLOAD = with_(SENSOR, SENSOR_RAW) + f"SELECT {VARIANT_SQL} AS variant, count(*) AS n_rows FROM sensor_raw GROUP BY 1"


@register("upload_landing", SQL_UPLOAD)
def q_upload_landing(spark, sf):
    """A batch of sensor files landed twice: the retry replaces the batch."""
    from qforge.session import scratch_path
    paths, out = _sensor_paths(spark, sf), scratch_path(spark, "uploads")
    for _ in range(2):
        CI.land_uploads(spark, paths, out)
    name = F.element_at(F.split("_source_file", "/"), -1)
    return spark.read.parquet(out).groupBy(FF.variant_of(name).alias("variant")).agg(F.count(F.lit(1)).alias("n_rows"))


SQL_FOREST_CHECKS = with_(SENSOR, *SPLIT_CTES) + (
    "SELECT count(*) AS n_test, CAST(sum(error) AS BIGINT) AS n_positive, CAST(1.0 AS DOUBLE) AS importance_sum, "
    "true AS accurate, (SELECT count(*) FROM train) AS n_train FROM test")


@register("forest_checks", SQL_FOREST_CHECKS)
def q_forest_checks(spark, sf):
    """What must hold of any forest on the exact split: sizes, importances that sum to 1, accuracy above 0.97."""
    model, test = trained_forest(spark, sf)
    scored = model.score(test).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("error").cast("long").alias("n_positive"),
        (F.avg((F.col("y_pred") == F.col("error")).cast("double")) > 0.97).alias("accurate"))
    total = model.importance().agg(F.round(F.sum("importance"), 6).alias("importance_sum")).first()[0]
    return scored.withColumn("importance_sum", F.lit(total)).withColumn("n_train", F.lit(model.n_train_rows).cast("long"))


from qforge.plans import catalog_results  # noqa: E402, F401 - registers its queries here
