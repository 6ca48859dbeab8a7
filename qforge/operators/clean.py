"""Cleaning operators (C1-C7): missing values and z-score outliers.

Statistics are fitted in one aggregate job (a single bounded row) and
applied as literals, so the filtering step is a narrow, codegen'd
``Filter`` over the scan: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col, dlit, is_missing, is_numeric, pct


def _all(conds: list[Column]) -> Column:
    if not conds:
        return F.lit(True)
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


# ---------------------------------------------------------------- C1
def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: column_name, missing_count (NULL, or NaN for floats)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])))


def total_missing(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Aggregate expression: number of missing cells."""
    cols = cols or df.columns
    total = F.lit(0).cast("long")
    for c in cols:
        total = total + F.count_if(is_missing(df, c))
    return total


# ---------------------------------------------------------------- C2
def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows holding a NULL (or NaN) in any column of ``subset`` (default: all)."""
    cols = subset or df.columns
    return df.where(_all([~is_missing(df, c) for c in cols]))


# ---------------------------------------------------------------- C3
def column_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def fill_missing_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill missing numeric values with the column mean (nulls skipped).

    Non-numeric columns and all-null columns stay as they are. Integral
    columns that receive a fill become double, as in pandas.
    """
    return df.select(*[e.alias(c) for c, e in _fill_values(df, cols).items()])


# ---------------------------------------------------------------- C5
@dataclass
class ZScoreModel:
    """Fitted z-score parameters: population mean / std per column."""
    threshold: float
    stats: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def keep(self) -> Column:
        """Row predicate: |z| < threshold strictly in every column.

        A NULL value, an undefined std (no rows) or a zero std (constant
        column, 0/0) makes z undefined and the row is dropped.
        """
        conds = []
        for c, (m, s) in self.stats.items():
            if m is None or s is None or s == 0.0:
                conds.append(F.lit(False))
            else:
                z = F.abs((as_double(c) - dlit(m)) / dlit(s))
                conds.append(F.coalesce(z < F.lit(float(self.threshold)), F.lit(False)))
        return _all(conds)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.where(self.keep())


def fit_zscore(df: DataFrame, cols: list[str], threshold: float = 3.0) -> ZScoreModel:
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(as_double(c)).alias(f"m{i}"), F.stddev_pop(as_double(c)).alias(f"s{i}"))]).first()
    return ZScoreModel(threshold, {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)})


def zscore_filter(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Keep rows whose |z| (population std, nulls omitted) is below threshold in all cols."""
    return fit_zscore(df, cols, threshold).transform(df)


# ---------------------------------------------------------------- C4 / C6
@dataclass
class CleanResult:
    cleaned: DataFrame
    summary: DataFrame
    zscore: ZScoreModel


def _fill_values(df: DataFrame, cols: list[str] | None) -> dict[str, Column]:
    """Column -> expression after mean filling (only columns with gaps change)."""
    numeric = [c for c in (cols or df.columns) if is_numeric(df, c)]
    out = {c: col(c) for c in df.columns}
    if not numeric:
        return out
    row = df.agg(*[e for i, c in enumerate(numeric) for e in (
        F.avg(as_double(c)).alias(f"m{i}"), F.count_if(is_missing(df, c)).alias(f"z{i}"))]).first()
    for i, c in enumerate(numeric):
        if row[f"z{i}"] > 0 and row[f"m{i}"] is not None:
            out[c] = F.coalesce(as_double(c), dlit(row[f"m{i}"]))
    return out


def _clean_plan(df: DataFrame, num_cols: list[str], missing_method: str, outlier_threshold: float,
                subset: list[str] | None):
    """after-missing values, the keep flags, the fitted z model and the counter expressions."""
    if missing_method == "drop":
        after = {c: col(c) for c in df.columns}
        kept = _all([~is_missing(df, c) for c in (subset or df.columns)])
    elif missing_method == "fill":
        after = _fill_values(df, subset)
        kept = F.lit(True)
    else:
        raise ValueError("missing_method must be 'drop' or 'fill'")
    after_missing = df.where(kept).select(*[e.alias(c) for c, e in after.items()])
    zs = fit_zscore(after_missing, num_cols, outlier_threshold)
    # one projection carries the input's missing flags and the after-missing values
    proj = df.select(*[e.alias(c) for c, e in after.items()], kept.alias("__kept"),
                     *[is_missing(df, c).alias(f"__m{i}") for i, c in enumerate(df.columns)])
    k = F.col("__kept")
    missing_before = F.lit(0).cast("long")
    for i in range(len(df.columns)):
        missing_before = missing_before + F.count_if(F.col(f"__m{i}"))
    missing_after = F.lit(0).cast("long")
    for c in after:
        missing_after = missing_after + F.count_if(k & is_missing(proj, c))
    counters = [F.count(F.lit(1)).alias("original_rows"), missing_before.alias("missing_before"),
                missing_after.alias("missing_after"), F.count_if(k).alias("rows_after_missing"),
                F.count_if(k & zs.keep()).alias("final_rows")]
    return after_missing, zs, proj, counters


def _summary(counts: DataFrame, missing_method: str, outlier_threshold: float) -> DataFrame:
    return counts.select(
        F.lit(missing_method).alias("missing_method"),
        F.lit(float(outlier_threshold)).alias("outlier_threshold"),
        "original_rows", "missing_before", "missing_after", "rows_after_missing",
        (F.col("original_rows") - F.col("rows_after_missing")).alias("removed_missing_rows"),
        (F.col("rows_after_missing") - F.col("final_rows")).alias("removed_outlier_rows"),
        pct(F.col("rows_after_missing") - F.col("final_rows"), F.col("rows_after_missing")).alias("outlier_removal_rate"),
        "final_rows",
        (F.col("original_rows") - F.col("final_rows")).alias("total_removed_rows"),
    )


def clean(df: DataFrame, num_cols: list[str], missing_method: str = "drop",
          outlier_threshold: float = 3.0, subset: list[str] | None = None) -> CleanResult:
    """C1 -> C2/C3 -> C5 with counters.

    The z-score statistics are fitted on the data *after* missing-value
    handling. All counters come from ONE aggregate over the input: the
    after-missing values and the fitted z predicate are evaluated on a
    projection of it, so no intermediate table is counted separately.
    """
    after_missing, zs, proj, counters = _clean_plan(df, num_cols, missing_method, outlier_threshold, subset)
    summary = _summary(proj.agg(*counters), missing_method, outlier_threshold)
    return CleanResult(zs.transform(after_missing), summary, zs)


def clean_summary(df: DataFrame, num_cols: list[str], missing_method: str = "drop",
                  outlier_threshold: float = 3.0) -> DataFrame:
    return clean(df, num_cols, missing_method, outlier_threshold).summary


def select_features(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Feature / target projection by name."""
    cols = list(features) + ([target] if target else [])
    return df.select(*[col(c) for c in cols])


__all__ = [
    "missing_counts", "total_missing", "drop_missing", "fill_missing_mean", "column_means",
    "ZScoreModel", "fit_zscore", "zscore_filter", "CleanResult", "clean", "clean_summary",
    "select_features",
]
