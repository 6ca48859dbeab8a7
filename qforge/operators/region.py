"""Safe operating region.

A parameter grid over feature bounds is scored by any scorer (a model,
or a closed-form rule); the points whose defect probability is strictly
below the threshold are summarised as a bounding box. The grid is
generated by ``spark.range`` with index arithmetic - no cartesian join -
so it parallelises over any resolution.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, dlit
from qforge.functions.order_stats import column_profile, exact_quantiles
from qforge.functions.stats import ColumnStats


def feature_bounds(df: DataFrame, cols: list[str], method: str = "quantile",
                   q: tuple[float, float] = (0.05, 0.95),
                   stats: ColumnStats | None = None) -> dict[str, tuple[float, float]]:
    """R1 (interpolated quantiles, default 5% / 95%) or R2 (min / max)."""
    if stats is not None and method == "minmax" and stats.has(cols):
        return {c: (stats.min[c], stats.max[c]) for c in cols}
    if stats is not None and method == "quantile" and stats.has(cols, q):
        return {c: (stats.q(c, q[0]), stats.q(c, q[1])) for c in cols}
    if method == "minmax":
        prof = column_profile(df, {c: as_double(c) for c in cols})
        return {c: (prof[c][1], prof[c][2]) for c in cols}
    if method != "quantile":
        raise ValueError("method must be 'quantile' or 'minmax'")
    qs = exact_quantiles(df, cols, list(q))
    return {c: (qs[c][0], qs[c][1]) for c in cols}


def linspace_value(i: Column, lo: float, hi: float, n: int) -> Column:
    """Point i of n evenly spaced values from lo to hi, both ends included."""
    if n == 1:
        return dlit(lo)
    step = (hi - lo) / (n - 1)
    return F.when(i == n - 1, dlit(hi)).otherwise(i.cast("double") * dlit(step) + dlit(lo))


def param_grid(spark: SparkSession, bounds: dict[str, tuple[float, float]],
               sizes: dict[str, int], num_partitions: int | None = None) -> DataFrame:
    """Cartesian grid, first feature varying slowest. Columns: point_id, features."""
    cols = list(bounds)
    total = 1
    for c in cols:
        total *= int(sizes[c])
    ids = spark.range(0, total, 1, num_partitions) if num_partitions else spark.range(total)
    out = [F.col("id").alias("point_id")]
    stride = total
    for c in cols:
        n = int(sizes[c])
        stride //= n
        i = (F.col("id") / F.lit(stride)).cast("long") % F.lit(n)
        lo, hi = bounds[c]
        out.append(linspace_value(i, lo, hi, n).alias(c))
    return ids.select(*out)


def safe_region(scored: DataFrame, cols: list[str], prob_col: str = "p_defect",
                threshold: float = 0.05) -> DataFrame:
    """One row with status, bounds of the safe points and counts.

    Columns: status ('success' | 'no_safe_region'), prob_threshold,
    <f>_min / <f>_max per feature, n_safe_points, n_total_points,
    safe_ratio (percent, 2 decimals). The box bounds the safe points; it is
    not guaranteed safe everywhere inside.
    """
    safe = F.col(prob_col) < dlit(threshold)
    aggs = [F.count(F.lit(1)).alias("n_total_points"), F.count_if(safe).alias("n_safe_points")]
    for c in cols:
        aggs += [F.min(F.when(safe, F.col(c))).alias(f"{c}_min"), F.max(F.when(safe, F.col(c))).alias(f"{c}_max")]
    agg = scored.agg(*aggs)
    return agg.select(
        F.when(F.col("n_safe_points") > 0, "success").otherwise("no_safe_region").alias("status"),
        dlit(threshold).alias("prob_threshold"),
        *[F.col(f"{c}_{e}") for c in cols for e in ("min", "max")],
        "n_safe_points", "n_total_points",
        F.round(F.coalesce(F.try_divide(F.col("n_safe_points") * 100.0, F.col("n_total_points")),
                           F.lit(0.0)), 2).alias("safe_ratio"),
    )


def safe_points(scored: DataFrame, cols: list[str], prob_col: str = "p_defect", threshold: float = 0.05) -> DataFrame:
    """The points themselves whose defect probability is strictly below the threshold."""
    return scored.where(F.col(prob_col) < dlit(threshold)).select(*cols, prob_col)


def safe_region_json(region: DataFrame, cols: list[str]) -> DataFrame:
    """R6 nested shape as one JSON string column ``result``."""
    rng = F.struct(*[F.struct(F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max")).alias(c)
                     for c in cols])
    ok = F.struct(F.col("status"), F.col("prob_threshold"), rng.alias("safe_range"),
                  F.col("n_safe_points"), F.col("n_total_points"), F.col("safe_ratio"))
    none = F.struct(F.col("status"), F.lit("no safe operating region inside the searched range").alias("message"))
    return region.select(F.when(F.col("status") == "success", F.to_json(ok))
                         .otherwise(F.to_json(none)).alias("result"))


def estimate_safe_region(spark: SparkSession, scorer: Callable[[DataFrame], DataFrame],
                         bounds: dict[str, tuple[float, float]], sizes: dict[str, int],
                         threshold: float = 0.05, prob_col: str = "p_defect") -> DataFrame:
    """Grid -> scorer (adds ``prob_col``) -> summary row."""
    grid = param_grid(spark, bounds, sizes)
    return safe_region(scorer(grid), list(bounds), prob_col, threshold)


def analyze_safe_region(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], cols: list[str],
                        sizes: dict[str, int], threshold: float = 0.05, bounds: str = "minmax",
                        prob_col: str = "p_defect") -> DataFrame:
    """Data bounds (minmax or 5-95% quantile) -> R4."""
    b = feature_bounds(df, cols, method=bounds)
    return estimate_safe_region(df.sparkSession, scorer, b, sizes, threshold, prob_col)


DEFAULT_SIZES = {"temp": 20, "humid": 20, "press": 10}
