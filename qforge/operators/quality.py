"""Data-quality indices (A1-A4).

Per column, over all rows n:
  CQI = (1 - missing / n) * 100        completeness
  UQI = distinct non-null / n * 100     uniqueness
  VQI = in-range / n * 100              validity, both ends inclusive, NULL invalid
  DQI = (CQI + VQI) / 2                 (UQI is not part of DQI)
The default valid range is Q1 - 1.5 IQR .. Q3 + 1.5 IQR with exact
linear-interpolated quartiles; a user range overrides it per column.
Every value is rounded to 2 decimals; n = 0 gives 0.

Plan: a profile job (count/min/max), the quartile refinement passes
(bounded histograms), then ONE scan for all columns: every cell is a slim
row (column number, value), counted by value in its task and shuffled by
value, never funnelled into one task. The values' counts give rows, missing,
distinct and (against literal bounds) in-range numbers together. (Spark's own
plan for many distinct counts copies the whole row once a column.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col, dlit
from qforge.functions.order_stats import exact_quantiles
from qforge.functions.stats import ColumnStats

GRADES = [(90.0, "Excellent"), (75.0, "Good"), (60.0, "Fair")]


def iqr_ranges(df: DataFrame, cols: list[str], k: float = 1.5,
               profile: dict | None = None) -> dict[str, tuple[float | None, float | None]]:
    """Q1 - k*IQR, Q3 + k*IQR per column (exact quartiles)."""
    qs = exact_quantiles(df, cols, [0.25, 0.75], profile=profile)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - k * iqr, q3 + k * iqr)
    return out


def _fmt_range(lo, hi) -> str:
    f = lambda v: "nan" if v is None else f"{v:.2f}"
    return f"[{f(lo)}, {f(hi)}]"


def quality_indices(df: DataFrame, cols: list[str],
                    valid_ranges: dict[str, tuple[float, float]] | None = None,
                    stats: ColumnStats | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column: column, CQI, UQI, VQI, DQI, valid_range.

    ``distinct="approx"`` counts distinct values with HyperLogLog++ (about
    1% error, no shuffle of the values) for very high-cardinality columns;
    the default is exact.
    """
    wide, rows = _quality_rows(df, cols, valid_ranges, stats, distinct)
    return wide.select(F.inline(F.array(*rows))).drop("n_rows")


def _quality_rows(df: DataFrame, cols: list[str], valid_ranges, stats,
                  distinct: str = "exact") -> tuple[DataFrame, list[Column]]:
    """The one-row aggregate and, over it, one struct per column."""
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    valid_ranges = valid_ranges or {}
    need = [c for c in cols if c not in valid_ranges]
    ranges = dict(valid_ranges)
    if need and stats is not None and stats.has(need, (0.25, 0.75)):
        for c in need:
            q1, q3 = stats.q(c, 0.25), stats.q(c, 0.75)
            ranges[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    elif need:
        ranges.update(iqr_ranges(df, need))

    if distinct == "exact":
        return _by_value(df, cols, ranges), _index_structs(cols, ranges)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = as_double(c)
        lo, hi = ranges[c]
        valid = F.lit(0).cast("long") if lo is None else F.count_if(x.between(dlit(lo), dlit(hi)))
        own = x if df.schema[c].dataType.typeName() in FRACTIONAL else col(c)
        aggs += [F.count(x).alias(f"nn{i}"), F.approx_count_distinct(own, 0.01).alias(f"d{i}"), valid.alias(f"v{i}")]
    return df.agg(*aggs), _index_structs(cols, ranges)


FRACTIONAL, INTEGRAL = ("float", "double"), ("byte", "short", "integer", "long")


def _by_value(df: DataFrame, cols: list[str], ranges: dict) -> DataFrame:
    """One row: n, and per column nn (present), d (distinct) and v (in range), from one grouping by (column, value)."""
    def cell(i: int, c: str) -> Column:
        # a value keeps its own kind: 64-bit integers lose digits as doubles
        kind = df.schema[c].dataType.typeName()
        none = {"x": F.lit(None).cast("double"), "k": F.lit(None).cast("long"), "s": F.lit(None).cast("string")}
        own = {"x": as_double(c)} if kind in FRACTIONAL else {"k": col(c).cast("long")} if kind in INTEGRAL else {"s": col(c).cast("string")}
        return F.struct(F.lit(i).alias("ci"), *[v.alias(n) for n, v in {**none, **own}.items()])
    counts = (df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).groupBy("ci", "x", "k", "s").agg(F.count(F.lit(1)).alias("n")))
    value = F.coalesce("x", F.col("k").cast("double"), F.expr("try_cast(s AS DOUBLE)"))
    inside = F.lit(False)
    for i, c in enumerate(cols):
        if ranges[c][0] is not None:
            inside = F.when(F.col("ci") == i, value.between(dlit(ranges[c][0]), dlit(ranges[c][1]))).otherwise(inside)
    here = F.col("x").isNotNull() | F.col("k").isNotNull() | F.col("s").isNotNull()
    each = counts.groupBy("ci").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("nn"),
                                    F.count_if(here).alias("d"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("v"))
    wide = [F.coalesce(F.max(F.when(F.col("ci") == i, F.col(k))), F.lit(0)).alias(f"{k}{i}") for i in range(len(cols)) for k in ("nn", "d", "v")]
    return each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *wide)             # a row a column


def _index_structs(cols, ranges) -> list[Column]:
    n = F.col("n").cast("double")
    rows = []
    for i, c in enumerate(cols):
        def idx(expr: Column) -> Column:
            return F.when(F.col("n") > 0, expr).otherwise(F.lit(0.0))
        cqi = idx((F.lit(1.0) - (n - F.col(f"nn{i}")) / n) * F.lit(100.0))
        uqi = idx(F.col(f"d{i}") / n * F.lit(100.0))
        vqi = idx(F.col(f"v{i}") / n * F.lit(100.0))
        rows.append(F.struct(
            F.lit(c).alias("column"),
            F.round(cqi, 2).alias("CQI"),
            F.round(uqi, 2).alias("UQI"),
            F.round(vqi, 2).alias("VQI"),
            F.round((cqi + vqi) / F.lit(2.0), 2).alias("DQI"),
            F.lit(_fmt_range(*ranges[c])).alias("valid_range"),
            F.col("n").alias("n_rows"),
        ))
    return rows


def grade(dqi: Column) -> Column:
    """Excellent >= 90, Good >= 75, Fair >= 60, else Poor."""
    expr = None
    for cut, name in GRADES:
        expr = F.when(dqi >= cut, name) if expr is None else expr.when(dqi >= cut, name)
    return expr.otherwise("Poor")


def quality_summary(indices: DataFrame) -> DataFrame:
    """A2: means of the (already rounded) per-column indices, rounded again."""
    return indices.agg(
        F.round(F.avg("CQI"), 2).alias("avg_cqi"),
        F.round(F.avg("UQI"), 2).alias("avg_uqi"),
        F.round(F.avg("VQI"), 2).alias("avg_vqi"),
        F.round(F.avg("DQI"), 2).alias("avg_dqi"),
        F.round(F.avg("DQI"), 2).alias("overall_dqi"),
    )


def quality_report(df: DataFrame, cols: list[str],
                   valid_ranges: dict[str, tuple[float, float]] | None = None,
                   stats: ColumnStats | None = None, distinct: str = "exact") -> DataFrame:
    """A4: per-column rows plus one overall row, each with a grade.

    Columns: scope ('column' | 'overall'), column, CQI, UQI, VQI, DQI,
    grade, total_rows, columns_evaluated. All rows are unfolded from the
    one-row aggregate, so the table is aggregated once.
    """
    wide, structs = _quality_rows(df, cols, valid_ranges, stats, distinct)
    wide = wide.select(F.array(*structs).alias("c"))

    def row(scope, name, idx: dict[str, Column], total) -> Column:
        return F.struct(F.lit(scope).alias("scope"), name.alias("column"), *[v.alias(k) for k, v in idx.items()],
                        grade(idx["DQI"]).alias("grade"), total.alias("total_rows"))

    names = ("CQI", "UQI", "VQI", "DQI")
    per_col = F.transform("c", lambda r: row("column", r["column"], {k: r[k] for k in names}, r["n_rows"]))
    mean = {k: F.round(sum((F.col("c")[i][k] for i in range(len(cols))), F.lit(0.0)) / F.lit(float(len(cols))), 2)
            for k in names}
    overall = row("overall", F.lit(None).cast("string"), mean, F.col("c")[0]["n_rows"])
    return wide.select(F.inline(F.concat(per_col, F.array(overall)))).select(
        "*", F.lit(len(cols)).cast("int").alias("columns_evaluated"))
