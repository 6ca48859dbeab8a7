"""Exploratory statistics as tables (A5-A10).

The source system draws charts; here each chart's numbers are a DataFrame.
All of them come from global aggregates with map-side partial
aggregation, so shuffled data is bounded by (#columns x #bins) or
(#columns^2), never by the number of rows.

Operators accept a precomputed ``ColumnStats`` (moments + quantiles);
``eda_report`` computes it once and fuses the box-plot, correlation and
label-summary aggregates into one scan.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col, dlit, is_missing
from qforge.functions.stats import ColumnStats, column_stats
from qforge.session import compiled_methods

QUARTILES = (0.25, 0.5, 0.75)

#: Columns up to which correlations are one aggregate; columns a block, and pairs of blocks a task adds up (3 MB each).
NARROW, GRAM_BLOCK, GRAM_PAIRS = 16, 256, 64
#: Share of the squares about the mean at which a pair's variance is too close to rounding.
NEARLY_CONSTANT = 1e-9


def _stats(df: DataFrame, cols: list[str], stats: ColumnStats | None, probs=QUARTILES) -> ColumnStats:
    if stats is not None and stats.has(cols, probs):
        return stats
    return column_stats(df, cols, probs)


# ---------------------------------------------------------------- A5
DESCRIBE_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def describe_numeric(df: DataFrame, cols: list[str], digits: int = 3,
                     stats: ColumnStats | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75% (interpolated), max; rounded.

    Not ``DataFrame.summary()``: its percentiles are approximate nearest-rank.
    Built from the fitted statistics (one row per column), so it costs no
    scan beyond the statistics themselves.
    """
    st = _stats(df, cols, stats)
    rows = [(c, st.count[c], st.mean[c], st.std_samp[c], st.min[c], st.q(c, 0.25), st.q(c, 0.5),
             st.q(c, 0.75), st.max[c]) for c in cols]
    base = df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return base.select("column", "count", *[F.round(c, digits).alias(c) for c in DESCRIBE_STATS[1:]])


def data_summary(df: DataFrame, num_cols: list[str], digits: int = 3, stats: ColumnStats | None = None) -> DataFrame:
    """A5 with the table's shape: a row a column, in the table's order.

    n_rows and n_cols (the shape), position, column, dtype, na_count, and for ``num_cols`` the numbers of ``describe_numeric``.
    """
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(is_missing(df, c)).alias(f"z{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"z{i}").alias("na_count")) for i, c in enumerate(cols)]
    shape = wide.select("n_rows", F.lit(len(cols)).alias("n_cols"), F.inline(F.array(*rows)))
    return shape.join(F.broadcast(describe_numeric(df, num_cols, digits, stats)), "column", "left").select(      # a row a column
        "n_rows", "n_cols", "position", "column", "dtype", "na_count", *DESCRIBE_STATS)


# ---------------------------------------------------------------- A6
def _edges(lo: float, hi: float, bins: int) -> tuple[float, float, float]:
    """Histogram range (widened by 0.5 each side when constant) and step."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return lo, hi, (hi - lo) / bins


def histogram(df: DataFrame, cols: list[str], bins: int = 30, stats: ColumnStats | None = None) -> DataFrame:
    """Equal-width bins per column over its own min..max; last bin closed.

    Columns: column, bin (0-based), bin_lo, bin_hi, count. Bin edges are
    ``lo + i*step`` with the last edge exactly ``hi``; a value is placed by
    the scaled index and then corrected against those edges, so values on
    an edge land where an edge-exact histogram puts them. Empty bins are
    listed with count 0; nulls are skipped.
    """
    spark = df.sparkSession
    st = _stats(df, cols, stats, ())
    meta = []
    for i, c in enumerate(cols):
        if st.count[c] == 0:
            continue
        if not (math.isfinite(st.min[c]) and math.isfinite(st.max[c])):
            raise ValueError(f"histogram range of {c!r} is not finite: [{st.min[c]}, {st.max[c]}]")
        lo, hi, step = _edges(st.min[c], st.max[c], bins)
        meta.append((i, c, lo, hi, step))
    schema = "column string, bin int, bin_lo double, bin_hi double, count long"
    if not meta:
        return spark.createDataFrame([], schema)

    def edge(k, lo, hi, step):
        return F.when(k >= bins, dlit(hi)).otherwise(k.cast("double") * dlit(step) + dlit(lo))

    # one projection per step, so each intermediate bin index is computed once per row
    x = {i: F.col(f"_x{i}") for i, *_ in meta}
    b = {i: F.col(f"_b{i}") for i, *_ in meta}
    staged = df.select(*[as_double(c).alias(f"_x{i}") for i, c, *_ in meta])
    staged = staged.select(*[x[i] for i, *_ in meta], *[
        F.least(F.floor((x[i] - dlit(lo)) * dlit(bins / (hi - lo))).cast("int"), F.lit(bins - 1)).alias(f"_b{i}")
        for i, _, lo, hi, _ in meta])
    staged = staged.select(*[x[i] for i, *_ in meta], *[
        F.when(x[i] < edge(b[i], lo, hi, step), b[i] - 1).otherwise(b[i]).alias(f"_b{i}")
        for i, _, lo, hi, step in meta])
    staged = staged.select(*[x[i] for i, *_ in meta], *[
        F.when((x[i] >= edge(b[i] + 1, lo, hi, step)) & (b[i] != bins - 1), b[i] + 1).otherwise(b[i]).alias(f"_b{i}")
        for i, _, lo, hi, step in meta])
    structs = [F.struct(F.lit(i).alias("ci"), b[i].alias("bin"), x[i].alias("x")) for i, *_ in meta]
    counts = (staged.select(F.inline(F.array(*structs)))
                .where(F.col("x").isNotNull())
                .groupBy("ci", "bin").agg(F.count(F.lit(1)).alias("count")))
    # skeleton of every (column, bin): generated, bounded by #columns x bins
    ids = F.array(*[F.lit(i) for i, *_ in meta])
    skeleton = (spark.range(len(meta) * bins)
                .select(F.element_at(ids, (F.col("id") / bins).cast("int") + 1).alias("ci"),
                        (F.col("id") % bins).cast("int").alias("bin")))
    pos = _pos(meta)
    name = F.element_at(F.array(*[F.lit(c) for _, c, *_ in meta]), pos)
    los = F.element_at(F.array(*[dlit(lo) for *_, lo, _, _ in meta]), pos)
    his = F.element_at(F.array(*[dlit(hi) for *_, hi, _ in meta]), pos)
    steps = F.element_at(F.array(*[dlit(s) for *_, s in meta]), pos)
    b = F.col("bin")
    # the counts side has at most #columns x bins rows by construction
    return (skeleton.join(F.broadcast(counts), ["ci", "bin"], "left")
            .select(name.alias("column"), b.alias("bin"),
                    (b.cast("double") * steps + los).alias("bin_lo"),
                    F.when(b + 1 >= bins, his).otherwise((b + 1).cast("double") * steps + los).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def _pos(meta):
    """1-based position of the row's column index within ``meta``."""
    expr = None
    for p, (i, *_rest) in enumerate(meta, start=1):
        expr = F.when(F.col("ci") == i, p) if expr is None else expr.when(F.col("ci") == i, p)
    return expr


# ---------------------------------------------------------------- A7
def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when either is constant.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant
    column, so it is written as covariance / (std * std) with try_divide.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _corr_parts(cols: list[str], digits: int):
    aggs, pairs = [], {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            pairs[(i, j)] = f"corr_{i}_{j}"
            aggs.append(pearson(as_double(a), as_double(cols[j])).alias(pairs[(i, j)]))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = F.nanvl(F.col(pairs[(min(i, j), max(i, j))]), F.lit(None).cast("double"))
            rows.append((a, b, F.round(v, digits)))
    return aggs, rows


def correlation(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation for every ordered pair (x, y), pairwise complete.

    A constant column gives NULL (also on its diagonal). Up to ``NARROW`` columns are one aggregate with an
    expression a pair; more are summed as blocks of a Gram matrix (``correlation_wide``), whose plan grows
    with the columns only.
    """
    if len(cols) > NARROW:
        return correlation_wide(df, cols, digits)
    aggs, rows = _corr_parts(cols, digits)
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), v.alias("corr")) for a, b, v in rows])))


def correlation_wide(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """``correlation`` of many columns by blocked Gram matrices with masks for missing values.

    A task adds up, over its Arrow batches and for each pair of column blocks, the products X'X, X'M, (X*X)'M and M'M
    of the values (less a centre of the task's own, the mean of the first values it met; missing ones 0) and their masks, with
    the least and largest value of a column: all that pairwise-complete correlation needs, in one scan. One row a task and
    pair is moved to the column's mean over all tasks and summed. Pairs that are nearly constant where both are present are
    too close to rounding for sums; they are computed again by ``pearson``.
    """
    spark, k = df.sparkSession, len(cols)
    rows = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(cols)])
    sums = ["si", "sj", "qi", "qj", "p"]
    doubles = ["ci", "cj", *sums, "lo", "hi"]
    schema = ", ".join(["i int", "j int", "n long", *[f"{c} double" for c in doubles]])
    blocks = [(a, min(a + GRAM_BLOCK, k)) for a in range(0, k, GRAM_BLOCK)]
    pairs = [(x, y) for n, x in enumerate(blocks) for y in blocks[n:]]

    def gram(mine):
        def run(batches):
            total, centre, low, high = None, np.full(k, np.nan), np.full(k, np.nan), np.full(k, np.nan)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns], axis=1)
                low, high = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
                if np.isnan(centre).any():                # columns without a value so far have added nothing
                    finite = np.isfinite(x)
                    mean = np.where(finite, x, 0.0).sum(axis=0) / np.where(finite.any(axis=0), finite.sum(axis=0), np.nan)
                    centre = np.where(np.isnan(centre), mean, centre)
                x -= np.nan_to_num(centre)
                m = ~np.isnan(x)
                x, m = np.where(m, x, 0.0), m.astype(np.float64)
                q = x ** 2
                now = [(x[:, a:b].T @ x[:, c:d], x[:, a:b].T @ m[:, c:d], m[:, a:b].T @ x[:, c:d],
                        q[:, a:b].T @ m[:, c:d], m[:, a:b].T @ q[:, c:d], m[:, a:b].T @ m[:, c:d]) for (a, b), (c, d) in mine]
                total = now if total is None else [tuple(u + v for u, v in zip(s, t)) for s, t in zip(total, now)]
            centre = np.nan_to_num(centre)
            for ((a, b), (c, d)), (p, si, sj, qi, qj, n) in zip(mine, total or []):
                i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
                keep = i <= j
                i, j = i[keep], j[keep]
                ends = [pa.array(np.where(i == j, v[i], np.nan), from_pandas=True) for v in (low, high)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[keep].astype(np.int64)), pa.array(centre[i]), pa.array(centre[j]),
                     *[pa.array(v[keep]) for v in (si, sj, qi, qj, p)], *ends], names=["i", "j", "n", *doubles])
        return run
    # a job adds up as many block pairs as fit in a task
    parts = [rows.mapInArrow(gram(pairs[at:at + GRAM_PAIRS]), schema) for at in range(0, len(pairs), GRAM_PAIRS)]
    with compiled_methods(spark):
        tasks = functools.reduce(DataFrame.unionAll, parts).checkpoint()      # columns squared numbers a task
    whole = tasks.where("i = j").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                                  F.try_divide(F.sum(F.col("n") * F.col("ci") + F.col("si")), F.sum("n")).alias("mean")).collect()
    prof = {r["i"]: r for r in whole}                     # a row a column
    flat = {i for i in range(k) if i not in prof or prof[i]["lo"] is None or prof[i]["lo"] == prof[i]["hi"]}      # no or one value: NULL
    used = [i for i in range(k) if i not in flat]
    means = spark.createDataFrame([(i, prof[i]["mean"]) for i in used], "at int, mean double")
    moved = tasks.join(F.broadcast(means.select(F.col("at").alias("i"), F.col("mean").alias("mi"))), "i").join(
        F.broadcast(means.select(F.col("at").alias("j"), F.col("mean").alias("mj"))), "j")
    n, si, sj, di, dj = F.col("n"), F.col("si"), F.col("sj"), F.col("ci") - F.col("mi"), F.col("cj") - F.col("mj")
    got = moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(si + n * di).alias("si"), F.sum(sj + n * dj).alias("sj"), F.sum(F.col("qi") + 2 * di * si + n * di * di).alias("qi"),
        F.sum(F.col("qj") + 2 * dj * sj + n * dj * dj).alias("qj"), F.sum(F.col("p") + di * sj + dj * si + n * di * dj).alias("p"))
    n = F.col("n")
    spread = lambda s, q: F.col(q) - F.try_divide(F.col(s) * F.col(s), n)
    got = got.select("i", "j", "n", (F.col("p") - F.try_divide(F.col("si") * F.col("sj"), n)).alias("cov"),
                     spread("si", "qi").alias("vi"), spread("sj", "qj").alias("vj"),
                     ((spread("si", "qi") <= F.col("qi") * NEARLY_CONSTANT) | (spread("sj", "qj") <= F.col("qj") * NEARLY_CONSTANT)).alias("near"))
    got = got.checkpoint()                                # columns squared numbers
    value = F.when(n < 1, None).otherwise(F.try_divide("cov", F.sqrt("vi") * F.sqrt("vj")))
    out = got.where(~F.col("near") | (n < 1)).select("i", "j", value.alias("corr"))
    again = [(r["i"], r["j"]) for r in got.where(F.col("near") & (n > 0)).select("i", "j").collect()]
    for at in range(0, len(again), 200):
        some = again[at:at + 200]
        one = df.agg(*[pearson(as_double(cols[i]), as_double(cols[j])).alias(f"p{q}") for q, (i, j) in enumerate(some)])
        with compiled_methods(spark):
            one = one.checkpoint()
        out = out.unionByName(one.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{q}").alias("corr")) for q, (i, j) in enumerate(some)]))))
    both = out.unionByName(out.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    named = spark.createDataFrame([(i, cols[i]) for i in used], "at int, name string")       # a row a column
    x, y = named.select(F.col("at").alias("i"), F.col("name").alias("x")), named.select(F.col("at").alias("j"), F.col("name").alias("y"))
    clean = F.round(F.nanvl("corr", F.lit(None).cast("double")), digits)
    out = both.join(F.broadcast(x), "i").join(F.broadcast(y), "j").select("x", "y", clean.alias("corr"))
    empty = [(cols[i], cols[j]) for i in range(k) for j in range(k) if i in flat or j in flat]
    if empty:
        out = out.unionByName(spark.createDataFrame(empty, "x string, y string").withColumn("corr", F.lit(None).cast("double")))
    return out


# ---------------------------------------------------------------- A8
BOX_STATS = ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]


def _box_parts(cols: list[str], st: ColumnStats, whis: float):
    aggs, rows = [], []
    for i, c in enumerate(cols):
        q1, med, q3 = st.q(c, 0.25), st.q(c, 0.5), st.q(c, 0.75)
        if q1 is None:
            continue
        iqr = q3 - q1
        lo_f, hi_f = q1 - whis * iqr, q3 + whis * iqr
        x = as_double(c)
        aggs += [F.min(F.when(x >= dlit(lo_f), x)).alias(f"box_wl{i}"),
                 F.max(F.when(x <= dlit(hi_f), x)).alias(f"box_wh{i}"),
                 F.count_if((x < dlit(lo_f)) | (x > dlit(hi_f))).alias(f"box_o{i}")]
        wl = F.least(F.coalesce(F.col(f"box_wl{i}"), dlit(q1)), dlit(q1))
        wh = F.greatest(F.coalesce(F.col(f"box_wh{i}"), dlit(q3)), dlit(q3))
        rows.append((c, {"q1": F.round(dlit(q1), 6), "median": F.round(dlit(med), 6),
                         "q3": F.round(dlit(q3), 6), "iqr": F.round(dlit(q3 - q1), 6),
                         "whisker_low": F.round(wl, 6), "whisker_high": F.round(wh, 6),
                         "n_outliers": F.col(f"box_o{i}")}))
    return aggs, rows


def boxplot_stats(df: DataFrame, cols: list[str], whis: float = 1.5,
                  stats: ColumnStats | None = None) -> DataFrame:
    """q1, median, q3, whiskers (most extreme data within whis*IQR), outliers."""
    st = _stats(df, cols, stats)
    aggs, rows = _box_parts(cols, st, whis)
    schema = ("column string, q1 double, median double, q3 double, iqr double, "
              "whisker_low double, whisker_high double, n_outliers long")
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    order = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "n_outliers"]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[e[k].alias(k) for k in order]) for c, e in rows])))


# ---------------------------------------------------------------- A9
def label_distribution(df: DataFrame, label_col: str = "error") -> DataFrame:
    """Count per non-null label, ascending: label, count."""
    return (df.where(col(label_col).isNotNull())
              .groupBy(col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy("label"))


def _label_parts(label_col: str):
    y = col(label_col)
    aggs = [F.count(F.lit(1)).alias("lab_total"), F.count_if(y == 0).alias("lab_normal"),
            F.count_if(y == 1).alias("lab_error")]
    rate = F.round(F.coalesce(F.try_divide(F.col("lab_error") * 100.0, F.col("lab_total")), F.lit(0.0)), 2)
    return aggs, {"total": F.col("lab_total"), "normal_count": F.col("lab_normal"),
                  "error_count": F.col("lab_error"), "error_rate": rate}


def label_summary(df: DataFrame, label_col: str = "error") -> DataFrame:
    """total (null labels included), normal_count, error_count, error_rate %."""
    aggs, out = _label_parts(label_col)
    return df.agg(*aggs).select(*[v.alias(k) for k, v in out.items()])


# ---------------------------------------------------------------- A10
def _long(section: str, column: str | Column, stat: str | Column, value: Column) -> Column:
    c = F.lit(column) if isinstance(column, str) else column
    s = F.lit(stat) if isinstance(stat, str) else stat
    return F.struct(F.lit(section).alias("section"), c.alias("column"), s.alias("stat"),
                    value.cast("double").alias("value"))


def eda_tables(df: DataFrame, cols: list[str], label_col: str = "error", bins: int = 30,
               stats: ColumnStats | None = None) -> dict[str, DataFrame]:
    """A10 as separate tables on one set of statistics.

    describe comes from the statistics; box plot, correlation and label
    summary come from ONE fused aggregate (its single row is materialised
    and the three tables are cut from it); histogram and label counts are
    one grouping each. Three scans in total beyond the statistics.
    """
    st = _stats(df, cols, stats)
    box_aggs, box_rows = _box_parts(cols, st, 1.5)
    corr_aggs, corr_rows = _corr_parts(cols, 6)
    lab_aggs, lab_out = _label_parts(label_col)
    agg = df.agg(*box_aggs, *corr_aggs, *lab_aggs)
    wide = df.sparkSession.createDataFrame([agg.first()], agg.schema)  # bounded: one row
    order = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "n_outliers"]
    if box_rows:
        box = wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), *[e[k].alias(k) for k in order]) for c, e in box_rows])))
    else:
        box = df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, "
                                                  "iqr double, whisker_low double, whisker_high double, n_outliers long")
    return {
        "describe": describe_numeric(df, cols, stats=st),
        "histogram": histogram(df, cols, bins, stats=st),
        "correlation": wide.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), v.alias("corr")) for a, b, v in corr_rows]))),
        "boxplot": box,
        "label_distribution": label_distribution(df, label_col),
        "label_summary": wide.select(*[v.alias(k) for k, v in lab_out.items()]),
    }


def eda_long(tables: dict[str, DataFrame], label_col: str = "error") -> DataFrame:
    """The EDA tables as one long table: section, column, stat, value."""
    describe = tables["describe"].select(F.inline(F.array(*[
        _long("describe", F.col("column"), s, F.col(s)) for s in DESCRIBE_STATS])))
    hist = tables["histogram"].select(
        F.lit("histogram").alias("section"), "column",
        F.format_string("bin_%02d", F.col("bin")).alias("stat"), F.col("count").cast("double").alias("value"))
    corr = tables["correlation"].select(
        F.lit("correlation").alias("section"), F.col("x").alias("column"), F.col("y").alias("stat"),
        F.col("corr").alias("value"))
    box = tables["boxplot"].select(F.inline(F.array(*[
        _long("boxplot", F.col("column"), s, F.col(s)) for s in BOX_STATS])))
    labels = tables["label_distribution"].select(
        F.lit("label").alias("section"), F.lit(label_col).alias("column"),
        F.col("label").cast("string").alias("stat"), F.col("count").cast("double").alias("value"))
    summ = tables["label_summary"].select(F.inline(F.array(*[
        _long("label_summary", label_col, s, F.col(s))
        for s in ["total", "normal_count", "error_count", "error_rate"]])))
    return describe.unionByName(hist).unionByName(corr).unionByName(box).unionByName(labels).unionByName(summ)


def eda_report(df: DataFrame, cols: list[str], label_col: str = "error", bins: int = 30,
               stats: ColumnStats | None = None) -> DataFrame:
    """All EDA tables in one long table: section, column, stat, value."""
    return eda_long(eda_tables(df, cols, label_col, bins, stats), label_col)
