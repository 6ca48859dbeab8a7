"""Exact order statistics and quantiles that scale with the data.

Spark's exact ``percentile`` keeps a value->count map per group and merges
all of them in ONE final task, so on a high-cardinality double column of a
very large table it cannot finish. ``percentile_approx`` scales but is not
exact. Here the k-th smallest value is found by *histogram refinement*:

1. one aggregate gives count / min / max per input;
2. each pass bins the values inside the current candidate interval into
   ``bins`` equal-width buckets with a ``groupBy(interval, bin)`` (map-side
   combined, output bounded by ``#intervals x bins`` rows) and keeps the
   bucket holding the wanted rank, shrunk to its observed min / max;
3. an interval that holds at most ``small`` values (or a single distinct
   value) is resolved by fetching just those values.

Quantiles of up to ``WIDE_INPUTS`` columns start better: the first aggregate also builds a mergeable
KLL sketch a column (``profile_and_brackets``), whose quantiles a little below and above each wanted
share bracket its rank. One scan then counts the values of every bracket (value by value where few are
expected, else in bins) and of the gaps between them, which proves where each rank lies: two scans in
all for tables of up to some 700,000 values a column. A rank outside its bracket is searched on in the gap
that holds it, by the passes above, so the sketch decides the cost and never the result.

Only bounded summaries reach the driver. Each pass is one scan of the
needed columns; where the caller names the raw column (``raw``), later passes
carry a range filter on it that the scan can use. A hot
value (say a third of all rows equal to one number) is resolved as soon as
its bucket has min == max, so skew makes this faster, not slower.

Interpolated quantiles follow the "linear" definition shared by pandas,
Spark ``percentile`` and DuckDB ``quantile_cont``: position h = (n-1)*p,
result = x[floor h] + (h - floor h) * (x[ceil h] - x[floor h]).
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col

DEFAULT_BINS = 4096
DEFAULT_SMALL = 4096
MAX_PASSES = 200
# rows one pass may bring to the driver, over all intervals together
PASS_BUDGET = 1_000_000
# inputs of one pass up to which every interval is an expression of its own; more meet a table of intervals in a join,
# so the plan grows with the inputs only
WIDE_INPUTS = 8
# size of a sketch (about 100 kB) and the share by which a bracket reaches beyond a rank: twice the sketch's error at 99 %
SKETCH_K, SKETCH_MARGIN = 4096, 0.0026


@dataclass
class RankResult:
    value: float
    n_less: int
    n_equal: int


@dataclass
class _State:
    lo: float
    hi: float
    below: int
    cnt: int


def column_profile(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[int, float | None, float | None]]:
    """count (non-null), min, max for each named value expression in one job."""
    aggs = []
    for i, v in enumerate(values.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {name: (int(row[f"n{i}"]), row[f"a{i}"], row[f"b{i}"])
            for i, name in enumerate(values)}


def bracket_aggregate(x: Column) -> Column:
    """Sketch of a double column, to stand in the aggregate that counts it."""
    return F.kll_sketch_agg_double(x, F.lit(SKETCH_K))


def bracket_columns(sketch: str, count: str, probs: list[float]) -> Column:
    """Array of the values a margin below and above each share (null without values)."""
    shares = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    return F.when(F.col(count) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*map(F.lit, shares))))


def brackets_of(found: list[float] | None, probs: list[float], lo: float, hi: float) -> list[tuple[float, float]]:
    """The intervals of one column; an end that a share passes is the column's own."""
    if found is None:
        return []
    return [(lo if p <= SKETCH_MARGIN else found[2 * i], hi if p >= 1 - SKETCH_MARGIN else found[2 * i + 1]) for i, p in enumerate(probs)]


def profile_and_brackets(df: DataFrame, values: dict[str, Column], probs) -> tuple[dict, dict | None]:
    """``column_profile`` and, from the same scan, intervals around the wanted shares (None for many columns)."""
    probs = list(probs)
    if not values or len(values) > WIDE_INPUTS:
        return column_profile(df, values), None
    aggs = []
    for i, v in enumerate(values.values()):
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), bracket_aggregate(v).alias(f"k{i}")]
    row = df.agg(*aggs).select(*[F.col(f"{c}{i}") for i in range(len(values)) for c in "nab"],
                               *[bracket_columns(f"k{i}", f"n{i}", probs).alias(f"q{i}") for i in range(len(values))]).first()
    profile = {name: (int(row[f"n{i}"]), row[f"a{i}"], row[f"b{i}"]) for i, name in enumerate(values)}
    return profile, {name: brackets_of(row[f"q{i}"], probs, *profile[name][1:]) for i, name in enumerate(values)}


def order_statistics(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]],
                     profile: dict | None = None, bins: int = DEFAULT_BINS,
                     small: int = DEFAULT_SMALL, raw: dict[str, Column] | None = None,
                     brackets: dict | None = None) -> dict[str, dict[int, RankResult]]:
    """k-th smallest non-null value (0-based ranks) of each value expression.

    ``values`` maps a name to a double Column (NULL = not part of that
    population, which is how grouped selections such as "per label" are
    expressed). ``raw`` maps a name to the stored column its values are a cast
    of, ``brackets`` to intervals that probably hold the ranks. Returns name -> rank -> RankResult(value, n_less, n_equal).
    """
    if profile is None:
        profile = column_profile(df, {k: values[k] for k in ranks})
    out: dict[str, dict[int, RankResult]] = {k: {} for k in ranks}
    pending: dict[tuple[str, int], _State] = {}
    for name, rs in ranks.items():
        n, lo, hi = profile[name]
        for r in set(rs):
            if not 0 <= r < n:
                raise ValueError(f"rank {r} out of range for {name!r} with {n} values")
            if lo == hi:
                out[name][r] = RankResult(float(lo), 0, n)
            else:
                pending[(name, r)] = _State(float(lo), float(hi), 0, n)

    names = list(values)
    if brackets and pending:
        _from_brackets(df, values, names, brackets, profile, pending, out, bins, small)
    passes = 0
    while pending:
        passes += 1
        if passes > MAX_PASSES:
            raise RuntimeError("order statistics did not converge")
        # distinct candidate intervals; within one input they are disjoint
        intervals: dict[tuple, int] = {}
        for (name, _), st in pending.items():
            intervals.setdefault((name, st.lo, st.hi, st.below, st.cnt), len(intervals))
        # many inputs x ranks: fewer bins and a smaller fetch size per interval,
        # so one pass never returns more than PASS_BUDGET rows
        share = max(PASS_BUDGET // len(intervals), 16)
        eff_bins, eff_small = min(bins, share), min(small, share)
        wide = {k: g for k, g in intervals.items() if k[4] > eff_small}
        narrow = {k: g for k, g in intervals.items() if k[4] <= eff_small}
        hist = _histogram_pass(_in_ranges(df, names, raw, wide), values, names, wide, eff_bins) if wide else {}
        vals = _values_pass(_in_ranges(df, names, raw, narrow), values, names, narrow) if narrow else {}

        for key in list(pending):
            name, r = key
            st = pending[key]
            g = intervals[(name, st.lo, st.hi, st.below, st.cnt)]
            local = r - st.below
            if g in vals:
                xs = vals[g]
                v = xs[local]
                i0, i1 = bisect.bisect_left(xs, v), bisect.bisect_right(xs, v)
                out[name][r] = RankResult(v, st.below + i0, i1 - i0)
                del pending[key]
                continue
            cum = 0
            for _, c, mn, mx in hist[g]:
                if local < cum + c:
                    nst = _State(float(mn), float(mx), st.below + cum, int(c))
                    break
                cum += c
            else:  # pragma: no cover - counts always cover the interval
                raise RuntimeError("rank not found in histogram")
            if nst.lo == nst.hi:
                out[name][r] = RankResult(nst.lo, nst.below, nst.cnt)
                del pending[key]
            else:
                pending[key] = nst
    return out


def _from_brackets(df, values, names, brackets, profile, pending, out, bins, small) -> None:
    """One scan that counts all values by bracket, value (or bin) and gap; ranks found leave ``pending``, the others are narrowed."""
    used = [n for n in names if any(k[0] == n for k in pending) and brackets.get(n)]
    df, values = _staged(df, values, names, {(n, 0, 0, 0, 0): 0 for n in used})
    cells, segments = [], {}
    for k, name in enumerate(used):
        v, ivs = values[name], []
        for lo, hi in sorted(brackets[name]):
            if ivs and lo <= ivs[-1][1]:
                ivs[-1] = (ivs[-1][0], max(hi, ivs[-1][1]))
            else:
                ivs.append((lo, hi))
        share = max(PASS_BUDGET // (len(used) * len(ivs)), 16)
        few = 2 * SKETCH_MARGIN * profile[name][0] * len(brackets[name]) / len(ivs) <= min(small, share)
        g = key = None
        for j, (lo, hi) in enumerate(ivs):                # segments in order of value: gap, bracket, gap, ...
            span = hi * 0.5 - lo * 0.5
            scaled = (F.least(F.floor((v * 0.5 - F.lit(lo * 0.5)) / F.lit(span) * min(bins, share)), F.lit(min(bins, share) - 1))
                      if math.isfinite(span) and span > 0 else F.when(v == F.lit(lo), 0).when(v == F.lit(hi), 2).otherwise(1))
            inside = v if few else scaled.cast("double")
            g = F.when(v < F.lit(lo), 2 * j) if g is None else g.when(v < F.lit(lo), 2 * j)
            g = g.when(v <= F.lit(hi), 2 * j + 1)
            key = F.when(v < F.lit(lo), 0.0) if key is None else key.when(v < F.lit(lo), 0.0)
            key = key.when(v <= F.lit(hi), inside)
        cells.append(F.struct(F.lit(k).alias("c"), g.otherwise(2 * len(ivs)).alias("g"), key.otherwise(0.0).alias("k"), v.alias("x")))
        segments[k] = []
    rows = (df.select(F.inline(F.array(*cells))).where("x IS NOT NULL").groupBy("c", "g", "k")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")).limit(2 * PASS_BUDGET + 1).collect())
    if len(rows) > 2 * PASS_BUDGET:                       # the brackets hold far more values than the sketch said: search without them
        return
    for r in rows:
        segments[r["c"]].append((r["mn"], r["mx"], r["n"]))
    for k, name in enumerate(used):
        ordered = sorted(segments[k])
        sums = [0]
        for _, _, n in ordered:
            sums.append(sums[-1] + n)
        for key in [key for key in pending if key[0] == name]:
            at = bisect.bisect_right(sums, key[1]) - 1
            lo, hi, n = ordered[at]
            if lo == hi:
                out[name][key[1]] = RankResult(float(lo), sums[at], n)
                del pending[key]
            else:
                pending[key] = _State(float(lo), float(hi), sums[at], n)


def _interval_case(v: Column, ivs: list[tuple[int, float, float]], then) -> Column:
    expr = None
    for g, lo, hi in ivs:
        cond = v.between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, then(g, lo, hi)) if expr is None else expr.when(cond, then(g, lo, hi))
    return expr


def _by_input(names, sel):
    per: dict[str, list[tuple[int, float, float]]] = {}
    for (name, lo, hi, _, _), g in sel.items():
        per.setdefault(name, []).append((g, lo, hi))
    return [(n, per[n]) for n in names if n in per]


def _in_ranges(df, names, raw, sel):
    """Rows with a value in one of the intervals, told from the stored columns so that the filter reaches
    the scan. NaN is above every number, so it stays out as it does in the values."""
    per = _by_input(names, sel)
    if raw is None or len(per) > WIDE_INPUTS or any(name not in raw for name, _ in per):
        return df
    return df.where(_any([raw[name].between(F.lit(lo), F.lit(hi)) for name, ivs in per for _, lo, hi in ivs]))


def _staged(df, values, names, sel):
    """Project each needed value once (e.g. a hash), then refer to the column."""
    used = [name for name, _ in _by_input(names, sel)]
    cols = {name: F.col(f"_v{k}") for k, name in enumerate(used)}
    return df.select(*[values[name].alias(f"_v{k}") for k, name in enumerate(used)]), cols


def _met(df, values, names, sel):
    """(g, x, lo, hi, ends) of all values inside an interval; ``ends``: the span is infinite or too small to scale."""
    df, values = _staged(df, values, names, sel)
    per = _by_input(names, sel)
    cells = [F.struct(F.lit(k).alias("k"), values[name].alias("x")) for k, (name, _) in enumerate(per)]
    rows = df.select(F.inline(F.array(*cells))).where("x IS NOT NULL")
    table = df.sparkSession.createDataFrame(
        [(k, g, lo, hi, not (math.isfinite(lo) and math.isfinite(hi)) or hi * 0.5 - lo * 0.5 == 0.0) for k, (_, ivs) in enumerate(per) for g, lo, hi in ivs],
        "k int, g int, lo double, hi double, ends boolean")
    return rows.join(F.broadcast(table), "k").where(F.col("x").between(F.col("lo"), F.col("hi")))      # a row an interval


def _histogram_pass(df, values, names, sel, bins):
    if len(_by_input(names, sel)) > WIDE_INPUTS:
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
        scaled = F.least(F.floor(F.try_divide(x * 0.5 - lo * 0.5, hi * 0.5 - lo * 0.5) * bins).cast("int"), F.lit(bins - 1))
        b = F.when(~F.col("ends"), scaled).when(x == lo, 0).when(x == hi, bins - 1).otherwise(1)
        return _by_interval(_met(df, values, names, sel).select("g", b.alias("b"), "x"))
    df, values = _staged(df, values, names, sel)
    structs, conds = [], []
    for name, ivs in _by_input(names, sel):
        v = values[name]

        def bin_of(g, lo, hi, v=v):
            if not (math.isfinite(lo) and math.isfinite(hi)) or hi * 0.5 - lo * 0.5 == 0.0:
                # an infinite end (or a span too small to scale): each end its own
                # bucket; the values in between form one bucket the next pass splits
                return F.when(v == F.lit(lo), 0).when(v == F.lit(hi), bins - 1).otherwise(1)
            # halves avoid overflow of hi-lo; the map is monotone in v
            frac = (v * 0.5 - F.lit(lo * 0.5)) / F.lit(hi * 0.5 - lo * 0.5)
            return F.least(F.floor(frac * bins).cast("int"), F.lit(bins - 1))

        gid = _interval_case(v, ivs, lambda g, lo, hi: F.lit(g))
        b = _interval_case(v, ivs, bin_of)
        structs.append(F.struct(gid.alias("g"), b.alias("b"), v.alias("x")))
        conds.append(gid.isNotNull())
    return _by_interval(df.where(_any(conds)).select(F.inline(F.array(*structs))).where(F.col("g").isNotNull()))


def _by_interval(rows) -> dict[int, list]:
    rows = (rows.groupBy("g", "b")
              .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
              .collect())  # bounded: <= #intervals x bins <= PASS_BUDGET
    hist: dict[int, list] = {}
    for row in rows:
        hist.setdefault(row["g"], []).append((row["b"], row["c"], row["mn"], row["mx"]))
    for g in hist:
        hist[g].sort()
    return hist


def _values_pass(df, values, names, sel):
    if len(_by_input(names, sel)) > WIDE_INPUTS:
        return _by_rank(_met(df, values, names, sel).select("g", "x"), sel)
    df, values = _staged(df, values, names, sel)
    structs, conds = [], []
    for name, ivs in _by_input(names, sel):
        v = values[name]
        gid = _interval_case(v, ivs, lambda g, lo, hi: F.lit(g))
        structs.append(F.struct(gid.alias("g"), v.alias("x")))
        conds.append(gid.isNotNull())
    return _by_rank(df.where(_any(conds)).select(F.inline(F.array(*structs))).where(F.col("g").isNotNull()), sel)


def _by_rank(rows, sel) -> dict[int, list[float]]:
    rows = rows.collect()                                 # bounded: each narrow interval holds <= small values
    vals: dict[int, list[float]] = {g: [] for g in sel.values()}
    for row in rows:
        vals[row["g"]].append(row["x"])
    for g in vals:
        vals[g].sort()
    return vals


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def interpolate(n: int, p: float, at) -> float | None:
    """Linear-interpolated quantile from an order-statistic accessor."""
    if n == 0:
        return None
    h = (n - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    a = at(lo)
    if lo == hi:
        return a
    b = at(hi)
    return a + (b - a) * (h - lo)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    profile: dict | None = None, brackets: dict | None = None, **kw) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each column (NaN/NULL skipped)."""
    values = {c: as_double(c) for c in cols}
    if profile is None:
        profile, brackets = profile_and_brackets(df, values, probs)
    ranks: dict[str, list[int]] = {}
    for c in cols:
        n = profile[c][0]
        rs = set()
        for p in probs:
            if n:
                h = (n - 1) * p
                rs.update({math.floor(h), math.ceil(h)})
        ranks[c] = sorted(rs)
    found = order_statistics(df, values, {c: r for c, r in ranks.items() if r},
                             profile=profile, raw={c: col(c) for c in cols}, brackets=brackets, **kw)
    return {c: [interpolate(profile[c][0], p, lambda k, c=c: found[c][k].value) for p in probs]
            for c in cols}
