"""Exact stratified split (M1) and standard scaling (M2).

Split: every row gets a repeatable order key md5("<key>:<seed>"). Class c
contributes exactly q_c test rows - its q_c smallest keys. The quotas
follow the stratified rule (floor of the proportional share, remaining
rows to the largest fractional parts, ties by class order). The q_c-th
key per class is found with the distributed order-statistic search on a
52-bit numeric prefix of the hash, so the split is a plain filter
``key <= threshold(class)``: no window, no per-class task, no join.
Rows with one key at the threshold are ordered by a hash of all columns
in the same way; of fully equal rows there, the right number goes to each
side. Without a key the hash of all columns is the key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double, col, dlit
from qforge.functions.order_stats import order_statistics
from qforge.operators.split_many import split_many

#: Copies of one row that a task writes when equal rows straddle the threshold.
COPIES_PER_TASK = 100_000
#: Classes up to which thresholds are literals, and the (class, bucket) rows that may reach the driver for it.
MAX_CLASSES, MAX_HISTOGRAM = 40, 200_000


def row_hash(df: DataFrame, seed: int) -> Column:
    """Hash of all columns, nulls included."""
    whole = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return F.md5(F.concat(whole, F.lit(f":{seed}")))


def split_hash(key: str | Column, seed: int) -> Column:
    k = col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def _prefix(h: Column) -> Column:
    """First 13 hex digits (52 bits) as an exact double; monotone in the hash."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double")


def class_quotas(counts: dict, n_draws: int) -> dict:
    """Proportional allocation of ``n_draws`` over classes, exact total."""
    total = sum(counts.values())
    labels = sorted(counts)
    cont = {c: counts[c] / total * n_draws for c in labels}
    floored = {c: math.floor(cont[c]) for c in labels}
    need = int(n_draws - sum(floored.values()))
    if need > 0:
        order = sorted(labels, key=lambda c: (-(cont[c] - floored[c]), labels.index(c)))
        for c in order[:need]:
            floored[c] += 1
    return floored


@dataclass
class SplitPlan:
    label: str
    key: object
    seed: int
    quotas: dict
    conds: dict = field(default_factory=dict)
    equal: dict = field(default_factory=dict)     # class -> (condition of the equal rows, copies in test, in train)

    def is_test(self) -> Column:
        """Rows of the test side, without the equal rows that straddle a threshold."""
        out = F.lit(False)
        for c, cond in self.conds.items():
            out = out | ((col(self.label) == F.lit(c)) & cond)
        return out

    def sides(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(train, test)"""
        flag, straddling = self.is_test(), F.lit(False)
        for cond, _, _ in self.equal.values():
            straddling = straddling | cond
        train, test = df.where(~flag & ~straddling), df.where(flag)
        for cond, n_test, n_train in self.equal.values():
            train = train.unionByName(copies(df.where(cond), n_train))
            test = test.unionByName(copies(df.where(cond), n_test))
        return train, test


def copies(equal: DataFrame, n: int) -> DataFrame:
    """n copies of the one row that all rows of ``equal`` are, dealt out over tasks."""
    one = equal.agg(F.first(F.struct(*[col(c) for c in equal.columns])).alias("row")).where("row IS NOT NULL")
    blocks = -(-n // COPIES_PER_TASK)
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    size = F.least(F.lit(COPIES_PER_TASK), F.lit(n) - F.col("block") * COPIES_PER_TASK)
    return (one.select("row", block).repartition("block")
            .select("row", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("nth")).select("row.*"))


PREFIX_SPAN = float(2 ** 52)


def plan_split(df: DataFrame, label: str, key: str | Column | None = None, test_size: float = 0.2,
               seed: int = 42, bins: int = 4096) -> SplitPlan | None:
    """Class quotas and per-class hash thresholds; None if classes and buckets are too many for the driver. A null label raises.

    The hash prefix is uniform over the known range [0, 2^52), so the first
    pass needs no min/max: one grouped pass over (class, prefix bucket)
    yields the class sizes and a histogram per class together. The bucket
    holding each class's threshold rank is then resolved by the order-
    statistic search restricted to that bucket (usually one value fetch).
    Where classes are clearly too many, a count of them spares the histogram.
    """
    y = col(label)
    pre = _prefix(row_hash(df, seed) if key is None else split_hash(key, seed))
    staged = df.select(y.alias("y"), pre.alias("pre"))
    if staged.agg(F.approx_count_distinct("y")).first()[0] > 2 * MAX_CLASSES:       # off by a twentieth: these are more
        return None
    bucket = F.least((F.col("pre") / F.lit(PREFIX_SPAN) * bins).cast("int"), F.lit(bins - 1))
    hist_rows = (staged.groupBy("y", bucket.alias("b"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min("pre").alias("lo"), F.max("pre").alias("hi"))
                 .limit(MAX_HISTOGRAM + 1).collect())
    if len(hist_rows) > MAX_HISTOGRAM or len({r["y"] for r in hist_rows}) > MAX_CLASSES:
        return None
    hist: dict = {}
    for r in hist_rows:
        hist.setdefault(r["y"], []).append((r["b"], int(r["n"]), r["lo"], r["hi"]))
    counts = {c: sum(n for _, n, _, _ in rows) for c, rows in hist.items()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no label")
    n = sum(counts.values())
    if n == 0:
        raise ValueError("cannot split an empty table")
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    if min(counts.values()) < 2:
        raise ValueError("the least populated class has fewer than 2 members")
    if n_test < len(counts) or n_train < len(counts):
        raise ValueError("test and train sets must each hold at least one row per class")
    quotas = class_quotas(counts, n_test)

    values, ranks, profile, below = {}, {}, {}, {}
    for i, c in enumerate(sorted(counts)):
        if quotas[c] == 0:
            continue
        r, cum = quotas[c] - 1, 0
        for b, cnt, lo, hi in sorted(hist[c]):
            if r < cum + cnt:
                name = f"c{i}"
                # the population is the class's rows inside that bucket
                values[name] = F.when((y == F.lit(c)) & pre.between(dlit(lo), dlit(hi)), pre)
                ranks[name] = [r - cum]
                profile[name] = (cnt, lo, hi)
                below[c] = (name, cum)
                break
            cum += cnt
    found = order_statistics(df, values, ranks, profile=profile) if values else {}
    plan = SplitPlan(label, key, seed, quotas)
    for c in sorted(counts):
        if quotas[c] == 0:
            plan.conds[c] = F.lit(False)
            continue
        name, cum = below[c]
        res = found[name][quotas[c] - 1 - cum]
        t, n_less = res.value, cum + res.n_less
        if n_less + res.n_equal == quotas[c]:
            plan.conds[c] = pre <= dlit(t)
            continue
        # several rows share the key's prefix at the threshold: order them by the hash of all columns
        need, tie = quotas[c] - n_less, (y == F.lit(c)) & (pre == dlit(t))
        rest = _prefix(row_hash(df, seed + 1))
        second = order_statistics(df, {"tie": F.when(tie, rest)}, {"tie": [need - 1]})["tie"][need - 1]
        u, at = second.value, tie & (rest == dlit(second.value))
        if second.n_less + second.n_equal == need:
            plan.conds[c] = (pre < dlit(t)) | ((pre == dlit(t)) & (rest <= dlit(u)))
            continue
        whole = row_hash(df, seed + 1)
        ends = df.where(at).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).first()
        if ends["lo"] != ends["hi"]:
            raise ValueError("different rows at the threshold have one 104-bit hash; choose another seed")
        plan.conds[c] = (pre < dlit(t)) | ((pre == dlit(t)) & (rest < dlit(u)))
        plan.equal[c] = (at, need - second.n_less, second.n_less + second.n_equal - need)
    return plan


def stratified_split(df: DataFrame, label: str, key: str | Column | None = None, test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact per-class test quotas; repeatable from the seed. A null label raises.

    Few classes: thresholds are literals of a filter. Many: a table that rows meet in a join (``split_many``). The split is the same.
    """
    plan = plan_split(df, label, key, test_size, seed)
    if plan is not None:
        return plan.sides(df)
    prefix = _prefix(row_hash(df, seed) if key is None else split_hash(key, seed))
    whole = row_hash(df, seed + 1)
    return split_many(df, label, prefix, _prefix(whole), whole, test_size)


# ---------------------------------------------------------------- M2
@dataclass
class ScalerModel:
    """(x - mean) / population std per column; a zero std divides by 1."""
    stats: dict[str, tuple[float, float]]

    def columns(self) -> dict[str, Column]:
        return {c: (as_double(c) - dlit(m)) / dlit(s) for c, (m, s) in self.stats.items()}

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        cols = self.columns()
        if suffix:
            return df.select("*", *[e.alias(c + suffix) for c, e in cols.items()])
        return df.withColumns(cols)


def fit_scaler(df: DataFrame, cols: list[str]) -> ScalerModel:
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(as_double(c)).alias(f"m{i}"), F.stddev_pop(as_double(c)).alias(f"s{i}"))]).first()
    stats = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None:
            raise ValueError(f"column {c!r} has no values to scale")
        stats[c] = (m, s if s and s >= 10 * 2.220446049250313e-16 else 1.0)
    return ScalerModel(stats)
