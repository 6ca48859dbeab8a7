"""Shared per-column statistics: one moments aggregate + exact quantiles.

Several operators need the same numbers (count, min, max, mean, std and
a few quantiles of the same columns). Computing them once and passing a
``ColumnStats`` around saves whole scans: the moments are one aggregate
job, and all requested quantiles of all columns share the refinement
passes of ``exact_quantiles``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge.functions.columns import as_double
from qforge.functions.order_stats import WIDE_INPUTS, bracket_aggregate, bracket_columns, brackets_of, exact_quantiles

DEFAULT_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass
class ColumnStats:
    n_rows: int
    count: dict = field(default_factory=dict)
    min: dict = field(default_factory=dict)
    max: dict = field(default_factory=dict)
    mean: dict = field(default_factory=dict)
    std_samp: dict = field(default_factory=dict)
    std_pop: dict = field(default_factory=dict)
    quantiles: dict = field(default_factory=dict)   # column -> {p: value}

    def profile(self, cols: list[str]) -> dict:
        return {c: (self.count[c], self.min[c], self.max[c]) for c in cols}

    def q(self, col: str, p: float):
        return self.quantiles[col][p]

    def to_json(self) -> str:
        own = dict(self.__dict__, quantiles={c: list(q.items()) for c, q in self.quantiles.items()})
        return json.dumps(own)

    @staticmethod
    def from_json(text: str) -> "ColumnStats":
        own = json.loads(text)
        return ColumnStats(**dict(own, quantiles={c: {p: v for p, v in q} for c, q in own["quantiles"].items()}))

    def has(self, cols: list[str], probs=()) -> bool:
        return all(c in self.count and all(p in self.quantiles.get(c, {}) for p in probs) for c in cols)


def column_stats(df: DataFrame, cols: list[str], probs=DEFAULT_PROBS) -> ColumnStats:
    """Moments in one aggregate, then the exact quantiles of every column."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        x = as_double(c)
        aggs += [F.count(x).alias(f"c{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                 F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.stddev_pop(x).alias(f"p{i}")]
    probs = list(probs)
    sketched = len(cols) <= WIDE_INPUTS and bool(probs)   # brackets of the quantiles come from the same scan
    if sketched:
        done = df.agg(*aggs, *[bracket_aggregate(as_double(c)).alias(f"k{i}") for i, c in enumerate(cols)])
        sketches = {f"k{i}" for i in range(len(cols))}
        row = done.select(*[c for c in done.columns if c not in sketches],
                          *[bracket_columns(f"k{i}", f"c{i}", probs).alias(f"q{i}") for i in range(len(cols))]).first()
    else:
        row = df.agg(*aggs).first()
    st = ColumnStats(int(row["n"]))
    for i, c in enumerate(cols):
        st.count[c], st.min[c], st.max[c] = int(row[f"c{i}"]), row[f"a{i}"], row[f"b{i}"]
        st.mean[c], st.std_samp[c], st.std_pop[c] = row[f"m{i}"], row[f"s{i}"], row[f"p{i}"]
    if probs and cols:
        found = {c: brackets_of(row[f"q{i}"], probs, st.min[c], st.max[c]) for i, c in enumerate(cols)} if sketched else None
        qs = exact_quantiles(df, cols, probs, profile=st.profile(cols), brackets=found)
        st.quantiles = {c: dict(zip(probs, qs[c])) for c in cols}
    return st
