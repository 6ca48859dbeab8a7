"""Quantiles from sketched brackets: exact whatever the sketch says, and two scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qforge.functions import order_stats as O
from qforge.operators import eda as E

PROBS = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def columns(seed, n):
    r = random.Random(seed)
    return [(r.gauss(0, 1e3), float(r.randrange(3)), 7.5 if r.random() < 0.4 else r.random(), r.choice((-1e308, 1e308, 0.0, r.random())),
             float("inf") if r.random() < 0.3 else -float("inf") if r.random() < 0.3 else r.random(),
             None if r.random() < 0.5 else float("nan") if r.random() < 0.2 else r.expovariate(1), None) for _ in range(n)]


@pytest.mark.parametrize("n,margin,small", [(6000, O.SKETCH_MARGIN, 4096), (6000, O.SKETCH_MARGIN, 8), (6000, 1e-9, 16), (40, O.SKETCH_MARGIN, 4096), (1, 0.3, 16)])
def test_exact_for_any_bracket(spark, monkeypatch, n, margin, small):
    monkeypatch.setattr(O, "SKETCH_MARGIN", margin)       # far too narrow brackets miss their ranks
    monkeypatch.setattr(O, "SKETCH_K", 8 if margin < 1e-6 else 4096)
    rows = columns(n, n)
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double").repartition(3)
    got = O.exact_quantiles(df, df.columns, PROBS, small=small, bins=64)
    for i, c in enumerate(df.columns):
        x = np.sort([r[i] for r in rows if r[i] is not None and r[i] == r[i]])
        for p, v in zip(PROBS, got[c]):
            if not len(x):
                assert v is None
                continue
            h = (len(x) - 1) * p
            a, b = x[int(np.floor(h))], x[int(np.ceil(h))]
            if np.isfinite(a) and np.isfinite(b) and abs(a) < 1e300 and abs(b) < 1e300:
                assert v == a + (b - a) * (h - np.floor(h)) or h == np.floor(h) and v == a, (c, p)


def test_wrong_brackets_are_searched_on(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x")).repartition(3)
    for wrong in ([(4000.0, 4100.0)], [(-9.0, -5.0)], [(2499.0, 2499.0)], [(0.0, 1.0), (1.0, 3000.0)]):
        found = O.order_statistics(df, {"x": F.col("x")}, {"x": [0, 2500, 4999]}, small=8, bins=16, brackets={"x": wrong})["x"]
        assert [(r, found[r].value, found[r].n_less, found[r].n_equal) for r in (0, 2500, 4999)] == [(r, float(r), r, 1) for r in (0, 2500, 4999)]


def test_describe_takes_two_scans(spark, monkeypatch):
    df = spark.range(50_000).select((F.rand(3) * 1000).alias("x"), F.randn(4).alias("y"), (F.col("id") % 10).cast("double").alias("z"))
    calls = []
    for name in ("_histogram_pass", "_values_pass", "_from_brackets"):
        real = getattr(O, name)
        monkeypatch.setattr(O, name, lambda *a, real=real, name=name: (calls.append(name), real(*a))[1])
    E.describe_numeric(df, ["x", "y", "z"]).collect()
    assert calls == ["_from_brackets"]
