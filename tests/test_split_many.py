"""The split with many classes equals the one with few; quantiles of many columns equal those of few."""

import math
import random

import pytest
from pyspark.sql import functions as F

from qforge.functions import order_stats as OS
from qforge.functions.columns import as_double
from qforge.operators import split as S
from qforge.operators import split_many as SM


def key(df):
    return sorted(map(str, df.collect()))


def table(spark, kind):
    r = random.Random(kind)
    rows = [(i, f"c{r.choice('aaaaabbcd')}{i % 3}", r.random()) for i in range(500)]
    if kind == "shared keys":                             # many rows share a key, some are equal
        rows = [(i % 7, c, round(x, 1)) for i, c, x in rows]
    if kind == "equal rows":
        rows = [(1, c, 0.5) for _, c, _ in rows]
    return spark.createDataFrame(rows, "`k.id` long, cls string, c0 double").repartition(5)


@pytest.mark.parametrize("kind", ["distinct", "shared keys", "equal rows"])
@pytest.mark.parametrize("sent", [SM.MAX_SENT, 0])
def test_many_classes_equal_few(spark, monkeypatch, kind, sent):
    df = table(spark, kind)
    want = [key(x) for x in S.stratified_split(df, "cls", "k.id", 0.3, 7)]
    monkeypatch.setattr(S, "MAX_CLASSES", 0)
    monkeypatch.setattr(SM, "MAX_SENT", sent)
    monkeypatch.setattr(SM, "COPIES_PER_TASK", 5)
    got = S.stratified_split(df, "cls", "k.id", 0.3, 7)
    assert [x.columns for x in got] == [df.columns] * 2
    assert [key(x) for x in got] == want and len(want[1]) == 150


@pytest.mark.parametrize("kind", ["distinct", "shared keys", "equal rows"])
@pytest.mark.parametrize("rows", [0, 30])
def test_large_classes_equal_small(spark, monkeypatch, kind, rows):
    """All classes by thresholds, and some of them; 0.37: remainders at the edge are shared by classes of one size."""
    df = table(spark, kind)
    want = [key(x) for x in S.stratified_split(df, "cls", "k.id", 0.37, 7)]
    monkeypatch.setattr(S, "MAX_CLASSES", 0)
    monkeypatch.setattr(SM, "MAX_CLASS_ROWS", rows)
    assert [key(x) for x in S.stratified_split(df, "cls", "k.id", 0.37, 7)] == want


def test_remainders_of_equal_classes(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"c{i // 3:02}") for i in range(90)] + [(i, "d") for i in range(90, 101)], "id long, cls string")
    want = [key(x) for x in S.stratified_split(df, "cls", "id", 0.5, 3)]
    monkeypatch.setattr(S, "MAX_CLASSES", 0)
    assert [key(x) for x in S.stratified_split(df, "cls", "id", 0.5, 3)] == want


def test_many_small_classes_shuffle_no_copies(spark, monkeypatch):
    """Rows are exchanged as they are: no table of thresholds is copied, no histogram is made."""
    df = spark.range(3000).select("id", (F.col("id") % 1000).alias("cls"))
    monkeypatch.setattr(SM, "MAX_SENT", 0)                # classes are too many to be sent to every task
    monkeypatch.setattr(SM, "_meet", lambda *a: pytest.fail("rows meet a table of thresholds"))
    train, test = S.stratified_split(df, "cls", "id", 0.5)
    assert (train.count(), test.count()) == (1500, 1500) and "Join" not in test._jdf.queryExecution().executedPlan().toString()


def test_many_classes_errors(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_CLASSES", 0)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, cls string")
    for rows, said in ((df, "fewer than 2"), (df.unionAll(spark.createDataFrame([(4, None)], "id long, cls string")), "no label"),
                       (df.where("id < 3").unionAll(df.where("id < 3").select("id", F.lit("b"))), None)):
        if said:
            with pytest.raises(ValueError, match=said):
                S.stratified_split(rows, "cls", "id", 0.5)
        else:
            train, test = S.stratified_split(rows, "cls", "id", 0.5)
            assert (train.count(), test.count()) == (2, 2)
    with pytest.raises(ValueError, match="at least one row per class"):
        S.stratified_split(df.where("id < 3"), "cls", "id", 0.0)


def test_quantiles_of_many_columns(spark, monkeypatch):
    r = random.Random(3)
    inf = float("inf")
    cols = [f"c{i}" for i in range(12)]
    rows = [tuple(None if r.random() < 0.1 else r.choice([7.0, -inf, inf, 1e308, -1e308]) if r.random() < 0.2 else r.gauss(0, 10 ** (i % 5))
                  for i in range(12)) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    values = {c: as_double(c) for c in cols}
    prof = OS.column_profile(df, values)
    ranks = {c: [0, prof[c][0] // 3, prof[c][0] - 1] for c in cols}
    want = {c: sorted(row[i] for row in rows if row[i] is not None) for i, c in enumerate(cols)}
    for wide in (2, 100):
        monkeypatch.setattr(OS, "WIDE_INPUTS", wide)
        got = OS.order_statistics(df, values, ranks, profile=prof, bins=16, small=8)
        for c in cols:
            for k in ranks[c]:
                x = want[c][k]
                assert got[c][k].value == x and got[c][k].n_less == sum(v < x for v in want[c]) and got[c][k].n_equal == want[c].count(x)
    assert math.isinf(want["c0"][-1])
