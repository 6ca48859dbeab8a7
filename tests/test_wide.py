"""Wide tables: correlations by blocks of a Gram matrix."""

import math
import random

from pyspark.sql import functions as F

from qforge.operators import eda as E


def rows_of(seed, n, k):
    r = random.Random(seed)
    return [tuple(None if r.random() < 0.2 else float("nan") if r.random() < 0.02 else 1e6 + r.gauss(0, 1) * (c + 1) + (i % 7) * (c % 3)
                  for c in range(k)) for i in range(n)]


def test_blocks_equal_the_pairwise_aggregate(spark, monkeypatch):
    monkeypatch.setattr(E, "GRAM_BLOCK", 4)               # several blocks and several jobs
    monkeypatch.setattr(E, "GRAM_PAIRS", 3)
    cols = [f"c{i}" for i in range(9)] + ["flat", "none", "a.b", "two"]
    rows = [(*r, 5.0, None, float(i), 3.0 if i else None) for i, r in enumerate(rows_of(1, 200, 9))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(4)
    # ``late`` is constant wherever ``c0`` is present: only the exact way says NULL
    df = df.withColumn("late", F.when(F.col("c0").isNotNull() & ~F.isnan("c0"), F.lit(0.1) + 0.2).otherwise(F.col("c1")))
    cols.append("late")
    got = {(r["x"], r["y"]): r["corr"] for r in E.correlation_wide(df, cols, 9).collect()}
    want = {(r["x"], r["y"]): r["corr"] for r in E.correlation(df, cols[:10], 9).collect()}
    for at in range(0, len(cols), 3):                     # pairs of all columns, a few at a time
        some = sorted({*cols[at:at + 3], "late", "c0"})
        want |= {(r["x"], r["y"]): r["corr"] for r in E.correlation(df, some, 9).collect()}
    assert len(got) == len(cols) ** 2
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-8)), k
    assert got[("late", "c0")] is None and got[("flat", "c1")] is None and got[("none", "none")] is None and got[("c1", "c1")] == 1.0


def test_many_columns_and_no_rows(spark):
    cols = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in cols))
    assert {r["corr"] for r in E.correlation(df, cols).collect()} == {None}
    ones = spark.createDataFrame([tuple(float(i) for i in range(40))], ", ".join(f"{c} double" for c in cols))
    assert E.correlation(ones, cols).where("corr IS NOT NULL").count() == 0


def test_wide_rows_are_read_once(spark):
    """One scan; tasks whose first values lie far apart, or that have none of a column, are brought to one mean."""
    cols = [f"c{i}" for i in range(18)]
    rows = [tuple(None if x is None or c == 3 and i < 250 else 1e6 * (i // 100) + x if c % 2 else x for c, x in enumerate(r))
            for i, r in enumerate(rows_of(5, 500, 18))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), ", ".join(f"{c} double" for c in cols))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    got = {(r["x"], r["y"]): r["corr"] for r in E.correlation(df.mapInArrow(count, df.schema), cols, 9).collect()}
    assert read.value == 500 and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
    want = {(r["x"], r["y"]): r["corr"] for at in (0, 9) for r in E.correlation(df, cols[at:at + 9], 9).collect()}
    assert len(got) == 18 ** 2 and all(math.isclose(got[k], v, abs_tol=1e-8) for k, v in want.items())
