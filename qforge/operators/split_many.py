"""Exact stratified split with many classes (M1): ranks are found in executors.

The same split as ``split``: each class gives its q smallest row keys to the test side. Here nothing per class reaches
the driver, only totals by class size (sizes that differ number at most the root of twice the rows):

1. quotas: floor of the proportional share per class; the classes with the largest remainders get one more. Both follow from
   the class size, but for the last remainder that is shared by more classes than are left: there the class decides,
   and the last one to get a row is found by running totals (``functions.running``, no single-task window);
2. a class of up to ``MAX_CLASS_ROWS`` rows is ranked by a window, which costs one exchange of the rows; rows that share a key
   are ordered by a hash of all columns, and of fully equal rows any may go;
3. larger classes, which are few, get a table of thresholds: rounds of a histogram by (class, bucket of the key's range);
   a window over a class's buckets picks the one that holds the q-th key, until it holds a single key. Later rounds read only
   rows within the classes' ranges. Rows that share the threshold key are ordered by the hash of all columns in the same way, and
   of fully equal rows there each side gets its number of copies;
4. rows of large classes meet their threshold in a join: sent to every task while they are few, else salted, so that
   a class with most of the rows is spread.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions.columns import col
from qforge.functions.running import running_totals

BINS, SALTS = 1024, 32
#: Rows of a class that one task ranks.
MAX_CLASS_ROWS = 100_000
#: Classes up to which the table of thresholds (about 60 bytes each) is sent to every task.
MAX_SENT = 100_000
#: Copies of one row that a task writes when equal rows straddle the threshold.
COPIES_PER_TASK = 100_000


def _meet(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Rows with their class's line of ``table`` (column ``__c``)."""
    if few:
        return rows.join(F.broadcast(table), F.col("__y") == F.col("__c"))
    salted = table.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__s", F.pmod(F.xxhash64("__p", "__r"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col("__y") == F.col("__c")) & (F.col("__s") == F.col("__t"))).drop("__s", "__t")


def _search(rows: DataFrame, value: str, state: DataFrame, few: bool) -> DataFrame:
    """(__c, rank, lo, below, cnt): the value of the given rank (from 1) of each class, how many are smaller, how many equal."""
    state = state.checkpoint()
    v = F.col(value)
    while not state.where("lo < hi").isEmpty():
        open_ = state.where("lo < hi")
        inside = _meet(rows, open_, few).where(v.between(F.col("lo"), F.col("hi")))
        b = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"), F.lit(BINS - 1))
        hist = (inside.groupBy("__c", "rank", "below", b.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")))
        before = Window.partitionBy("__c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)      # at most BINS rows a class
        hist = hist.withColumn("less", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        new = hist.where((F.col("less") < F.col("rank")) & (F.col("rank") <= F.col("less") + F.col("n"))).select(
            "__c", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("less").alias("below"), F.col("n").alias("cnt"))
        state = state.where("lo >= hi").unionByName(new).checkpoint()
    return state


def quotas(counts: DataFrame, sizes: dict[int, int], n: int, n_test: int) -> Callable[[Column, Column], Column]:
    """Test rows of a class as an expression of its size and itself, exact in total; remainders by size, then class order.

    ``sizes``: class size -> number of such classes.
    """
    less = {}                                             # floor less share -> sizes
    for size in sizes:
        cont = size / n * n_test
        less.setdefault(math.floor(cont) - cont, []).append(size)
    need = n_test - sum(math.floor(size / n * n_test) * k for size, k in sizes.items())
    edge, last = -2.0, None                               # below the edge all get one more, at the edge classes up to the last
    for at in sorted(less):
        k = sum(sizes[size] for size in less[at])
        if need < k:
            edge = at
            if need > 0:
                same = counts.sparkSession.createDataFrame([(size,) for size in less[at]], "n long")
                line = counts.join(F.broadcast(same), "n").select("__c", F.lit(1).alias("one"))
                last = running_totals(line, "__c", ["one"], descending=False).where(F.col("cum_one") == need).select("__c").first()[0]
            break
        need -= k
    else:
        edge = 2.0

    def quota(size: Column, cls: Column) -> Column:
        cont = size / F.lit(n) * F.lit(n_test)
        whole = F.floor(cont)
        below = whole - cont
        more = below < F.lit(edge)
        if last is not None:
            more = more | ((below == F.lit(edge)) & (cls <= F.lit(last)))
        return whole + more.cast("long")
    return quota


def split_many(df: DataFrame, label: str, prefix: Column, rest: Column, whole: Column, test_size: float) -> tuple[DataFrame, DataFrame]:
    """(train, test). ``prefix``: each row's key as a number below 2^52; ``rest`` and ``whole``: number and text of the hash of all columns."""
    counts = df.groupBy(col(label).alias("__c")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    none = F.max(F.when(F.col("__c").isNull(), F.col("n"))).alias("none")
    by_size = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"), none).collect()
    if none := max((r["none"] or 0 for r in by_size), default=0):
        raise ValueError(f"{none} rows have no label")
    sizes = {r["n"]: r["k"] for r in by_size}
    n, k = sum(size * many for size, many in sizes.items()), sum(sizes.values())
    n_test = math.ceil(test_size * n)
    if n == 0:
        raise ValueError("cannot split an empty table")
    if min(sizes) < 2:
        raise ValueError("the least populated class has fewer than 2 members")
    if n_test < k or n - n_test < k:
        raise ValueError("test and train sets must each hold at least one row per class")
    quota = quotas(counts, sizes, n, n_test)
    n_large = sum(many for size, many in sizes.items() if size > MAX_CLASS_ROWS)
    large = counts.where(F.col("n") > MAX_CLASS_ROWS).withColumn("quota", quota(F.col("n"), F.col("__c")))
    sides = []
    if n_large < k:
        names = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
        rows = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], col(label).alias("__y"), prefix.alias("__p"), rest.alias("__r"))
        if n_large:
            spread = large.select("__c")
            rows = rows.join(F.broadcast(spread) if n_large <= MAX_SENT else spread, F.col("__y") == F.col("__c"), "left_anti")
        mine = Window.partitionBy("__y")
        ranked = rows.withColumn("__rank", F.row_number().over(mine.orderBy("__p", "__r"))).withColumn("__n", F.count(F.lit(1)).over(mine))
        is_test = F.col("__rank") <= quota(F.col("__n"), F.col("__y"))
        sides.append((ranked.where(~is_test).select(*names), ranked.where(is_test).select(*names)))
    if n_large:
        sides.append(_split_large(df, label, prefix, rest, whole, large, n_large <= MAX_SENT))
    return tuple(functools.reduce(DataFrame.unionByName, side) for side in zip(*sides))


def _split_large(df: DataFrame, label: str, prefix: Column, rest: Column, whole: Column, counts: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the rows of the classes in ``counts`` (__c, n, quota)."""
    names = [F.col(f"__row.{n}").alias(c) for n, c in zip([f"c{i}" for i in range(len(df.columns))], df.columns)]
    packed = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("__row")
    rows = df.select(packed, col(label).alias("__y"), prefix.alias("__p"), rest.alias("__r"), whole.alias("__w"))
    slim = rows.select("__y", "__p", "__r", "__w")
    wanted = counts.where("quota > 0").select(
        "__c", F.col("quota").alias("rank"), F.lit(0.0).alias("lo"), F.lit(float(2 ** 52)).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("cnt"))
    found = _search(slim, "__p", wanted, few).select("__c", F.col("rank").alias("quota"), F.col("lo").alias("t"), F.col("below").alias("less"), F.col("cnt").alias("equal"))
    tied = found.where("less + equal > quota").checkpoint()
    limits = found.where("less + equal = quota").select("__c", "t", F.lit(None).cast("double").alias("u"), F.lit(False).alias("cut"), F.lit(0).cast("long").alias("to_test"),
                                                        F.lit(0).cast("long").alias("to_train"))
    straddling = False
    if not tied.isEmpty():
        at = _meet(slim, tied.select("__c", "t"), few).where(F.col("__p") == F.col("t")).select("__y", "__p", "__r", "__w")
        second = _search(at, "__r", tied.select("__c", (F.col("quota") - F.col("less")).alias("rank"), F.lit(0.0).alias("lo"), F.lit(float(2 ** 52)).alias("hi"),
                                                F.lit(0).cast("long").alias("below"), F.col("equal").alias("cnt")), few)
        cut = F.col("below") + F.col("cnt") > F.col("rank")
        more = tied.select("__c", "t").join(second, "__c").select(
            "__c", "t", F.col("lo").alias("u"), cut.alias("cut"), F.when(cut, F.col("rank") - F.col("below")).otherwise(0).alias("to_test"),
            F.when(cut, F.col("below") + F.col("cnt") - F.col("rank")).otherwise(0).alias("to_train")).checkpoint()
        limits = limits.unionByName(more)
        cuts = more.where("cut")
        straddling = not cuts.isEmpty()
        if straddling:
            ends = _meet(at, cuts.select("__c", "u"), few).where(F.col("__r") == F.col("u")).groupBy("__c").agg(F.min("__w").alias("a"), F.max("__w").alias("b"))
            if not ends.where("a <> b").isEmpty():
                raise ValueError("different rows at the threshold have one 104-bit hash; choose another seed")
    unused = counts.select("__c").join(found.select("__c"), "__c", "left_anti").select(
        "__c", F.lit(-1.0).alias("t"), F.lit(None).cast("double").alias("u"), F.lit(False).alias("cut"), F.lit(0).cast("long").alias("to_test"), F.lit(0).cast("long").alias("to_train"))
    table = limits.unionByName(unused).checkpoint()
    met = _meet(rows, table, few)
    on, u = F.col("__p") == F.col("t"), F.col("u")
    loose = on & F.col("cut") & (F.col("__r") == u)
    is_test = (F.col("__p") < F.col("t")) | (on & (u.isNull() | (F.col("__r") < u) | ((F.col("__r") == u) & ~F.col("cut"))))
    loose, is_test = F.coalesce(loose, F.lit(False)), F.coalesce(is_test, F.lit(False))
    train, test = met.where(~is_test & ~loose).select(*names), met.where(is_test & ~loose).select(*names)
    if straddling:
        one = met.where(loose).groupBy("__c", "to_test", "to_train").agg(F.first("__row").alias("__row")).checkpoint()
        train, test = train.unionByName(_copies(one, "to_train").select(*names)), test.unionByName(_copies(one, "to_test").select(*names))
    return train, test


def _copies(one: DataFrame, number: str) -> DataFrame:
    """As many copies of each class's row, dealt out over tasks."""
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col(number) - 1) / COPIES_PER_TASK))).alias("block")
    size = F.least(F.lit(COPIES_PER_TASK), F.col(number) - F.col("block") * COPIES_PER_TASK)
    return (one.where(F.col(number) > 0).select("__c", "__row", number, block).repartition("__c", "block")
            .select("__row", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("nth")))
