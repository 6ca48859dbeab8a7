"""Running (cumulative) totals without a single-partition window.

``Window.orderBy(k)`` with no partition key sends every row to one task.
Instead the rows are range-partitioned by the key into as many buckets as
there are shuffle partitions and written once to the shared checkpoint
folder, each with its bucket number. A ``groupBy`` gives one total per
bucket; the totals' prefix sums (one row per bucket) are joined back as a
small table, and the running sum inside a bucket is a window partitioned by
the bucket. Every size of input takes this way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_totals(df: DataFrame, key: str, sums: list[str], descending: bool = True,
                   with_next: bool = False, buckets: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in key order) for each c in ``sums``.

    ``key`` must be distinct per row (aggregate first). With ``with_next``
    also add ``next_<c>``: the value of c on the following row in that
    order (NULL on the last row). ``buckets`` defaults to the number of
    shuffle partitions, which also bounds the rows that reach the driver.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.col(key)
    order = k.desc() if descending else k.asc()
    # the bucket number is stored with the row, so all later passes agree on the borders
    b = df.repartitionByRange(n, order).withColumn("_bucket", F.spark_partition_id()).checkpoint(eager=True)

    aggs = [F.sum(F.col(c)).alias(c) for c in sums]
    if with_next:
        first = (F.max_by if descending else F.min_by)(F.struct(*[F.col(c) for c in sums]), k)
        aggs.append(first.alias("_first"))
    totals = sorted(b.groupBy("_bucket").agg(*aggs).collect(), key=lambda r: r["_bucket"])  # bounded: <= buckets

    before, rows = [0] * len(sums), []
    for i, r in enumerate(totals):
        following = totals[i + 1]["_first"] if with_next and i + 1 < len(totals) else [None] * len(sums)
        rows.append((r["_bucket"], *before, *(following if with_next else ())))
        before = [x + (r[c] or 0) for x, c in zip(before, sums)]
    total_type = b.groupBy().agg(*aggs).schema
    fields = [T.StructField("_bucket", T.IntegerType())]
    fields += [T.StructField(f"_before_{c}", total_type[c].dataType) for c in sums]
    if with_next:
        fields += [T.StructField(f"_after_{c}", b.schema[c].dataType) for c in sums]
    zero = {T.DoubleType: float, T.FloatType: float}
    cast = [zero.get(type(f.dataType), lambda v: v) for f in fields]
    offsets = spark.createDataFrame(
        [tuple(None if v is None else c(v) for c, v in zip(cast, r)) for r in rows], T.StructType(fields))

    w = Window.partitionBy("_bucket").orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = []
    for c in sums:
        cols.append((F.col(f"_before_{c}") + F.sum(F.col(c)).over(running)).alias(f"cum_{c}"))
        if with_next:
            # the first row of the next bucket follows the last row of this one
            cols.append(F.coalesce(F.lead(F.col(c)).over(w), F.col(f"_after_{c}")).alias(f"next_{c}"))
    joined = b.join(F.broadcast(offsets), "_bucket")   # one row a bucket
    return joined.select(*[F.col(c) for c in df.columns], *cols)
