"""Operator 4: sharding by best-fit-decreasing bin packing.

Rows with equal texts form a group that is never cut. Groups sorted by size, largest first,
enter the bin with the tightest remaining capacity that holds them, found in a balanced tree.

Groups are too many for one task, so small ones (below 1/512 of a shard) first form parcels
by hash; parcels and large groups are the items. Their number is bounded by the byte total
over the parcel size, whatever the number of rows. ``pack`` fills as few shards of a fixed
capacity as it can: cells of about 64 shards are packed in parallel and the part-filled
bins of all cells are packed again by cells of bins, in rounds. ``pack_into`` fills a given number of shards evenly: the
smallest capacity at which best fit needs no further shard (found by bisection).

A group larger than a shard cannot stay whole in ``pack_into`` without breaking the size
law, so only such a group is cut, by row number (equal rows too); in ``pack`` it gets a shard of its own.
Null text: no bytes (size 1), grouped with the empty text. Repeated rows are rows of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

PARCELS = 512                    # parcels a shard


class Tree:
    """Balanced tree (treap, priorities from a hash of the bin) of (remaining, bin)."""

    def __init__(self):
        self.root = None

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[0] > b[0]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[1] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def add(self, remaining: int, bin_no: int) -> None:
        left, right = self._split(self.root, (remaining, bin_no))
        new = [(bin_no * 0x9E3779B97F4A7C15 + remaining) % 0xFFFFFFFFFFC5, (remaining, bin_no), None, None]
        self.root = self._merge(self._merge(left, new), right)

    def take_tightest(self, size: int):
        """Remove and return the smallest (remaining, bin) with remaining >= size, or None."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[1][0], node[1][1] + 1))
        self.root = self._merge(left, rest)
        return node[1]


def best_fit_decreasing(items: list[tuple[int, str]], capacity: int, bins: int = 0) -> tuple[dict[str, int], list[int]]:
    """Bin of every item and the bins' loads; ``bins`` are open at the start, others open as needed."""
    tree, load, where = Tree(), [0] * bins, {}
    for b in range(bins):
        tree.add(capacity, b)
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        got = tree.take_tightest(size)
        if got is None:
            got = (max(capacity, size), len(load))
            load.append(0)
        where[key] = got[1]
        load[got[1]] += size
        tree.add(got[0] - size, got[1])
    return where, load


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the group digest; no text goes further."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body, 256).alias("group"))


def _parcel(n: Column | int) -> Column:
    return F.concat(F.lit("p"), F.pmod(F.xxhash64("group"), F.lit(n) if isinstance(n, int) else n).cast("string"))


def pack_into(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (size, group, ...) plus ``shard`` 0..n-1, with sizes as equal as best fit makes them, and the row's number ``__row``."""
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    parcels = PARCELS * n_shards
    total = rows.agg(F.sum("size")).first()[0] or 0
    big = max(1, total // parcels)
    part = -(-total // n_shards) or 1                     # a shard's share: only a larger group is cut
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") > big)            # at most `parcels` rows
    cut = F.when(F.col("bytes") > part, F.ceil(F.col("bytes") / F.lit(max(1, part // 64)))).otherwise(1)
    keyed = (rows.join(F.broadcast(large.select("group", cut.cast("long").alias("cut"))), "group", "left")
             .withColumn("item", F.when(F.col("cut").isNull(), _parcel(parcels)).otherwise(
                 F.concat_ws("#", "group", F.pmod(F.xxhash64("__row"), F.col("cut")).cast("string")))).drop("cut"))
    items = [(r["bytes"], r["item"]) for r in
             keyed.groupBy("item").agg(F.sum("size").alias("bytes")).collect()]     # bounded: see above
    low, high = part, max(part, max([s for s, _ in items], default=0)) * 2
    while low < high:                                     # the smallest capacity that needs no further shard
        mid = (low + high) // 2
        if len(best_fit_decreasing(items, mid, n_shards)[1]) <= n_shards:
            high = mid
        else:
            low = mid + 1
    where, _ = best_fit_decreasing(items, high, n_shards)
    shards = rows.sparkSession.createDataFrame([(k, v) for k, v in where.items()] or [("", 0)], "item string, shard int")
    return keyed.join(F.broadcast(shards), "item").drop("item")


def _repacked(bins: DataFrame, capacity: int, limit: int) -> DataFrame:
    """(cell, bin, shard): bins below 7/8 packed again, about ``limit`` of them a task, until they fit one task.

    A bin that finds no partner among those of its task stays a shard; merged ones halve in number each round.
    """
    def again(step: int):
        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            where, load = best_fit_decreasing(list(zip(pdf["load"].tolist(), pdf["shard"])), capacity)
            b = pdf["shard"].map(where)
            held = b.map(b.value_counts())
            to = f"t{step}:{pdf['part'].iloc[0]}:" + b.astype(str)
            return pdf.assign(to=to.where(held > 1, pdf["shard"]), load=b.map(dict(enumerate(load))), held=held)[["shard", "to", "load", "held"]]
        return fn
    named = bins.select("cell", "bin", "load", F.concat_ws(":", "cell", "bin").alias("shard")).checkpoint()
    loose, step = named.where(F.col("load") * 8 < capacity * 7).select("shard", "load"), 0
    while (n := loose.count()) > 1:
        parts = -(-n // limit)
        moved = (loose.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts))).groupBy("part")
                 .applyInPandas(again(step), "shard string, to string, load long, held long").checkpoint())
        named = (named.join(moved.select("shard", "to"), "shard", "left")
                 .select("cell", "bin", F.coalesce("to", "shard").alias("shard")).checkpoint())
        if parts == 1:
            break
        loose = (moved.where((F.col("held") > 1) & (F.col("load") * 8 < capacity * 7))
                 .select(F.col("to").alias("shard"), "load").distinct())
        step += 1
    return named.select("cell", "bin", "shard")


def pack(rows: DataFrame, capacity: int, cell_shards: int = 64, tail_bins: int = 4096) -> DataFrame:
    """(group, shard, bytes): every group in a shard of at most ``capacity`` bytes (a larger group alone)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    cells = max(1, -(-total // (capacity * cell_shards)))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    cell = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(cells))
    keyed = groups.select("group", "bytes", cell.alias("cell"),
                          F.when(F.col("bytes") <= max(1, capacity // PARCELS), _parcel(PARCELS * cell_shards))
                          .otherwise(F.col("group")).alias("item"))
    items = keyed.groupBy("cell", "item").agg(F.sum("bytes").alias("bytes"))

    def one_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        where, load = best_fit_decreasing(list(zip(pdf["bytes"].tolist(), pdf["item"])), capacity)
        b = pdf["item"].map(where)
        return pdf.assign(bin=b, load=b.map(dict(enumerate(load))))[["cell", "item", "bin", "load"]]
    first = items.groupBy("cell").applyInPandas(one_cell, "cell long, item string, bin long, load long")
    bins = first.select("cell", "bin", "load").distinct()
    named = _repacked(bins, capacity, tail_bins)
    return keyed.join(first.select("cell", "item", "bin"), ["cell", "item"]).join(named, ["cell", "bin"]).select(
        "group", "shard", "bytes")


def slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps within each shard, numbered in many buckets at once (dealt by ``__row``, so equal rows spread)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = rows.withColumn("bucket", F.pmod(F.xxhash64("__row"), F.lit(n)))
    counts = split.groupBy("shard", "bucket").agg(F.count("*").alias("n"))        # shards x buckets rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group", "__row")
    return (split.withColumn("i", F.row_number().over(inside)).join(F.broadcast(start), ["shard", "bucket"])
            .withColumn("slot", F.col("start") + F.col("i") - 1).drop("bucket", "i", "start"))


def digest(placed: DataFrame) -> DataFrame:
    """Contract columns for the law ``bytes``."""
    return slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
