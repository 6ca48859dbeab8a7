"""Operator 13: Merkle manifest of a dataset by sibling-shift self-joins.

Every row becomes a leaf, the SHA-256 of its fields. Leaves of a tree (a language) ascend by id; while
a tree has more than one node, each run of ``arity`` consecutive nodes becomes one parent (a last run may be shorter,
even one node). The roots of all trees, in the order of their keys, are the leaves of the top tree.

A level is built by equijoins of its nodes with their siblings: a node in slot k knows that its run's
slot-zero row has index ``idx - k``, so for k = 1, 2, ... the slot-zero rows join the nodes of slot k on
(tree, idx - k) = (tree, idx), and then emit the parent. Nodes are stored by slot, so each of these joins reads
its own slot only and a level is shuffled once. Slot-zero rows keep the run's digests, from which every
member's siblings are read. Proofs go down the other way: a run joins its parent's run, which holds the path above.

Positions need no window over a tree: rows are range-partitioned by tree, id and leaf, stored with a running number, and
(tree, partition) totals give each row's place. All joins are on (tree, position), so one language that holds most rows
spreads over all tasks. Only the size of the largest tree reaches the driver.

Null fields count as ``-``. A null id comes first in its tree, rows with one id stand in the order of their leaves, and
equal rows are leaves of their own. A null tree key is a tree of its own, the first one. Long texts are hashed whole. An
empty table has no root and gives an empty result. Columns that are not hashed or asked for are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from qforge.session import scratch_path

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """``leaves`` (t, idx, n, leaf, kept columns), ``levels`` of all trees, ``trees`` (t, subroot, ...), ``top`` levels, ``root``."""
    leaves: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    root: DataFrame
    arity: int

    def nodes(self) -> DataFrame:
        """The manifest as one table: tree (null: above the trees), level, position and digest."""
        out = self.leaves.select("t", F.lit(0).alias("level"), "idx", F.col("leaf").alias("h"))
        for tree, above in (("t", self.levels), (None, self.top)):
            for i, runs in enumerate(above, 1):
                out = out.unionByName(runs.select(F.col("t") if tree else F.lit(None).cast("long").alias("t"),
                                                  F.lit(i).alias("level"), "idx", "h"))
        return out


def digest(values: list[Column]) -> Column:
    """H over fields: null is ``-``, otherwise the UTF-8 byte count, a colon and the value."""
    one = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*one), 256)


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, sizes are known."""
    path = scratch_path(df.sparkSession, f"merkle-{name}")
    w = df.write.partitionBy(by) if by else df.write
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(rows: DataFrame, tree: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``idx``, their place in the tree, and (tree, n) of all trees; rows equal in ``order`` stand in any order."""
    line = [F.col(tree).asc_nulls_first(), *order, F.col("__row")]
    dealt = (rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*line).sortWithinPartitions(*line)
             .drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    dealt = _stored(dealt.withColumn("__part", F.shiftright("__at", 33)), "dealt")
    pieces = dealt.groupBy(tree, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))   # trees + partitions rows
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)          # a partition a row
    pieces = pieces.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sizes = pieces.groupBy(tree).agg(F.sum("__n").alias("n"))
    p = pieces.select(F.col(tree).alias("__tree"), F.col("__part").alias("__p"), (F.col("__start") - F.col("__first")).alias("__shift"))
    placed = dealt.join(p, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__tree", "__p", "__shift", "__part", "__at"), sizes


def build(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (t, idx, n, h, slot) and (t, h) of every tree's root.

    A level has (t, idx, n, body, h, slot): n nodes in its tree, body the digests of the run below.
    """
    levels, tops, cur = [], nodes.where("n = 1").select("t", "h"), nodes
    size = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while size > 1:
        run = cur.where("slot = 0 AND n > 1").select("t", "idx", "n", F.col("h").alias("h0"))
        for k in range(1, arity):
            sibling = cur.where(f"slot = {k} AND n > 1").select("t", (F.col("idx") - k).alias("idx"), F.col("h").alias(f"h{k}"))
            run = run.join(sibling, ["t", "idx"], "left")
        body = F.concat_ws("", *[f"h{k}" for k in range(arity)])
        up = run.select("t", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), body.alias("body"))
        up = up.withColumn("h", F.sha2("body", 256)).withColumn("slot", (F.col("idx") % arity).cast("int"))
        cur = _stored(up, f"level{len(levels) + 1}", "slot")
        levels.append(cur)
        tops = tops.unionByName(cur.where("n = 1").select("t", "h"))
        size = -(-size // arity)
    return levels, tops


def manifest(rows: DataFrame, tree: Column, order: Column, fields: list[Column], keep: list[Column] | None = None, arity: int = ARITY) -> Manifest:
    """Leaves over ``fields`` and all levels; ``keep`` are further columns (named ``k_...``) carried on the leaves."""
    made = _stored(rows.select(tree.alias("tree"), order.alias("ord"), digest(fields).alias("leaf"), *(keep or [])), "leaves")
    placed, sizes = positions(made, "tree", [F.col("ord").asc_nulls_first(), F.col("leaf")])
    trees, _ = positions(sizes.withColumn("one", F.lit(0)), "one", [F.col("tree").asc_nulls_first()])
    trees = _stored(trees.select(F.col("idx").alias("t"), "tree", "n"), "trees")
    # a row a tree; a hot tree is no skew where these are broadcast, which Spark decides by their size, or split by AQE
    leaves = placed.join(trees.withColumnRenamed("tree", "__k"), F.col("tree").eqNullSafe(F.col("__k"))).drop("__k")
    leaves = _stored(leaves.withColumn("slot", (F.col("idx") % arity).cast("int")), "placed", "slot")
    levels, tops = build(leaves.select("t", "idx", "n", F.col("leaf").alias("h"), "slot"), arity)
    count = trees.count()
    roots = _stored(tops.join(trees.select("t", "tree"), "t"), "roots")
    upper = roots.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("idx"), F.lit(count).cast("long").alias("n"), "h",
                         (F.col("t") % arity).cast("int").alias("slot"))
    top, root = build(upper, arity)
    return Manifest(leaves, levels, roots.select("t", "tree", F.col("h").alias("subroot")), top, root.select(F.col("h").alias("root")), arity)


def paths(nodes: DataFrame, levels: list[DataFrame], info: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (t, idx, n, ...) with the columns of ``info`` (one row a tree) and ``path``: the bodies of the runs above."""
    extra = [c for c in info.columns if c != "t"]
    above = None
    for runs in reversed(levels):
        mine = runs.select("t", "idx", "n", "body")
        got = mine.where("n = 1").join(info, "t").select("t", "idx", *extra, F.array("body").alias("path"))
        if above is not None:
            up = above.withColumnRenamed("idx", "up")
            got = got.unionByName(mine.where("n > 1").withColumn("up", F.expr(f"idx div {arity}")).join(up, ["t", "up"])
                                  .select("t", "idx", *extra, F.concat(F.array("body"), "path").alias("path")))
        above = got
    alone = nodes.where("n = 1").join(info, "t").withColumn("path", F.array().cast("array<string>"))
    if above is None:
        return alone
    up = above.withColumnRenamed("idx", "up")
    return alone.unionByName(nodes.where("n > 1").withColumn("up", F.expr(f"idx div {arity}")).join(up, ["t", "up"]).drop("up"))


def siblings(path: str, idx: str, arity: int) -> Column:
    """Digests of all siblings, level by level, left to right."""
    slot = f"64 * cast(({idx} div cast(pow({arity}, j) as bigint)) % {arity} as int)"
    return F.expr(f"array_join(transform({path}, (b, j) -> concat(substr(b, 1, {slot}), substr(b, {slot} + 65))), '')")


def fold(path: str, idx: str, leaf: str, arity: int) -> Column:
    """The root that ``leaf`` and its siblings give."""
    slot = f"64 * cast(a.i % {arity} as int)"
    return F.expr(f"aggregate({path}, struct({leaf} as h, {idx} as i), (a, b) -> struct(sha2(concat(substr(b, 1, {slot}), a.h, "
                  f"substr(b, {slot} + 65)), 256) as h, a.i div {arity} as i), a -> a.h)")


def prove(m: Manifest, claimed: str = "leaf") -> DataFrame:
    """Leaves with subroot, root, ``path`` and ``top_path``, ``proof`` (siblings as text) and the root folded from ``claimed``."""
    root = m.root.select(F.lit(0).cast("long").alias("t"), "root")
    count = F.lit(1) if not m.top else F.lit(2)           # only whether the top tree has levels matters here
    upper = m.trees.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("idx"), count.cast("long").alias("n"), "subroot")
    tops = paths(upper, m.top, root, m.arity).select(F.col("idx").alias("t"), "subroot", "root", F.col("path").alias("top_path"))
    tops = _stored(tops, "tops")
    got = paths(m.leaves, m.levels, tops, m.arity)
    proof = F.concat(siblings("path", "idx", m.arity), siblings("top_path", "t", m.arity))
    got = got.withColumn("proof", proof).withColumn("__sub", fold("path", "idx", claimed, m.arity))
    return got.withColumn("folded_root", fold("top_path", "t", "__sub", m.arity)).drop("__sub")


def documents_manifest(docs: DataFrame, arity: int = ARITY) -> Manifest:
    """Trees by language over documents; ``k_claim`` is the leaf of the text with A-Z lower-cased where 3 divides crc32(id)."""
    every = [F.col(f"`{c}`") for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claim = F.when(tampered, digest([*every[:-1], folded(every[-1].cast("string"))]))
    return manifest(docs, F.col("lang"), F.col("doc_id"), every, [claim.alias("k_claim")], arity)


def audit(docs: DataFrame) -> DataFrame:
    """Contract columns: every document's leaf, subroot, root, proof digest and whether its claim folds to the root."""
    m = documents_manifest(docs)
    m.leaves = m.leaves.withColumn("claimed", F.coalesce("k_claim", "leaf"))
    return prove(m, "claimed").select(
        F.col("ord").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
