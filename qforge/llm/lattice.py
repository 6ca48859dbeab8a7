"""Operator 1: near-duplicate vectors by E8 lattice hashing.

A vector (of one label, scaled to length 1) is projected onto 8 random orthonormal directions,
scaled, and decoded to the nearest point of the E8 lattice: its home cell in a table. It also
probes the neighbouring cells (home plus one of the 240 shortest lattice vectors) whose border is
nearest. Two vectors meet in a table if one's home is the other's home or probe. Several tables with other
directions make up for borders. Every meeting pair is verified by cosine in double precision.

A pair that meets several times counts once: in the first table where it meets, and there in the home
cell of the smaller id if both probe each other. So each cell counts its own links and no pairs are
written out. Crowded cells are cut into blocks by id and every pair of blocks is compared. Cells also emit a
forest of their links, from which components are found.

Equal vectors of a label form a class and are compared once; their copies count as links. Vectors that are
null, zero, or hold null or non-finite components, and null labels, link with nothing. Vectors of different
length link with nothing. Rows with an equal vec_id are different vectors: each has links of its own and is counted one by one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from qforge.llm.components import components
from qforge.llm.textops import field

MIN_COSINE, TABLES, PROBES, SCALE, MAX_CELL = 0.93, 6, 2, 4.0, 4000
#: Crowded cells up to which their list (12 bytes a cell) is sent to every task.
MAX_CROWDED = 200_000


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even coordinate sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        i = np.abs(off).argmax(axis=1)
        r[odd, i] += np.where(off[np.arange(len(odd)), i] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the nearer of the D8 point and the shifted D8 point."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def directions(dim: int, table: int, seed: int = 0) -> np.ndarray:
    """Eight orthonormal directions (fewer dimensions: padded with zeros)."""
    g = np.random.default_rng([seed, table, dim]).standard_normal((dim, min(8, dim)))
    q, _ = np.linalg.qr(g)
    return np.concatenate([q, np.zeros((dim, 8 - q.shape[1]))], axis=1)


def _code(points: np.ndarray, label: np.ndarray, dim: int, table: int) -> np.ndarray:
    """64-bit name of a cell; label, length and table are part of it."""
    h = np.full(points.shape[:-1], dim * 1000 + table, np.uint64)
    h = h * np.uint64(0x9E3779B97F4A7C15) + label.astype(np.int64).view(np.uint64).reshape(-1, *[1] * (points.ndim - 2))
    for i in range(8):
        h = (h ^ (2 * points[..., i]).astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def cells(x: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """(vector, table, 1 + probes) cell names; the first is the home."""
    dim, out, near = x.shape[1], [], roots()
    for t in range(tables):
        p = x @ directions(dim, t) * scale
        home = nearest_e8(p)
        gain = (p - home) @ near.T           # all neighbours are equally far, so the largest product has the nearest border
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        out.append(_code(np.concatenate([home[:, None], home[:, None] + near[best]], axis=1), label, dim, t))
    return np.stack(out, axis=1)


def classes(vectors: DataFrame) -> DataFrame:
    """Usable distinct vectors: label, unit vector's source, smallest id and number of copies."""
    e = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
          & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
            .where(F.coalesce(ok, F.lit(False))).groupBy("label", "embedding")
            .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))


CELL_ROW = T.StructType([field("cell", T.LongType()), field("home", T.BooleanType()), field("vec_id", T.LongType()),
                         field("copies", T.LongType()), field("vec", T.BinaryType()), field("codes", T.BinaryType()),
                         field("at", T.IntegerType())])


def cell_rows(distinct: DataFrame, tables: int, probes: int, scale: float, kind: str) -> DataFrame:
    """One row a vector, table and cell (home or probed)."""
    def run(batches):
        for b in batches:
            vecs = b.column(1).to_pylist()
            ids, copies, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            dims = np.array([len(v) for v in vecs])
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                bodies = [np.array(vecs[i], kind).tobytes() for i in own]
                codes = cells(unit(bodies, kind), label[own], tables, probes, scale)
                m = codes.shape[1] * codes.shape[2]
                rep = np.repeat(np.arange(len(own)), m)
                vec = pa.array(bodies, pa.binary())
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.reshape(-1).view(np.int64)), pa.array(np.arange(m * len(own)) % codes.shape[2] == 0),
                     pa.array(ids[own][rep]), pa.array(copies[own][rep]), vec.take(pa.array(rep)), code.take(pa.array(rep)),
                     pa.array((np.arange(m * len(own)) // codes.shape[2] % codes.shape[1]).astype(np.int32))],
                    names=CELL_ROW.fieldNames())
    return distinct.select("vec_id", "embedding", "copies", "label").mapInArrow(run, CELL_ROW)


def compare(ids, home, x, codes, table: int, left: np.ndarray, right: np.ndarray, min_cosine: float) -> np.ndarray:
    """Links between two sets of rows of one cell that count here: (i, j) row pairs.

    ``left`` and ``right`` index the rows; a pair within one set is taken once.
    """
    out = []
    for a in range(0, len(left), 512):
        i = left[a:a + 512]
        near = x[i] @ x[right].T >= min_cosine - 1e-9
        p, q = np.nonzero(near)
        p, q = i[p], right[q]
        ok = (ids[p] < ids[q]) & (home[p] | home[q])     # two probers meet at their homes or not at all
        p, q = p[ok], q[ok]
        if not len(p):
            continue
        exact = np.einsum("ij,ij->i", x[p], x[q]) >= min_cosine
        p, q = p[exact], q[exact]
        cp, cq = codes[p], codes[q]
        meets = ((cp[:, :, 0][:, :, None] == cq).any(axis=2) | (cq[:, :, 0][:, :, None] == cp).any(axis=2))
        first = meets.argmax(axis=1) == table            # counted in the first table where they meet
        same = cp[:, table, 0] == cq[:, table, 0]
        p_probes = (cq[:, table, :1] == cp[:, table, 1:]).any(axis=1)      # the smaller id probes the other's home
        q_probes = (cp[:, table, :1] == cq[:, table, 1:]).any(axis=1)
        here = np.where(same, home[p] & home[q], np.where(q_probes, home[p], p_probes & home[q]))
        keep = first & here
        out.append(np.stack([p[keep], q[keep]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def unit(bodies: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision (very large or small values stay finite)."""
    x = np.frombuffer(b"".join(bodies), kind).astype(np.float64).reshape(len(bodies), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cells(min_cosine: float, tables: int, kind: str):
    """Cells (or pairs of their blocks) of a bucket -> link counts per vector and a forest of links."""
    def fn(key, rows):
        cell, low, high, side, ids, copies, at = (rows.column(c).to_numpy() for c in
                                                  ("cell", "low", "high", "side", "vec_id", "copies", "at"))
        home = rows.column("home").to_numpy(zero_copy_only=False)
        vecs, codes = rows.column("vec").to_pylist(), rows.column("codes").to_pylist()
        order = np.lexsort((ids, high, low, cell))
        k = np.stack([cell, low, high])[:, order]
        cut = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [len(order)]])
        out = ([], [], [])
        for p, q in zip(cut[:-1], cut[1:]):
            own = order[p:q]
            if len(own) < 2 or not home[own].any():
                continue
            width = len(vecs[own[0]])                    # cells of other lengths share a name only by chance
            own = own[[len(vecs[i]) == width for i in own]]
            x = unit([vecs[i] for i in own], kind)
            c = np.frombuffer(b"".join([codes[i] for i in own]), np.uint64).reshape(len(own), tables, -1)
            a, b = np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)
            sets = [(a, b), (b, a)] if low[own[0]] != high[own[0]] else [(a, a)]
            pairs = np.concatenate([compare(ids[own], home[own], x, c, int(at[own[0]]), i, j, min_cosine) for i, j in sets])
            if not len(pairs):
                continue
            n = np.zeros(len(own), np.int64)
            np.add.at(n, pairs[:, 0], copies[own][pairs[:, 1]])
            np.add.at(n, pairs[:, 1], copies[own][pairs[:, 0]])
            best = np.arange(len(own))                   # rows are in the order of ids: spread the first until nothing changes
            while True:
                m = np.minimum(best[pairs[:, 0]], best[pairs[:, 1]])
                new = best.copy()
                np.minimum.at(new, pairs[:, 0], m)
                np.minimum.at(new, pairs[:, 1], m)
                new = new[new]
                if (new == best).all():
                    break
                best = new
            hit = np.flatnonzero(n)
            for o, v in zip(out, (ids[own[hit]], n[hit], ids[own[best[hit]]])):
                o.append(v)
        none = [np.zeros(0, np.int64)]
        return pa.table({c: pa.array(np.concatenate(none + v)) for c, v in zip(("vec_id", "n", "parent"), out)})
    return fn


def link(vectors: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES,
         scale: float = SCALE, max_cell: int = MAX_CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row a vector."""
    # every class has a number of its own, as vec_ids may repeat; ids come back at the end
    distinct = classes(vectors).withColumn("cid", F.monotonically_increasing_id()).checkpoint()
    numbered = distinct.select(F.col("cid").alias("vec_id"), "embedding", "copies", "label")
    kind = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cell_rows(numbered.repartition("vec_id"), tables, probes, scale, kind)
    # crowded cells only: fewer than one row for max_cell rows
    crowded = (rows.select("cell").groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > max_cell)
               .select("cell", F.ceil(F.col("m") / F.lit(max_cell)).cast("int").alias("blocks")).checkpoint())
    if crowded.count() <= MAX_CROWDED:
        crowded = F.broadcast(crowded)
    dealt = (rows.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
             .withColumn("side", F.when(F.col("block") == F.col("low"), 0).otherwise(1))
             .withColumn("bucket", F.pmod(F.xxhash64("cell", "low", "high"), F.lit(n)).cast("int")))
    found = (dealt.select("bucket", "cell", "low", "high", "side", "home", "vec_id", "copies", "vec", "codes", "at")
             .groupBy("bucket").applyInArrow(_cells(min_cosine, tables, kind), "vec_id long, n long, parent long").checkpoint())
    counts = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("vec_id").alias("a"), F.col("parent").alias("b"))).select(F.col("id").alias("lid"), "component")
    ids = distinct.select("cid", "vec_id").join(comps, F.col("cid") == F.col("lid")).select("lid", "component", "vec_id")
    least = ids.groupBy(F.col("component").alias("c")).agg(F.min("vec_id").alias("least"))        # combined before the exchange
    comps = ids.join(least, F.col("component") == F.col("c")).select("lid", "least")
    named = (distinct.join(counts, F.col("cid") == F.col("id"), "left").join(comps, F.col("cid") == F.col("lid"), "left")
             .select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("least", "vec_id").alias("component_id")))
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("l"), F.col("embedding").alias("e"))
    return own.join(named, ["l", "e"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
