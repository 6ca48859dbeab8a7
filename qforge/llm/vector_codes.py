"""Operator 11: vector code compression with Drake-Hamerly adaptive distance bounds.

A vector becomes integers (floor of ``scale`` times each component), cut into ``parts`` consecutive parts (equal ones, or the first
ones a component longer). Each part position has a codebook of up to ``entries`` entries, started from the parts of the
smallest ids and moved by rounds of assignment and averaging (floor of the mean). A vector's code is the index of
the nearest entry of every part, ties to the lower index.

After the first full assignment every part keeps the ``b`` entries closest after its own, an ordered lower bound for each, and one outer
bound for all others. When entries move, the upper bound grows by the own entry's shift, each lower bound sinks by its
entry's shift and the outer bound by the largest shift. The first bound that lies above the upper
bound says how many of the listed entries can still be nearer: none (nothing is computed), the first z (their distances
are computed as integers and decide, so ties are exact), or more than b (the part is compared with all entries). The
tasks count which z was needed, and b for the next round is the smallest that settles ``SETTLED`` of the parts.
Bounds are 16-bit floats, rounded to the safe side, so they can cost a comparison but never change a code.

Vectors, codes and bounds are stored between rounds in the shared scratch folder; no row is shuffled. A round returns one row a
task, entry and component, whose sums (entries x components numbers) reach the driver, as does the codebook.

A vector that is null, empty, or holds null or non-finite components is left out, as is one of another length than the vector with
the smallest id (equal ids: smallest integers). A null id is taken last. Repeated rows are rows of their own. A component outside
+-65535 raises ValueError, since distances could leave 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from qforge.llm.textops import field
from qforge.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Share of parts that the listed entries have to settle; b lies between MIN_B and an eighth of the entries.
SETTLED, MIN_B = 0.98, 2
MAX_VALUE = 1 << 24
#: Labels up to which their totals are sent to every task; beyond it they are joined with SALTS copies of each.
MAX_LABELS, SALTS = 100_000, 32
CHUNK = 4096

WHOLE = T.StructType([field("vec_id", T.LongType()), field("label", T.LongType()), field("dim", T.IntegerType()), field("ints", T.BinaryType())])
STATE = T.StructType([*WHOLE.fields[:2], WHOLE.fields[3], field("code", T.BinaryType()), field("bounds", T.BinaryType()), field("needed", T.BinaryType())])
CODED = T.StructType([*WHOLE.fields[:2], field("code", T.BinaryType()), field("error", T.LongType())])
SUMS = T.StructType([field("slot", T.IntegerType()), field("at", T.IntegerType()), field("total", T.LongType())])


@dataclass
class Codebook:
    """``entries`` of every part position: a (entries, width) integer array each."""
    parts: list[np.ndarray]

    @property
    def cuts(self) -> np.ndarray:
        return np.cumsum([0, *[p.shape[1] for p in self.parts]])

    def moved(self, new: "Codebook") -> list[np.ndarray]:
        """How far each entry moved, rounded up."""
        return [np.nextafter(np.sqrt(((a - b) ** 2).sum(axis=1).astype(np.float64)), np.inf) for a, b in zip(self.parts, new.parts)]

    def text(self) -> str:
        return ",".join(str(v) for p in self.parts for v in p.reshape(-1).tolist())


def widths(dim: int, parts: int) -> np.ndarray:
    return np.array([dim // parts + (i < dim % parts) for i in range(parts)])


def up(x: np.ndarray) -> np.ndarray:
    """16-bit floats not below x."""
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
        return np.where(h.astype(np.float64) < x, np.nextafter(h, np.float16(np.inf)), h).astype(np.float16)


def down(x: np.ndarray) -> np.ndarray:
    """16-bit floats not above x (those beyond the range become its largest value)."""
    x = np.where(np.isinf(x), x, np.minimum(x, 65504.0))
    h = x.astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(-np.inf)), h).astype(np.float16)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to (rows, m, width) or (m, width) entries, as integers."""
    return ((x[:, None] - (c if c.ndim == 3 else c[None])) ** 2).sum(axis=2)


@dataclass
class Bounds:
    """Of one part position: own entry, upper bound, listed entries with ordered lower bounds, outer bound, needed z (b + 1: all)."""
    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray
    needed: np.ndarray


def full(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """Compare with all entries."""
    k = len(c)
    key = distances(x, c) * k + np.arange(k)              # nearest first, ties to the lower index
    m = min(b + 2, k)
    key = np.sort(np.partition(key, m - 1, axis=1)[:, :m], axis=1)
    ids, d = key % k, np.sqrt((key // k).astype(np.float64))
    outer = down(d[:, b + 1]) if k > b + 1 else np.full(len(x), np.inf, np.float16)
    return Bounds(ids[:, 0].astype(np.uint8), up(d[:, 0]), ids[:, 1:b + 1].astype(np.uint8), down(d[:, 1:b + 1]), outer, np.full(len(x), b + 1, np.uint8))


def narrower(s: Bounds, b: int) -> Bounds:
    """Keep ``b`` listed entries; the first one dropped gives the outer bound."""
    if s.near.shape[1] <= b:
        return s
    return Bounds(s.code, s.upper, s.near[:, :b], s.lower[:, :b], np.minimum(s.outer, s.lower[:, b:].min(axis=1)), s.needed)


def moved(x: np.ndarray, c: np.ndarray, s: Bounds, shift: np.ndarray) -> Bounds:
    """The assignment after the entries moved to ``c``; only uncertain parts are compared."""
    k, b, n = len(c), s.near.shape[1], len(x)
    code, near = s.code.astype(np.int64), s.near.astype(np.int64)
    upper = up(s.upper.astype(np.float64) + shift[code]).astype(np.float64)
    low = np.concatenate([s.lower.astype(np.float64) - shift[near], (s.outer.astype(np.float64) - shift.max())[:, None]], axis=1)
    low = down(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]).astype(np.float64)       # ordered: each bounds all that follow
    needed = np.zeros(n, np.uint8)
    loose = np.flatnonzero(upper >= low[:, 0])
    if len(loose):
        own = ((x[loose] - c[code[loose]]) ** 2).sum(axis=1)
        upper[loose] = np.nextafter(np.sqrt(own.astype(np.float64)), np.inf)
        above = upper[loose, None] < low[loose]
        z = np.where(above.any(axis=1), above.argmax(axis=1), b + 1)
        needed[loose] = z
        some = loose[(z > 0) & (z <= b)]
        if len(some):
            zs = needed[some].astype(np.int64)
            m = int(zs.max())
            key = np.concatenate([own[np.isin(loose, some)][:, None] * k + code[some][:, None],
                                  distances(x[some], c[near[some, :m]]) * k + near[some, :m]], axis=1)
            tested = np.arange(m + 1) <= zs[:, None]
            key = np.sort(np.where(tested, key, np.iinfo(np.int64).max), axis=1)
            d = np.sqrt((key // k).astype(np.float64))
            code[some] = key[:, 0] % k
            upper[some] = np.nextafter(d[:, 0], np.inf)
            put = tested[:, 1:]                           # z candidates and the old entry, less the new one: z remain
            near[some, :m] = np.where(put, key[:, 1:] % k, near[some, :m])
            low[some, :m] = np.where(put, d[:, 1:], low[some, :m])
    out = Bounds(code.astype(np.uint8), up(upper), near.astype(np.uint8), down(low[:, :b]), down(low[:, b]), needed)
    every = np.flatnonzero(needed == b + 1)
    if len(every):
        new = full(x[every], c, b)
        for mine, its in ((out.code, new.code), (out.upper, new.upper), (out.near, new.near), (out.lower, new.lower), (out.outer, new.outer)):
            mine[every] = its
    return out


def _packed(states: list[Bounds]) -> list[bytes]:
    """Bounds of all parts of each vector as one value."""
    rows = [np.concatenate([np.stack([s.upper, s.outer], axis=1), s.lower], axis=1).astype("<f2").view(np.uint8).reshape(len(s.code), -1)
            for s in states]
    body = np.concatenate([np.concatenate([r, s.near], axis=1) for r, s in zip(rows, states)], axis=1)
    return [r.tobytes() for r in body]


def _unpacked(codes: np.ndarray, bodies: np.ndarray, b: int) -> list[Bounds]:
    step, out = 2 * (b + 2) + b, []
    for p in range(codes.shape[1]):
        mine = bodies[:, p * step:(p + 1) * step]
        f = np.ascontiguousarray(mine[:, :2 * (b + 2)]).view("<f2")
        out.append(Bounds(codes[:, p], f[:, 0], mine[:, 2 * (b + 2):], f[:, 2:], f[:, 1], np.zeros(len(mine), np.uint8)))
    return out


def _rows(col: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def whole(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """Usable vectors as integers of 4 bytes: vec_id, label, dim, ints."""
    sel = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))

    def run(batches):
        for batch in batches:
            e = batch.column(2)
            size = np.array([0 if n is None else n for n in pa.compute.list_value_length(e).to_pylist()], np.int64)
            flat = e.flatten()                            # null lists have no values
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            good = np.isfinite(x) & np.array(flat.is_valid(), bool)
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
            if any(np.abs(x[end[i] - size[i]:end[i]]).max() >= MAX_VALUE for i in keep.tolist()):
                raise ValueError("a vector's component is too large for integer distances")
            bodies = [x[end[i] - size[i]:end[i]].astype("<i4").tobytes() for i in keep.tolist()]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size[keep].astype(np.int32)),
                                              pa.array(bodies, pa.binary())], names=WHOLE.fieldNames())
    return sel.mapInArrow(run, WHOLE)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"codes-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_codebook(kept: DataFrame, dim: int, parts: int, entries: int) -> Codebook:
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()     # ``entries`` rows
    x = np.stack([np.frombuffer(bytes(r["ints"]), "<i4").astype(np.int64) for r in rows])
    cut = np.cumsum([0, *widths(dim, parts)])
    return Codebook([x[:, a:b] for a, b in zip(cut[:-1], cut[1:])])


def assign(kept: DataFrame, book: Codebook, b: int) -> DataFrame:
    """First round: every part compared with all entries; state of every vector."""
    def run(batches):
        cut = book.cuts
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _rows(part.column(2), "<i4").astype(np.int64)
                yield _state(part, [full(x[:, cut[p]:cut[p + 1]], c, b) for p, c in enumerate(book.parts)])
    return kept.select("vec_id", "label", "ints").mapInArrow(run, STATE)


def _state(part: pa.RecordBatch, states: list[Bounds]) -> pa.RecordBatch:
    codes, needed = (np.stack([getattr(s, a) for s in states], axis=1) for a in ("code", "needed"))
    return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()),
                                       pa.array(_packed(states), pa.binary()), pa.array([z.tobytes() for z in needed], pa.binary())],
                                      names=STATE.fieldNames())


def reassign(state: DataFrame, old: Codebook, new: Codebook, b: int, keep: int) -> DataFrame:
    """Next round: state with ``b`` listed entries -> state with ``keep``, by the moved bounds."""
    shift = old.moved(new)

    def run(batches):
        cut = new.cuts
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _rows(part.column(2), "<i4").astype(np.int64)
                before = _unpacked(_rows(part.column(3), np.uint8), _rows(part.column(4), np.uint8), b)
                yield _state(part, [narrower(moved(x[:, cut[p]:cut[p + 1]], c, before[p], shift[p]), keep) for p, c in enumerate(new.parts)])
    return state.select("vec_id", "label", "ints", "code", "bounds").mapInArrow(run, STATE)


def _summed(df: DataFrame, run) -> list:
    """Sums of one row a task and number; as many rows as there are numbers reach the driver."""
    return df.mapInArrow(run, SUMS).groupBy("slot", "at").agg(F.sum("total").alias("total")).collect()


def means(state: DataFrame, book: Codebook) -> Codebook:
    """Each entry's floor of the mean of its parts; an unused entry stays."""
    cut, k = book.cuts, len(book.parts[0])

    def run(batches):
        total = [np.zeros((k, c.shape[1] + 1), np.int64) for c in book.parts]
        for batch in batches:
            x, code = _rows(batch.column(0), "<i4").astype(np.int64), _rows(batch.column(1), np.uint8)
            for p, t in enumerate(total):
                order = np.argsort(code[:, p], kind="stable")
                used, begin = np.unique(code[order, p], return_index=True)
                if len(used):
                    mine = np.concatenate([x[order, cut[p]:cut[p + 1]], np.ones((len(x), 1), np.int64)], axis=1)
                    t[used] += np.add.reduceat(mine, begin, axis=0)
        for p, t in enumerate(total):
            r, c = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array((p * k + r).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(t[r, c])],
                                             names=SUMS.fieldNames())
    got = [np.zeros((k, c.shape[1] + 1), np.int64) for c in book.parts]
    for slot, at, total in _summed(state.select("ints", "code"), run):
        got[slot // k][slot % k, at] = total
    return Codebook([np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), c) for t, c in zip(got, book.parts)])


def next_b(state: DataFrame, b: int) -> int:
    """The smallest b that settles the given share of the parts (those compared with all entries would not have been settled)."""
    def run(batches):
        n = np.zeros(b + 2, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=b + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b + 2, np.int32)), pa.array(np.arange(b + 2, dtype=np.int32)), pa.array(n)],
                                         names=SUMS.fieldNames())
    n = np.zeros(b + 2, np.int64)
    for _, at, total in _summed(state.select("needed"), run):
        n[at] = total
    settled = np.cumsum(n)[:b + 1] >= SETTLED * n.sum()
    return max(MIN_B, int(settled.argmax())) if settled.any() else b


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebook | None]:
    """(vec_id, label, code, error) of every usable vector, and the codebook (None without vectors)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    every = _stored(whole(vectors, scale), "whole")
    first = every.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], CODED), None
    kept = every.where(F.col("dim") == first[0]["dim"])
    book = first_codebook(kept, first[0]["dim"], parts, entries)
    b = min(max(MIN_B, entries // 8), len(book.parts[0]) - 1)
    state = _stored(assign(kept, book, b), "round0")
    for i in range(1, rounds + 1):
        new = means(state, book)
        keep = b if i == 1 else min(b, next_b(state, b))  # the first round lists entries but needs none
        state = _stored(reassign(_cut(state, b, keep), book, new, keep, keep), f"round{i}")
        book, b = new, keep

    def run(batches):
        cut = book.cuts
        for batch in batches:
            x, code = _rows(batch.column(2), "<i4").astype(np.int64), _rows(batch.column(3), np.uint8)
            error = sum(((x[:, cut[p]:cut[p + 1]] - c[code[:, p]]) ** 2).sum(axis=1) for p, c in enumerate(book.parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(error, pa.int64())], names=CODED.fieldNames())
    return state.select("vec_id", "label", "ints", "code").mapInArrow(run, CODED), book


def _cut(state: DataFrame, b: int, keep: int) -> DataFrame:
    """State whose bounds list ``keep`` entries."""
    if keep == b:
        return state

    def run(batches):
        for batch in batches:
            codes = _rows(batch.column(3), np.uint8)
            yield _state(batch, [narrower(s, keep) for s in _unpacked(codes, _rows(batch.column(4), np.uint8), b)])
    return state.mapInArrow(run, STATE)


def reconstruct(coded: DataFrame, book: Codebook) -> DataFrame:
    """vec_id and the integers that each code stands for."""
    out = T.StructType([field("vec_id", T.LongType()), field("ints", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            code = _rows(batch.column(1), np.uint8)
            x = np.concatenate([c[code[:, p]] for p, c in enumerate(book.parts)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.int64()))], names=out.fieldNames())
    return coded.select("vec_id", "code").mapInArrow(run, out)


def label_totals(coded: DataFrame, label: Column) -> DataFrame:
    """``coded`` with ``label_error``; a hot label's rows are spread, whatever the number of labels."""
    named = coded.withColumn("__l", F.coalesce(label.cast("string"), F.lit("\x00")))
    totals = _stored(named.groupBy("__l").agg(F.sum("error").alias("label_error")), "labels")
    if totals.count() <= MAX_LABELS:
        return named.join(F.broadcast(totals), "__l").drop("__l")
    salted = totals.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return named.withColumn("__s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, ["__l", "__s"]).drop("__l", "__s")


def digest(coded: DataFrame, book: Codebook | None) -> DataFrame:
    """Contract columns."""
    coded = _stored(coded, "coded")
    sha = hashlib.sha256((book.text() if book else "").encode()).hexdigest()
    return label_totals(coded, F.col("label")).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                                      F.lit(sha).alias("codebooks_sha256"))
