"""Packed exchanges: many small values travel as a few compressed columns of numbers or texts.

A table is dealt to ``n`` buckets; each map task sends one compressed row a bucket and slice.
The number of buckets is the number of shuffle partitions, so a bucket's size stays the same when
partitions grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from qforge.llm.textops import SLICE_BYTES, field, slices

PACKED = T.StructType([field("bucket", T.IntegerType()), field("origin", T.IntegerType()), field("body", T.BinaryType())])
_HEAD = np.dtype("<i8")


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Compress arrays (or raw bytes) into one value."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(
        np.array([len(raw), *map(len, raw)], _HEAD).tobytes() + b"".join(raw))


def unpack(body: bytes, *kinds) -> list:
    """Arrays of the given dtypes (``bytes`` leaves raw bytes)."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, _HEAD, 1)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(np.frombuffer(raw, _HEAD, n, 8), kinds):
        part = raw[at:at + int(size)]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += int(size)
    return out


def rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, o, x = zip(*items) if items else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(o, pa.int32()), pa.array(x, pa.binary())],
                                      names=["bucket", "origin", "body"])


def table(items: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([rows(items)])


def deal(to: np.ndarray, n: int, origin: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket in ``to``."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n + 1))
    return [(b, origin, pack(*[c[order[cut[b]:cut[b + 1]]] for c in columns]))
            for b in np.flatnonzero(np.diff(cut)).tolist()]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack_documents(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(bucket, origin, body): documents with an id, dealt by a hash of the id; null text stays empty."""
    sel = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"),
                      F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 4 << 20):
                to = part.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(n + 1))
                ids = np.array([0 if x is None else x for x in part.column(0).to_pylist()], np.int64)
                known = np.array(part.column(0).is_valid(), bool)
                texts = [x.encode() for x in part.column(1).to_pylist()]
                out = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    mine = order[cut[k]:cut[k + 1]]
                    own = [texts[i] for i in mine]
                    out.append((k, 0, pack(ids[mine], known[mine], np.array([len(x) for x in own], np.int64), b"".join(own))))
                if out:
                    yield rows(out)
    return sel.mapInArrow(run, PACKED)


def documents(packed: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ids, whether known, texts) of a bucket, in the order of id and text: the same whenever it is read."""
    every = []
    for body in packed.column("body").to_pylist():
        ids, known, size, raw = unpack(body, np.int64, bool, np.int64, bytes)
        end = np.cumsum(size)
        every += [(not k, i, raw[e - s:e]) for i, k, s, e in zip(ids.tolist(), known.tolist(), size.tolist(), end.tolist())]
    every.sort()
    return (np.array([x[1] for x in every], np.int64), np.array([not x[0] for x in every], bool),
            [x[2].decode() for x in every])


def text_slices(texts: list[str], max_bytes: int = SLICE_BYTES):
    """(first index, Arrow array) over runs of bounded size."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > max_bytes:
            yield at, pa.array(texts[at:i], pa.string())
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, pa.array(texts[at:], pa.string())
