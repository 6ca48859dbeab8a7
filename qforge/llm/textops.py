"""Vectorised words, word hashes and word n-grams over Arrow text columns.

All helpers work on one bounded slice of an Arrow batch (``max_bytes`` of
text, or a single document when that is longer). Words are found on the
UTF-8 bytes with a 256-entry class table; hashes are 64-bit and computed
eight bytes at a time, so the cost per word is a few numpy operations.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SLICE_BYTES = 2 << 20
#: Bytes of rows up to which one Arrow batch goes to a task's Python (one row at least); Spark's own bound is 10,000 rows.
BATCH_BYTES = 4 << 20


def _class_table(kind: str) -> np.ndarray:
    """True for bytes that belong to a word (after lower-casing A-Z)."""
    t = np.ones(256, dtype=bool)
    if kind == "space":                      # words [^\x20\x09-\x0D]+
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":                    # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
        t[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
    else:
        raise ValueError(f"unknown word kind {kind!r}")
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit moves every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a slice: byte spans ``s``/``e``, document index, hash.

    ``first[d]:first[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, col: pa.Array, kind: str, lower: bool, seed: int = 0):
        data, self.off = utf8(col)
        if lower:
            data = _lower_table()[data]
        self.data = data
        n = len(data)
        m = _class_table(kind)[data]
        before = np.zeros(n, bool)
        before[1:] = m[:-1]
        after = np.zeros(n, bool)
        after[:-1] = m[1:]
        cut = self.off[(self.off > 0) & (self.off < n)]
        before[cut] = False
        after[cut - 1] = False
        self.s = np.flatnonzero(m & ~before)
        self.e = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.s, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        self.h = self.hashes(seed)

    def hashes(self, seed: int) -> np.ndarray:
        n = len(self.s)
        length = self.e - self.s
        h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1))
        if n == 0:
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded, strides=(1,))
        keep = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], np.uint64)
        live, at = np.arange(n), 0
        while len(live):
            rest = np.minimum(length[live] - at, 8)
            x = eight[self.s[live] + at] & keep[rest]
            h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) + x + np.uint64(1))
            at += 8
            live = live[length[live] > at]
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.s[i]:self.e[i]].tobytes()


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes (crossing documents too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = mix(h[:n] + np.uint64(0x632BE59BD9B4E019 + seed))
    for j in range(1, k):
        g = mix(g * np.uint64(0x9FB21C651E98DF25) + h[j:n + j])
    return g


def slices(batch: pa.RecordBatch, col: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most max_bytes of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.cumsum(utf8(batch.column(col))[1][1:] - utf8(batch.column(col))[1][:-1])
    at, base = 0, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        base, at = int(size[end - 1]), end


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], out: list[T.StructField],
             keep: list[str], text: str = "text", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns plus the columns that ``make()(text slice)`` returns; no shuffle."""
    sel = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([sel.schema[c] for c in keep] + out)
    names = schema.fieldNames()

    def run(batches):
        fn = make()
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last, max_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *fn(part.column(last))], names=names)
        fn = b = part = None
        give_back()
    return sel.mapInArrow(run, schema)


def give_back() -> None:
    """What this worker has freed goes back to the system: Spark keeps workers between stages, beside a heap that may be full."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # the GNU C library has it
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on a session's Arrow batches hold BATCH_BYTES of rows at most, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def field(name: str, kind) -> T.StructField:
    return T.StructField(name, kind, True)


def shards_of(df: DataFrame) -> int:
    """Hash shards for packed exchanges: a few per shuffle partition, so both grow together."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession, value) -> Callable:
    """Send a value (its classes included) to the tasks once an executor; call the result there."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)
