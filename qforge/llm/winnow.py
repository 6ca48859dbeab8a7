"""Operator 6: benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Of every
``window`` consecutive k-gram hashes the rightmost smallest is kept, on both sides, with
``k + window - 1 = span``: whatever shares ``span`` consecutive words shares a kept hash.
Kept hashes are joined; a document's windows around a hit are compared, word by word on the
texts, with the different windows of the items that keep the same hash, and equal neighbours are
extended to one span. A window is looked up once whatever the number of its places in an item, so
repetitive texts cost time in proportion to their length. An item with
fewer than ``span`` words is one window, so it is found by all its grams of its own length.

Null or empty texts have no words and no hits; an empty benchmark hits nothing; a null
item_id can hit words but is never named; repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from qforge.llm.textops import Words, field, gram_hashes, map_text, ship

SPAN, K = 10, 5
#: Words of the benchmark up to which its index is sent to every task (8 bytes a hash and the texts); beyond it the hashes are joined by a shuffle.
MAX_INDEX_WORDS = 2_000_000
SPANS = T.ArrayType(T.StructType([field("item_id", T.LongType()), field("start", T.LongType()),
                                  field("end", T.LongType())]))


def kept_grams(w: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows inside one document, position of the k-gram each keeps, hashes of all k-grams)."""
    width = span - k + 1
    g = gram_hashes(w.h, k)
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        c = g[j:n + j]
        less = c <= best
        best[less] = c[less]
        at[less] = np.flatnonzero(less) + j
    whole = np.flatnonzero(w.doc[:n] == w.doc[span - 1:span - 1 + n])
    return whole, at[whole], g


def winnowed(w: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the kept k-grams."""
    _, at, g = kept_grams(w, k, span)
    pos = np.unique(at)
    return pos, g[pos]


def short_grams(w: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of m words (for items of m words), with a hash of their own."""
    g = gram_hashes(w.h, m, seed=7919 * m)
    ok = np.flatnonzero(w.doc[:len(g)] == w.doc[m - 1:m - 1 + len(g)])
    return ok, g[ok]


def within(count: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def same_bytes(w: Words, i: np.ndarray, v: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of w and word j of v are equal, for all pairs."""
    n = w.e[i] - w.s[i]
    ok = n == v.e[j] - v.s[j]
    t = np.flatnonzero(ok)
    step = within(n[t])
    unlike = w.data[np.repeat(w.s[i[t]], n[t]) + step] != v.data[np.repeat(v.s[j[t]], n[t]) + step]
    ok[np.repeat(t, n[t])[unlike]] = False
    return ok


def merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one document and item that overlap or touch become one. Ends must ascend with starts, as those of one item do."""
    order = np.lexsort((end, start, item, doc))
    doc, item, start, end = (x[order] for x in (doc, item, start, end))
    if not len(doc):
        return doc, item, start, end
    new = np.flatnonzero(np.concatenate(
        [[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])]))
    return doc[new], item[new], start[new], end[np.append(new[1:], len(doc)) - 1]


class Index:
    """Kept hashes of the benchmark, its words by hash, and the different windows of each item by hash."""

    def __init__(self, ids: list, texts: list, span: int, k: int):
        self.ids, self.span, self.k = pa.array(ids, pa.int64()), span, k
        v = self.words = Words(pa.array(texts, pa.string()), "alnum", True)
        sizes = np.diff(v.first)
        self.fp = np.unique(winnowed(v, k, span)[1])
        number = {}
        self.code = np.array([number.setdefault(v.word(i), i) for i in range(len(v.h))], np.int64)
        self.vocabulary = np.unique(self.code)                        # first place of every word, by hash
        self.vocabulary = self.vocabulary[np.argsort(v.h[self.vocabulary], kind="stable")]
        self.hashes = v.h[self.vocabulary]
        self.windows = []
        for m in sorted({int(min(x, span)) for x in sizes if x > 0}):
            pos, g = short_grams(v, m)
            mine = (sizes[v.doc[pos]] == m) if m < span else sizes[v.doc[pos]] >= m
            pos, g = pos[mine], g[mine]
            order = np.lexsort((pos, v.doc[pos], g))
            pos, g = pos[order], g[order]
            again = np.zeros(len(pos), bool)
            again[1:] = (g[1:] == g[:-1]) & (v.doc[pos[1:]] == v.doc[pos[:-1]])
            for j in range(m):
                again[1:] &= self.code[pos[1:] + j] == self.code[pos[:-1] + j]
            self.windows.append((m, g[~again], pos[~again]))

    def codes(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Number of the equal word of the benchmark for each word position, -1 without one; the bytes decide."""
        out = np.full(len(at), -1, np.int64)
        low, high = (np.searchsorted(self.hashes, w.h[at], side) for side in ("left", "right"))
        for r in range(int((high - low).max(initial=0))):             # once, unless two words share a hash
            t = np.flatnonzero(low + r < high)
            j = self.vocabulary[low[t] + r]
            same = same_bytes(w, at[t], self.words, j)
            out[t[same]] = j[same]
        return out

    def hits(self, w: Words, pairs: int):
        """(document, item, first word, word after the last) of equal windows, merged, at most about ``pairs`` windows at a time."""
        whole, kept, grams = kept_grams(w, self.k, self.span)
        j = np.minimum(np.searchsorted(self.fp, grams[kept]), max(len(self.fp) - 1, 0))
        near = whole[self.fp[j] == grams[kept]] if len(self.fp) else whole[:0]         # windows that keep a hash the benchmark keeps
        for m, hashes, pos in self.windows:
            p, g = short_grams(w, m)
            if m == self.span:
                use = np.isin(p, near, assume_unique=True)
                p, g = p[use], g[use]
            low, high = (np.searchsorted(hashes, g, side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            p, low, n = p[hit], low[hit], (high - low)[hit]
            mark = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(mark, p, 1)
            np.add.at(mark, p + m, -1)
            need = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            code = np.full(len(w.h), -1, np.int64)
            code[need] = self.codes(w, need)
            block = np.cumsum(n) // pairs
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(block)) + 1):
                x = pos[np.repeat(low[part], n[part]) + within(n[part])]
                q = np.repeat(p[part], n[part])
                same = np.ones(len(q), bool)
                for t in range(m):
                    same &= code[q + t] == self.code[x + t]
                q, x = q[same], x[same]
                d = w.doc[q]
                yield merged(d, self.words.doc[x], q - w.first[d], q - w.first[d] + m)

    def spans(self, w: Words, pairs: int = 4_000_000) -> pa.ListArray:
        """Per document of the slice: the stretches of words covered by windows of an item, by item and start."""
        found = list(self.hits(w, pairs))
        none = [np.zeros(0, np.int64)] * 4
        doc, item, start, end = merged(*[np.concatenate(x) for x in zip(*found)] if found else none)
        off = np.searchsorted(doc, np.arange(len(w.off)))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(
            [self.ids.take(pa.array(item)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["item_id", "start", "end"]))


def find_spans(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text", span: int = SPAN, k: int = K,
               names: tuple[str, str] = ("n_words", "spans"), max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """``keep`` columns of every document row with its word count and its hit spans.

    A benchmark within ``max_index_words`` (counted first) goes to every task and documents
    are read once without a shuffle. A larger one is joined by hash, see ``_joined``.
    """
    items = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.select(F.sum(F.length("text")).alias("c"), F.count("*").alias("n")).first()
    if (size["c"] or 0) // 2 + size["n"] > max_index_words:
        return _joined(docs, items, keep, text, span, k, names)
    rows = sorted(((r[0], r[1] or "") for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared = ship(docs.sparkSession, Index([r[0] for r in rows], [r[1] for r in rows], span, k))

    def make():
        index = shared()

        def fn(col):
            w = Words(col, "alnum", True)
            return [pa.array(np.diff(w.first), pa.int64()), index.spans(w)]
        return fn
    return map_text(docs, make, [field(names[0], T.LongType()), field(names[1], SPANS)], keep, text)


def _hash_rows(df: DataFrame, key: str, span: int, k: int, lengths: list[int], own: bool) -> DataFrame:
    """(key, fp): different kept hashes; for items (own) only the gram that is the whole short item."""
    out = T.StructType([field(key, T.StringType()), field("fp", T.LongType())])

    def run(batches):
        for b in batches:
            w = Words(b.column(1), "alnum", True)
            sizes = np.diff(w.first)
            keep = [winnowed(w, k, span)]
            for m in lengths:
                p, g = short_grams(w, m)
                mine = sizes[w.doc[p]] == m if own else np.ones(len(p), bool)
                keep.append((p[mine], g[mine]))
            p, g = np.concatenate([x for x, _ in keep]), np.concatenate([x for _, x in keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.doc[p])), pa.array(g.view(np.int64))], names=out.fieldNames())
    return df.mapInArrow(run, out).distinct()


def _joined(docs: DataFrame, items: DataFrame, keep: list[str], text: str, span: int, k: int,
            names: tuple[str, str]) -> DataFrame:
    """The same for a benchmark of any size: hashes meet by a shuffle join, hit texts are joined and extended."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    d = docs.select(F.sha2(body, 256).alias("dk"), body.alias("dt")).distinct()
    i = items.select(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")),
                                 F.sha2(F.coalesce("text", F.lit("")), 256)).alias("ik"),
                     "item_id", F.coalesce("text", F.lit("")).alias("it")).distinct()
    counted = map_text(items, lambda: lambda col: [pa.array(np.diff(Words(col, "alnum", True).first), pa.int64())],
                       [field("n", T.LongType())], [], "text")
    every = sorted(r[0] for r in counted.where(f"n BETWEEN 1 AND {span - 1}").distinct().collect())   # below span values
    hits = _hash_rows(d.select("dk", "dt"), "dk", span, k, every, False).join(
        _hash_rows(i.select("ik", "it"), "ik", span, k, every, True), "fp").select("dk", "ik").distinct()
    pairs = hits.join(d, "dk").join(i, "ik")
    out = T.StructType([field("dk", T.StringType()), *SPANS.elementType.fields])

    def extend(batches):
        for b in batches:
            for dk, item, text, own in zip(*[b.column(c).to_pylist() for c in ("dk", "item_id", "dt", "it")]):
                found = Index([item], [own], span, k).spans(Words(pa.array([text], pa.string()), "alnum", True)).flatten()
                yield pa.RecordBatch.from_arrays([pa.array([dk] * len(found), pa.string()), *found.flatten()], names=out.fieldNames())
    spans = (pairs.mapInArrow(extend, out).groupBy("dk")
             .agg(F.collect_list(F.struct("item_id", "start", "end")).alias("__spans")))

    def make():
        return lambda col: [pa.array(np.diff(Words(col, "alnum", True).first), pa.int64())]
    keyed = docs.withColumn("__dk", F.sha2(body, 256))
    counted = map_text(keyed, make, [field(names[0], T.LongType())], [*keep, "__dk"], text)
    return (counted.join(spans, F.col("__dk") == F.col("dk"), "left")
            .select(*[F.col(f"`{c}`") for c in keep], F.col(names[0]),
                    F.coalesce("__spans", F.array().cast(SPANS)).alias(names[1])))


def covered(spans) -> int:
    """Words inside any span (the spans may overlap)."""
    n = end = 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def digest(found: DataFrame) -> DataFrame:
    """Contract columns from (doc_id, n_words, spans)."""
    out = T.StructType([found.schema["doc_id"], field("n_words", T.LongType()), field("n_hit", T.LongType()),
                        field("n_items", T.LongType()), field("items_sha256", T.StringType()),
                        field("contaminated", T.BooleanType())])

    def run(batches):
        for b in batches:
            hit, n, sha = [], [], []
            for spans in b.column(2).to_pylist():
                ids = sorted({str(s["item_id"]) for s in spans if s["item_id"] is not None})
                hit.append(covered(spans))
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], names=out.fieldNames())
    return found.select("doc_id", "n_words", "spans").mapInArrow(run, out)
