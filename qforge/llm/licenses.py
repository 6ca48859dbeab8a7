"""Operator 9: licence scan with a positional rare-token index.

The words of all templates form a small vocabulary. One pass counts, over all documents,
in how many each of them occurs (IDF). The index lists, for each word, the templates and
offsets it stands at. In a file only the highest-IDF words of each template are looked up;
each occurrence places the template (position minus offset), the other words are compared
at their relative positions, and the mandatory key phrase must stand at its place. A base
phrase must match whole.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null or empty text: no
words, no labels, score 0. Repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from qforge.llm.textops import Words, field, map_text, slices

# Phrase -> label (matched whole, every place counts).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Template text, mandatory key phrase inside it, label.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", "mit"),
    ("released under the mit license", "mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use", "bsd"),
    ("licensed under the gnu general public license version 3", "gnu general public license", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
]
ANCHORS, MIN_SCORE = 3, 0.7


class Index:
    """Vocabulary hashes and, per template, word ids, key-phrase slice and label."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str, str]]):
        texts = [(p, p, label, True) for p, label in base.items()] + [(t, k, label, False) for t, k, label in templates]
        self.words = sorted({x for t, _, _, _ in texts for x in t.split()})
        at = {x: i for i, x in enumerate(self.words)}
        w = Words(pa.array([" ".join(self.words)]), "alnum", True)
        order = np.argsort(w.h)
        self.hash, self.id = w.h[order], np.arange(len(self.words))[order]
        self.templates = []
        for t, key, label, whole in texts:
            ids, k = [at[x] for x in t.split()], [at[x] for x in key.split()]
            o = next(i for i in range(len(ids)) if ids[i:i + len(k)] == k)
            self.templates.append((np.array(ids), (o, o + len(k)), label, whole))

    def lookup(self, w: Words) -> np.ndarray:
        """Vocabulary id of each word of the slice, -1 for others (bytes compared)."""
        j = np.minimum(np.searchsorted(self.hash, w.h), len(self.hash) - 1)
        out = np.where(self.hash[j] == w.h, self.id[j], -1)
        size = np.array([len(x) for x in self.words])
        hit = np.flatnonzero(out >= 0)
        out[hit[size[out[hit]] != (w.e - w.s)[hit]]] = -1
        return out


def document_frequency(docs: DataFrame, index: Index, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each vocabulary word occurs, and the number of documents (one row a word)."""
    out = T.StructType([field("i", T.IntegerType()), field("n", T.LongType())])
    col = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        seen = np.zeros(len(index.words) + 1, np.int64)
        for b in batches:
            for part in slices(b, 0):
                w = Words(part.column(0), "alnum", True)
                wid = index.lookup(w)
                hit = wid >= 0
                pairs = np.unique(w.doc[hit] * np.int64(len(index.words)) + wid[hit])
                seen[:-1] += np.bincount(pairs % len(index.words), minlength=len(index.words))
                seen[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen)), pa.int32()), pa.array(seen)], names=["i", "n"])
    got = {r["i"]: r["n"] for r in col.mapInArrow(run, out).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return {x: got.get(i, 0) for i, x in enumerate(index.words)}, got.get(len(index.words), 0)


def place(w: Words, wid: np.ndarray, ids: np.ndarray, anchors: list[int]):
    """(start, document, same) of every placement: where the template's first word would stand, and which of its words agree there.

    A placement belongs to the document of the anchor word that proposed it: at a border of documents one start
    may be a cut template of each of them.
    """
    hit = [np.flatnonzero(wid == ids[o]) for o in anchors]
    pairs = np.stack([np.concatenate([h - o for h, o in zip(hit, anchors)]), w.doc[np.concatenate(hit)]])
    starts, home = np.unique(pairs, axis=1)
    n = len(wid)
    if not len(starts):
        return starts, home, np.zeros((0, len(ids)), bool)
    at = starts[:, None] + np.arange(len(ids))
    inside = (at >= 0) & (at < n)
    safe = np.clip(at, 0, n - 1)
    return starts, home, inside & (wid[safe] == ids) & (w.doc[safe] == home[:, None])


def scan(docs: DataFrame, keep: list[str], text: str = "text", base: dict[str, str] | None = None,
         templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``keep`` columns, word count, base places (label, start) and template matches (label, start, score)."""
    index = Index(BASE if base is None else base, TEMPLATES if templates is None else templates)
    df, total = document_frequency(docs, index, text)
    idf = np.array([math.log((total + 1) / (df[x] + 1)) + 1 for x in index.words])
    places = T.ArrayType(T.StructType([field("label", T.StringType()), field("start", T.LongType())]))
    found = T.ArrayType(T.StructType([*places.elementType.fields, field("score", T.DoubleType())]))
    a_places = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    a_found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))

    def make():
        def fn(col):
            w = Words(col, "alnum", True)
            wid = index.lookup(w)
            n = len(w.off) - 1
            whole, near = [[] for _ in range(n)], [[] for _ in range(n)]
            for ids, (k0, k1), label, is_base in index.templates:
                rare = sorted(range(len(ids)), key=lambda o: (-idf[ids[o]], o))
                starts, home, same = place(w, wid, ids, rare[:1] if is_base else rare[:ANCHORS])
                score = (same * idf[ids]).sum(axis=1) / idf[ids].sum()
                ok = same.all(axis=1) if is_base else same[:, k0:k1].all(axis=1) & (score >= MIN_SCORE)
                for t in np.flatnonzero(ok):
                    if any(w.word(starts[t] + o) != index.words[ids[o]].encode() for o in np.flatnonzero(same[t])):
                        continue                          # equal hash, other word
                    d = int(home[t])
                    x = {"label": label, "start": int(max(starts[t], w.first[d]) - w.first[d])}
                    if is_base:
                        whole[d].append(x)
                    else:
                        near[d].append(x | {"score": min(1.0, float(score[t]))})
            return [pa.array(np.diff(w.first), pa.int64()), pa.array(whole, a_places), pa.array(near, a_found)]
        return fn
    return map_text(docs, make, [field("n_words", T.LongType()), field("base", places), field("matches", found)],
                    keep, text)


def digest(scanned: DataFrame) -> DataFrame:
    """Contract columns, all by built-in functions."""
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    start = F.transform("base", lambda x: x["start"])
    best = F.array_max(F.transform("matches", lambda x: x["score"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("matches"))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
