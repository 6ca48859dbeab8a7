"""Operator 3: substring dedup with repeated-phrase automata.

A phrase is a window of ``span`` consecutive words. Every window has a smallest 5-gram; windows
with equal words have the same one, so it decides the shard.

1. Candidates: shards count in how many documents each kept 5-gram occurs.
2. Only stretches whose 5-gram recurs travel on. Their shard confirms the windows that really occur
   in two documents, compiles them into Aho-Corasick automata over word numbers (bounded in
   size, several a shard if needed) and streams every distinct stretch through them once; what is found
   holds at each of its places in each document.
3. The places found where a smaller doc_id has the phrase go back to the documents, whose covered words
   are removed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null or empty text: no words. A null doc_id is not
smaller or larger than any, so its row keeps all words and removes none elsewhere. Rows with an equal doc_id
do not remove words from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from qforge.llm.parcels import PACKED, deal, documents, pack, pack_documents, partitions, rows, table, text_slices, unpack
from qforge.llm.textops import Words, field, gram_hashes

SPAN, K = 13, 5
MAX_PATTERNS = 50_000


def minimizers(w: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, position of its rightmost smallest k-gram, that hash) of every window."""
    width = span - k + 1
    g = gram_hashes(w.h, k)
    n = len(g) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = np.flatnonzero(g[j:n + j] <= best)
        best[less] = g[less + j]
        at[less] = less + j
    whole = np.flatnonzero(w.doc[:n] == w.doc[span - 1:span - 1 + n])
    return whole, at[whole], best[whole]


def normal(w: Words) -> tuple[bytes, np.ndarray]:
    """All words of the slice joined by one space, and where each begins (plus the end)."""
    size = w.e - w.s
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    n = int(size.sum())
    own = np.repeat(np.arange(len(size)), size)
    src = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    out[np.arange(n) + own] = w.data[src + np.repeat(w.s, size)]
    return out.tobytes(), begin


def _shard(fp: np.ndarray, n: int) -> np.ndarray:
    return ((fp >> np.uint64(17)) % np.uint64(n)).astype(np.int32)


def _grams(n: int, span: int, k: int):
    """Bucket of documents -> distinct (5-gram, document) by shard."""
    def fn(key, packed):
        ids, known, texts = documents(packed)
        fps, docs = [], []
        for at, col in text_slices(texts):
            w = Words(col, "space", False)
            start, _, fp = minimizers(w, span, k)
            d = w.doc[start] + at
            ok = known[d]
            fp, d = fp[ok], d[ok]
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (d[1:] != d[:-1])
            fps.append(fp[new])
            docs.append(ids[d[new]])
        if not fps:
            return table([])
        fp = np.concatenate(fps)
        return table(deal(_shard(fp, n), n, key[0].as_py(), fp, np.concatenate(docs)))
    return fn


def _recurring(key, packed):
    """Shard -> for each bucket, its 5-grams that occur in two documents or more."""
    parts = [(o, *unpack(b, np.uint64, np.int64)) for o, b in zip(packed.column("origin").to_pylist(), packed.column("body").to_pylist())]
    fp = np.concatenate([p[1] for p in parts])
    doc = np.concatenate([p[2] for p in parts])
    origin = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
    order = np.argsort(fp, kind="stable")
    fp, doc, origin = fp[order], doc[order], origin[order]
    begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    keep = np.repeat(many, np.diff(np.concatenate([begin, [len(fp)]])))
    fp, origin = fp[keep], origin[keep]
    return table([(o, 0, pack(np.unique(fp[origin == o]))) for o in np.unique(origin).tolist()])


def _stretches(n: int, span: int, k: int):
    """Bucket of documents and its recurring 5-grams -> stretches of words that share one, by shard."""
    def fn(key, packed, recurring):
        if not recurring.num_rows or not packed.num_rows:
            return table([])
        known_fp = np.sort(np.concatenate([unpack(b, np.uint64)[0] for b in recurring.column("body").to_pylist()]))
        ids, known, texts = documents(packed)
        out = []
        for at, col in text_slices(texts):
            w = Words(col, "space", False)
            start, pos, fp = minimizers(w, span, k)
            j = np.minimum(np.searchsorted(known_fp, fp), len(known_fp) - 1)
            ok = (known_fp[j] == fp) & known[w.doc[start] + at]
            start, pos, fp = start[ok], pos[ok], fp[ok]
            if not len(start):
                continue
            head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)]))
            tail = np.concatenate([head[1:], [len(start)]]) - 1
            a, b = start[head], start[tail] + span
            text, begin = normal(w)
            x, y = begin[a], begin[b] - 1
            d = w.doc[a]
            to = _shard(fp[head], n)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(n + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[s]:cut[s + 1]]
                body = b"\n".join([text[p:q] for p, q in zip(x[own].tolist(), y[own].tolist())])
                out.append((s, key[0].as_py(), pack(ids[d[own] + at], (d[own] + at).astype(np.int32),
                                                    (a[own] - w.first[d[own]]).astype(np.int32),
                                                    (b[own] - a[own]).astype(np.int32), body)))
        return table(out)
    return fn


def spell(number: np.ndarray, width: int) -> str:
    """Word numbers as ``width`` letters each, base 64. Each place has letters of its own, so a match cannot
    begin inside a word, and no node of an automaton has more than 65 children."""
    digits = np.stack([number >> (6 * i) & 63 | 64 * (i + 1) for i in range(width - 1, -1, -1)], axis=1)
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def automaton(phrases: list[str]):
    """Aho-Corasick automaton over spelled words; the value is the number of the phrase."""
    import ahocorasick
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        a.add_word(phrase, i)
    a.make_automaton()
    return a


def _locate(span: int, max_patterns: int):
    """Shard: confirm recurring phrases, compile them, stream every distinct stretch -> places to remove, by bucket."""
    def fn(key, packed):
        parts = [(o, *unpack(b, np.int64, np.int32, np.int32, np.int32, bytes))
                 for o, b in zip(packed.column("origin").to_pylist(), packed.column("body").to_pylist())]
        origin = np.repeat(np.array([p[0] for p in parts], np.int32), [len(p[1]) for p in parts])
        doc, row, first, sizes = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        # stretches with equal words are confirmed and streamed once; ``which`` leads back to all their places
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(t, len(seen)) for p in parts for t in p[5].split(b"\n")), np.int64, len(doc))
        del parts
        text = pa.array([b"\n".join(seen)], pa.large_binary()).cast(pa.large_string())
        m = len(seen)
        del seen
        hashes = Words(text, "space", False).h
        del text
        size = np.zeros(m, np.int64)
        size[which] = sizes
        places = np.argsort(which, kind="stable")
        from_ = np.searchsorted(which[places], np.arange(m + 1))
        lo, hi = np.minimum.reduceat(doc[places], from_[:-1]), np.maximum.reduceat(doc[places], from_[:-1])
        # word numbers from 1; a 0 after each stretch keeps phrases from running over its end
        number = np.unique(hashes, return_inverse=True)[1] + 1
        begin = np.cumsum(size + 1) - size - 1
        own = np.repeat(np.arange(m), size)
        seq = np.zeros(int((size + 1).sum()), np.int64)
        seq[np.arange(len(number)) + own] = number
        # confirm: which windows occur in two documents, and in which document first
        start = np.concatenate([[0], np.cumsum(size - span + 1)])
        of = np.repeat(np.arange(m), size - span + 1)
        at = begin[of] + np.arange(int(start[-1])) - start[of]
        g = gram_hashes(seq.astype(np.uint64), span)[at]
        order = np.argsort(g, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
        low, high = np.minimum.reduceat(lo[of][order], head), np.maximum.reduceat(hi[of][order], head)
        many = np.flatnonzero(low < high)
        spot, low = at[order][head[many]], low[many]
        del g, order, of, at
        width = max(1, -(-int(seq.max(initial=0)).bit_length() // 6))
        stream, out = spell(seq, width), []
        where = np.repeat(np.arange(m), size + 1)
        for i in range(0, len(spot), max_patterns):
            a = automaton([stream[x * width:(x + span) * width] for x in spot[i:i + max_patterns].tolist()])
            found = np.array(list(a.iter(stream)), np.int64).reshape(-1, 2)
            end = found[:, 0] // width
            t = where[end]
            copies = from_[t + 1] - from_[t]
            hit = np.repeat(np.arange(len(t)), copies)
            place = places[np.arange(len(hit)) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(from_[t], copies)]
            gone = low[i + found[hit, 1]] < doc[place]
            hit, place = hit[gone], place[gone]
            out.append((origin[place], row[place],
                        (first[place] + (end - span + 1 - begin[t])[hit]).astype(np.int32)))
        if not out:
            return table([])
        to, row, word = (np.concatenate([o[i] for o in out]) for i in (0, 1, 2))
        return table(deal(to, int(to.max(initial=-1)) + 1, 0, row, word))
    return fn


def _removed(span: int, with_text: bool):
    """Bucket of documents and its places -> one row a document."""
    def fn(key, packed, places):
        ids, known, texts = documents(packed) if packed.num_rows else ([], [], [])
        pairs = [unpack(b, np.int32, np.int32) for b in places.column("body").to_pylist()] if places.num_rows else []
        row = np.concatenate([p[0] for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
        start = np.concatenate([p[1] for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
        n_words, n_removed, sha, kept = [], [], [], []
        for at, col in text_slices(texts):
            w = Words(col, "space", False)
            mine = (row >= at) & (row < at + len(col))
            p = w.first[row[mine] - at] + start[mine]
            step = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(step, p, 1)
            np.add.at(step, p + span, -1)
            gone = np.cumsum(step[:-1]) > 0
            text, begin = normal(w)
            for d in range(len(col)):
                a, b = int(w.first[d]), int(w.first[d + 1])
                g = gone[a:b]
                if g.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], g.astype(np.int8), [1]]))) + a
                    own = b" ".join([text[begin[x]:begin[y] - 1] for x, y in zip(edge[::2], edge[1::2])])
                else:
                    own = text[begin[a]:begin[b] - 1] if b > a else b""
                n_words.append(b - a)
                n_removed.append(int(g.sum()))
                sha.append(hashlib.sha256(own).hexdigest())
                if with_text:
                    kept.append(own.decode())
        cols = {"doc_id": pa.array([i if k else None for i, k in zip(ids, known)], pa.int64()),
                "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if with_text else {}))
    return fn


def remove_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, k: int = K, with_text: bool = True,
                   max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) the kept words of every document."""
    n = partitions(docs)
    packed = pack_documents(docs, n, text)
    grams = packed.groupBy("bucket").applyInArrow(_grams(n, span, k), PACKED)
    recurring = grams.groupBy("bucket").applyInArrow(_recurring, PACKED)
    stretches = (packed.groupBy("bucket").cogroup(recurring.groupBy("bucket")).applyInArrow(_stretches(n, span, k), PACKED))
    places = stretches.groupBy("bucket").applyInArrow(_locate(span, max_patterns), PACKED)
    out = [field("doc_id", T.LongType()), field("n_words", T.LongType()), field("n_removed", T.LongType()),
           field("kept_sha256", T.StringType()), *([field("kept", T.StringType())] if with_text else [])]
    return (packed.groupBy("bucket").cogroup(places.groupBy("bucket"))
            .applyInArrow(_removed(span, with_text), T.StructType(out)))
