"""Operator 2: byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes its part of the corpus in bounded chunks. The distinct pre-tokens of a chunk
are laid out in one array of byte tokens. An inverted index leads from the rank of a token
pair to the positions where that pair stands; ranks are applied in order, each to all its
positions at once, and only the pairs beside a merged position enter the index anew.
Documents are then strings of pre-token numbers, so encoding them is a lookup. Nothing is
shuffled, so a corpus of any size costs the same per byte and a lost task redoes its part.

Null text counts as empty; an empty text has no ids. Special tokens are never produced.
Repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

from qforge.llm.textops import field, map_text, ship

CHUNK_BYTES = 8 << 20


class Ranks:
    """Token bytes by rank, and every way to split a token into two (sorted pair keys -> rank)."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank = tokens
        self.bytes = {r: b for b, r in tokens.items()}
        self.byte = np.array([tokens[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted((tokens[b[:i]] << 32 | tokens[b[i:]], r) for b, r in tokens.items()
                       for i in range(1, len(b)) if b[:i] in tokens and b[i:] in tokens)
        self.key, self.to = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        # tokens that are part of a token of lower rank: merging one may call for a lower rank again
        self.risky = {x for side in (self.key >> 32, self.key & 0xFFFFFFFF) for x in side[self.to < side].tolist()}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two do not form a token."""
        if not len(self.key):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        j = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[j] == key, self.to[j], -1)


def load_ranks(spark: SparkSession, path: str) -> Ranks:
    """Read a rank file (base64 token, rank) on the driver; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_word(word: bytes, ranks: Ranks) -> list[int]:
    """One word, pair by pair: the leftmost pair of lowest rank first."""
    parts = [bytes([x]) for x in word]
    while True:
        best = min(((ranks.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.rank),
                   default=None)
        if best is None:
            return [ranks.rank[x] for x in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, offsets): every merge in rank order over an inverted index."""
    size = np.array([len(x) for x in words], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    tok = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tok)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[off[1:][size > 0] - 1] = -1
    prv[off[:-1][size > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, x in zip(rank[np.concatenate([[0], cut])].tolist() if len(rank) else [], np.split(at, cut)):
            if r in index:
                index[r].append(x)
            else:
                index[r] = [x]
                heapq.heappush(heap, r)

    at = np.flatnonzero(nxt >= 0)
    r = ranks.of(tok[at], tok[nxt[at]])
    post(at[r >= 0], r[r >= 0])
    odd: list[np.ndarray] = []
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        p = p[(tok[p] >= 0) & (nxt[p] >= 0)]
        p = p[ranks.of(tok[p], tok[nxt[p]]) == rank]
        if not len(p):
            continue
        q = nxt[p]
        chained = p[1:] == q[:-1]
        if chained.any():                    # "aaa": from the left, every other one
            begin = np.concatenate([[True], ~chained])
            step = np.arange(len(p)) - np.maximum.accumulate(np.where(begin, np.arange(len(p)), 0))
            p, q = p[step % 2 == 0], q[step % 2 == 0]
        nn, pp = nxt[q], prv[p]
        if rank in ranks.risky:              # words where that can happen are encoded alone at the end
            after, before = ranks.of(np.full(len(p), rank), tok[nn]), ranks.of(tok[pp], np.full(len(p), rank))
            low = (nn >= 0) & (after >= 0) & (after < rank) | (pp >= 0) & (before >= 0) & (before < rank)
            odd.append(p[low])
        tok[p], tok[q], nxt[p] = rank, -1, nn
        prv[nn[nn >= 0]] = p[nn >= 0]
        near = np.concatenate([pp[pp >= 0], p[nn >= 0]])
        near = near[tok[near] >= 0]          # a neighbour may just have been merged away
        if len(near):
            r = ranks.of(tok[near], tok[nxt[near]])
            if rank in ranks.risky:
                odd.append(near[(r >= 0) & (r < rank)])
            post(near[r >= 0], r[r >= 0])
    live = tok >= 0
    count = np.add.reduceat(np.concatenate([live, [False]]).astype(np.int64), off[:-1]) if len(words) else size
    count = np.where(size > 0, count, 0)
    ids = tok[live]
    again = set(np.unique(np.searchsorted(off, np.concatenate(odd), side="right") - 1).tolist()) if odd else set()
    whole = {i: [ranks.rank[x]] for i, x in enumerate(words) if x in ranks.rank and count[i] != 1}
    if again or whole:                       # a pre-token that is a token stays whole
        start = np.concatenate([[0], np.cumsum(count)])
        fixed = {i: whole.get(i) or encode_word(words[i], ranks) for i in again | set(whole)}
        parts = [fixed[i] if i in fixed else ids[start[i]:start[i + 1]] for i in range(len(words))]
        count = np.array([len(x) for x in parts], np.int64)
        ids = np.concatenate([np.asarray(x, np.int64) for x in parts])
    return ids, np.concatenate([[0], np.cumsum(count)])


#: Up to here letters, numbers and white space are the same in every Unicode version.
PLAIN_END = 0x250


def plain_pattern(pattern: str) -> str | None:
    """The pattern for the standard library's engine, for texts of characters below PLAIN_END; None if it has other classes."""
    def run(ok):
        return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if ok(chr(c)))
    classes = {"\\p{L}": run(lambda c: unicodedata.category(c)[0] == "L"),
               "\\p{N}": run(lambda c: unicodedata.category(c)[0] == "N"), "\\s": "\t-\r \x85\xa0"}
    out, i, inside = "", 0, False
    while i < len(pattern):
        name = next((k for k in classes if pattern.startswith(k, i)), None)
        if name:
            out += classes[name] if inside else f"[{classes[name]}]"
            i += len(name)
        elif pattern.startswith("\\S", i) and not inside:
            out += f"[^{classes['\\s']}]"
            i += 2
        elif pattern[i] == "\\":
            return None
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out += pattern[i]
            i += 1
    return out


class Encoder:
    """Encode lists of texts to id arrays, and ids back to bytes."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex
        self.ranks, self.any = ranks, regex.compile(pattern).findall
        plain = plain_pattern(pattern)
        self.plain = re.compile(plain).findall if plain else self.any
        self.other = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]").search
        self.bytes = [ranks.bytes.get(i, b"") for i in range(max(ranks.bytes) + 1)]

    def find(self, text: str) -> list[str]:
        return (self.any if self.other(text) else self.plain)(text)

    def each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of one text after the other; all that is held of the texts is a number (4 bytes) a pre-token."""
        number: dict[str, int] = {}
        put = number.setdefault
        docs = [np.array([put(x, len(number)) for x in self.find(t)], np.int32) for t in texts]
        ids, off = replay([x.encode() for x in number], self.ranks)
        size = np.diff(off)
        for d in docs:
            k = size[d]
            end = np.cumsum(k)
            total = int(end[-1]) if len(end) else 0
            at = np.arange(total) - np.repeat(end - k, k) + np.repeat(off[:-1][d], k)
            yield ids[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.each(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def tokenize(docs: DataFrame, ranks: Ranks, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every document."""
    shared = ship(docs.sparkSession, ranks)

    def make():
        enc = Encoder(shared(), pattern)
        return lambda col: [pa.array(enc.encode(pc.fill_null(col, "").to_pylist()), pa.list_(pa.int32()))]
    return map_text(docs, make, [field("ids", T.ArrayType(T.IntegerType()))], keep, text, CHUNK_BYTES)


def detokenize(encoded: DataFrame, ranks: Ranks, keep: list[str]) -> DataFrame:
    """``keep`` columns and the decoded bytes of ``ids`` (null ids: no bytes)."""
    shared = ship(encoded.sparkSession, ranks)
    sel = encoded.select(*keep, "ids")
    out = T.StructType([*[sel.schema[c] for c in keep], field("decoded", T.BinaryType())])

    def run(batches):
        names = shared().bytes
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([b"".join(map(names.__getitem__, x or [])) for x in b.column(b.num_columns - 1).to_pylist()],
                                           pa.binary())], names=out.fieldNames())
    return sel.mapInArrow(run, out)


def digests(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens and the two digests, in one pass over each chunk."""
    shared = ship(docs.sparkSession, ranks)

    def make():
        enc = Encoder(shared(), pattern)
        digit = [str(i) for i in range(len(enc.bytes))]
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def fn(col):
            n, a, b = [], [], []
            for ids in enc.each(pc.fill_null(col, "").to_pylist()):
                n.append(len(ids))
                a.append(sha(" ".join(map(digit.__getitem__, ids.tolist())).encode()))
                b.append(sha(enc.decode(ids)))
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        return fn
    return map_text(docs, make, [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()),
                                 field("decoded_sha256", T.StringType())], ["doc_id"], text, CHUNK_BYTES)
