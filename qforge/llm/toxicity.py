"""Operator 12: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps every character to one character: lower case, full-width forms and look-alike letters of other alphabets to their Latin
ones, and digits and signs that stand for letters (0 o, 1 i, 3 e, 4 a, 5 s, 7 t, @ a, $ s, ! i, | i) where a letter follows them in
their word. ``l`` and ``i`` fold together, as 1 and | stand for either. Spans of matches are therefore spans of the text.

Lexicon entries are whole folded words or word stems (their first 4 to 8 letters), learned from labelled documents of which near
copies are left out (documents that share two of their eight smallest 3-word hashes), so that the words of one much copied text
do not look toxic. An entry must occur in toxic documents beyond chance (binomial tail below exp(-``MIN_EVIDENCE``), by Chernoff's
bound) and with odds ratio exp(``MIN_WEIGHT``) or more. Of entries that continue each other the strongest stays. An entry's weight is its log odds
ratio. Matches inside exception phrases are not counted. Such phrases are given as parameter or learned: an entry with the word before or
after it, as rarely in toxic documents as any text and far below the entry's own rate. Entries are weighed again without them, for
which candidates need only odds ratio exp(``DRAFT_WEIGHT``).

A document's evidence is the weight of the distinct entries it holds, divided by the logarithm of its length in words, and the weight of all
matches a word. A logistic model of both gives the score.

Fitted on at most ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other labelled documents (documented bounds, chosen by a hash of the id, one text an id);
every document is scored by its whole text. Only the text is read for a score. Of repeated label rows the worst counts;
rows with a null id or mark are left out. Null text counts as empty. Without labelled documents of both classes every score is 0. Repeated
documents are scored one by one. Ties between candidates go to the larger, then the longer, then the alphabetically first one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field as member

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from qforge.llm.textops import Words, field, gram_hashes, map_text, slices

MAX_TOXIC, MAX_OTHER = 10_000, 20_000
#: MAX_CANDIDATES bounds what the strongest terms of the sample may bring to the driver.
MIN_DOCS, MIN_EVIDENCE, MIN_WEIGHT, DRAFT_WEIGHT, MAX_CANDIDATES = 5, 14.0, 2.0, 0.7, 20_000
STEM = range(4, 9)

# Letters of other alphabets that look like Latin ones, and signs written for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
              "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
              "ı": "i", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ℓ": "i", "l": "i"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
_SIGNED = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\W_]))[0134578@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


class _Folding(dict):
    """Code point -> folded character, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else chr(code)
        low = c.lower()
        low = low if len(low) == 1 else c
        self[code] = out = LOOKALIKES.get(low, low)
        return out


def folder() -> Callable[[str], str]:
    """A function that folds a text to one of the same length."""
    table, signs = _Folding(), str.maketrans(SIGNS)
    return lambda text: _SIGNED.sub(lambda m: m[0].translate(signs), text.translate(table))


def words_of(folded: str) -> set[str]:
    return set(_WORD.findall(folded))


def terms_of(words: Iterable[str]) -> set[str]:
    """Words (marked by a full stop) and their stems."""
    out = set()
    for w in words:
        out.add(w + ".")
        out.update(w[:k] for k in STEM if len(w) > k)
    return out


@dataclass
class Lexicon:
    """Terms (a word ends in a full stop, else a stem) with weights, exception phrases, and the logistic model."""
    terms: list[str]
    weights: np.ndarray
    exceptions: frozenset[tuple[str, ...]] = frozenset()
    model: tuple[float, float, float] | None = None
    counts: list[tuple[int, int]] = member(default_factory=list)     # toxic and other documents of each term

    def matcher(self) -> Callable[[str], list[tuple[int, int, int]]]:
        """Folded text -> (start, end of the whole word, term) of all matches outside exception phrases."""
        if not self.terms:
            return lambda t: []
        auto = ahocorasick.Automaton()
        by_text: dict[str, list[int]] = {}
        for i, term in enumerate(self.terms):
            by_text.setdefault(term.rstrip("."), []).append(i)
        for text, ids in by_text.items():
            auto.add_word(text, (len(text), ids))
        auto.make_automaton()
        excused = _excused(self.exceptions)

        def find(t: str) -> list[tuple[int, int, int]]:
            out, n = [], len(t)
            for end, (size, ids) in auto.iter(t):
                start = end - size + 1
                if start and (t[start - 1].isalnum()):
                    continue
                stop = end + 1
                if stop < n and t[stop].isalnum():
                    stop = _WORD.match(t, start).end()
                for i in ids:
                    if (stop == end + 1) == self.terms[i].endswith(".") and not excused(t, start, stop):
                        out.append((start, stop, i))
            return out
        return find

    def evidence(self, hits: list[tuple[int, int, int]], n_words: int) -> tuple[float, float]:
        """Weight of the distinct entries by the log of the length, and of all matches a word."""
        if not hits:
            return 0.0, 0.0
        ids = [i for _, _, i in hits]
        return (float(self.weights[list(set(ids))].sum() / np.log(np.e + n_words)),
                float(np.sqrt(self.weights[ids].sum() / max(n_words, 1))))

    def score(self, hits: list[tuple[int, int, int]], n_words: int) -> float:
        if self.model is None:
            return 0.0
        a, b = self.evidence(hits, n_words)
        x = self.model[0] * a + self.model[1] * b + self.model[2]
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def _neighbours(t: str, start: int, stop: int, before: int, after: int) -> tuple[list[str], list[str]]:
    """Up to so many words before and after a span, from a bounded stretch of text."""
    left = _WORD.findall(t[max(0, start - 64 * before):start])[-before:] if before else []
    right = _WORD.findall(t[stop:stop + 64 * after])[:after] if after else []
    return left, right


def _excused(phrases: frozenset[tuple[str, ...]]) -> Callable[[str, int, int], bool]:
    """Whether the word at a span stands inside an exception phrase."""
    by_word: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for p in phrases:
        for i, w in enumerate(p):
            by_word.setdefault(w, []).append((p, i))

    def test(t: str, start: int, stop: int) -> bool:
        mine = by_word.get(t[start:stop])
        if not mine:
            return False
        for p, i in mine:
            left, right = _neighbours(t, start, stop, i, len(p) - i - 1)
            if tuple(left) == p[:i] and tuple(right) == p[i + 1:]:
                return True
        return False
    return test


def sample(docs: DataFrame, labels: DataFrame, usable: Column, text: str, max_toxic: int, max_other: int) -> DataFrame:
    """(toxic, text) of a bounded number of labelled documents without near copies; ``usable`` is told from ``doc_id``."""
    marks = (labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    first = lambda cond, n: marks.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = first("toxic = 1", max_toxic).unionByName(first("toxic != 1", max_other)).select(F.col("doc_id").alias("__id"), "toxic")
    # at most max_toxic + max_other rows of two numbers are broadcast
    mine = docs.select(F.col("doc_id").alias("__doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = (mine.join(F.broadcast(some), F.col("__doc") == F.col("__id"))
            .groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).checkpoint())
    ids = rows.sparkSession.createDataFrame([(i,) for i in without_copies(rows)], "__own long")       # as many again
    return rows.join(F.broadcast(ids), F.col("__id") == F.col("__own")).select("toxic", "text").checkpoint()


def without_copies(rows: DataFrame, grams: int = 8) -> list[int]:
    """Ids of sampled documents, in the order of their smallest hash, that share at most one of their smallest 3-word hashes with an earlier one."""
    out = T.StructType([field("id", T.LongType()), field("sketch", T.BinaryType())])

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                w, got = Words(part.column(1), "alnum", True), []
                for d in range(part.num_rows):
                    h = w.h[w.first[d]:w.first[d + 1]]
                    got.append(np.unique(gram_hashes(h, min(3, max(len(h), 1))))[:grams].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=out.fieldNames())
    found = rows.select(F.col("__id").cast("long"), "text").mapInArrow(run, out).collect()        # 72 bytes a sampled document
    kept, taken = [], set()
    for sketch, i in sorted((np.frombuffer(bytes(r["sketch"]), "<u8").tolist(), r["id"]) for r in found):
        same = sum(x in taken for x in sketch)
        if same < min(2, len(sketch)) or not sketch:
            kept.append(i)
            taken.update(sketch)
    return kept


def candidates(rows: DataFrame, n_toxic: int, n_other: int, max_candidates: int = MAX_CANDIDATES) -> list[str]:
    """Terms of toxic documents beyond chance, the strongest first."""
    out = T.StructType([field("term", T.StringType()), field("toxic", T.LongType()), field("n", T.LongType())])

    def run(batches):
        fold = folder()
        for b in batches:
            n, bad = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms_of(words_of(fold(t)))
                n.update(found)
                if y == 1:
                    bad.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([bad[k] for k in n], pa.int64()),
                                              pa.array(list(n.values()), pa.int64())], names=out.fieldNames())
    q = n_toxic / (n_toxic + n_other)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n_other + 1))
    got = (rows.mapInArrow(run, out).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
           .where(F.col("toxic") >= MIN_DOCS).where(F.col("toxic") > F.col("n") * q).withColumn("beyond", F.round(_evidence(F.lit(q)), 9))
           .where(F.col("beyond") >= MIN_EVIDENCE).withColumn("odds", odds).where(F.col("odds") >= DRAFT_WEIGHT)
           .orderBy(F.desc(F.col("odds") >= MIN_WEIGHT), F.desc("beyond"), F.desc(F.length("term")), "term").limit(max_candidates))
    return [r["term"] for r in got.select("term").collect()]


def _evidence(q: Column) -> Column:
    """Chernoff's exponent of finding ``toxic`` of ``n`` at rate q."""
    p = F.col("toxic") / F.col("n")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return F.col("n") * (part(p, q) + part(1 - p, 1 - q))


def choose(terms: list[str]) -> list[str]:
    """Of terms that continue each other (``path``, ``pathetic.``) the first."""
    out, texts, heads = [], set(), set()
    for term in terms:
        t = term.rstrip(".")
        if t in heads or any(t[:k] in texts for k in range(1, len(t) + 1)):
            continue
        out.append(term)
        texts.add(t)
        heads.update(t[:k] for k in range(1, len(t) + 1))
    return out


def contexts(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(toxic, hits): the distinct entries of every sampled document, and those with the phrase of each match."""
    hit = T.ArrayType(T.StructType([field("term", T.IntegerType()), field("phrase", T.StringType())]))
    out = T.StructType([field("toxic", T.IntegerType()), field("hits", hit)])

    def run(batches):
        fold, find = folder(), lexicon.matcher()
        for b in batches:
            hits = []
            for t in map(fold, b.column(1).to_pylist()):
                mine = set()
                for s, e, i in find(t):
                    left, right = _neighbours(t, s, e, 1, 1)
                    mine.add((i, None))
                    mine.update((i, " ".join(p)) for p in ([*left, t[s:e]], [t[s:e], *right]) if len(p) == 2)
                hits.append([{"term": i, "phrase": p} for i, p in mine])
            kind = pa.list_(pa.struct([("term", pa.int32()), ("phrase", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(hits, kind)], names=out.fieldNames())
    return (rows.mapInArrow(run, out).select((F.col("toxic") == 1).cast("long").alias("toxic"), F.explode("hits").alias("hit"))
            .groupBy("hit.term", "hit.phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")))


def learned_exceptions(found: DataFrame, share: float) -> set[tuple[str, ...]]:
    """Phrases of an entry that are not toxic beyond the share of toxic documents, and far less so than the entry."""
    own = found.where("phrase IS NULL").select("term", (F.col("toxic") / F.col("n")).alias("rate"))
    few = (found.where("phrase IS NOT NULL").where(F.col("n") >= MIN_DOCS).where(F.col("toxic") <= F.col("n") * share).join(F.broadcast(own), "term")
           .where((F.col("toxic") < F.col("n") * F.col("rate"))).where((F.col("rate") == 1) | (_evidence(F.col("rate")) >= MIN_EVIDENCE)))
    return {tuple(r["phrase"].split(" ")) for r in few.select("phrase").distinct().collect()}      # a bounded sample's phrases


def measured(rows: DataFrame, lexicon: Lexicon) -> list:
    """(toxic, the two kinds of evidence) of the sampled documents."""
    out = T.StructType([field("toxic", T.IntegerType()), field("a", T.DoubleType()), field("b", T.DoubleType())])

    def run(batches):
        fold, find = folder(), lexicon.matcher()
        for b in batches:
            x = [lexicon.evidence(find(t), len(t.split())) for t in map(fold, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *(pa.array([v[i] for v in x], pa.float64()) for i in (0, 1))],
                                             names=out.fieldNames())
    return rows.mapInArrow(run, out).collect()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps for ridge logistic regression with an intercept."""
    z, b = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * len(b))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, exceptions: Iterable[str] = (), text: str = "text",
        max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Lexicon:
    """Lexicon, exceptions and model from labelled documents; ``usable`` (told from ``doc_id``) may hold some back."""
    fold = folder()
    given = frozenset(tuple(_WORD.findall(fold(p))) for p in exceptions)
    rows = sample(docs, labels, F.lit(True) if usable is None else usable, text, max_toxic, max_other)
    size = {r["toxic"] == 1: r["n"] for r in rows.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return Lexicon([], np.zeros(0), given)
    terms = choose(candidates(rows, n1, n0))
    phrases = given | learned_exceptions(contexts(rows, Lexicon(terms, np.zeros(len(terms)), given)).checkpoint(), n1 / (n1 + n0))
    seen = np.zeros((len(terms), 2))
    for r in contexts(rows, Lexicon(terms, np.zeros(len(terms)), phrases)).where("phrase IS NULL").collect():      # an entry a row
        seen[r["term"]] = r["toxic"], r["n"] - r["toxic"]
    weights = np.log((seen[:, 0] + 0.5) / (n1 + 1)) - np.log((seen[:, 1] + 0.5) / (n0 + 1))
    strong = np.flatnonzero((weights >= MIN_WEIGHT) & (seen[:, 0] >= MIN_DOCS))
    out = Lexicon([terms[i] for i in strong], weights[strong], frozenset(phrases), None, [tuple(map(int, r)) for r in seen[strong]])
    x = measured(rows, out)
    out.model = logistic(np.array([r[1:] for r in x]), np.array([float(r[0] == 1) for r in x]))
    return out


SPANS = T.ArrayType(T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType()), field("term", T.StringType()), field("weight", T.DoubleType())]))


def scan(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and ``spans``: matched words (code points, end exclusive) with entry and weight."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))

    def make():
        fold, find = folder(), lexicon.matcher()

        def fn(col: pa.Array) -> list:
            scores, spans = [], []
            for t in col.to_pylist():
                t = fold(t or "")
                hits = find(t)
                scores.append(lexicon.score(hits, len(t.split()) if hits else 0))
                spans.append([{"start": s, "end": e, "term": lexicon.terms[i], "weight": float(lexicon.weights[i])} for s, e, i in hits])
            return [pa.array(scores, pa.float64()), pa.array(spans, kind)]
        return fn
    return map_text(docs, make, [field("score", T.DoubleType()), field("spans", SPANS)], keep, text)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: those whose crc32 of the id as text is divisible by 5 (null: false, it has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns, and the number of matches."""
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id")))
    return scan(docs, lexicon, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_matches"))
