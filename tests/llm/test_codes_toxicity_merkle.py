"""Operators 11 to 13 against brute force on small hostile tables, and on edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qforge.llm import merkle, toxicity, vector_codes


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------ operator 11

VEC = "vec_id long, embedding array<double>, label int, code string, error string, ints int"


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, l, np.floor(scale * np.array(e, float)).astype(np.int64)) for i, e, l in rows
            if e and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].astype("<i4").tobytes()))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    x = np.stack([r[2] for r in kept])
    cut = np.cumsum([0, *vector_codes.widths(x.shape[1], parts)])
    codes, error, books = [], np.zeros(len(x), np.int64), []
    for a, b in zip(cut[:-1], cut[1:]):
        part = x[:, a:b]
        c = part[:entries].copy()
        for turn in range(rounds + 1):
            near = ((part[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            if turn < rounds:
                for j in range(len(c)):
                    mine = part[near == j]
                    if len(mine):
                        c[j] = mine.sum(axis=0) // len(mine)
        codes.append(near)
        error += ((part - c[near]) ** 2).sum(axis=1)
        books.append(c)
    total = {}
    for r, e in zip(kept, error.tolist()):
        total[r[1]] = total.get(r[1], 0) + e
    book = sha(",".join(str(v) for c in books for v in c.reshape(-1).tolist()))
    return [(r[0], "".join("%02x" % c[i] for c in codes), int(error[i]), total[r[1]], book) for i, r in enumerate(kept)]


def vectors(dim, n, seed, step):
    """Coarse values, so that distances tie often."""
    r = random.Random(seed)
    base = [[round(r.uniform(-1, 1) / step) * step for _ in range(dim)] for _ in range(9)]
    return [[v + step * r.randint(-2, 2) for v in r.choice(base)] for _ in range(n)]


@pytest.mark.parametrize("dim,n,step", [(64, 400, 0.25), (35, 300, 0.01), (16, 500, 0.5), (5, 40, 0.125)])
def test_codes_are_brute_force(spark, dim, n, step):
    nan, inf = float("nan"), float("inf")
    body = vectors(dim, n, dim, step)
    rows = [(1000 - i if i % 7 else 5, v, i % 4 or None) for i, v in enumerate(body)]       # unordered and repeated ids
    rows += [rows[3]] * 30 + [(None, body[1], 2), (None, body[2], 2)]
    rows += [(1, None, 1), (2, [], 1), (3, [nan] * dim, 1), (4, [inf] + [0.0] * (dim - 1), 1), (6, [None] + [0.0] * (dim - 1), 1),
             (7, [0.5] * (dim + 1), 1)]
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], VEC).repartition(5)
    coded, book = vector_codes.compress(df)
    got = [tuple(r) for r in vector_codes.digest(coded, book).collect()]
    want = brute_codes(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    near = {tuple(r["ints"]) for r in vector_codes.reconstruct(coded, book).collect()}
    assert all(len(v) == dim for v in near)


def test_bounds_are_safe_and_save_comparisons():
    r = np.random.default_rng(0)
    x = np.floor(r.normal(size=(3000, 4)) * 300).astype(np.int64)
    c = x[:64].copy()
    for b in (0, 1, 2, 8, 63):
        state, old, compared = vector_codes.full(x, c, b), c, []
        for turn in range(6):
            new = old + np.floor(r.normal(size=old.shape) * (3 if turn < 4 else 200)).astype(np.int64)
            new[5] = new[4]                               # equal entries: ties
            shift = np.nextafter(np.sqrt(((old - new) ** 2).sum(axis=1).astype(float)), np.inf)
            state = vector_codes.moved(x, new, state, shift)
            d = vector_codes.distances(x, new)
            assert (state.code == d.argmin(axis=1)).all()
            for j in range(state.near.shape[1]):          # every bound holds
                assert (state.lower[:, j].astype(float) <= np.sqrt(d[np.arange(len(x)), state.near[:, j]])).all()
            listed = np.concatenate([state.code[:, None], state.near], axis=1)
            rest = d.astype(float)
            np.put_along_axis(rest, listed.astype(np.int64), np.inf, axis=1)
            assert (state.outer.astype(float) <= np.sqrt(rest.min(axis=1))).all()
            compared.append((state.needed == b + 1).mean())
            state = vector_codes.narrower(state, b)
            old = new
        if b == 8:
            assert max(compared[1:4]) < 0.1               # small shifts (the first turn moves entry 5 far): few comparisons with all


def test_codes_label_totals_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, [float(i % 13), 1.0], i % 5 if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, vector_codes.digest(*vector_codes.compress(df, parts=2, entries=4)).collect()))
    monkeypatch.setattr(vector_codes, "MAX_LABELS", 1)
    assert sorted(map(tuple, vector_codes.digest(*vector_codes.compress(df, parts=2, entries=4)).collect())) == want


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([], VEC)
    assert vector_codes.digest(*vector_codes.compress(df)).count() == 0
    assert vector_codes.digest(*vector_codes.compress(spark.createDataFrame([(1, None, 1, "", "", 1)], VEC))).count() == 0
    one = vector_codes.digest(*vector_codes.compress(spark.createDataFrame([(1, [0.5] * 32, None, "", "", 1)], VEC))).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 32, None, "", "", 1)], VEC))


# ------------------------------------------------------------------ operator 12

BAD, STEMS = ["gloxer", "brimfat", "skunt"], ["zorvi", "quatle"]


def toxic_corpus(seed=2):
    """Documents of invented words; a third of the toxic ones is written in other letters, and one phrase is harmless."""
    r = random.Random(seed)
    letters = "abdehmnorstuvw"
    vocab = ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(r.choice((4, 30, 300)))]
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(BAD) if r.random() < 0.7 else r.choice(STEMS) + r.choice(vocab)[:3])
        if i % 8 == 0:
            w.insert(r.randrange(len(w)), "gloxer fish")
        docs.append((i, " ".join(w), "en", None, 1, "x", 0.5))
        labels.append((i, toxic))
    copied = docs[0][1].replace("gloxer fish", "") + " skunt " + " ".join(f"only{k}here" for k in range(20))
    for i in range(900, 980):                             # copies of one toxic text: its other words are innocent
        docs.append((i, f"{copied} {i}", "en", None, 1, "x", 0.5))
        labels.append((i, 1))
    return docs, labels


TOX = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = toxic_corpus()
    return (spark.createDataFrame(docs, TOX).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, dict(labels))


@pytest.fixture(scope="module")
def lexicon(corpus):
    return toxicity.fit(corpus[0], corpus[1], ~toxicity.held_out(F.col("doc_id")))


def test_folding_keeps_length():
    fold = toxicity.folder()
    for t in ("", "IDIOT", "іdiоt", "1d10t", "Ｉｄｉｏｔ", "ŁÓDŹ İ ß ﬁ 😀", "a$$ l0$er! 100 5th e-mail@x", "x" * 100_000):
        assert len(fold(t)) == len(t)
    assert len({fold(t) for t in ("IDIOT", "іdiоt", "1d10t", "Ｉｄｉｏｔ", "!d|0t")}) == 1
    assert fold("loser") == fold("1053r") == fold("l0$er") == fold("L0SER")
    assert fold("in 100 of 34 cases") == "in 100 of 34 cases"


def test_lexicon_is_learned(lexicon):
    fold = toxicity.folder()
    assert {t.rstrip(".") for t in lexicon.terms} >= {fold(w) for w in BAD} | {fold(w) for w in STEMS}
    assert not [t for t in lexicon.terms if t.startswith("oniy")]      # of the copied text only its bad word
    assert (fold("gloxer"), fold("fish")) in lexicon.exceptions


def test_held_out_accuracy(spark, corpus, lexicon):
    docs, labels, rows, truth = corpus
    got = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 100 and np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.98
    disguised = spark.createDataFrame([(1, "ваd ѕkunt hеrе"), (2, "a br1mf4t"), (3, "ＳＫＵＮＴ"), (4, "gloxer fish only"), (5, "skunts"), (6, "askunt")],
                                      "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.scan(disguised, lexicon, ["doc_id"]).collect()}
    assert min(score[1], score[2], score[3]) >= 0.5 > max(score[4], score[6])


def test_spans_are_those_of_the_text(spark, lexicon):
    text = "Ab ＳＫＵＮＴ, " + "word " * 50 + "zorvihut. Gloxer fish"
    row = toxicity.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), lexicon, ["doc_id"]).first()
    assert [text[s["start"]:s["end"]] for s in row["spans"]] == ["ＳＫＵＮＴ", "zorvihut"]
    given = toxicity.Lexicon(["scum."], np.array([5.0]), frozenset({("pond", "scum")}), (1.0, 1.0, -1.0))
    found = toxicity.scan(spark.createDataFrame([(1, "pond  scum and scum, pond-scum scums")], "doc_id long, text string"), given, ["doc_id"]).first()
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(15, 19)]


def test_toxicity_edges(spark, corpus):
    docs, labels = corpus[:2]
    odd = [(None, "skunt", None, None, None, "", 0.0), (1, None, None, None, None, "", 0.0), (1, "", None, None, None, "", 0.0),
           (2, "ha " * 200_000 + "skunt", None, None, None, "", 0.0), (0, "skunt", "", "", 0, "", 0.0), (0, "skunt", "", "", 0, "", 0.0)]
    marks = spark.createDataFrame([(None, 1), (0, None), (0, 0), (0, 1), (1, None)], "doc_id long, toxic int")
    both = docs.unionByName(spark.createDataFrame(odd, TOX))
    got = toxicity.digest(both, labels.unionByName(marks)).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    empty = spark.createDataFrame([], TOX)
    assert toxicity.digest(empty, labels).count() == 0
    assert {(r["score"], r["predicted"]) for r in toxicity.digest(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {r["predicted"] for r in toxicity.digest(docs, labels.where("toxic = 1")).collect()} == {0}


# ------------------------------------------------------------------ operator 13

def brute_tree(docs, arity=8):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(one, (*r[:4], t))))

    def climb(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def beside(path, i):
        out = []
        for level in path[:-1]:
            begin = i // arity * arity
            out.append((level[begin:i], level[i + 1:begin + arity]))
            i //= arity
        return out
    trees = {}
    for r in docs:
        trees.setdefault(r[2], []).append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    grown = [climb([leaf(r, r[4]) for r in trees[k]]) for k in keys]
    top = climb([g[-1][0] for g in grown])
    for t, (k, g) in enumerate(zip(keys, grown)):
        for i, r in enumerate(trees[k]):
            sides = beside(g, i) + beside(top, t)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, low(r[4]) if tampered else r[4])
            for a, b in sides:
                h = sha("".join(a) + h + "".join(b))
            proof = sha("".join(x for a, b in sides for x in a + b))
            yield (r[0], leaf(r, r[4]), g[-1][0], top[-1][0], proof, h, h == top[-1][0])


MER = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, n int, t int, slot int"


def audited(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], MER).repartition(3)


def key(r):
    return tuple(map(str, r))


def merkle_rows(sizes, seed=5):
    r = random.Random(seed)
    langs = [None, "", "Zz", "de", "en", "é", "日"] + [f"l{i}" for i in range(60)]
    rows = []
    for lang, n in zip(langs, sizes):
        rows += [(len(rows) * 3 - 50, r.choice((None, "s", "src")), lang, r.choice((None, 5)), r.choice((None, "", "Ab", "lower", "ÄÖ X", "😀 Q"))) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [(1,), (9,), (1, 2, 7, 8, 9, 64, 65), (3,) + (1,) * 20])
def test_merkle_is_brute_force(spark, sizes):
    rows = merkle_rows(sizes)
    got = [tuple(r) for r in merkle.audit(audited(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_tree(rows), key=key)


def test_merkle_repeated_and_null_ids(spark):
    rows = merkle_rows((4, 0, 20)) + [(7, "s", "en", 1, "Same")] * 40 + [(7, "s", "en", 1, "Other")] + [(None, None, None, None, None)] * 5 + [(None, "s", "en", 1, "A")] * 3
    got = [tuple(r) for r in merkle.audit(audited(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_tree(rows), key=key)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.audit(audited(spark, [])).count() == 0


def test_merkle_binary_and_nodes(spark):
    rows = merkle_rows((5, 1, 4))
    m = merkle.documents_manifest(audited(spark, rows), arity=2)
    got = merkle.prove(m).collect()
    want = {r[1]: r for r in brute_tree(rows, 2)}
    assert all(r["root"] == want[r["leaf"]][3] == r["folded_root"] and sha(r["proof"]) == want[r["leaf"]][4] for r in got) and len(got) == 10
    nodes = m.nodes().collect()
    assert len(nodes) == (5 + 3 + 2 + 1) + 1 + (4 + 2 + 1) + (2 + 1)
    assert len({(r["t"], r["level"], r["idx"]) for r in nodes}) == len(nodes)


def test_merkle_long_text(spark):
    rows = [(1, None, "en", None, "Word " * 400_000), (2, None, "en", None, "b")]
    got = [tuple(r) for r in merkle.audit(audited(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_tree(rows), key=key)
