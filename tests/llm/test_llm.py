"""Operators of qforge.llm against brute force on a small hostile table, and on edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from qforge.llm import bpe, chats, lattice, licenses, packing, phrases, secret_scan, site_quality, token_groups, winnow

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, keep int, n_words string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abeiost") for _ in range(r.randint(1, 7)))
    base = [[word() for _ in range(r.choice((3, 12, 13, 40, 90)))] for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base[:12]:                                   # near copies
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = word()
            texts.append("\n".join(v) if r.random() < 0.3 else "  ".join(v))
    passage = " ".join(base[20] + base[21])
    texts += [f"{word()} {word()} {passage} {word()}" for _ in range(8)]
    texts += [texts[5]] * 6 + ["", None, " \n\t ", "one", "One", "日本語 テキスト 😀 é", "x" * 40_000, "ha " * 3000, "ha ha", "\x00\x1f a\x0bb"]
    texts += ["All Rights Reserved. CC-BY cc by, the General public\nlicense", "Licensed under the Apache License, Version 2.0.",
              'my password: "hunter2hunter2" and token=abc AKIA' + "B" * 16 + " " + "0af3" * 9, "é😀 secret = 0123456789abcdef0123456789abcdef",
              "key 9f8Zq2LxV0bT7nRk4WmP1sYd6HcJ3gEa end"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def components_of(n, links):
    top = list(range(n))
    for pair in links:
        ends = []
        for v in pair:
            while top[v] != v:
                v = top[v]
            ends.append(v)
        top[max(ends)] = min(ends)
    out = []
    for v in range(n):
        while top[v] != v:
            v = top[v]
        out.append(v)
    return out


def test_bpe_is_tiktoken(docs, texts, ranks, empty):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    got = by_id(bpe.digests(docs, ranks, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = ref.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
    encoded = bpe.tokenize(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "spans"])
    back = by_id(bpe.detokenize(encoded, ranks, ["doc_id"]))
    assert all(bytes(back[i]["decoded"]).decode() == (t or "") for i, t in enumerate(texts))
    assert bpe.digests(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_replay_with_odd_ranks():
    """A longer token may rank below its parts, and runs of one letter overlap."""
    r = random.Random(1)
    for _ in range(60):
        tokens = {bytes([i]): i for i in range(256)}
        for _ in range(30):
            t = bytes(r.choice(b"abc") for _ in range(r.randint(2, 5)))
            tokens.setdefault(t, len(tokens))
        ranks = bpe.Ranks(tokens)
        words = list({bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(40)})
        ids, off = bpe.replay(words, ranks)
        for i, w in enumerate(words):
            want = [tokens[w]] if w in tokens else bpe.encode_word(w, ranks)
            assert ids[off[i]:off[i + 1]].tolist() == want


def brute_repeats(texts, span=13):
    first, words = {}, [SPACE.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - span + 1):
            first.setdefault(tuple(w[j:j + span]), i)
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if first[tuple(w[j:j + span])] < i:
                gone[j:j + span] = [True] * span
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


def test_phrases(docs, texts, empty):
    got = by_id(phrases.remove_repeats(docs, max_patterns=50))
    for i, n, gone, kept in brute_repeats(texts):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"], got[i]["kept_sha256"]) == (n, gone, kept, sha(kept))
    assert phrases.remove_repeats(empty).count() == 0


def test_phrases_null_and_repeated_ids(spark, texts):
    long = texts[3]
    rows = [(None, long), (4, long), (4, long), (4, long + " tail"), (7, long), (None, long)]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(SPACE.findall(long))
    gone = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in got)
    assert gone == [(-1, 0), (-1, 0), (4, 0), (4, 0), (4, 0), (7, n if n >= 13 else 0)]


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = SPACE.findall(low(t))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, components_of(len(sets), links)


@pytest.mark.parametrize("max_group", [4000, 3])
def test_token_groups(docs, texts, empty, max_group):
    sets, comp = brute_jaccard(texts)
    got = by_id(token_groups.join(docs, max_group=max_group))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    if max_group > 3:
        assert token_groups.join(empty).count() == 0


def test_links_of_drifting_versions():
    """Chains of near copies whose later versions drift: the largest component changes while sets are left out."""
    for seed in range(1500):
        r = random.Random(seed)
        sets, fresh = [], iter(range(10 ** 6, 10 ** 7))
        for _ in range(r.randint(1, 3)):
            now = sets[-1] if sets and r.random() < 0.5 else list(range(r.randint(12, 40)))
            for _ in range(r.randint(3, 12)):
                now = [next(fresh) if r.random() < r.choice((0.02, 0.06, 0.1)) else x for x in now]
                sets.append(now)
        r.shuffle(sets)
        sets = [set(x) for x in {tuple(sorted(s)): s for s in sets}.values()]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        got = token_groups.links([np.array(sorted(s), np.uint64) for s in sets], 80)
        assert components_of(len(sets), got) == components_of(len(sets), want), seed
        assert set(map(lambda e: (max(e), min(e)), got)) <= set(want)


def test_jaccard_border(spark):
    """Exactly 0.8 links, a little less does not, whatever the size."""
    rows, want, i = [], {}, 0
    for n in (8, 40, 45, 200):                            # n shared shingles, n / 4 others
        w = [f"w{n}x{k}" for k in range(n + 4)]
        extra = [f"e{n}x{k}" for k in range(n // 4 + 1)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w + extra[:n // 4])), (i + 2, " ".join(extra + w + extra[:1]))]
        i += 10
    texts = [t for _, t in rows]
    _, comp = brute_jaccard(texts)
    got = by_id(token_groups.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[r[0]]["component_id"] for r in rows] == [rows[c][0] for c in comp]


def test_passage_in_a_share_of_documents(spark, monkeypatch):
    """Passages that many unlike documents have, a few in each slice, lead to no pairs of groups; near copies with one are found."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abeiost") for _ in range(6))
    passages = [[word() for _ in range(40)] for _ in range(3)]
    texts = [" ".join([*(w := [word() for _ in range(60)]), *passages[i % 3], w[0]]) for i in range(240)]
    texts += [t + " end" for t in texts[:6]]
    seen, real = [], token_groups.components
    monkeypatch.setattr(token_groups, "components", lambda edges: seen.append(edges.count()) or real(edges))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(120)
    got = by_id(token_groups.join(rows))
    assert [got[i]["component_id"] for i in range(246)] == [*range(240), *range(6)]
    assert seen[0] < 30                                   # 9,480 pairs share a passage


def test_sizes_that_allow_no_link_open_nothing():
    """Groups of 40 to 79 and of 280 to 319 tokens share enough keys but cannot link at 0.8; those of 240 to 279 can."""
    from qforge.llm.parcels import pack, table
    a, b = np.array([0x5002, 0x6007], np.uint64), np.array([0x7008, 0x8008], np.uint64)
    got = token_groups._enough(80)(None, table([(0, 0, pack(a, b, np.array([9, 9])))]))
    assert got.to_pylist() == [{"g1": 0x6007, "g2": 0x8008}]


def brute_hits(texts, items):
    words = [(i, ALNUM.findall(low(t))) for i, t in items]
    for t in texts:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for i, v in words:
            k = min(10, len(v))
            for j in range(len(v) - k + 1 if v else 0):
                for s in range(len(w) - k + 1):
                    if w[s:s + k] == v[j:j + k]:
                        hit.update(range(s, s + k))
                        found.add(str(i))
        yield len(w), len(hit), len(found), sha(",".join(sorted(found)))


@pytest.mark.parametrize("limit", [winnow.MAX_INDEX_WORDS, 0])
def test_winnow(spark, docs, texts, empty, limit):
    items = [(1, texts[4]), (2, texts[20]), (10, "one"), (11, ""), (12, None), (13, "ha ha ha"), (14, texts[21]), (2, "All rights reserved"),
             (15, " ".join(SPACE.findall(texts[21])[3:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(winnow.digest(winnow.find_spans(docs, bench, ["doc_id"], max_index_words=limit)))
    for i, (n, hit, k, ids) in enumerate(brute_hits(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, k, ids, hit > 0)
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.digest(winnow.find_spans(docs, none, ["doc_id"], max_index_words=limit)).where("contaminated").count() == 0
    assert winnow.find_spans(empty, bench, ["doc_id"], max_index_words=limit).count() == 0


def test_secrets(docs, texts, empty):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    scanned = secret_scan.scan(docs, ["doc_id", "text"]).cache()
    got = by_id(secret_scan.digest(scanned))
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)]
        assert got[i]["base_sha256"] == sha(",".join(said))
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == said
    last = got[len(texts) - 1]["spans"]
    assert last == "random:4:36"                          # mixed letters and digits, no pattern
    clean = scanned.select("doc_id", secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("c"))
    assert by_id(clean)[len(texts) - 1]["c"] == "key [SECRET] end"
    assert secret_scan.scan(empty, ["doc_id"]).count() == 0


def test_secrets_long_base64(spark):
    """Random keys of 1000 to 4000 signs in base64 and base64url, padded or not, are found and leave the text."""
    r, rows = random.Random(7), []
    for i in range(240):
        raw = r.randbytes(r.randint(750, 3000) // 3 * 3 + i % 3)
        key = (base64.b64encode if i % 2 else base64.urlsafe_b64encode)(raw).decode()
        rows.append((i, f"the key is {key if i % 4 < 2 else key.rstrip('=')} and so on", len(key if i % 4 < 2 else key.rstrip("="))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    found = secret_scan.scan(docs, ["doc_id", "text", "n"]).cache()
    got = by_id(found)
    for odd in (0, 1):
        for low, high in ((1000, 2000), (2000, 3000), (3000, 4100)):
            own = [x for x in got.values() if x["doc_id"] % 2 == odd and low <= x["n"] < high]
            hit = [x for x in own if [(s["start"], s["kind"], s["end"]) for s in x["spans"]] == [(11, 3, 11 + x["n"])]]
            assert len(own) > 20 and len(hit) >= 0.95 * len(own), (odd, low, len(hit), len(own))
    clean = by_id(found.where(F.size("spans") == 1).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("c")))
    assert {x["c"] for x in clean.values()} == {"the key is [SECRET] and so on"}


def test_licenses(docs, texts, empty):
    got = by_id(licenses.digest(licenses.scan(docs, ["doc_id"])))
    for i, t in enumerate(texts):
        w = ALNUM.findall(low(t))
        at = sorted((j, label) for p, label in licenses.BASE.items() for j in range(len(w)) if w[j:j + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert 0 <= r["score"] <= 1
    assert any(r["labels"] == "apache-2.0" for r in got.values())
    assert licenses.scan(empty, ["doc_id"]).count() == 0


def test_licenses_at_borders_of_documents(spark):
    """What a document gets does not depend on the row before it or behind it."""
    cut = ["GNU General Public License version 3", "Apache License Version 2.0 text", "hereby granted, free of charge, to any person obtaining a copy",
           "so it is licensed under the GNU lesser general public", "licensed under the GNU general public license", "licensed under the", "the",
           "this is licensed under", None, ""]
    order = [(i, j) for i in range(len(cut)) for j in range(len(cut))]
    flat = [k for pair in order for k in pair]
    rows = spark.createDataFrame([(i, cut[k]) for i, k in enumerate(flat)], "doc_id long, text string").coalesce(1)
    got = by_id(licenses.digest(licenses.scan(rows, ["doc_id"])))
    for k in range(len(cut)):                             # one text, one answer, whatever its neighbours
        assert len({(got[i]["labels"], got[i]["score"]) for i, x in enumerate(flat) if x == k}) == 1
    assert {got[i]["labels"] for i, x in enumerate(flat) if x == 0} == {"gpl,gpl-3.0"}


def test_packing_even(docs, texts, empty):
    rows = by_id(packing.digest(packing.pack_into(packing.sized(docs), 3)))
    home = {}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert home.setdefault(t or "", r["shard"]) == r["shard"]
    for s in {r["shard"] for r in rows.values()}:
        slots = sorted(r["slot"] for r in rows.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert packing.digest(packing.pack_into(packing.sized(empty), 8)).count() == 0


def test_packing_fewest():
    r = random.Random(2)
    items = [(r.randint(1, 60), f"k{i}") for i in range(400)]
    where, load = packing.best_fit_decreasing(items, 100)
    free = []                                             # the same rule by plain search
    for size, _ in sorted(items, key=lambda x: (-x[0], x[1])):
        fit = [f for f in free if f >= size]
        free.remove(min(fit)) if fit else None
        free.append((min(fit) if fit else 100) - size)
    assert len(load) == len(free) and sorted(load) == sorted(100 - f for f in free) and max(load) <= 100
    assert len(load) <= 11 / 9 * -(-sum(s for s, _ in items) // 100) + 1


def test_pack_capacity(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"), F.col("id").cast("string").alias("group"))
    got = packing.pack(rows, 1000, cell_shards=8).collect()
    total = sum(r["bytes"] for r in got)
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["bytes"]
    assert len(got) == 3000 and max(load.values()) <= 1000 and len(load) <= total / 1000 * 1.1 + 1


def test_pack_repacks_tails_by_cells(spark):
    """Part-filled bins are dealt to tasks of a bounded number; bins without a partner stay as they are."""
    for size, least in ((F.col("id") % 97 + 1, 1), (F.lit(510), 0)):
        rows = spark.range(600).select(size.cast("long").alias("size"), F.col("id").cast("string").alias("group"))
        got = packing.pack(rows, 1000, cell_shards=1, tail_bins=4).collect()
        load = {}
        for r in got:
            load[r["shard"]] = load.get(r["shard"], 0) + r["bytes"]
        assert len({r["group"] for r in got}) == len(got) == 600 and max(load.values()) <= 1000
        assert len({x.split(":")[1] for x in load if x.startswith("t0:")}) > least or not least
        assert least or (len(load) == 600 and not any(x.startswith("t") for x in load))


def test_packing_cuts_only_groups_above_a_share(spark):
    """A group of copies with more than a shard's share of the bytes lies in several shards, every other in one."""
    rows = [(i, "copy" * 25) for i in range(400)] + [(1000 + i, f"text {i % 300} " * 6) for i in range(1200)]
    got = packing.pack_into(packing.sized(spark.createDataFrame(rows, "doc_id long, text string")), 8).collect()
    home, load = {}, {}
    for r in got:
        home.setdefault(r["group"], set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    share = -(-sum(load.values()) // 8)
    assert len(got) == len(rows) and len(load) == 8 and max(load.values()) <= 1.05 * share
    assert [len(x) > 1 for x in home.values()].count(True) == 1 and len(home[hashlib.sha256(b"copy" * 25).hexdigest()]) > 1


def test_chats(spark):
    rows = [(1, 2, "assistant", "b\\ <|end|>"), (1, 0, "system", None), (1, 1, None, "</s>[INST] x"), (2, 0, "assistant", ""),
            (None, 0, "user", "n"), (1, 2, "assistant", "b\\ <|end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chats.format_chats(chats.as_events(turns))
    got = by_id(chats.digest(made), "conv_id")
    want = "system\n\n" + "\n</s>[INST] x\n" + "assistant\nb\\ <|end|>\n" * 2
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"]) == (4, sha(want), 20)
    assert got[1]["loss_sha256"] == sha("b\\ <|end|>" * 2) and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chats.format_chats(chats.as_events(turns.limit(0))).count() == 0


def test_chat_events(spark):
    log = [(1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "he"), (1, 2, "delta", 1, None, "llo"),
           (1, 3, "message", None, "user", "more"), (1, 4, "edit", 0, None, "hey"), (1, 5, "regenerate", 1, None, "yo"), (1, 6, "delta", None, None, "!")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    row = chats.format_chats(events).first()
    assert chats.parse(row["formatted"]) == [("user", "hey"), ("assistant", "yo!")]


def test_chat_escape():
    r = random.Random(1)
    parts = chats.CONTROL + ["\\", "\b", "<", "|", "[", "/", "a", "\n", "<<SYS", "</"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        assert chats.unescape(chats.escape(t)) == t and not any(c in chats.escape(t) for c in chats.CONTROL)


def brute_vectors(vecs, labels, least=0.93):
    n = len(vecs)
    ok = [v is not None and None not in v and bool(np.isfinite(v).all()) and any(v) and labels[i] is not None for i, v in enumerate(vecs)]
    links = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vecs[i]) == len(vecs[j]):
                a, b = (np.array(vecs[k], np.float64) / np.linalg.norm(vecs[k]) for k in (i, j))
                if a @ b >= least:
                    links.append((i, j))
    return [sum(i in e for e in links) for i in range(n)], components_of(n, links)


def test_lattice(spark):
    r = np.random.default_rng(4)
    vecs, labels = [], []
    for k in range(12):
        c = r.standard_normal(16)
        for _ in range(1 + k):
            vecs.append((c + 0.1 * r.standard_normal(16)).astype(np.float32).tolist())
            labels.append(k % 2)
    vecs += [vecs[5]] * 4 + [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [], [None, 1.0], vecs[7], [1.0, 2.0], [2.0, 4.0]]
    labels += [labels[5]] * 4 + [0] * 6 + [None, 1, 1]
    df = spark.createDataFrame([(i, v, y, 0) for i, (v, y) in enumerate(zip(vecs, labels))], "vec_id long, embedding array<float>, label int, n_links int")
    n, comp = brute_vectors(vecs, labels)
    for max_cell in (4000, 3):
        got = by_id(lattice.link(df, max_cell=max_cell), "vec_id")
        assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in range(len(vecs))}
    assert lattice.link(df.limit(0)).count() == 0


def test_lattice_decodes_nearest():
    r = np.random.default_rng(2)
    x = r.normal(0, 2, (300, 8))
    y = lattice.nearest_e8(x)
    d = ((x - y) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()                          # covering radius of E8
    assert all((((x - y - v) ** 2).sum(axis=1) >= d - 1e-9).all() for v in lattice.roots())


def test_lattice_recall():
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = r.standard_normal(x.shape)
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.zeros(len(x), np.int64)
    a, b = (lattice.cells(v, label, lattice.TABLES, lattice.PROBES, lattice.SCALE) for v in (x, 0.93 * x + np.sqrt(1 - 0.93 ** 2) * u))
    meets = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert meets.any(axis=1).mean() >= 0.99


def test_quality_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    host, path = site_quality.host_and_path(d)
    got = site_quality.judge(d, lab.where(half), host, path, ["doc_id"]).join(lab.where(~half), "doc_id")
    r = got.agg(*[F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0) == F.col("keep")).cast("double")).alias("acc")]).first()
    assert r["acc"] > 0.98


def test_quality_edges(spark, docs, empty):
    lab = spark.createDataFrame([(0, 1, 0), (0, 1, None), (1, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    host, path = F.col("source"), F.col("lang")
    assert site_quality.judge(docs, lab, host, path, ["doc_id"]).where("keep").count() == docs.count()   # one class: nothing is rejected
    assert site_quality.judge(empty, lab, host, path, ["doc_id"]).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    """Different texts with one id are different documents; only rows equal in id and text count once."""
    import corpus_pipeline
    w = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    rows = [(1, w[0]), (1, w[1]), (1, w[0]), (2, w[2]), (3, w[1] + " tail"), (4, w[3]), (4, w[4]), (0, w[4] + " tail"), (5, w[2]),
            (6, w[5]), (6, w[5] + " tail"), (7, None), (7, ""), (None, w[0]), (None, w[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(1, w[0]), (1, w[1]), (2, w[2]), (4, w[3]), (0, w[4] + " tail"), (7, None), (7, ""), (None, w[0]), (None, w[0])]
    six = [x for x in got if x[0] == 6]
    assert len(six) == 1 and sorted(map(str, got)) == sorted(map(str, want + six))
    one = token_groups.join(docs.where("doc_id IN (0, 1, 3, 4)")).collect()   # as one document an id links by each of its texts
    assert {(r["doc_id"], r["component_id"]) for r in one} == {(1, 1), (3, 1), (4, 0), (0, 0)}


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    left = docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, sf).collect(), docs.schema)
        assert left.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in left.collect()}
    _, comp = brute_jaccard([t for _, t in sorted(seen["quality"].items())])
    ids = sorted(seen["quality"])
    assert set(seen["near_duplicates"]) == {ids[c] for c in comp}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = sorted(seen["near_duplicates"].items())
    clean = {i for (i, _), (_, hit, _, _) in zip(before, brute_hits([t for _, t in before], items)) if not hit}
    assert set(seen["decontaminate"]) == set(seen["secrets"]) == clean
    again = secret_scan.scan(left.select("doc_id", "text"), ["doc_id"])
    assert again.where(F.size("spans") > 0).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == len(clean)
