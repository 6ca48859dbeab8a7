"""Operators 1, 4 and 8 where ids and whole rows repeat, 6 and 7 where a text repeats itself."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qforge.llm import lattice, packing, secret_scan, site_quality, winnow
from qforge.llm.textops import Words


def brute_links(rows, bound=0.93):
    """(vec_id, n_links, component, kept) of (vec_id, vector, label) rows, each row a vector of its own."""
    x = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    n = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] == rows[j][2] and rows[i][2] is not None and x[i] @ x[j] >= bound:
                n[i] += 1
                n[j] += 1
                top[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((r[0], n[i], low[root(i)], low[root(i)] == r[0]) for i, r in enumerate(rows))


def test_lattice_repeated_ids_of_different_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 24))
    near = lambda k, s: (base[k] + s * r.normal(size=24)).tolist()
    rows = [(1, base[0].tolist(), 0), (1, base[1].tolist(), 0), (1, base[1].tolist(), 1)]
    rows += [(10 + i, near(0, 0.02), 0) for i in range(4)]          # four near the first row of id 1 only
    rows += [(9, base[2].tolist(), 0), (9, near(2, 0.02), 0)]       # two near vectors with one id
    rows += [(9, base[2].tolist(), 0)] * 5                          # and copies of one of them
    rows += [(20 + i % 3, near(3 + i % 2, 0.03), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    for max_cell in (4000, 3):
        got = lattice.link(df, max_cell=max_cell).select("vec_id", "n_links", "component_id", "kept").collect()
        assert sorted(map(tuple, got)) == brute_links(rows)


def test_lattice_crowded_list_joined_instead_of_sent(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, (np.ones(16) + 0.05 * r.normal(size=16)).tolist(), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(lattice, "MAX_CROWDED", 0)
    got = lattice.link(df, max_cell=7).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_links(rows)


def even(spark, rows, shards=8):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.digest(packing.pack_into(packing.sized(df), shards)).collect()
    assert len(got) == len(rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    for shard in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    total = sum(load.values())
    assert set(load) == set(range(shards)) and max(load.values()) - min(load.values()) <= 0.05 * total / shards
    return got


def test_packing_equal_rows_above_a_share(spark):
    r = random.Random(1)
    others = [(i, "".join(r.choice("abc ") for _ in range(r.randint(20, 60)))) for i in range(6000)]
    got = even(spark, [(7, "the same row " * 4)] * 3000 + others)
    groups = {}
    for x in got:
        groups.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
    assert sum(len(s) > 1 for s in groups.values()) == 1             # only the large group is cut
    even(spark, [(None, "null ids share one text")] * 2000 + [(None, t) for _, t in others[:4000]])


def test_classifier_fits_one_row_of_a_labelled_id(spark, monkeypatch):
    rows = [(i, f"good plain words number {i}" if i % 3 else f"bad $$$ words {i}", "s", "en") for i in range(60)] + [(1, "the same row again", "s", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen, real = [], site_quality.logistic
    monkeypatch.setattr(site_quality, "logistic", lambda x, y, ridge=1.0: (seen.append(len(y)), real(x, y, ridge))[1])
    host, path = site_quality.host_and_path(docs)
    assert site_quality.judge(docs, labels, host, path, ["doc_id"]).count() == len(rows)
    assert seen == [60, 60]


def test_winnow_repetitive_texts():
    """Spans of texts over few words against brute force; a long text of one word in seconds, and one span."""
    r = random.Random(5)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abcdefgh"
        items = [" ".join(r.choices(letters, k=r.choice((0, 1, 2, 5, 9, 10, 11, 30, 60)))) for _ in range(6)]
        docs = [" ".join(r.choices(letters, k=r.randint(0, 80))) for _ in range(3)] + [f"c {items[5]} {items[4]}"]
        index, w = winnow.Index(list(range(6)), items, 10, 5), Words(pa.array(docs), "alnum", True)
        want = []
        for d in docs:
            d, hit = d.split(), set()
            for i, item in enumerate(items):
                item = item.split()
                m = min(10, len(item))
                grams = {tuple(item[j:j + m]) for j in range(len(item) - m + 1)} if m else set()
                hit |= {(i, p + t) for p in range(len(d) - m + 1) if tuple(d[p:p + m]) in grams for t in range(m)}
            want.append(hit)
        for pairs in (4_000_000, 3):
            assert [{(s["item_id"], p) for s in spans for p in range(s["start"], s["end"])}
                    for spans in index.spans(w, pairs).to_pylist()] == want
    began = time.time()
    index = winnow.Index([7], ["ha " * 200], 10, 5)
    assert index.spans(Words(pa.array(["ha " * 1_000_000]), "alnum", True)).to_pylist() == [[{"item_id": 7, "start": 0, "end": 1_000_000}]]
    assert time.time() - began < 30


def test_secrets_in_long_listings(spark):
    """Thousands of matches in one text: spans, overlaps of the random ones and the cut text against brute force."""
    r = random.Random(9)
    run = lambda letters, n: "".join(r.choices(letters, k=n))
    some = [run("0123456789abcdef", 34) if i % 3 else "token=" + run("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789", 30) for i in range(3000)]
    some[5] = "AKIA" + run("ABCDEFGHIJKLMNOP0123456789", 16)
    text = " ".join(("é " if i % 7 == 0 else "") + x for i, x in enumerate(some))
    df = spark.createDataFrame([(1, text), (2, some[1]), (3, ""), (4, None)], "doc_id long, text string")
    found = secret_scan.scan(df, ["doc_id", "text"]).cache()
    spans = [tuple(s) for s in found.where("doc_id = 1").first()["spans"]]
    base = sorted([(m.start(), 0, m.end()) for m in re.finditer("token=([A-Za-z0-9]+)", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}", text)])
    assert [s for s in spans if s[1] < 3] == base
    assert not any(s[1] == 3 and any(b[0] < s[2] and s[0] < b[2] for b in base) for s in spans)
    clean = found.select(secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("c")).collect()
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert [r["c"] for r in clean] == ["".join(out) + text[at:], "[SECRET]", "", ""]


def test_random_spans_beside_base_ones(spark):
    """The walk over ordered spans drops just the random ones that overlap a base span."""
    r = random.Random(2)
    rows = [(i, sorted((s, r.choice((0, 2, 3, 3)), s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(14))))) for i in range(200)]
    df = spark.createDataFrame(rows, f"id long, spans {secret_scan.SPAN}")
    got = {x["id"]: [tuple(s) for s in x["s"]] for x in df.select("id", secret_scan._apart(F.col("spans")).alias("s")).collect()}
    for i, spans in rows:
        base = [s for s in spans if s[1] < 3]
        assert got[i] == [s for s in spans if s[1] < 3 or not any(b[0] < s[2] and s[0] < b[2] for b in base)]


@pytest.mark.parametrize("max_sites", [site_quality.MAX_SITES, 0])
def test_site_priors_by_brute_force(spark, max_sites):
    """Posteriors from the documents' evidence, site by site in plain Python: sparse, lone, null and hot sites."""
    r = random.Random(4)
    poor = ["#$% buy now #$%"] * 2 + ["win $$$ !!! now"]
    docs, labels = [], []
    for i in range(400):
        host = "big" if i % 3 == 0 else None if i % 50 == 1 else f"h{r.randrange(60)}"
        bad = r.random() < (0.7 if host in ("h1", "h2", "h3", "h4") else 0.2)
        text = (r.choice(poor) + " ") * 3 if bad else " ".join(r.choices("river stone light green house tree walk".split(), k=30))
        docs.append((i, text if i != 7 else None, host, r.choice(("en", "de", None)), "clash"))
        if i % 2:
            labels.append((i, int(not bad), int(i % 11 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, hn string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, path = site_quality.host_and_path(df)
    got = {x["doc_id"]: x for x in site_quality.judge(df, marks, host, path, ["doc_id", "hn"], max_sites=max_sites).collect()}
    assert all(x["hn"] == "clash" for x in got.values())
    model = site_quality.fit(df, marks)
    logits = {x["doc_id"]: x for x in site_quality.evidence(df, model, ["doc_id"]).collect()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    clamp = lambda v: min(max(v, 1e-4), 1 - 1e-4)
    # the path of a null host is that of no source: concat_ws leaves it out
    site = {d[0]: (d[2] if d[2] is not None else "\x00", "/".join(x for x in (d[2], d[3] or "") if x is not None)) for d in docs}

    def strength(groups, parents):
        noise = [q * (1 - q) for q in parents]
        between = np.mean([(np.mean(g) - q) ** 2 - v / len(g) for g, q, v in zip(groups, parents, noise)])
        return min(max(np.mean(noise) / max(between, 1e-9) - 1, 5.0), 10_000.0)
    for name, out, prior in (("__good", "p_good", "site_good"), ("__toxic", "p_toxic", "site_toxic")):
        e = {i: sig(x[name]) for i, x in logits.items()}
        whole = clamp(np.mean(list(e.values())))
        by_host, by_path = {}, {}
        for i, s in site.items():
            by_host.setdefault(s[0], []).append(e[i])
            by_path.setdefault(s, []).append(e[i])
        k = strength(list(by_host.values()), [whole] * len(by_host))
        rate = {h: (sum(v) + k * whole) / (len(v) + k) for h, v in by_host.items()}
        p = strength(list(by_path.values()), [rate[s[0]] for s in by_path])
        for i, s in site.items():
            others = [j for j in site if j != i]
            mine = [e[j] for j in others if site[j][0] == s[0]]
            own_host = (sum(mine) + k * whole) / (len(mine) + k)
            near = [e[j] for j in others if site[j] == s]
            want = clamp((sum(near) + p * own_host) / (len(near) + p))
            assert abs(got[i][prior] - want) < 1e-9
            assert abs(got[i][out] - sig(logits[i][name] + np.log(want / (1 - want)) - np.log(whole / (1 - whole)))) < 1e-9
