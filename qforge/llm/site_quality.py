"""Operator 8: quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence comes from two logistic models (good quality; toxic) over style features
and over words whose presence differs between the labelled classes far beyond chance. They are fitted on
at most ``MAX_LABELLED`` labelled rows (a documented bound, chosen by a hash of the id); all
other figures cover all documents.

Sites: the mean evidence over all documents is the global prior. Each host's rate is shrunk
towards it, each path's rate towards its host's, with a strength estimated from how much
rates differ between sites beyond sampling noise (method of moments). A document's posterior
log-odds are its evidence plus the log-odds by which its path's prior differs from the global one; that prior is made
of the other documents, its own evidence is left out of the sums of its path and host (a lone document has its host's prior).
A document is rejected if its posterior of good quality is below 0.5 or that of being toxic above 0.5.

Null text counts as empty, null host or path as a site of its own. Without labels of both
classes that model has no evidence and rejects nothing. Label rows with a null are left out
for that target; of repeated label rows the worst counts. Repeated documents are judged one by one; of a labelled id's rows
one is fitted (the words of all are counted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from qforge.llm.textops import Words, field, map_text, utf8

MAX_LABELLED, MAX_WORDS, MIN_Z, MIN_DOCS = 20_000, 2000, 6.0, 5
#: Paths up to which the site priors are sent to every task; beyond it they are joined.
MAX_SITES = 200_000
N_STYLE = 8


def style(w: Words, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of style features a document."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    doc = np.repeat(np.arange(n), np.diff(off))
    share = lambda m: np.bincount(doc[m], minlength=n) / size
    words = np.maximum(np.diff(w.first), 1)
    if len(w.h):
        order = np.lexsort((w.h, w.doc))
        new = np.ones(len(order), bool)
        new[1:] = (w.h[order][1:] != w.h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
        kinds = np.bincount(w.doc[order][new], minlength=n)
        again = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
        repeats = np.bincount(w.doc[1:][again], minlength=n)
    else:
        kinds = repeats = np.zeros(n)
    signs = np.isin(data, np.frombuffer(b"#$%&*|!<>{}~^=_", np.uint8))
    return np.stack([np.log(words), 10 * share(signs), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)),
                     kinds / words, repeats / words, np.log1p(size / words), (np.diff(w.first) == 0).astype(float)], axis=1)


def features(col: pa.Array, word_hash: np.ndarray, word_weight: np.ndarray) -> np.ndarray:
    """Style features and, for each target, the weight of the strongest marked word present (long texts gather weak ones by chance)."""
    data, off = utf8(col)
    w = Words(col, "alnum", True)
    x = style(w, data, off)
    evidence = np.zeros((len(col), word_weight.shape[1]))
    if len(word_hash) and len(w.h):
        j = np.minimum(np.searchsorted(word_hash, w.h), len(word_hash) - 1)
        hit = np.flatnonzero(word_hash[j] == w.h)
        pairs = np.unique(w.doc[hit] * np.int64(len(word_hash)) + j[hit])
        for t in range(word_weight.shape[1]):
            np.maximum.at(evidence[:, t], pairs // len(word_hash), word_weight[pairs % len(word_hash), t])
    return np.concatenate([x, evidence], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray | None:
    """Newton steps for ridge logistic regression on standardised columns; None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    b, penalty = np.zeros(z.shape[1]), np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([b[:-1] / sd, [b[-1] - (b[:-1] * mean / sd).sum()]])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED) -> dict:
    """Marked words with their weights and the two fitted models."""
    marks = (labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
             .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"), F.max("toxic").alias("__t"))
             .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    # at most max_labelled rows of three numbers on the broadcast side
    mine = docs.join(F.broadcast(marks), docs["doc_id"] == marks["__id"]).select(
        "__q", "__t", F.col(f"`{text}`").cast("string").alias("text"), "__id").checkpoint()
    out = T.StructType([field("word", T.StringType()), *[field(c, T.LongType()) for c in ("n", "bad", "toxic")]])

    def count(batches):
        for b in batches:
            w = Words(b.column(2), "alnum", True)
            q, t = (np.array([-1 if x is None else x for x in b.column(i).to_pylist()]) for i in (0, 1))
            if not len(w.h):
                continue
            order = np.lexsort((w.doc, w.h))
            h, d = w.h[order], w.doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            order, h, d = order[once], h[once], d[once]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sums = [np.add.reduceat(v, begin) for v in (np.ones(len(d), np.int64), (q[d] == 0).astype(np.int64),
                                                        (t[d] == 1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([w.word(i).decode("utf-8", "replace") for i in order[begin]], pa.string()),
                                              *map(pa.array, sums)], names=out.fieldNames())
    total = mine.agg(F.count("*").alias("n"), F.sum((F.col("__q") == 0).cast("int")).alias("bad"),
                     F.sum((F.col("__t") == 1).cast("int")).alias("toxic")).first()
    n = total["n"]
    share = {t: min(max((total[t] or 0) / max(n, 1), 1e-6), 1 - 1e-6) for t in ("bad", "toxic")}
    z = lambda t: (F.col(t) - F.col("n") * share[t]) / F.sqrt(F.col("n") * share[t] * (1 - share[t]))
    words = (mine.mapInArrow(count, out).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "toxic")])
             .where(F.col("n") >= MIN_DOCS).withColumn("z", F.greatest(z("bad"), z("toxic")))
             .where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS).collect())
    weight = np.array([[max(0.0, np.log((r[t] + 0.5) / (r["n"] - r[t] + 2)) - np.log(share[t] / (1 - share[t])))
                        for t in ("bad", "toxic")] for r in words]).reshape(-1, 2)
    hashes = np.array([Words(pa.array([r["word"]]), "alnum", True).h[0] for r in words], np.uint64)
    order = np.argsort(hashes)
    model = {"hash": hashes[order], "weight": weight[order]}
    made = map_text(mine, lambda: lambda c: [pa.array(features(c, model["hash"], model["weight"]).tolist(), pa.list_(pa.float64()))],
                    [field("x", T.ArrayType(T.DoubleType()))], ["__q", "__t", "__id"])
    # an id may stand in many rows: one of them, so at most max_labelled rows of ten numbers reach the driver
    rows = made.groupBy("__id").agg(F.min(F.struct("__q", "__t", "x")).alias("row")).select("row.*").collect()
    for name, i, want in (("good", 0, 1), ("toxic", 1, 1)):
        use = [r for r in rows if r[i] is not None]
        model[name] = logistic(np.array([r["x"] for r in use]), np.array([float(r[i] == want) for r in use]))
    return model


def evidence(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the log-odds of good quality and of being toxic (null without a model)."""
    def make():
        def fn(col):
            x = features(col, model["hash"], model["weight"])
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            return [pa.array(x @ model[m], pa.float64()) if model[m] is not None else pa.nulls(len(x), pa.float64())
                    for m in ("good", "toxic")]
        return fn
    return map_text(docs, make, [field("__good", T.DoubleType()), field("__toxic", T.DoubleType())], keep, text)


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def _logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def _strength(rate: Column, parent: Column) -> Column:
    """Pseudo-count of the prior: parent variance over the variance between sites beyond noise, 5 to 10000 (an aggregate over sites of n)."""
    noise = parent * (1 - parent)
    between = F.avg((rate - parent) * (rate - parent) - noise / F.col("n"))
    return F.least(F.greatest(F.avg(noise) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(5.0)), F.lit(10_000.0))


def site_sums(seen: DataFrame) -> DataFrame:
    """One row a path: documents and summed evidence of path and host, the strengths of both priors and the global rates.

    Columns for target x (g: good, t: toxic): ``n``, ``x`` of the path; ``hn``, ``hx`` of its host; ``kx``, ``px``, the pseudo-counts
    of the global prior in a host and of the host's in a path; ``wx``, the rate over all documents.
    """
    own = _own_evidence()
    paths = seen.groupBy("__host", "__path").agg(F.count("*").alias("n"), *[F.sum(own[t]).alias(t) for t in own]).checkpoint()
    hosts = paths.groupBy(F.col("__host").alias("hh")).agg(*[F.sum(c).alias(f"h{c}") for c in ("n", "g", "t")])
    top = paths.agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("t").alias("t")).first()
    whole = {t: min(max((top[t] or 0) / max(top["n"] or 0, 1), 1e-4), 1 - 1e-4) for t in own}
    rates = hosts.select(F.col("hn").alias("n"), *[(F.col(f"h{t}") / F.col("hn")).alias(t) for t in own])
    k = rates.agg(*[_strength(F.col(t), F.lit(whole[t])).alias(t) for t in own]).first()
    k = {t: k[t] or 5.0 for t in own}
    both = paths.join(hosts, F.col("__host").eqNullSafe(F.col("hh"))).drop("hh")
    rates = both.select("n", *[(F.col(t) / F.col("n")).alias(t) for t in own],
                        *[((F.col(f"h{t}") + k[t] * whole[t]) / (F.col("hn") + k[t])).alias(f"h{t}") for t in own])
    p = rates.agg(*[_strength(F.col(t), F.col(f"h{t}")).alias(t) for t in own]).first()
    return both.select("*", *[F.lit(float(v)).alias(f"{c}{t}") for t in own for c, v in (("k", k[t]), ("p", p[t] or 5.0), ("w", whole[t]))])


def _own_evidence() -> dict[str, Column]:
    return {"g": F.coalesce(_sigmoid(F.col("__good")), F.lit(1.0)), "t": F.coalesce(_sigmoid(F.col("__toxic")), F.lit(0.0))}


def _prior(t: str, own: Column) -> Column:
    """Rate of the path, shrunk to its host's and that to the global one, both without the document's own evidence."""
    host = (F.col(f"h{t}") - own + F.col(f"k{t}") * F.col(f"w{t}")) / (F.col("hn") - 1 + F.col(f"k{t}"))
    path = (F.col(t) - own + F.col(f"p{t}") * host) / (F.col("n") - 1 + F.col(f"p{t}"))
    return F.greatest(F.least(path, F.lit(1 - 1e-4)), F.lit(1e-4))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str], text: str = "text",
          max_labelled: int = MAX_LABELLED, max_sites: int = MAX_SITES) -> DataFrame:
    """``keep`` columns, the two posteriors, the site priors and ``keep`` (false: rejected)."""
    model = fit(docs, labels, text, max_labelled)
    sited = docs.withColumn("__host", F.coalesce(host.cast("string"), F.lit("\x00"))).withColumn(
        "__path", F.coalesce(path.cast("string"), F.lit("\x00")))
    sums = site_sums(evidence(sited, model, ["__host", "__path"], text)).checkpoint()
    if sums.count() <= max_sites:
        sums = F.broadcast(sums)
    names = [f"__keep{i}" for i in range(len(keep))]      # kept columns may be named like those of the sums
    sited = sited.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names)], F.col(f"`{text}`").alias("__body"), "__host", "__path")
    scored = evidence(sited, model, [*names, "__host", "__path"], "__body").join(sums, ["__host", "__path"])
    scored = scored.select(*names, "__good", "__toxic", "wg", "wt", *[_prior(t, own).alias(f"site_{t}") for t, own in _own_evidence().items()])
    good = _sigmoid(F.col("__good") + _logit(F.col("site_g")) - _logit(F.col("wg")))
    toxic = _sigmoid(F.col("__toxic") + _logit(F.col("site_t")) - _logit(F.col("wt")))
    return scored.select(*[F.col(a).alias(c) for c, a in zip(keep, names)], good.alias("p_good"), toxic.alias("p_toxic"),
                         F.col("site_g").alias("site_good"), F.col("site_t").alias("site_toxic")).withColumn(
        "keep", (F.coalesce("p_good", F.lit(1.0)) >= 0.5) & (F.coalesce("p_toxic", F.lit(0.0)) <= 0.5))


def host_and_path(df: DataFrame, source: str = "source", lang: str = "lang") -> tuple[Column, Column]:
    """Documents carry no address: the source is the host, its language section the path."""
    return F.col(source), F.concat_ws("/", F.col(source), F.coalesce(F.col(lang), F.lit("")))
