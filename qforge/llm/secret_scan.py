"""Operator 7 (built-in functions only): secrets by patterns and by a battery of randomness tests.

Patterns give the base spans (assign, access, hex). The method looks at every run of 20 or more
token characters that mixes letters and digits. Its encoding is inferred without the padding at its end (hex, base32,
base36, base62, base64, base64url, else the union of them) and three tests ask whether it is uniform over that alphabet:
chi-squared of the character counts, a runs test above and below the middle of the alphabet,
and lag-1 serial correlation. Their p-values are combined by Fisher's rule; a run is
consistent with a random key if the combined p-value is at least ``ALPHA``. Against chance, the likelihood
ratio of the uniform model over the corpus' own mix of character classes (counted over all
documents) serves as an e-value, and the e-BH rule bounds the share of false discoveries by ``Q`` within
each stratum of length. Random spans that overlap a base span are not repeated.

Null text counts as empty; empty texts have no spans. A text with very many matches is walked in blocks, so its
time grows little faster than its length. Positions are code points, ends exclusive.
Repeated rows are scanned one by one; other columns are ignored unless kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# The patterns; lengths are those of whole runs, so a run that is too short never matches in part.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHABETS = [("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base64url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
             ("union", "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")]
# Fixed value: at most six signs of padding (base32); a longer row of them is no padding.
PADDING = "(?<!=)={1,6}$"
ALPHA, Q, STEP, TOP = 1e-3, 0.05, 0.25, 4000
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (inside lambdas an expression would be computed for every element)."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """A non-empty array cut into about as many blocks as each has elements."""
    return _bound(items, lambda v: _bound(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda b: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda i: F.slice(v, i * b + 1, b))))


def _running(values: Column, zero: Column, add) -> Column:
    """For each element of array<bigint> what ``add`` makes of those before it.

    Blocks are reduced first, then each is walked from its start, so the arrays that a walk
    appends to hold the square root of all elements and a long array costs little more a piece than a short one.
    """
    def walk(xs, start):
        begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct(
            add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    return _bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(_bound(_blocks(v), lambda bs: F.flatten(F.zip_with(
        bs, walk(F.transform(bs, lambda x: F.aggregate(x, zero, add)), zero), walk)))))


def _matches(text: Column, pattern: str, value: int = 0, least: int = 0) -> Column:
    """Struct (start, end, value) of every leftmost match: gaps and matches alternate."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m")))
    parts = F.zip_with(parts, F.regexp_extract_all(text, F.lit(pattern), F.lit(value)),
                       lambda p, v: F.struct(p["g"].alias("g"), p["m"].alias("m"), v.alias("v")))
    walked = _bound(F.filter(parts, lambda p: p["m"].isNotNull()), lambda ps: F.zip_with(
        ps, _running(F.transform(ps, lambda p: (p["g"] + p["m"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x),
        lambda p, at: F.struct((at + p["g"]).alias("start"), (at + p["g"] + p["m"]).alias("end"), p["v"].alias("value"))))
    found = F.filter(walked, lambda x: F.char_length(x["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def _apart(spans: Column) -> Column:
    """Spans in order, without the random ones that overlap a base span: those before end, those after begin outside."""
    far = F.lit(2 ** 62).cast("bigint")
    ends = lambda v: _running(F.transform(v, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)),
                              F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x))
    begins = lambda v: F.reverse(_running(F.transform(F.reverse(v), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far)),
                                          far, lambda a, x: F.least(a, x)))
    return _bound(F.array_sort(spans), lambda v: F.when(~F.exists(v, lambda x: x["kind"] == 3), v).otherwise(
        _bound(F.struct(ends(v).alias("ends"), begins(v).alias("begins")), lambda o: F.filter(v, lambda x, i: (x["kind"] < 3) | (
            (F.get(o["ends"], i) <= x["start"]) & (F.get(o["begins"], i) >= x["end"]))))))


def _typed(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 x["end"].alias("end"))).cast(SPAN)


def _tail(z: Column) -> Column:
    """Two-sided normal tail probability (Abramowitz and Stegun 7.1.26), at least 1e-300."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-F.least(x * x, F.lit(690.0))), F.lit(1e-300))


def _is(chars: Column, low: str, high: str) -> Column:
    return F.size(F.filter(chars, lambda c: (c >= low) & (c <= high)))


def battery(found: Column) -> Column:
    """For each run: span, length without padding, combined p-value of the three tests, and its counts by character class."""
    keep = F.transform(F.filter(found, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(x["value"], PADDING, "").alias("value")))

    def alphabet(v: Column) -> Column:
        out = F.lit(ALPHABETS[-1][1])
        for name, letters in reversed(ALPHABETS[:-1]):
            out = F.when(v.rlike(f"^[{letters}]+$"), F.lit(letters)).otherwise(out)
        return out
    a = F.transform(keep, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("v"), F.split(x["value"], "").alias("c"),
        F.char_length(x["value"]).cast("double").alias("n"), alphabet(x["value"]).alias("abc")))
    b = F.transform(a, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"),
        F.char_length(x["abc"]).cast("double").alias("k"),
        _is(x["c"], "0", "9").alias("digits"), _is(x["c"], "A", "Z").alias("upper"), _is(x["c"], "a", "z").alias("lower"),
        F.aggregate(F.array_distinct(x["c"]), F.lit(0.0), lambda s, c: s + F.pow(
            x["n"] - F.char_length(F.replace(x["v"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        F.transform(x["c"], lambda c: F.instr(x["abc"], c).cast("double")).alias("o")))
    c = F.transform(b, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["digits"].alias("digits"),
        x["upper"].alias("upper"), x["lower"].alias("lower"), (x["k"] / x["n"] * x["squares"] - x["n"]).alias("chi"),
        F.size(F.filter(x["o"], lambda o: o > x["k"] / 2)).cast("double").alias("above"),
        F.aggregate(F.sequence(F.lit(2), F.size(x["o"])), F.lit(1.0), lambda s, i: s + (
            (F.element_at(x["o"], i) > x["k"] / 2) != (F.element_at(x["o"], i - 1) > x["k"] / 2)).cast("double")).alias("runs"),
        F.aggregate(F.sequence(F.lit(2), F.size(x["o"])), F.lit(0.0), lambda s, i: s + (
            F.element_at(x["o"], i) - (x["k"] + 1) / 2) * (F.element_at(x["o"], i - 1) - (x["k"] + 1) / 2)).alias("lag")))
    d = F.transform(c, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["digits"].alias("digits"),
        x["upper"].alias("upper"), x["lower"].alias("lower"),
        # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is near normal
        ((F.cbrt(x["chi"] / (x["k"] - 1)) - (1 - 2 / (9 * (x["k"] - 1)))) / F.sqrt(2 / (9 * (x["k"] - 1)))).alias("z1"),
        (2 * x["above"] * (x["n"] - x["above"]) / x["n"] + 1).alias("mu"), x["runs"].alias("runs"),
        (x["lag"] / ((x["k"] * x["k"] - 1) / 12) / F.sqrt(x["n"] - 1)).alias("z3")))
    e = F.transform(d, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["digits"].alias("digits"),
        x["upper"].alias("upper"), x["lower"].alias("lower"),
        (-2 * (F.log(F.when(x["z1"] > 0, _tail(x["z1"]) / 2).otherwise(1 - _tail(x["z1"]) / 2))
               + F.log(F.when(x["mu"] > 2, _tail((x["runs"] - x["mu"]) / F.sqrt(
                   F.greatest((x["mu"] - 1) * (x["mu"] - 2) / (x["n"] - 1), F.lit(1e-9))))).otherwise(F.lit(1e-300)))
               + F.log(_tail(x["z3"])))).alias("fisher")))
    half = lambda x: x["fisher"] / 2  # noqa: E731  chi-squared with six degrees of freedom has a closed tail
    return F.transform(e, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), x["k"].alias("k"), x["digits"].alias("digits"),
        x["upper"].alias("upper"), x["lower"].alias("lower"),
        (F.exp(-half(x)) * (1 + half(x) + half(x) * half(x) / 2)).alias("p")))


def class_mix(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Share of digits, capitals, small letters and other token signs over all documents."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    count = {"digits": r"[0-9]", "upper": r"[A-Z]", "lower": r"[a-z]", "other": r"[+/_=-]"}
    drop = {"digits": "0123456789", "upper": ALPHABETS[4][1][10:36], "lower": ALPHABETS[4][1][36:], "other": "+/_=-"}
    row = docs.agg(*[F.sum(F.char_length(body) - F.char_length(F.translate(body, drop[c], ""))).alias(c) for c in count]).first()
    n = sum((row[c] or 0) + 1 for c in count)
    return {c: ((row[c] or 0) + 1) / n for c in count}


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans`` (start, kind number, end), base and random, in order."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = F.concat(_typed(_matches(body, ASSIGN, 2, 8), "assign"), _typed(_matches(body, ACCESS), "access"),
                    _typed(_matches(body, HEX), "hex"))
    mix = class_mix(docs, text)
    log = lambda c: F.lit(math.log(mix[c]))
    ratio = lambda x: (-x["n"] * F.log(x["k"]) - (  # noqa: E731  log of uniform over the corpus' mix, letters of a class alike
        x["digits"] * (log("digits") - math.log(10)) + x["upper"] * (log("upper") - math.log(26))
        + x["lower"] * (log("lower") - math.log(26))
        + (x["n"] - x["digits"] - x["upper"] - x["lower"]) * (log("other") - math.log(5))))
    tested = F.transform(battery(_matches(body, RUN)), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.floor(F.log2(x["n"])).cast("int").alias("stratum"), x["p"].alias("p"),
        F.greatest(F.least(F.floor(ratio(x) / STEP), F.lit(TOP)), F.lit(0)).cast("int").alias("bin")))
    runs = docs.select(F.explode_outer(tested).alias("x")).where("x IS NOT NULL")  # outer: a filter on the array would compute it again
    limits = {r["stratum"]: r["bin"] for r in _limits(runs).collect()}          # one row a power of two of the length
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], base.alias("__base"), tested.alias("__tested"))
    ok = lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[x["stratum"]] <= x["bin"],
                              F.lit(False)) if limits else F.lit(False)
    random = F.transform(F.filter("__tested", lambda x: (x["p"] >= ALPHA) & ok(x)), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end"))).cast(SPAN)
    every = _apart(F.concat("__base", random))
    return slim.select(*[F.col(f"`{c}`") for c in keep], every.alias("spans"))


def _limits(runs: DataFrame) -> DataFrame:
    """e-BH by stratum on binned e-values: the lowest bin b with (runs at b or above) * e(b) >= m / Q."""
    likely = (F.col("x.p") >= ALPHA).cast("int")
    bins = (runs.groupBy("x.stratum", "x.bin")
            .agg(F.count("*").alias("m"), F.sum(likely).alias("n")))
    above = Window.partitionBy("stratum").orderBy(F.desc("bin"))                 # at most TOP + 1 bins
    return (bins.withColumn("k", F.sum("n").over(above)).withColumn("m", F.sum("m").over(Window.partitionBy("stratum")))
            .where((F.col("n") > 0) & (F.log("k") + F.col("bin") * STEP >= F.log(F.col("m") / Q))).groupBy("stratum").agg(F.min("bin").alias("bin")))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with every (merged) span replaced by a mark; ``spans`` in order. What is kept is cut out block by block."""
    zero = F.lit(0).cast("bigint")

    def cut(whole, a, b):
        return F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))

    def block(x):
        base, end = x[0]["a"], F.element_at(x, -1)["b"]
        return _bound(cut(text, base, end), lambda whole: F.concat_ws("", F.transform(x, lambda c: F.concat(
            cut(whole, c["a"] - base, c["b"] - base), F.lit(mark)))))

    def pieces(s):
        before = _running(F.transform(s, lambda x: x["end"]), zero, lambda a, x: F.greatest(a, x))
        return F.filter(F.zip_with(s, before, lambda x, at: F.struct(at.alias("a"), x["start"].alias("b"))), lambda c: c["b"] >= c["a"])
    done = _bound(spans, lambda s: F.concat(
        F.concat_ws("", F.transform(_blocks(pieces(s)), block)), cut(text, F.array_max(F.transform(s, lambda x: x["end"])), F.lit(2 ** 31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def digest(scanned: DataFrame) -> DataFrame:
    """Contract columns from (doc_id, spans)."""
    name = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                          F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                          said(F.col("spans")).alias("spans"))
