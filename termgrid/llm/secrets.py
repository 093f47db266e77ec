"""Secret scans: fixed patterns, and a randomness battery with length-aware control of false discoveries.

DataFrame functions only. A candidate is a long token with a letter. Its encoding is inferred from its signs,
and three tests ask whether it is a uniform draw from that alphabet: chi-squared of the signs' counts, runs above and
below the middle of the alphabet, serial correlation of neighbours. Their squared deviations add up to one p-value,
uniform for random strings and near 0 for words. In each class of encoding and length the p-values above a half tell how
many candidates are random, and the cut is the least for which the expected share of others stays below the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .decontam import bound
from .pii import located, span_text

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern; hex and access take their least length into the pattern, which matches the same runs.
KINDS = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{14,}+", "hex": r"[0-9a-f]{16,}+"}
_SIGNS = "A-Za-z0-9+/_-"
#: A token of 20 signs or more with a letter; digits alone are numbers, not secrets.
RANDOM = rf"(?:\G|(?<![{_SIGNS}]))(?=[0-9+/_-]*+[A-Za-z])[{_SIGNS}]{{20,}}+={{0,2}}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding -> signs in order; the first that fits is taken.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower26": _LOWER,
    "UPPER26": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "alpha52": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Share of false discoveries; candidates that every class is taken to hold besides its own, half of them random.
RATE, PRIOR = 0.1, 40
_BINS = 40
#: Lengths at which a class begins.
LENGTHS = (20, 24, 32, 48, 96)


def battery(value: Column) -> Column:
    """Struct (encoding, n, chi, runs, serial, p) of a token; null if no alphabet fits.

    The token is cut into signs once and each step is bound to a name, so the work is that of sorting its signs.
    """

    def encoded(bare: Column) -> Column:
        encoding = F.lit(None).cast("string")
        for name, signs in reversed(ALPHABETS.items()):
            cls = signs.replace("-", r"\-")
            encoding = F.when(bare.rlike(rf"^[{cls}]+\z"), F.lit(name)).otherwise(encoding)
        return F.struct(bare.alias("bare"), encoding.alias("encoding"))

    def valued(t: Column) -> Column:
        signs = F.lit("")
        for name, alphabet in ALPHABETS.items():
            signs = F.when(t.encoding == name, F.lit(alphabet)).otherwise(signs)
        values = lambda s: F.transform(F.split(t.bare, ""), lambda c: (F.position(c, s) - 1).cast("double"))
        x = bound(signs, lambda s: F.struct(t.encoding.alias("encoding"), F.length(s).cast("double").alias("a"), values(s).alias("v")))
        return F.when(t.encoding.isNotNull() & (F.length(t.bare) >= LENGTHS[0]), bound(bound(x, tests), joined))

    def tests(x: Column) -> Column:
        n, a, v = F.size(x.v).cast("double"), x.a, x.v
        pairs = lambda: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        # each sign adds what the square of its count grows by
        met = lambda z, y: F.struct(y.alias("last"), F.when(z["last"] == y, z.run + 2).otherwise(1.0).alias("run"), (z.total + F.when(z["last"] == y, z.run + 2).otherwise(1.0)).alias("total"))
        squares = F.aggregate(F.array_sort(v), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")), met, lambda z: z.total)
        chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        high = lambda y: y * 2 >= a
        runs = F.aggregate(pairs(), F.lit(1.0), lambda s, y: s + F.when(high(y.p) != high(y.q), 1.0).otherwise(0.0))
        middle, spread = (a - 1) / 2, (a * a - 1) / 12
        serial = F.aggregate(pairs(), F.lit(0.0), lambda s, y: s + (y.p - middle) * (y.q - middle)) / spread / F.sqrt(n - 1)
        return F.struct(x.encoding.alias("encoding"), F.size(v).alias("n"), chi.alias("chi"), ((runs - (n + 1) / 2) / (F.sqrt(n - 1) / 2)).alias("runs"), serial.alias("serial"))

    def joined(t: Column) -> Column:
        # chi-squared of 3 to a normal deviate by its cube root
        q = t.chi * t.chi + t.runs * t.runs + t.serial * t.serial
        z = (F.pow(q / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5
        p = 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))
        return F.struct(t.encoding.alias("encoding"), t.n.alias("n"), t.chi.alias("chi"), t.runs.alias("runs"), t.serial.alias("serial"), p.alias("p"))

    return bound(bound(F.regexp_replace(value, "=+$", ""), encoded), valued)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def cuts(candidates: DataFrame, rate: float = RATE, prior: float = PRIOR) -> dict[tuple[str, int], float]:
    """The least p by (encoding, class of length), from all candidates (encoding, n, p), by one rule at every size.

    A class also counts prior candidates, one half random and the other no secrets with the least p: they stand for what is not
    known of a small class and weigh nothing in a large one. At most ten encodings, five classes and 40 bins of p reach the driver.
    """
    bins = candidates.groupBy("encoding", length_class(F.col("n")).alias("k"), F.least(F.floor(F.col("p") * _BINS), F.lit(_BINS - 1)).cast("int").alias("b")).count().collect()
    seen: dict[tuple[str, int], list[float]] = {}
    for r in bins:
        seen.setdefault((r["encoding"], r["k"]), [prior / 2 / _BINS + (prior / 2 if b == 0 else 0) for b in range(_BINS)])[r["b"]] += r["count"]
    out = {}
    for key, n in seen.items():
        random = 2 * sum(n[_BINS // 2 :])
        meets = (b for b in range(1, _BINS) if sum(n[b:]) - random * (1 - b / _BINS) <= rate * sum(n[b:]))
        out[key] = next(meets, _BINS) / _BINS
    return out


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """key, secrets: array of (start, k, kind, end, value, score), sorted by start, then assign, access, hex, random.

    Positions are code points, end exclusive. The score of a pattern is 1, that of a random token its p-value. A null or
    empty text has no spans. Repeated rows are each answered alone; other columns are left out. The spans are written
    to the shared folder once, as the cuts of the random tokens depend on all of them.
    """
    out = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    signs = {"assign": F.col("_text").rlike("[:=]"), "access": F.contains("_text", F.lit("AKIA")), "hex": F.lit(True), "random": F.col("_text").rlike(f"[{_SIGNS}]{{20}}")}
    for k, (kind, pattern) in enumerate((KINDS | {"random": RANDOM}).items()):
        out = located(out, "_text", pattern, signs[kind], f"_{kind}")
        out = out.withColumn(f"_{kind}", _passed(F.col(f"_{kind}"), k, kind, pattern))
    names = [f"_{kind}" for kind in KINDS]
    found = materialize(out.select("_key", F.concat(*names).alias("_base"), "_random"), "secrets")
    limits = cuts(found.select(F.explode("_random").alias("r")).select("r.encoding", "r.n", F.col("r.score").alias("p")), rate)

    def kept(r: Column) -> Column:
        cut = F.lit(1.1)
        for (encoding, k), least in limits.items():
            cut = F.when((r.encoding == encoding) & (length_class(r.n) == k), F.lit(least)).otherwise(cut)
        return r.score >= cut

    random = F.transform(F.filter("_random", kept), lambda r: F.struct(*[r[c].alias(c) for c in ("start", "k", "kind", "end", "value", "score")]))
    return found.select(F.col("_key").alias(key), F.array_sort(F.concat("_base", random)).alias("secrets"))


def _passed(spans: Column, k: int, kind: str, pattern: str) -> Column:
    head = lambda x: (x.start.alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x.end.alias("end"), x["value"].alias("value"))
    if kind == "random":
        tested = F.transform(spans, lambda x: F.struct(x.alias("x"), battery(x["value"]).alias("t")))
        return F.transform(F.filter(tested, lambda y: y.t.isNotNull()), lambda y: F.struct(*head(y.x), y.t.p.alias("score"), y.t.encoding.alias("encoding"), y.t.n.alias("n")))
    if kind == "assign":
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["value"], pattern, 2)) >= 12)
    return F.transform(spans, lambda x: F.struct(*head(x), F.lit(1.0).alias("score")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x.kind != "random")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))
