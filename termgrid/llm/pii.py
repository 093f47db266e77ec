"""PII: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. A pattern is applied twice to a text, to extract its matches and to split around them; the
lengths of both give the positions. Patterns use possessive repeats and \\G so that each is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, a character every match has, words nearby that raise the score, score without them)
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|reach|kontakt|correo", 0.9),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|server|host|address|login|client", 0.6),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "", "card|visa|credit|payment|karte|carte|tarjeta", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax|llame|appel", 0.7),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", "iban|bank|account|konto|compte|cuenta", 0.9),
}
#: The kinds whose spans the digest fixes.
BASE = ("email", "ip", "card", "phone")
_BLOCK = 256
_NEAR = 40


def prefix_sums(values: Column) -> Column:
    """Sums of the values before each one, in time linear in their number: blocks first, then inside each block."""

    def run(part: Column, begin: Column) -> Column:
        return F.aggregate(part, F.struct(begin.alias("s"), F.expr("array_repeat(0, 0)").alias("a")), lambda z, x: F.struct((z.s + x).alias("s"), F.concat(z.a, F.array(z.s)).alias("a"))).a

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    part = lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))
    sums = F.transform(starts, lambda b: F.aggregate(part(b), F.lit(0), lambda s, x: s + x))
    before = run(sums, F.lit(0))
    return F.when(F.size(values) == 0, F.expr("array_repeat(0, 0)")).otherwise(F.flatten(F.zip_with(starts, before, lambda b, s: run(part(b), s))))


def located(df: DataFrame, text: str, pattern: str, keep: Column, out: str) -> DataFrame:
    """Adds out: array of (start, end, value, before, after), code points, for the leftmost non-overlapping matches.

    keep says of a whole text whether it can match at all. before and after are up to 40 characters around a match.
    """
    p = F.lit(pattern)
    df = df.withColumn("_m", F.when(keep, F.regexp_extract_all(text, p, F.lit(0))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_l", F.when(F.size("_m") > 0, F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, prefix_sums(F.col("_l"))))
    near = F.zip_with(F.slice("_g", 1, F.size("_m")), F.slice("_g", 2, F.size("_m")), lambda a, b: F.struct(F.length(a).alias("n"), F.lower(F.right(a, F.lit(_NEAR))).alias("before"), F.lower(F.left(b, F.lit(_NEAR))).alias("after")))
    spans = F.zip_with(F.zip_with("_m", "_s", lambda m, s: F.struct(m.alias("m"), s.alias("s"))), near, lambda x, y: F.struct((x.s + y.n).alias("start"), (x.s + y.n + F.length(x.m)).alias("end"), x.m.alias("value"), y.before.alias("before"), y.after.alias("after")))
    return df.withColumn(out, F.coalesce(F.when(F.size("_m") > 0, spans), F.expr("filter(array(named_struct('start', 0, 'end', 0, 'value', '', 'before', '', 'after', '')), x -> false)"))).drop("_m", "_g", "_l", "_s")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(i: Column) -> Column:
        d = F.substr(value, F.length(value) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check."""
    turned = F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))

    def step(s: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The checksum or range test of a kind."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.when(F.length(bare(p)) <= 3, bare(p)).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        bare = F.regexp_replace(value, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _confirmed_spans(found: Column, k: int, kind: str) -> Column:
    _, _, context, score = KINDS[kind]

    def span(x: Column) -> Column:
        nearby = F.concat(x.before, F.lit(" "), x.after).rlike(context)
        return F.struct(x.start.alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x.end.alias("end"), x["value"].alias("value"), (F.lit(score) + F.when(nearby, 0.1).otherwise(0.0)).alias("score"))

    return F.transform(F.filter(found, lambda x: confirmed(kind, x["value"])), span)


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Adds pii: array of (start, k, kind, end, value, score), sorted by start, then by the order of KINDS.

    Positions are code points, end exclusive. A null or empty text has no spans. score lies between 0 and 1: the
    kind's own score, 0.1 more with a word of its context within 40 characters. Repeated rows are each answered alone;
    other columns stay as they are, whatever their names; a column named pii is replaced. An empty table gives no rows.
    """
    out = docs.select(F.struct(*[c for c in docs.columns if c != "pii"]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_pii_text"))
    for k, kind in enumerate(kinds):
        pattern, sign, _, _ = KINDS[kind]
        keep = F.contains("_pii_text", F.lit(sign)) if sign else F.col("_pii_text").rlike("[0-9]")
        out = located(out, "_pii_text", pattern, keep, f"_pii_{kind}")
        out = out.withColumn(f"_pii_{kind}", _confirmed_spans(F.col(f"_pii_{kind}"), k, kind))
    names = [f"_pii_{kind}" for kind in kinds]
    return out.select("_row.*", F.array_sort(F.concat(*names)).alias("pii"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x.kind.isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: F.round(x.score, 2).cast("string")), ",").alias("scores"))
