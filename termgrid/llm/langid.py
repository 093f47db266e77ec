"""Language ID: interpolated Kneser-Ney character models in sorted arrays; the lowest cross-entropy a character wins.

A text is lower-cased, what is not a letter becomes a blank, and runs of blanks become one. Four characters of 16 bits
make the 64-bit key of an n-gram (characters beyond 16 bits share one value); a model finds keys by binary search.
Every n-gram of the training texts counts: where they are too many for one worker, the model is tables in the shared
folder, which are joined with the distinct keys of the texts, and each block of texts meets its own keys' shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import quantiles
from .common import held_out, materialize, slices, table, text_batches
from .tokens import _LETTER, _classes

ORDER = 4
#: n-grams of the highest order up to which a model is held in each worker's memory; a larger one is kept as tables.
MAX_GRAMS = 2_000_000
#: Texts that meet the shares of their keys in one call, where the model is tables.
BLOCK_ROWS = 500
#: The share of a language's training rows that is not rejected.
PASS = 0.995
_letters: list[np.ndarray] = []


def _codes() -> np.ndarray:
    if not _letters:
        kind = _classes()
        code = np.minimum(np.arange(len(kind)), 0xFFFF).astype(np.uint64)
        _letters.append(np.where(kind == _LETTER, code, 32).astype(np.uint64))
    return _letters[0]


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram keys of each text, one after another, and their numbers; none for a text without letters."""
    gap = "\x01" * (ORDER - 1)
    whole = gap + "".join(t + gap for t in texts)
    c = _codes()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    size = np.array([len(t) + ORDER - 1 for t in texts])
    stop = ORDER - 1 + np.cumsum(size)
    border = np.zeros(len(c), dtype=bool)
    for j in range(1, ORDER):
        border[stop - j] = True
    border[: ORDER - 1] = True
    blank = c == 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = border[1:] | ~(blank[1:] & blank[:-1])
    row = np.repeat(np.arange(len(texts)), size)
    c, border, row = c[keep], border[keep], np.concatenate((np.zeros(ORDER - 1, dtype=np.int64), row))[keep]
    key = np.zeros(len(c), dtype=np.uint64)
    for j in range(ORDER):
        key[ORDER - 1 :] |= c[ORDER - 1 - j : len(c) - j] << np.uint64(16 * j)
    own = ~border
    own[1:] |= border[1:] & ~border[:-1] & (c[:-1] != 32)  # a text ends with one blank
    letter = np.bincount(row[~border & (c != 32)], minlength=len(texts)) > 0
    own &= letter[row]
    return key[own], np.bincount(row[own], minlength=len(texts))


def _at(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = np.minimum(np.searchsorted(table_, keys), max(len(table_) - 1, 0))
    return spot, (table_[spot] == keys) if len(table_) else np.zeros(len(keys), dtype=bool)


@dataclass
class LanguageModel:
    """By order: sorted n-gram keys with discounted shares, and sorted contexts with what they leave to the order below.

    Rows are n-grams, columns languages. pass_mark: the largest excess of cross-entropy, times the root of the length,
    of a text that is not rejected; mean: the mean cross-entropy of a language's own texts.
    """

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    mean: np.ndarray | None = None
    pass_mark: np.ndarray | None = None

    def share(self, keys: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.broadcast_to(self.base, (len(keys), len(self.languages)))
        below = self.share(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        (g, own), (x, left) = self.grams[order - 1], self.contexts[order - 1]
        spot, known = _at(g, keys)
        at, seen = _at(x, keys >> np.uint64(16))
        return np.where(known[:, None], own[spot] if len(g) else 0, 0) + np.where(seen[:, None], left[at] if len(x) else 1, 1) * below

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character, by text and language, and the number of characters."""
        return _entropies(texts, len(self.languages), lambda keys: self.share(keys, ORDER))


@dataclass
class TableModel:
    """The same model as tables, by order: grams (key, own) and contexts (x, left), each a map from a language's number.

    As many rows as the training texts have n-grams; what the driver holds is bounded by the number of languages.
    """

    languages: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    base: float
    mean: np.ndarray | None = None
    pass_mark: np.ndarray | None = None

    def share(self, keys: DataFrame) -> DataFrame:
        """key, p: each distinct key's probability by language, from the lowest order up; a join has at most 2**16 rows a key."""
        asked = [keys.select("key").distinct()]
        for order in range(ORDER - 1, 0, -1):
            asked.insert(0, asked[0].select(_suffix(order).alias("key")).distinct())
        out = asked[0].withColumn("p", F.array_repeat(F.lit(self.base), len(self.languages)))
        for order, (mine, g, x) in enumerate(zip(asked, self.grams, self.contexts, strict=True), 1):
            if order > 1:
                out = mine.withColumn("suffix", _suffix(order - 1)).join(out.withColumnRenamed("key", "suffix"), "suffix")
            out = out.withColumn("x", _context()).join(g, "key", "left").join(x, "x", "left")
            p = F.transform("p", lambda below, k: F.coalesce(F.col("own")[k].cast("double"), F.lit(0.0)) + F.coalesce(F.col("left")[k].cast("double"), F.lit(1.0)) * below)
            out = out.select("key", p.alias("p"))
        return out

    def apply(self, docs: DataFrame, run, schema) -> DataFrame:
        """run(batches of docs, entropies) makes the result's rows with that schema, a block of texts at a time."""
        names, languages = docs.columns, len(self.languages)
        block = next(c for k in range(len(names) + 1) if (c := f"_block{k or ''}") not in names)
        # written, as both sides must see the same blocks
        blocks = materialize(docs.withColumn(block, F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)), "language-blocks")
        asked = blocks.select(F.col(block).alias("_block"), "text").mapInArrow(_asked, "_block long, key long").distinct()
        shares = asked.join(self.share(asked), "key").select("_block", "key", "p")

        def joined(texts: pa.Table, known: pa.Table) -> pa.Table:
            keys = known.column("key").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            keys, p = keys[order], known.column("p").combine_chunks().flatten().to_numpy().reshape(-1, languages)[order]
            made = list(run(texts.select(names).combine_chunks().to_batches(), lambda texts: _entropies(texts, languages, lambda k: p[np.searchsorted(keys, k)])))
            return pa.Table.from_batches(made)

        return blocks.groupBy(block).cogroup(shares.groupBy("_block")).applyInArrow(joined, schema)


def _entropies(texts: list[str], languages: int, share) -> tuple[np.ndarray, np.ndarray]:
    keys, n = keys_of(texts)
    distinct, inverse = np.unique(keys, return_inverse=True)
    logs = np.log(share(distinct)).astype(np.float32)
    stop, out = np.concatenate(([0], np.cumsum(n))), np.zeros((len(texts), languages))
    for k in range(languages):
        total = np.concatenate(([0.0], np.cumsum(logs[inverse, k], dtype=np.float64)))
        out[:, k] = -(total[stop[1:]] - total[stop[:-1]]) / np.maximum(n, 1)
    return out, n


def _suffix(order: int) -> Column:
    return F.col("key").bitwiseAND((1 << 16 * order) - 1)


def _context() -> Column:
    return F.shiftrightunsigned("key", 16)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block and the distinct keys of a block's texts; a block in several batches or slices gives some more than once."""
    for batch in batches:
        blocks, text = batch.column("_block").to_numpy(), pc.utf8_lower(batch.column("text"))
        for lo, hi, *_ in slices(text):
            keys, n = keys_of(text.slice(lo, hi - lo).fill_null("").to_pylist())
            of = np.repeat(blocks[lo:hi], n)
            for block in np.unique(of):
                distinct = np.unique(keys[of == block])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), block)), pa.array(distinct.view(np.int64))], ["_block", "key"])


def kneser_ney_tables(languages: list[str], counts: DataFrame) -> TableModel:
    """kneser_ney for counts (lang, key, n) of any number, one row for each lang and key."""
    spark, grams, contexts = counts.sparkSession, [], []
    number = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "k int, lang string"))
    mine = materialize(counts.join(number, "lang").select("k", "key", F.col("n").cast("double").alias("n")), "language-grams")
    base = 1.0 / (mine.select(_suffix(1)).distinct().count() + 1)
    for order in range(ORDER, 0, -1):
        one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(one > 0, F.least(F.greatest(one / (one + 2 * two), F.lit(0.1)), F.lit(0.9))).otherwise(0.5)
        d = F.broadcast(mine.groupBy("k").agg(discount.alias("d")))
        x = mine.groupBy("k", _context().alias("x")).agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(d, "k")
        own = mine.withColumn("x", _context()).join(x, ["k", "x"]).withColumn("v", ((F.col("n") - F.col("d")) / F.col("total")).cast("float"))
        left = x.withColumn("v", (F.col("d") * F.col("types") / F.col("total")).cast("float"))
        by_language = F.map_from_entries(F.collect_list(F.struct("k", "v")))  # as many as there are languages
        grams.insert(0, materialize(own.groupBy("key").agg(by_language.alias("own")), f"language-grams-{order}"))
        contexts.insert(0, materialize(left.groupBy("x").agg(by_language.alias("left")), f"language-contexts-{order}"))
        if order > 1:
            mine = materialize(mine.groupBy("k", _suffix(order - 1).alias("key")).agg(F.count("*").cast("double").alias("n")), "language-grams")
    return TableModel(languages, grams, contexts, base)


def kneser_ney(languages: list[str], keys: list[np.ndarray], counts: list[np.ndarray]) -> LanguageModel:
    """keys: each language's sorted n-grams of the highest order; lower orders count the distinct n-grams they end."""
    grams, contexts = [], []
    letters = np.unique(np.concatenate([k & np.uint64(0xFFFF) for k in keys] or [np.empty(0, dtype=np.uint64)]))
    for order in range(ORDER, 0, -1):
        mine = []
        for k, n in zip(keys, counts, strict=True):
            one, two = (n == 1).sum(), (n == 2).sum()
            discount = min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5
            x, inverse, types = np.unique(k >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, n, len(x))
            mine.append((k, (n - discount) / total[inverse], x, discount * types / total))
        g, x = (np.unique(np.concatenate([m[i] for m in mine] or [np.empty(0, dtype=np.uint64)])) for i in (0, 2))
        own, left = np.zeros((len(g), len(languages)), dtype=np.float32), np.ones((len(x), len(languages)), dtype=np.float32)
        for i, (k, s, c, b) in enumerate(mine):
            own[np.searchsorted(g, k), i], left[np.searchsorted(x, c), i] = s, b
        grams.insert(0, (g, own))
        contexts.insert(0, (x, left))
        lower = [np.unique(k & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True) for k in keys]
        keys, counts = [k for k, _ in lower], [n.astype(np.float64) for _, n in lower]
    return LanguageModel(languages, grams, contexts, np.full(len(languages), 1.0 / (len(letters) + 1)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key and count, summed within a task as far as memory allows."""
    have: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in have.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        text = pc.utf8_lower(batch.column("text"))
        for lo, hi, *_ in slices(text):
            part, texts = np.array(langs[lo:hi]), text.slice(lo, hi - lo).to_pylist()
            for lang in set(langs[lo:hi]):
                k, n = np.unique(keys_of([texts[i] for i in np.flatnonzero(part == lang)])[0], return_counts=True)
                have.setdefault(lang, []).append((k, n))
                rows += len(k)
        if rows > 3_000_000:
            yield from merged()
            have, rows = {}, 0
    yield from merged()


def _applied(docs: DataFrame, model: LanguageModel | TableModel, run, schema) -> DataFrame:
    """run(batches of docs, entropies) over docs, with the model in memory or joined as tables."""
    if isinstance(model, TableModel):
        return model.apply(docs, run, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda batches: run(batches, shared.value.entropies), schema)


def _model(languages: list[str], counts: DataFrame, tables: bool) -> LanguageModel | TableModel:
    """The model of counts (lang, key, n), one row for each lang and key, in memory or as tables."""
    if tables:
        return kneser_ney_tables(languages, counts)
    got = counts.toArrow()
    lang, key, n = got["lang"].to_numpy(zero_copy_only=False), got["key"].to_numpy().view(np.uint64), got["n"].to_numpy().astype(np.float64)
    parts = []
    for name in languages:
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(key[own])]
        parts.append((key[own], n[own]))
    return kneser_ney(languages, [k for k, _ in parts], [c for _, c in parts])


def _seen(rows: DataFrame, model: LanguageModel | TableModel, run) -> DataFrame:
    """What run finds for the rows, as a table; the model does not stay in the workers."""
    schema = "k int, h double, n long"
    if isinstance(model, TableModel):
        return materialize(model.apply(rows, run, schema), "language-seen")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = materialize(rows.mapInArrow(lambda batches: run(batches, shared.value.entropies), schema), "language-seen")
    shared.destroy()
    return found


def fit_languages(docs: DataFrame, max_grams: int = MAX_GRAMS) -> LanguageModel | TableModel:
    """Models of all languages in docs (text string, lang string); rows without either do not count.

    max_grams decides where the model is kept, never what is in it. The rejection is calibrated on all rows, by one rule at every size: the
    rows are halved by a hash, and each row is tried on the model of the other half, which has not counted it. Each repeated row counts.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    known = known.withColumn("half", F.pmod(F.xxhash64("text", "lang"), F.lit(2)).cast("int"))
    coded = known.select("text", F.concat(F.col("half").cast("string"), "lang").alias("lang")).mapInArrow(_counted, "lang string, key long, n long")
    first = F.substring("lang", 1, 1) == "0"
    counts = coded.groupBy(F.expr("substring(lang, 2)").alias("lang"), "key").agg(F.sum("n").alias("n"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("n0"))
    counts = materialize(counts.withColumn("n1", F.col("n") - F.col("n0")), "language-counts")
    total = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    languages = sorted(total)
    model, *halves = [_model(languages, counts.filter(F.col(n) > 0).select("lang", "key", F.col(n).alias("n")), sum(total.values()) > max_grams) for n in ("n", "n0", "n1")]
    for m in halves:  # a language that a half lacks is as likely as any row of letters there
        m.base = model.base

    def tried(batches: Iterator[pa.RecordBatch], entropies) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = pc.utf8_lower(batch.column("text")), [languages.index(x) if x in languages else -1 for x in batch.column("lang").to_pylist()]
            for lo, hi, *_ in slices(text):
                h, size = entropies(text.slice(lo, hi - lo).to_pylist())
                own = np.array(at[lo:hi])
                ok = (own >= 0) & (size > 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[ok].astype(np.int32)), pa.array(h[np.flatnonzero(ok), own[ok]]), pa.array(size[ok].astype(np.int64))], ["k", "h", "n"])

    # the rows of one half on the model of the other: three numbers a row
    tried_on = [_seen(known.filter(F.col("half") == 1 - k).select("text", "lang"), m, tried) for k, m in enumerate(halves)]
    seen = tried_on[0].unionByName(tried_on[1])
    mean = seen.groupBy("k").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"))
    means = {r["k"]: r["mean"] for r in mean.collect()}
    excess = seen.join(F.broadcast(mean), "k").select(F.col("k").alias("lang"), ((F.col("h") - F.col("mean")) * F.sqrt("n")).alias("x"))
    marks = {r["lang"]: r["q"][0] for r in quantiles(excess, ["lang"], "x", (PASS,)).collect()} if means else {}
    model.mean, model.pass_mark = (np.array([of.get(i, np.inf) for i in range(len(languages))]) for of in (means, marks))
    return model


def identify(docs: DataFrame, model: LanguageModel | TableModel) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1), lang_entropy and lang_rejected added.

    lang_pred is the language of the lowest cross-entropy a character, ties to the first by name; `und` for a null text
    or one without letters, with score 0. lang_score: its share of the likelihood of all languages. lang_rejected: the
    cross-entropy lies above what all but a small share of the language's own texts reach at that length, or `und`.
    Input columns of these four names are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_entropy", "lang_rejected"]
    docs = docs.drop(*added)
    languages, mean, pass_mark = model.languages, model.mean, model.pass_mark
    schema = docs.selectExpr("*", "'' as lang_pred", "0D as lang_score", "0D as lang_entropy", "true as lang_rejected").schema

    def run(batches: Iterator[pa.RecordBatch], entropies) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = pc.utf8_lower(batch.column("text")).fill_null(""), [[], [], [], []]
            for lo, hi, *_ in slices(text):
                h, n = entropies(text.slice(lo, hi - lo).to_pylist())
                if not languages:
                    h = np.zeros((hi - lo, 1))
                best = h.argmin(axis=1)
                low = h[np.arange(len(h)), best]
                known = (n > 0) & bool(languages)
                score = 1 / np.exp(np.maximum((low[:, None] - h) * n[:, None], -700)).sum(axis=1)
                out[0] += [languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                out[1].append(np.where(known, score, 0.0))
                out[2].append(np.where(known, low, 0.0))
                out[3].append(~known | ((low - mean[best]) * np.sqrt(n) > pass_mark[best]) if languages else ~known)
            for name, column in zip(added, out, strict=True):
                batch = batch.append_column(name, pa.array(column if name == "lang_pred" else np.concatenate([*column, np.empty(0, dtype=bool if name == "lang_rejected" else float)])))
            yield batch

    return _applied(docs, model, run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
