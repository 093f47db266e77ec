"""Phrase collocations: n-grams as rows, counted by language, scored by their weakest cut, less the parts of longer ones.

An n-gram can be frequent only if both (n-1)-grams in it are, so the texts are read once for each n, and only n-grams
whose parts may have enough counts become rows: a bit set of fixed size leaves out what surely has not. Rows are counted within
a slice of text, by the words themselves, then by hash aggregation on both sides of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, gram_hashes, has_bit, lookup, materialize, pieces, signed, slices, span_hashes, table, text_batches

#: Words of a phrase, its least count, percent of a phrase's count from which a longer one takes its place, phrases a language.
MAX_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Parts in which the phrases of a language are ranked first.
PARTS = 16
#: Bits of the set of frequent n-grams: 16 MB on each worker. Bytes of text that are counted at once.
BITS, SLICE = 27, 1 << 22
#: Counts below 10**15 keep every product within 38 digits; a corpus of 100 TB holds fewer words.
_COUNT, SCALE = "decimal(15,0)", 1_000_000
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _MARK.copy()
_APART[[0x20, 0x09]] = True


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones, which Arrow compares in full, and those."""
    edge = np.empty(2 * len(starts) + 1, dtype=np.int64)
    edge[:-1:2], edge[1::2], edge[-1] = starts, ends, len(data)
    spans = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edge), pa.py_buffer(data)])
    coded = spans.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_string())


def _hashes(words: pa.Array) -> np.ndarray:
    off = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    return span_hashes(np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8), off[:-1], off[1:])


def _grams(n: int, parts) -> object:
    """Rows (lang, phrase, h, f): the n-grams of a slice of texts of one language; with parts, a bit set, only those both of whose
    (n-1)-grams are in it. A row without a phrase counts the words."""

    def count(data: np.ndarray, off: np.ndarray) -> tuple:
        data = _SMALL[data]
        starts, ends, row = pieces(data, off, _APART)
        if not len(starts):
            return (pa.array([], pa.large_string()), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), 0
        piece = np.searchsorted(np.flatnonzero(_MARK[data]), starts)
        joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        word, words = _distinct(data, starts, ends)
        hashes = _hashes(words)
        ok = np.ones(max(len(word) - n + 1, 0), dtype=bool)
        for j in range(n - 1):
            ok &= joined[j : j + len(ok)]
        if parts:
            part = has_bit(parts.value, gram_hashes(hashes[word], n - 1))
            ok &= part[: len(ok)] & part[1 : len(ok) + 1]
        at = np.flatnonzero(ok)
        key = word[at]
        for j in range(1, n):
            key = key * len(words) + word[at + j]
            if j < n - 1:  # renumbered, so that the next product stays small
                key = np.unique(key, return_inverse=True)[1]
        _, first, f = np.unique(key, return_index=True, return_counts=True)
        of = [word[at[first] + j] for j in range(n)]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(w)) for w in of], pa.scalar(" ", pa.large_string())) if n > 1 else words.take(pa.array(of[0]))
        h = gram_hashes(np.stack([hashes[w] for w in of], axis=1).reshape(-1), n)[::n]
        return (phrase, h, f), len(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "h", "f"]
        for batch in batches:
            lang = batch.column(0)
            for one in lang.unique().to_pylist():
                for _, _, data, off in slices(batch.column(1).filter(pc.equal(lang, one)), SLICE):
                    (phrase, h, f), total = count(data, off)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(f), pa.string()), phrase.cast(pa.string()), pa.array(signed(h)), pa.array(f.astype(np.int64))], names)
                    if n == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([one], pa.string()), pa.array([None], pa.string()), pa.array([0]), pa.array([total])], names)

    return run


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all runs of 1 to max_words words within a piece with a count of least or more; and lang, n, all words of it."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    frequent, total, parts = None, None, None
    for n in range(1, max_words + 1):
        counts = texts.mapInArrow(_grams(n, parts), "lang string, phrase string, h long, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.any_value("h").alias("h"))
        counts = materialize(counts.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{n}")
        if parts:
            parts.destroy()
        else:
            total = counts.filter("phrase is null and f > 0").select("lang", F.col("f").alias("n"))
            counts = counts.filter("phrase is not null")
        if n < max_words:
            parts = bitmap(counts, "h", bits)
        counts = counts.select("lang", "phrase", "f")
        frequent = counts if frequent is None else frequent.unionByName(counts)
    return frequent, total


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r, score of each phrase of 2 words or more, by its lowest-scoring cut after k words.

    frequent: lang, phrase, f of all phrases with a count of at least some limit; a part of a phrase is at least as
    frequent as the phrase, so its count is there. The first word of a third of all phrases makes no hot task (lookup).
    """
    w = F.split("phrase", " ")
    cuts = frequent.filter(F.size(w) > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.size(w)), " ").alias("rest"))
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = materialize(lookup(materialize(cuts, "cuts"), part("first", "l"), ["lang", "first"]), "cuts-first")
    cuts = lookup(cuts, part("rest", "r"), ["lang", "rest"])
    # div of decimals without a fraction is exact and drops the rest; a <= l and a <= r, so no score is above SCALE
    exact = "cast({0} as " + _COUNT + ")"
    a, l, r = (exact.format(c) for c in "alr")  # noqa: E741
    cuts = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(7,0)) * ({a} * {a}) div ({l} * {r})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.k", "b.l", "b.r", "b.score")


def without_parts(scored: DataFrame, frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """scored less the phrases that stand inside a longer frequent one with at least share percent of their count.

    A part of a phrase is at least as frequent as the phrase, so a longer phrase that takes another's place contains
    one, longer by a single word, that does too: only those are looked at, each phrase by its most frequent one.
    """
    w = F.split("phrase", " ")
    parts = F.array(*[F.array_join(F.slice(w, F.lit(1 + skip), F.size(w) - 1), " ") for skip in (0, 1)])
    longer = frequent.filter(F.size(w) > 2).select("lang", F.explode(parts).alias("part"), "f").groupBy("lang", "part").agg(F.max("f").alias("most"))
    taken = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["part"]) & (longer["most"] * 100 >= scored["a"] * share)
    return scored.join(longer, taken, "left_anti")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, k, l, r, n, score: the top phrases of 2 to max_words words of each language, all counted over all texts.

    Capital letters A to Z count as small ones. Texts are cut into pieces at signs and line ends and those into words at
    blanks and tabs. a is the phrase's count, l and r those of its two parts at the lowest-scoring cut (equal scores: the
    first cut), n the language's words and the score 1,000,000 a^2 / (l r), rounded down. Ties go to the larger a, then to the first phrase in
    UTF-8 order. A null text is empty and a null lang counts as und, together with a lang of that name. Repeated rows count
    as often as they stand there. An empty table, or one without a phrase of enough counts, gives no rows. Columns besides
    text and lang are not read.
    """
    frequent, total = phrase_counts(docs, max_words, least)
    scored = without_parts(scored_phrases(frequent), frequent, share)
    best_first = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = Window.partitionBy("lang", "part").orderBy(*best_first)  # so that one language is not one task's
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "k", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
