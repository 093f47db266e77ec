"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted shingles decide.

DataFrame functions only. Every window of as many words as an item stands for judgement; those are left unprinted that provably
cannot reach the similarity, because too few of their places hold a shingle of any item of that size. Moved one place on from a
place that holds none, a window loses nothing, so the last best one begins at such a place or is the text's last. The windows'
fingerprints name the items: within the radius
some block differs in at most radius / blocks bits, and items are indexed under all such values of each block. Every
fingerprint within the radius is thus met; the exact similarity of the shingles, weighted by their counts, decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, materialize, table

WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold differs in 9.6 of 64 bits on average, with a deviation of 2.9.
RADIUS, BLOCKS = 20, 8
#: Rows of two or three numbers up to which a side is broadcast, some 5 MB; else both sides are shuffled, less what a bit set of
#: 2**SET_BITS bits leaves out, and the keys are salted.
BROADCAST_ROWS = 200_000
SET_BITS, SALTS = 26, 16
_NO_ID = -(1 << 63)


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, wherever the optimizer moves the expression to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_array(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word n-grams in order, lower case; a shorter text is one n-gram, a null or blank one has none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))

    def grams(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) < words, F.array(F.xxhash64(w))).otherwise(long)

    return F.when(F.length(bare) == 0, F.array().cast("array<bigint>")).otherwise(bound(F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)), grams))


def simhash(array: str) -> Column:
    """64-bit SimHash of an array of hashes: two bits are counted in the halves of each of 32 sums."""
    sums = F.expr(f"transform(sequence(0, 31), j -> aggregate({array}, 0L, (a, x) -> a + (shiftrightunsigned(x, j) & 4294967297L)))")
    n = F.size(array)

    def bits(s: Column) -> Column:
        low = lambda v: F.when(2 * v.bitwiseAND(4294967295) > n, 1).otherwise(0)
        high = lambda v: F.when(2 * F.shiftrightunsigned(v, 32) > n, 1).otherwise(0)
        text = F.concat(F.array_join(F.reverse(F.transform(s, high)), ""), F.array_join(F.reverse(F.transform(s, low)), ""))
        return F.conv(text, 2, -10).cast("bigint")

    return bound(sums, bits)


def block_values(fingerprint: str, radius: int, blocks: int, near: bool) -> Column:
    """Structs (block, value): each block's bits, or all values that differ from them in at most radius / blocks bits."""
    width = 64 // blocks
    flips = [sum(1 << b for b in c) for k in range(radius // blocks + 1 if near else 1) for c in combinations(range(width), k)]
    masks = F.array(*[F.lit(m).cast("bigint") for m in flips])
    part = lambda b: F.expr(f"shiftrightunsigned({fingerprint}, {b * width}) & {(1 << width) - 1}L")
    return F.flatten(F.array(*[_block(part(b), b, masks) for b in range(blocks)]))


def _block(value: Column, b: int, masks: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(b).alias("block"), value.bitwiseXOR(m).alias("value")))


def dense_starts(places: Column, m: Column, n: Column, similarity: float) -> Column:
    """Starts of windows of n of a text's m shingles that may reach the similarity, from the sorted places of items' shingles.

    c common of w and n shingles have the similarity c / (w + n - c). Some best window begins at one of the places or is the last.
    """
    need = F.ceil(F.lit(similarity) / (1 + similarity) * (F.least(m, n) + n) - 1e-9).cast("int")
    last = F.greatest(F.lit(0), m - n)

    def starts(x: Column) -> Column:
        size = F.size(x.ps)
        full = F.filter(F.sequence(F.lit(0), size - x.need), lambda j: (F.get(x.ps, j) < x.last) & (F.get(x.ps, j + x.need - 1) < F.get(x.ps, j) + x.n))
        end = F.when(F.get(x.ps, size - x.need) >= x.last, F.array(x.last)).otherwise(F.array().cast("array<int>"))
        return F.when(size >= x.need, F.concat(F.transform(full, lambda j: F.get(x.ps, j)), end)).otherwise(F.array().cast("array<int>"))

    return bound(F.struct(places.alias("ps"), F.greatest(need, F.lit(1)).alias("need"), last.alias("last"), n.alias("n")), starts)


def may_hold(df: DataFrame, key: Column, keys: DataFrame, bits: int = SET_BITS) -> DataFrame:
    """df less rows whose key (a long hash) surely is not in keys (one such column): a bit set of fixed size is broadcast."""
    at = lambda h: F.pmod(h, F.lit(1 << bits)) + 1  # noqa: E731  bitmap functions count from 1
    h = at(F.col(keys.columns[0]))
    parts = keys.groupBy(F.bitmap_bucket_number(h).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bits"))
    place = F.bitmap_bit_position(at(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = df.withColumn("_bucket", F.bitmap_bucket_number(at(key))).join(F.broadcast(parts), "_bucket")
    return both.filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: for each document and item of benchmark that some window matches, the best one.

    docs: doc_id long, text; benchmark: item_id, text. A window has as many words as its item (the whole text, if that is
    shorter); start counts words from 0. The similarity is the sum of the lesser counts of the two sides' word n-grams
    over that of the greater ones, the greatest that any window reaches; of equal ones the last counts. Null and blank texts match
    nothing. Repeated rows and rows with equal ids are answered by one row, those without an id too. Other columns are left out.
    """
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0
    items = benchmark.select("item_id", "text").filter(~blank).distinct().select("item_id", shingle_array(F.col("text"), words).alias("s"))
    items = materialize(items.select("item_id", "s", F.size("s").alias("n"), simhash("s").alias("print"), F.xxhash64("item_id", "s").alias("item")).distinct().transform(few_files), "items")
    seeds = items.select("n", F.explode("s").alias("h")).distinct()
    # rows of one id are told apart by their text, so that places of two texts never mix
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    spots = docs.select("doc", "row", shingle_array(F.col("text"), words).alias("s")).select("doc", "row", F.size("s").alias("m"), F.posexplode("s").alias("p", "h"))
    if seeds.count() <= broadcast_rows:
        shared = spots.join(F.broadcast(seeds), "h")
    else:
        spots = may_hold(spots, F.col("h"), seeds.select("h")).withColumn("salt", F.col("p") % SALTS)
        shared = spots.join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])
    hits = shared.groupBy("doc", "row", "m", "n").agg(F.collect_set("p").alias("ps"))  # fewer places than the text has words
    laid = hits.select("doc", "row", "m", "n", F.explode(dense_starts(F.array_sort("ps"), F.col("m"), F.col("n"), similarity)).alias("start"))
    laid = materialize(few_files(laid), "windows")
    ids = laid.select("doc", "row").distinct()
    some = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    held = docs if some is not ids else may_hold(docs, F.xxhash64("doc", "row"), ids.select(F.xxhash64("doc", "row").alias("h")))
    held = held.join(some, ["doc", "row"], "left_semi").dropDuplicates(["doc", "row"]).select("doc", "row", shingle_array(F.col("text"), words).alias("s"))
    windows = held.join(laid, ["doc", "row"]).select("doc", "n", "start", F.slice("s", F.col("start") + 1, F.col("n")).alias("w"))
    windows = materialize(windows.select("doc", "start", "n", "w", simhash("w").alias("print"), F.monotonically_increasing_id().alias("id")), "prints")
    met = windows.select("id", "n", F.col("print").alias("p"), F.explode(block_values("print", radius, blocks, False)).alias("b")).select("id", "n", "p", "b.*")
    index = items.select("item", "n", F.col("print").alias("q"), F.explode(block_values("print", radius, blocks, True)).alias("b")).select("item", "n", "q", "b.*")
    near = met.join(index, ["n", "block", "value"]).filter(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius).select("id", "item").distinct()
    counts = items.select("item", F.explode("s").alias("h")).groupBy("item", "h").agg(F.count("*").alias("c"))
    mine = windows.select("id", F.explode("w").alias("h")).join(near, "id").groupBy("id", "item", "h").agg(F.count("*").alias("k"))
    common = mine.join(counts, ["item", "h"], "left").groupBy("id", "item").agg(F.sum(F.least("k", F.coalesce("c", F.lit(0)))).alias("common"), F.sum("k").alias("total"))
    scored = common.join(items.select("item", "item_id", F.col("n").alias("size")), "item").withColumn("similarity", F.col("common") / (F.col("total") + F.col("size") - F.col("common"))).filter(F.col("similarity") >= similarity)
    best = scored.join(windows.select("id", "doc", "start", F.size("w").alias("len")), "id").groupBy("doc", "item_id").agg(F.max(F.struct("similarity", "start", "len")).alias("best"))
    return few_files(best).select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "item_id", "best.start", (F.col("best.len") + words - 1).alias("n_words"), "best.similarity")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less those that hold an item; rows without an id stay unless such a row holds one. All columns stay, whatever their names."""
    gone = materialize(contaminated(docs, benchmark).select("doc_id").distinct().transform(few_files), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
