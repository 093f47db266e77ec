"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

Texts with equal sets form one class and go on as one. Bands are shuffled on their hash; a bucket is the classes that share
one. A pair is looked at in the bucket of the first band that it shares, so once. Two passes deal the buckets out alike: the
first one, over bands alone, finds which members have such a pair in a bucket, the second ships the full sets of those there
and verifies. Small buckets share a task; large ones are cut into blocks, and each pair of blocks is a task of its own.
Links are counted in the task, not written; classes are the connected components of verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, gram_hashes, has_bit, lists, materialize, mix, signed, slices, split_by, table, text_batches, words_of
from .components import components

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9995, 6
#: Members of a block of a large bucket; members of small ones that share a task.
BLOCK = 512
#: Stands for a null doc_id, which is never the least of a class.
_NO_ID = (1 << 63) - 1
_SEED, _K1, _K2 = 20240607, 0x51ED270B, 0x2545F491


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of so many rows that a pair at the threshold meets in one with this probability."""
    if similarity >= 1:
        return 1
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(data: np.ndarray, off: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted set of word n-gram hashes of each row; a shorter text is one n-gram, one without words has none."""
    h, at, *_ = words_of(data, off)
    grams = gram_hashes(h, words)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield mix(gram_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def _set_hash(s: np.ndarray, salt: int) -> np.uint64:
    return mix(s ^ np.uint64(salt)).sum(dtype=np.uint64)


def _signatures(words: int, bands: int, rows: int):
    rng = np.random.default_rng(_SEED)
    flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    times = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in slices(pc.utf8_lower(batch.column(1))):
                sets = list(shingles(data, off, words))
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                k1 = np.array([_set_hash(s, _K1) for s in sets], dtype=np.uint64)
                k2 = np.array([_set_hash(s, _K2) for s in sets], dtype=np.uint64)
                out = np.zeros((len(sets), bands), dtype=np.uint64)
                if len(full):
                    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                    begin = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    for b in range(bands):
                        h = np.full(len(full), b + 1, dtype=np.uint64)
                        for r in range(b * rows, b * rows + rows):
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ flip[r]) * times[r], begin))
                        out[full, b] = h
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(size.astype(np.int32)), lists(signed(out.ravel()), np.full(len(sets), bands))], ["doc_id", "k1", "k2", "size", "bands"])

    return run


def _sets_of(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(has_bit(wanted.value, h)))
            for _, _, data, off in slices(pc.utf8_lower(batch.column("text"))):
                sets = list(shingles(data, off, words))
                k1 = np.array([_set_hash(s, _K1) for s in sets], dtype=np.uint64)
                k2 = np.array([_set_hash(s, _K2) for s in sets], dtype=np.uint64)
                flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(k1)), pa.array(signed(k2)), lists(signed(flat), np.array([len(s) for s in sets]))], ["k1", "k2", "set"])

    return run


def _with_keys(batch: pa.RecordBatch, words: int) -> pa.RecordBatch:
    """The batch with _k1 and _k2, null for a text without n-grams."""
    sets = [s for _, _, data, off in slices(pc.utf8_lower(batch.column("text"))) for s in shingles(data, off, words)]
    none = pa.array([not len(s) for s in sets], pa.bool_())
    for name, salt in (("_k1", _K1), ("_k2", _K2)):
        key = pa.array(signed(np.array([_set_hash(s, salt) for s in sets], dtype=np.uint64)))
        batch = batch.append_column(name, pc.if_else(none, pa.scalar(None, pa.int64()), key))
    return batch


def _linked(flat: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of the sets, given one after another, reach the similarity."""
    n = len(size)
    _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = df[inverse] > 1
    column = np.cumsum(df > 1)[inverse[shared]] - 1
    owner, width = owner[shared], int((df > 1).sum())
    common, step = np.zeros((n, n), dtype=np.float32), max(1, (4 << 20) // n)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    out = common >= similarity * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first_shared(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of members of a bucket of this band share none before it."""
    out = ~np.eye(len(bands), dtype=bool)
    for c in range(band):
        if not out.any():
            break
        out &= bands[:, c, None] != bands[None, :, c]
    return out


def _buckets(t: pa.Table, across: bool):
    """Of each bucket in a task with two members or more: rows in order of their node, and the pairs to look at."""
    hash_, d, k, block, number = (t[c].to_numpy() for c in ("hash", "d", "k", "block", "band"))
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(d), -1) if len(d) else np.empty((0, 1), dtype=np.int64)
    order = np.lexsort((k, d, hash_, number))
    edge = np.flatnonzero((np.diff(hash_[order]) != 0) | (np.diff(number[order]) != 0)) + 1
    for rows in np.split(order, edge):
        rows = rows[np.concatenate(([True], (d[rows][1:] != d[rows][:-1]) | (k[rows][1:] != k[rows][:-1])))]  # a repeated row comes once
        if len(rows) < 2:
            continue
        pairs = _first_shared(bands[rows], int(number[rows[0]]))
        if across:
            pairs &= block[rows][:, None] != block[rows][None, :]
        if pairs.any():
            yield rows, pairs


def _needed(key: tuple, t: pa.Table) -> pa.Table:
    """The members that have a pair to look at."""
    out = [rows[pairs.any(axis=1)] for rows, pairs in _buckets(t, key[1].as_py() != key[2].as_py())]
    return t.take(pa.array(np.concatenate([*out, np.empty(0, dtype=np.int64)]).astype(np.int64))).select(["band", "hash", "d", "k", "k2", "copies", "bands"])


def _verify(similarity: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        d, k, copies = (t[c].to_numpy() for c in ("d", "k", "copies"))
        sets = t["set"].combine_chunks()
        begin, values, out = sets.offsets.to_numpy(), sets.values.to_numpy(), []
        for rows, pairs in _buckets(t, key[1].as_py() != key[2].as_py()):
            size = begin[rows + 1] - begin[rows]
            linked = pairs & _linked(np.concatenate([values[begin[r] : begin[r + 1]] for r in rows]), size, similarity)
            some = np.flatnonzero(linked.any(axis=1))
            root = rows[_roots(linked)[some]]
            out.append((d[rows[some]], k[rows[some]], (linked @ copies[rows])[some], d[root], k[root]))
        return pa.table({n: pa.array((np.concatenate([x[c] for x in out]) if out else np.empty(0)).astype(np.int64)) for c, n in enumerate(("d", "k", "links", "rd", "rk"))})

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """members (band, hash, k, ...) with g, i, j, the task of each, and block: one row for each pair of blocks that a member is in."""
    sizes = materialize(members.groupBy("band", "hash").agg(F.count("*").alias("n")), "bucket-sizes")
    few = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / BLOCK))
    placed = members.join(sizes, ["band", "hash"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("d", "k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") > 1
    task = F.when(alone, F.xxhash64("band", "hash")).otherwise(F.pmod(F.xxhash64("hash"), F.lit(few)))
    return placed.select("*", task.alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("n", "blocks", "other")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, bits: int = 25) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs (doc_id long, text string).

    n_links: other rows whose set of word n-grams (lower case, words between ASCII white space) has at least this Jaccard
    similarity with the row's own; copies count. class_id: the least doc_id of those that links connect with the row.
    recall is the probability that a pair just at the threshold shares a band; more similar pairs are safer. A text of
    fewer words is one n-gram; a null or empty one links to nothing and is its own class. A repeated row counts as a
    copy. A null doc_id links like any other and is never the least. Other columns are left out.
    """
    keys, final = linked_classes(docs, words, similarity, recall, rows, bits)
    rest = keys.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return keys.filter("size > 0").join(final, ["k1", "k2"]).select("doc_id", "class_id", "n_links").unionByName(rest)


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, bits: int = 25) -> DataFrame:
    """docs with one row of each class of near_duplicates: the least by doc_id, a null one last, then by the other columns in order.

    It is decided for each row by its text's set, so repeated or missing doc_ids take no other text with them. Only rows that may
    have a link are shuffled, and they are combined by their sets before. Columns must be orderable; names _k1, _k2, _h are replaced.
    """
    keys, final = linked_classes(docs, words, similarity, recall, rows, bits)
    final = final.filter("n_links > 0")
    linked_ids = keys.join(final, ["k1", "k2"], "left_semi").select(F.xxhash64(F.coalesce("doc_id", F.lit(_NO_ID))).alias("h"))
    names = [c for c in docs.columns if c not in ("_k1", "_k2", "_h")]
    hashed = docs.select(*names, F.xxhash64(F.coalesce("doc_id", F.lit(_NO_ID))).alias("_h"))
    with_keys = hashed.selectExpr("*", "cast(null as long) as _k1", "cast(null as long) as _k2").schema
    keyed, clean = split_by(hashed, "_h", bitmap(linked_ids, "h", bits), edit=lambda batch: _with_keys(batch, words), edited=with_keys)
    # a set without links belongs to one row, so nothing but linked rows is combined here
    row = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_d"), *names)
    once = keyed.filter("_k1 is not null").groupBy("_k1", "_k2").agg(F.min(row).alias("row"))
    gone = final.filter("not first").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    once = once.join(gone, ["_k1", "_k2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])
    return once.unionByName(keyed.filter("_k1 is null").select(*names)).unionByName(clean.select(*names))


def linked_classes(docs: DataFrame, words: int, similarity: float, recall: float, rows: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, size and k1, k2, which name its set of n-grams; and of each set k1, k2, class_id, n_links, first: whether
    the class of links begins with it."""
    bands = bands_for(similarity, recall, rows)
    signed_ = materialize(docs.select("doc_id", "text").mapInArrow(_signatures(words, bands, rows), "doc_id long, k1 long, k2 long, size int, bands array<long>"), "signatures")
    filled = signed_.filter("size > 0")
    classes = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.col("k1").alias("k"), "k2", "copies", "bands"), "classes")
    met = classes.select("d", "k", F.posexplode("bands").alias("band", "hash"))
    several = met.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("band", "hash")
    members = met.join(several, ["band", "hash"]).groupBy("d", "k").agg(F.collect_list(F.struct("band", "hash")).alias("at"))  # at most one for each band
    members = materialize(members.join(classes, ["d", "k"]).select("d", "k", "k2", "copies", "bands", F.inline("at")), "bucket-members")
    schema = "band int, hash long, d long, k long, k2 long, copies long, bands array<long>"
    needed = materialize(_dealt(members).groupBy("g", "i", "j").applyInArrow(_needed, schema).dropDuplicates(["band", "hash", "d", "k"]), "bucket-pairs")
    wanted = bitmap(needed.select(F.xxhash64("d").alias("h")), "h", bits)
    sets = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(_NO_ID))).alias("h"), "text").mapInArrow(_sets_of(words, wanted), "k long, k2 long, set array<long>").dropDuplicates(["k", "k2"])
    placed = _dealt(needed).join(sets, ["k", "k2"])
    links = materialize(placed.groupBy("g", "i", "j").applyInArrow(_verify(similarity), "d long, k long, links long, rd long, rk long"), "links")
    wanted.destroy()  # no later plan reads it
    node = lambda a, b: F.struct(F.col(a).alias("d"), F.col(b).alias("k"))  # noqa: E731  ordered as the ids are
    roots = components(links.select(node("d", "k").alias("a"), node("rd", "rk").alias("b"))).select("node.d", "node.k", F.col("root.d").alias("rd"), F.col("root.k").alias("rk"))
    counted = links.groupBy("d", "k").agg(F.sum("links").alias("links"))
    final = classes.select("d", "k", "k2", "copies").join(counted, ["d", "k"], "left").join(roots, ["d", "k"], "left")
    first, links_ = F.coalesce("rd", "d"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    out = final.select(F.col("k").alias("k1"), "k2", F.when(first != _NO_ID, first).alias("class_id"), links_.alias("n_links"), F.coalesce((F.col("rd") == F.col("d")) & (F.col("rk") == F.col("k")), F.lit(True)).alias("first"))
    return signed_.select("doc_id", "k1", "k2", "size"), materialize(out, "linked")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
