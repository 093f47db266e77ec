"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become pieces of at most the capacity; full pieces are sequences by themselves. The rest is dealt into shards of
bounded size, and each shard is evolved on several islands. A crossover injects whole well-filled sequences of one
parent into the other, drops the sequences that now hold a piece twice, and best-fits the displaced pieces. After each
round an island's elite moves to the next island. Sequences that stay ill filled are opened and packed again together.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_batches
from .tokens import words_for

CAPACITY, END = 4096, 1
#: Pieces of a shard, islands, rounds between which elites migrate, generations of a round, solutions of an island.
SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4000, 2, 2, 24, 6
#: A sequence filled less than this is opened and packed again.
WELL_FILLED = 0.99


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """pid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids: the pieces of each text.

    A text's ids are the tokenizer's, without special tokens, then end. A null text counts as empty, so it has one piece
    of one id. Repeated rows are pieces of their own; pid numbers the pieces and differs between runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(path)
        pid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 500):
                rows = []
                for doc, found in zip(ids[lo : lo + 500], words.ids([t or "" for t in texts.slice(lo, 500).to_pylist()]), strict=True):
                    found = np.append(found, np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(found), capacity)):
                        part = found[at : at + capacity]
                        rows.append((pid, doc, k, at, len(part), zlib.crc32(part), *([part.tolist()] if with_ids else [])))
                        pid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=False)], names)

    schema = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- one island


def best_fit(items: list[int], length: list[int], bins: list[list[int]], capacity: int) -> None:
    """Put each item, longest first, into the fullest sequence that has room, or a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, inside in enumerate(bins):
        r = capacity - sum(length[i] for i in inside)
        room[r].append(b)
        mask |= 1 << r
    for i in sorted(items, key=lambda i: -length[i]):
        n = length[i]
        left = mask >> n
        if left:
            r = n + (left & -left).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        mask |= 1 << (r - n)


def exchange(displaced: list[int], length: list[int], bins: list[list[int]], capacity: int) -> list[int]:
    """Swap an item of a sequence for the longest displaced one that fits in its place; returns what is displaced after."""
    displaced = sorted(displaced, key=lambda i: length[i])
    sizes = [length[i] for i in displaced]
    for inside in bins:
        room = capacity - sum(length[i] for i in inside)
        for k, i in enumerate(inside):
            at = bisect_right(sizes, length[i] + room) - 1
            if at < 0 or sizes[at] <= length[i]:
                continue
            room -= sizes[at] - length[i]
            inside[k] = displaced.pop(at)
            sizes.pop(at)
            back = bisect_right(sizes, length[i])
            displaced.insert(back, i)
            sizes.insert(back, length[i])
            if not room:
                break
    return displaced


def crossover(one: list[list[int]], other: list[list[int]], length: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """one, with half of the well-filled sequences of other injected whole.

    Sequences that then hold a piece twice go, and so does a tenth of the others, the worst filled ones; their pieces take the places of
    shorter ones where they fill a sequence better, and what is displaced in the end is packed by best fit.
    """
    fill = lambda b: sum(length[i] for i in b)
    order = sorted(other, key=fill, reverse=True)
    good = [b for b in order if fill(b) >= WELL_FILLED * capacity] or order[: max(1, len(order) // 2)]
    injected = rng.sample(good, max(1, len(good) // 2))
    inside = {i for b in injected for i in b}
    whole, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            whole.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    whole.sort(key=lambda b: fill(b) + rng.random(), reverse=True)
    while whole and len(whole) > 0.9 * (len(one) - len(injected)):
        displaced += whole.pop()
    child = [list(b) for b in injected] + whole
    best_fit(exchange(displaced, length, child, capacity), length, child, capacity)
    return child


def fitness(bins: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first; of as many, those whose free places lie together."""
    return len(bins), -sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins)


def _turns(length: list[int], rng: random.Random) -> list[list[int]]:
    """The items in random parts, to be packed one after another."""
    order = rng.sample(range(len(length)), len(length))
    step = max(1, len(order) // rng.choice((2, 4, 8, 16)))
    return [order[k : k + step] for k in range(0, len(order), step)]


def evolve(length: list[int], capacity: int, seeds: list[list[list[int]]], generations: int, population: int, rng: random.Random) -> list[list[int]]:
    least = -(-sum(length) // capacity)
    people = list(seeds)
    while len(people) < population:
        if any(len(p) == least for p in people):
            break
        bins: list[list[int]] = []
        for part in _turns(length, rng) if people else [list(range(len(length)))]:  # best fit alone first, then perturbed orders
            best_fit(part, length, bins, capacity)
        people.append(bins)
    people.sort(key=lambda p: fitness(p, length, capacity))
    for _ in range(generations):
        if len(people[0]) == least or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        people.append(crossover(a, b, length, capacity, rng))
        people.sort(key=lambda p: fitness(p, length, capacity))
        people.pop()
    return people[0]


def _island(capacity: int, generations: int, population: int, turn: int):
    def bins_of(label: np.ndarray) -> list[list[int]]:
        order = np.argsort(label, kind="stable")
        return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(label[order])) + 1)]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pid")
        pid, length = t["pid"].to_numpy(), t["length"].to_pylist()
        seeds = [bins_of(t[c].to_numpy()) for c in ("bin", "elite") if t[c].null_count == 0]
        rng = random.Random(f"{key[0].as_py()} {key[1].as_py()} {turn}")
        bins = evolve(length, capacity, seeds, generations, population, rng)
        label = np.empty(len(pid), dtype=np.int64)
        for b in bins:
            label[b] = pid[min(b)]
        return pa.table({"shard": t["shard"], "island": t["island"], "pid": t["pid"], "length": t["length"], "bin": pa.array(label)})

    return run


# ---------------------------------------------------------------- all pieces


def _pack_once(parts: DataFrame, n: int, capacity: int) -> DataFrame:
    """pid, length, bin for one deal into shards."""
    shards = -(-n // SHARD)
    none = F.lit(None).cast("long")
    state = parts.select(F.pmod(F.xxhash64("pid"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "pid", "length", none.alias("bin"), none.alias("elite"))
    for turn in range(ROUNDS):
        state = materialize(state.groupBy("shard", "island").applyInArrow(_island(capacity, GENERATIONS, POPULATION, turn), "shard long, island int, pid long, length long, bin long"), "islands")
        if turn < ROUNDS - 1:
            moved = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "pid", F.col("bin").alias("elite"))
            state = state.join(moved, ["shard", "island", "pid"])
    best = state.groupBy("shard", "island").agg(F.count_distinct("bin").alias("n")).groupBy("shard").agg(F.min(F.struct("n", "island")).alias("best")).select("shard", F.col("best.island").alias("island"))
    return state.join(best, ["shard", "island"]).select("pid", "length", "bin")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (pid long, unique, length long from 1 to capacity) -> pid, sequence_id.

    Needs no order and no size of the whole: shards of SHARD pieces are packed apart, then what fills badly is dealt
    again, until it fits into one shard. Where the lengths allow of no good fill, the better half stays each time.
    """
    done = parts.filter(F.col("length") >= capacity).select("pid", F.col("pid").alias("sequence_id"))
    rest = parts.filter(F.col("length") < capacity).select("pid", "length")
    n = rest.count()
    while n:
        packed = materialize(_pack_once(rest, n, capacity), "packed")
        if n <= SHARD:
            return done.unionByName(packed.select("pid", F.col("bin").alias("sequence_id")))
        ill = packed.groupBy("bin").agg(F.sum("length").alias("fill")).filter(F.col("fill") < WELL_FILLED * capacity).select("bin")
        done = done.unionByName(packed.join(ill, "bin", "left_anti").select("pid", F.col("bin").alias("sequence_id")))
        rest = materialize(packed.join(ill, "bin", "left_semi").select("pid", "length"), "ill-filled")
        before, n = n, rest.count()
        if n > before // 2:  # most cannot be filled well: only the worse half is opened again
            fills = packed.join(ill, "bin", "left_semi").groupBy("bin").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
            middle = fills.agg(F.percentile_approx("fill", 0.5, F.lit(1000))).first()[0]
            worse = materialize(fills.filter(F.col("fill") < middle).select("bin"), "worse")
            done = done.unionByName(packed.join(ill, "bin", "left_semi").join(worse, "bin", "left_anti").select("pid", F.col("bin").alias("sequence_id")))
            rest = materialize(packed.join(worse, "bin", "left_semi").select("pid", "length"), "ill-filled")
            n = rest.count()
    return done


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each text of docs lies."""
    parts = materialize(token_pieces(docs, path or tokenizer_path(), capacity, end), "pieces")
    placed = parts.join(pack(parts, capacity), "pid")
    before = Window.partitionBy("sequence_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"))
