"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes. Codes are cut into substrings and each substring
is indexed. Of a code within the search radius some substring differs from the query's in so few bits (the pigeonhole
principle) that probing all values that near retrieves every code within the radius; those are ranked by their inner products.
Rows are dealt into shards of bounded size; queries travel to the shards, each of which builds its index once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, table

#: Rows that the rotations are learned on; bits of a code, which has a substring for each 16.
SAMPLE, BITS = 4000, 128
#: Share of the sample's true neighbours that lies within the search radius.
RECALL = 0.95
#: Rows of a shard, which a task holds: 13 MB of vectors of 64 floats.
SHARD = 50_000
NEIGHBOURS = 20
_ROUNDS = 30


@dataclass
class Codes:
    """Centre, rotations (dimensions by bits) and the radius within which neighbours are looked for."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One row of substrings of 16 bits for each vector."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1).view(np.uint16)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part: not null, not zero, all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def learn_codes(sample: np.ndarray, bits: int = BITS, recall: float = RECALL, neighbours: int = NEIGHBOURS) -> Codes:
    """Rotations by alternating sign codes and orthogonal fits; the radius from the sample's own nearest neighbours.

    A sample that is a share of all rows holds that share of a row's neighbours, so as many fewer of the nearest are looked at;
    at least one, which errs to the safe side.
    """
    centre = sample.mean(axis=0)
    x, d, rng = sample - centre, sample.shape[1], np.random.default_rng(7)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(_ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        parts.append(r)
    codes = Codes(centre, np.hstack(parts)[:, :bits], bits)
    c, far = codes.encode(sample), []
    for i in range(0, len(sample), max(1, len(sample) // 200)):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score)[:neighbours]
        far.append(np.bitwise_count(c[near] ^ c[i]).sum(axis=1, dtype=np.int64))
    codes.radius = int(np.quantile(np.concatenate(far), recall)) if len(sample) > 1 else bits
    return codes


@lru_cache(8)
def _ball(radius: int) -> np.ndarray:
    """All 16-bit masks of at most radius bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


Index = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def indexed(codes: np.ndarray) -> Index:
    """For each substring: rows in the order of its values, the values there are, and where each begins."""
    out = []
    for c in codes.T:
        order = np.argsort(c, kind="stable")
        values, begin = np.unique(c[order], return_index=True)
        out.append((order, values, np.append(begin, len(c))))
    return out


def probed(query: np.ndarray, index: Index, rows: int, radius: int) -> np.ndarray:
    """Rows that some substring's probes retrieve, each once.

    With m substrings and radius a * m + b, a code in the radius is within a bits in one of the first b + 1 substrings or within
    a - 1 in one of the others. Of the values that near, those that exist are looked up.
    """
    hit = np.zeros(rows, dtype=bool)
    near, first_ones = divmod(radius, len(query))
    for j, ((order, values, begin), value) in enumerate(zip(index, query, strict=True)):
        r = near if j <= first_ones else near - 1
        if r < 0:
            continue
        ball = _ball(min(r, 16))
        if len(ball) < len(values):
            wanted = ball ^ value
            spot = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            spot = spot[values[spot] == wanted]
        else:
            spot = np.flatnonzero(np.bitwise_count(values ^ value) <= r)
        first, n = begin[spot], begin[spot + 1] - begin[spot]
        stop = np.cumsum(n)
        hit[order[np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]] = True
    return np.flatnonzero(hit)


def probe(codes: np.ndarray, query: np.ndarray, index: Index, radius: int) -> np.ndarray:
    """Rows of the index within the radius of one query, each once."""
    rows = probed(query, index, len(codes), radius)
    return rows[np.bitwise_count(codes[rows] ^ query).sum(axis=1, dtype=np.int64) <= radius]


class _Shard:
    """The rows of a shard, gathered from batches, and their index, built when the first query comes."""

    def __init__(self, number: int):
        self.number, self.parts, self.index = number, [], None

    def answer(self, model: Codes, radius: int, k: int, q: np.ndarray, qv: np.ndarray) -> list[tuple]:
        if not self.parts:
            return []
        if self.index is None:
            self.ids, self.x = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.codes = model.encode(self.x)
            self.index = indexed(self.codes)
        out = []
        for query, vector, asked in zip(q, qv, model.encode(qv), strict=True):
            rows = probe(self.codes, asked, self.index, radius)
            rows = rows[self.ids[rows] != query]
            score = self.x[rows] @ vector
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(best), query), self.ids[rows][best], score[best]))
        return out


def _answers(model: Codes, radius: int, k: int):
    """Batches in order of shard, its rows before its queries, to query_id, vec_id, score: the k best of the shard within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            s, side, ids = (batch.column(c).to_numpy() for c in ("s", "side", "id"))
            x = np.array(batch.column("v").flatten(), dtype=np.float64).reshape(len(ids), -1) if len(ids) else None
            edges = np.concatenate(([0], np.flatnonzero((np.diff(s) != 0) | (np.diff(side) != 0)) + 1, [len(s)]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if shard is None or shard.number != s[lo]:
                    shard = _Shard(s[lo])
                if side[lo] == 0:
                    shard.parts.append((ids[lo:hi], x[lo:hi]))
                    continue
                for at in range(lo, hi, 500):
                    found = shard.answer(model, radius, k, ids[at : min(hi, at + 500)], x[at : min(hi, at + 500)])
                    a, b, c = (np.concatenate([*[f[i] for f in found], np.empty(0)]) for i in range(3))
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c)})

    return run


def _within(rows: DataFrame, queries: DataFrame, shards: int, model: Codes, radius: int, k: int) -> DataFrame:
    """Of each query the k best rows within the radius, and n of them."""
    rows = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("long").alias("s"), F.lit(0).alias("side"), "id", "v")
    # the query set against all rows, in shards
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.lit(1).alias("side"), "id", "v")
    dealt = rows.unionByName(asked).repartition("s").sortWithinPartitions("s", "side")
    found = dealt.mapInArrow(_answers(model, radius, k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.withColumn("n", F.count("*").over(w))


def search(rows: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query, the k rows found with the largest inner product, itself excepted.

    Both sides: id_column long, vector array of numbers. Vectors that are null, empty, zero, or hold a null or non-finite
    component take no part, nor do those of another length than most of the sample, nor rows with a null id. Ties go to the
    smaller id; of repeated ids the one with the larger score counts. Other columns are left out.
    """
    types = {dict(df.dtypes)[vector] for df in (rows, queries)}
    kind = "array<float>" if types == {"array<float>"} else "array<double>"
    clean = lambda df: usable(df.filter(F.col(id_column).isNotNull()), vector).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    rows, queries = clean(rows), clean(queries)
    none = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = bounded_sample(rows, F.xxhash64("id"), sample).toArrow()
    if not picked.num_rows:
        return none
    vectors = picked["v"].to_pylist()
    width = max(set(map(len, vectors)), key=lambda d: (sum(len(v) == d for v in vectors), d))
    rows, queries = rows.filter(F.size("v") == width), queries.filter(F.size("v") == width)
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    vectors = np.array([v for v in vectors if len(v) == width])
    model = learn_codes(vectors, bits, neighbours=math.ceil(k * len(vectors) / n))
    shards, radius, out = max(1, math.ceil(n / SHARD)), model.radius, none
    while True:
        found = materialize(_within(rows, queries, shards, model, radius, k), "neighbours")
        enough = found if radius >= bits else found.filter(F.col("n") >= min(k, ids - 1))
        out = out.unionByName(enough.select("query_id", "rank", "vec_id", "score"))
        if radius >= bits:
            return out
        # queries with too few in the radius are asked again with a wider one
        queries = queries.join(enough.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
        if queries.isEmpty():
            return out
        radius = min(bits, radius + bits // 8)


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
