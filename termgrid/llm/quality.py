"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge loss by dual coordinate descent.

The n-grams are of words (1 and 2) and of word shapes (1 to 3): case, digits, final sign, length, and whether a word
repeats one of the two before it. They are hashed to a fixed number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, gram_hashes, held_out, lists, materialize, mix, pieces, slices, span_hashes, table, text_batches

#: log2 of the number of features; labelled rows, and distinct features of all of them, that a fit takes at most: 16 MB in the
#: driver, and as much again for their values; score from which a row is of quality 1.
FEATURE_BITS, FIT_ROWS, FIT_FEATURES, ACCEPT = 18, 4000, 4_000_000, 0.7
_COST, _EPOCHS, _SMOOTH = 1.0, 8, 1.0


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each row, one after another, and their numbers."""
    starts, ends, row = pieces(data, off)
    n = len(off) - 1
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.zeros(n, dtype=np.int64)
    h = span_hashes(data, starts, ends)
    count = lambda lo, hi: np.add.reduceat(((data >= lo) & (data <= hi)).astype(np.int32), starts)  # noqa: E731  white space is in no range
    upper, lower, digit, wide = count(65, 90), count(97, 122), count(48, 57), count(128, 255)
    size, last = ends - starts, data[ends - 1]
    sign = np.where((last < 128) & ~((last >= 97) & (last <= 122)) & ~((last >= 65) & (last <= 90)) & ~((last >= 48) & (last <= 57)), last, 0)
    again = np.zeros(len(h), dtype=np.int64)
    again[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[2:] |= ((h[2:] == h[:-2]) & (row[2:] == row[:-2])).astype(np.int64) << 1
    flags = (upper > 0) + 2 * ((upper > 1) & (lower == 0)) + 4 * (digit > 0) + 8 * (digit == size) + 16 * (upper + lower + digit + wide == 0)
    shape = mix((flags | again << 5 | np.minimum(size, 12).astype(np.int64) << 8 | sign.astype(np.int64) << 16).astype(np.uint64))
    coarse = mix((flags | again << 5 | sign.astype(np.int64) << 16).astype(np.uint64) + np.uint64(1 << 40))
    found, salt = [], 0
    for units, longest in ((h, 2), (shape, 1), (coarse, 3)):
        for k in range(1, longest + 1):
            salt += 1
            g = gram_hashes(units, k) if k > 1 else units
            ok = row[: len(g)] == row[k - 1 :]
            f = mix(g[ok] + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - bits)
            found.append((row[: len(g)][ok].astype(np.uint64) << np.uint64(bits)) | f)
    keys = np.unique(np.concatenate(found))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=n)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int, size: int) -> np.ndarray:
    """Weights, the bias last, of an L2 support vector machine with hinge loss. Rows are scaled to length 1."""
    rng = np.random.default_rng(0)
    x = [scale[r].astype(np.float32) for r in rows]
    x = [v / max(np.sqrt(v @ v), 1e-12) for v in x]
    w, a, q = np.zeros(size + 1), np.zeros(len(rows)), np.array([v @ v + 1 for v in x])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + w[-1]) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost)
            if new != a[i]:
                w[rows[i]] += (new - a[i]) * y[i] * x[i]
                w[-1] += (new - a[i]) * y[i]
                a[i] = new
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve of the margin, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p)
        hess = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, [((p - t) * margin).sum(), (p - t).sum()])
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


@dataclass
class QualityModel:
    """gain: log-count ratio times weight by feature; square: the ratio's square; then bias, slope and shift."""

    bits: int
    gain: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, n = features(data, off, self.bits)
        stop = np.cumsum(n)
        add = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v[f], dtype=np.float64)))[np.concatenate(([0], stop))])
        margin = add(self.gain) / np.sqrt(np.maximum(add(self.square), 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def learn(rows: list[np.ndarray], y: np.ndarray, bits: int = FEATURE_BITS) -> QualityModel:
    """y: 1 or -1. With one class only, or none, every score is that class's smoothed share."""
    size = 1 << bits
    if not (y > 0).any() or not (y < 0).any():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return QualityModel(bits, np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))

    def fit(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = [np.full(size, _SMOOTH), np.full(size, _SMOOTH)]
        for i in chosen:
            count[int(y[i] > 0)][rows[i]] += 1
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        return ratio, dual_coordinate_descent([rows[i] for i in chosen], ratio, y[chosen], _COST, _EPOCHS, size)

    def margins(ratio: np.ndarray, w: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.array([ratio[rows[i]] @ w[rows[i]] / max(np.sqrt(ratio[rows[i]] @ ratio[rows[i]]), 1e-6) + w[-1] for i in chosen])

    fold = np.arange(len(y)) % 5 == 0  # a fifth shows how margins of unseen rows fall
    part = np.flatnonzero(~fold)
    apart = fold.any() and (y[part] > 0).any() and (y[part] < 0).any()
    ratio, w = fit(part) if apart else fit(np.arange(len(y)))
    tried = np.flatnonzero(fold) if apart else np.arange(len(y))
    slope, shift = platt(margins(ratio, w, tried), y[tried])
    ratio, w = fit(np.arange(len(y)))
    return QualityModel(bits, ratio * w[:-1], ratio * ratio, float(w[-1]), slope, shift)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, bits: int = FEATURE_BITS, fit_features: int = FIT_FEATURES) -> QualityModel:
    """A model from at most fit_rows labelled rows, the first by a hash of doc_id; none of them is held out.

    Of those the first count that have fit_features features together. Whole texts are read. Rows without an id, a label or a
    document do not count; of an id's labels the mean decides, a tie for 1; of repeated rows of an id one counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    sample = bounded_sample(known, F.xxhash64("doc_id"), fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column("text")):
                f, n = features(data, off, bits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("good").slice(lo, hi - lo), lists(f.astype(np.int32), n)], ["doc_id", "good", "f"])

    # at most fit_rows rows of two small columns are broadcast
    listed = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id long, good boolean, f array<int>")
    listed = materialize(listed.withColumn("at", F.xxhash64("doc_id")), "quality-features")
    sizes = listed.select("at", F.size("f").alias("n")).toArrow().sort_by("at")
    most = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), fit_features, side="right"))
    if most < sizes.num_rows:
        listed = listed.filter(F.col("at") < sizes["at"][most].as_py())
    got = listed.select("doc_id", "good", "f").toArrow().sort_by("doc_id")
    rows = [part for chunk in got["f"].chunks for part in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])] if got.num_rows else []
    return learn(rows, np.where(got["good"].to_numpy().astype(bool), 1.0, -1.0) if got.num_rows else np.empty(0), bits)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with quality_score (0 to 1) added, in place of a column of that name; every row and whole text.

    A null text is scored as an empty one, each repeated row as the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("quality_score").withColumn("quality_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(data, off) for _, _, data, off in slices(batch.column("text"))]
            yield batch.append_column("quality_score", pa.array(np.concatenate([*scores, np.empty(0)])))

    return docs.drop("quality_score").mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
