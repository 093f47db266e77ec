"""Mixtures of normals and k-means fitted by Spark: one step of all fits of all series is one aggregate over the rows.

A step reads the rows where they lie, adds up each fit's weights, weighted sums and products there, and combines them by one shuffle of
small rows. Only the parameters of the fits, about a kilobyte each, pass through the driver; no task holds a long series. Series that
are no longer than a block are fitted by the same steps within tasks, in one job for all fits in place of one a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import covariances_of, kmeans, log_density

#: Rows of a series that starting centres are drawn from, the first by a hash of the row; all rows are fitted.
START_ROWS = 2_000
#: Series that one call takes, and fits whose parameters travel at a time; more fits are done in turns.
SERIES, AT_ONCE = 50_000, 20_000
#: Least gain of the log-likelihood for each row that continues a fit, and what is added to variances.
GAIN, FLOOR, ROUNDS = 1e-4, 1e-5, 100
#: Rows of a series whose fits are made within tasks, at most; as many as a block of time has.
WHOLE_ROWS = 100_000
#: A row and all others meet in pairs of blocks of this size.
PAIRS = 2_048


@dataclass
class Fit:
    """One fit of one series. kind: full, tied, diag, spherical, or kmeans, whose loglik is less its inertia."""

    series: str
    k: int
    kind: str
    start: int
    centres: np.ndarray  # of the start, then of the fit
    weights: np.ndarray | None = None
    covs: np.ndarray | None = None
    loglik: float = -np.inf
    n: int = 0
    live: bool = field(default=True, repr=False)

    @property
    def means(self) -> np.ndarray:
        return self.centres

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Of each row and component the log of its weight and density; of k-means, or before the first step, less the squared distance."""
        if self.covs is None:
            return -((x[:, None] - self.centres[None]) ** 2).sum(axis=2)
        return log_density(x, self.centres, self.covs) + np.log(self.weights)

    def share(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each row's shares in the components, and the sum of the log-likelihoods."""
        joint = self.joint(x)
        top = joint.max(axis=1, keepdims=True)
        if self.covs is None:
            return np.eye(self.k)[joint.argmax(axis=1)], float(top.sum())
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        return np.exp(joint - total[:, None]), float(total.sum())

    def update(self, sums: np.ndarray) -> None:
        """The parameters that the sums of a step give."""
        d = self.centres.shape[1]
        n, first = sums[: self.k], sums[self.k : self.k * (d + 1)].reshape(self.k, d)
        if self.kind == "kmeans":
            self.centres = np.where(n[:, None] > 0, first / np.maximum(n, 1e-300)[:, None], self.centres)
            return
        second, n = sums[self.k * (d + 1) :].reshape(self.k, d, d), n + 1e-12
        self.weights, self.centres = n / self.n, first / n[:, None]
        self.covs = covariances_of(second / n[:, None, None] - self.centres[:, :, None] * self.centres[:, None, :], n, self.kind, FLOOR)

    def advance(self, sums: np.ndarray) -> None:
        """Take the sums of a step; live tells whether another one follows."""
        self.live, self.loglik = bool(sums[0] - self.loglik >= GAIN * self.n), float(sums[0])
        if self.live:
            self.update(sums[1:])


def _sums(x: np.ndarray, fit: Fit) -> np.ndarray:
    """loglik, then of each component the shares, the weighted rows and, but for k-means, their products."""
    r, loglik = fit.share(x)
    parts = [[loglik], r.sum(axis=0), (r.T @ x).ravel()]
    if fit.kind != "kmeans":
        parts.append(((r.T[:, None] * x.T[None]) @ x).ravel())
    return np.concatenate(parts)


def _step(z: DataFrame, series: str, columns: tuple[str, ...], fits: list[Fit]) -> dict[int, np.ndarray]:
    """The sums of each fit over its series' rows."""
    of: dict[str, list[int]] = {}
    for i, f in enumerate(fits):
        of.setdefault(f.series, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for name, x, _ in by_series(batches, columns):
            for i in of.get(name, ()):
                s = _sums(x, fits[i])
                total[i] = total[i] + s if i in total else s
        for i, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int32()), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["fit", "at", "v"])

    made = z.select(F.col(series).alias("_series"), *columns).mapInArrow(run, "fit int, at int, v double").groupBy("fit", "at").agg(F.sum("v").alias("v")).toArrow()
    fit, at, v = (made[c].to_numpy() for c in ("fit", "at", "v"))
    order = np.lexsort((at, fit))
    edge = np.flatnonzero(np.diff(fit[order])) + 1
    return {int(fit[part[0]]): v[part] for part in np.split(order, edge) if len(part)}


def _whole(z: DataFrame, series: str, columns: tuple[str, ...], fits: list[Fit], rounds: int) -> None:
    """Run the fits to their ends in one job. A task holds the rows of one series, of at most WHOLE_ROWS, for some of its fits."""
    spark, of, d = z.sparkSession, {}, len(columns)
    for i, f in enumerate(fits):
        of.setdefault(f.series, []).append(i)
    parts = min(max(map(len, of.values())), -(-2 * spark.sparkContext.defaultParallelism // len(of)))
    dealt = spark.createDataFrame([(s, p) for s in of for p in range(parts)], "_series string, _part int")
    rows = z.select(F.col(series).alias("_series"), *columns).join(F.broadcast(dealt), "_series").repartition(2 * len(of) * parts if parts > 1 else len(of), "_series", "_part")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, out = np.column_stack([t[c].to_numpy() for c in columns]), []
        x = x[np.lexsort(x.T)]  # whatever order the shuffle gave
        for i in of[key[0].as_py()][key[1].as_py() :: parts]:
            f = fits[i]
            f.update(_sums(x, f)[1:])
            for _ in range(rounds):
                f.advance(_sums(x, f))
                if not f.live:
                    break
            mine = [f.centres] if f.covs is None else [f.centres, f.weights, f.covs]
            out.append((i, f.loglik, np.concatenate([v.ravel() for v in mine]).tolist()))
        kinds = (("fit", pa.int32()), ("loglik", pa.float64()), ("v", pa.list_(pa.float64())))
        return pa.table({c: pa.array([r[j] for r in out], type=t) for j, (c, t) in enumerate(kinds)})

    for r in rows.groupBy("_series", "_part").applyInArrow(run, "fit int, loglik double, v array<double>").collect():
        f, v = fits[r["fit"]], np.array(r["v"])
        m = f.k * d
        f.live, f.loglik, f.centres = False, r["loglik"], v[:m].reshape(f.k, d)
        if len(v) > m:
            f.weights, f.covs = v[m : m + f.k], v[m + f.k :].reshape(f.k, d, d)


def by_series(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(series, matrix of the columns, the rows' places in the batch) for each series of each batch."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        number = names.indices.to_numpy(zero_copy_only=False)
        x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns])
        for k, name in enumerate(names.dictionary.to_pylist()):
            at = np.flatnonzero(number == k)
            yield name, x[at], at


def _starts(z: DataFrame, series: str, columns: tuple[str, ...], specs: list[tuple[int, str, int]], seed: int) -> dict[tuple, np.ndarray]:
    """(series, k, start) -> centres of a k-means++ clustering of the sampled rows of a series."""
    wanted = sorted({(k, start) for k, _, start in specs})
    by_hash = Window.partitionBy(series).orderBy(F.xxhash64(*columns))
    sample = z.select(F.col(series).alias("_series"), *columns, F.row_number().over(by_hash).alias("_r")).filter(F.col("_r") <= START_ROWS).drop("_r")

    def run(table: pa.Table) -> pa.Table:
        x, rows = np.column_stack([table[c].to_numpy() for c in columns]), []
        x = x[np.lexsort(x.T)]
        for k, start in wanted:
            label = kmeans(x, k, np.random.default_rng([seed, start]))
            centres = np.stack([x[label == j].mean(axis=0) if (label == j).any() else x[j % len(x)] for j in range(k)])
            rows.append((table["_series"][0].as_py(), k, start, centres.ravel().tolist()))
        return pa.table({c: pa.array([r[i] for r in rows], type=t) for i, (c, t) in enumerate((("s", pa.string()), ("k", pa.int32()), ("start", pa.int32()), ("c", pa.list_(pa.float64()))))})

    made = sample.groupBy("_series").applyInArrow(run, "s string, k int, start int, c array<double>").collect()
    return {(r["s"], r["k"], r["start"]): np.array(r["c"]).reshape(r["k"], len(columns)) for r in made}


def fit_all(z: DataFrame, series: str, columns: tuple[str, ...], specs: list[tuple[int, str, int]], seed: int = 0, centres: dict[tuple, np.ndarray] | None = None, rounds: int = ROUNDS) -> list[Fit]:
    """A fit for each series of z and each (k, kind, start) of specs, from the centres of its start or from given ones.

    z: rows without nulls, read once for each round of the series longer than WHOLE_ROWS, so a stored table. The first step deals each row to its nearest
    centre; a fit ends once the log-likelihood gains less than GAIN for each row. More than SERIES series are refused.
    """
    sizes = dict(z.groupBy(series).count().limit(SERIES + 1).collect())
    if len(sizes) > SERIES:
        raise ValueError(f"more than {SERIES} series at once; fit them in parts")
    centres = centres or _starts(z, series, columns, specs, seed)
    names, out = sorted(sizes), []
    turn = max(1, AT_ONCE // len(specs))
    for lo in range(0, len(names), turn):
        part = names[lo : lo + turn]
        rows = z if len(part) == len(names) else z.filter(F.col(series).isin(part))
        fits = [Fit(s, k, kind, start, centres[s, k, start], n=sizes[s]) for s in part for k, kind, start in specs]
        if short := [f for f in fits if f.n <= WHOLE_ROWS]:
            _whole(rows, series, columns, short, rounds)
        long = [f for f in fits if f.n > WHOLE_ROWS]
        sums = _step(rows, series, columns, long) if long else {}
        for i, f in enumerate(long):
            f.update(sums[i][1:])
        for _ in range(rounds):
            live = [f for f in long if f.live]
            if not live:
                break
            sums = _step(rows, series, columns, live)
            for i, f in enumerate(live):
                f.advance(sums[i])
        out += fits
    return out


def best_fits(fits: list[Fit]) -> dict[tuple[str, int, str], Fit]:
    """(series, k, kind) -> the start with the largest log-likelihood, the first of equal ones."""
    best: dict[tuple, Fit] = {}
    for f in fits:
        key = (f.series, f.k, f.kind)
        if key not in best or f.loglik > best[key].loglik:
            best[key] = f
    return best


def in_order(fit: Fit, column: int) -> Fit:
    """fit with its components numbered by the rising centre of one column."""
    order = np.argsort(fit.centres[:, column], kind="stable")
    return Fit(fit.series, fit.k, fit.kind, fit.start, fit.centres[order], None if fit.weights is None else fit.weights[order], None if fit.covs is None else fit.covs[order], fit.loglik, fit.n, False)


def assign_all(z: DataFrame, series: str, columns: tuple[str, ...], fits: dict[str, list[Fit]], posterior: bool = False) -> DataFrame:
    """z with l0, l1, ...: the component of each of its series' fits that a row most likely is of; with posterior, of the first
    fit also top, the largest posterior, and p0, p1, ... of its components. Rows stay where they are."""
    several = max((len(f) for f in fits.values()), default=1)
    k = max((f[0].k for f in fits.values()), default=0) if posterior else 0
    extra = [*[f"l{i}" for i in range(several)], *(["top", *[f"p{j}" for j in range(k)]] if posterior else [])]
    names = z.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in z.schema], *[f"{c} {'int' if c[0] == 'l' else 'double'}" for c in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keyed = pa.RecordBatch.from_arrays([batch.column(names.index(series)), *[batch.column(names.index(c)) for c in columns]], ["_series", *columns])
            made = {c: np.full(batch.num_rows, np.nan) for c in extra}
            for name, x, at in by_series([keyed], columns):
                for i, f in enumerate(fits.get(name, ())):
                    made[f"l{i}"][at] = f.joint(x).argmax(axis=1)
                if posterior and name in fits:
                    r, _ = fits[name][0].share(x)
                    made["top"][at] = r.max(axis=1)
                    for j in range(r.shape[1]):
                        made[f"p{j}"][at] = r[:, j]
            columns_ = [pa.array(v, type=pa.int32() if c[0] == "l" else pa.float64(), from_pandas=True, safe=False) for c, v in made.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns_], [*names, *extra])

    return z.mapInArrow(run, schema)


def silhouettes(labelled: DataFrame, series: str, columns: tuple[str, ...], labels: list[str], block: int = PAIRS) -> DataFrame:
    """series, labelling, silhouette: the mean Euclidean silhouette of each label column (whole numbers from 0); null with one cluster.

    Rows are dealt to blocks; each pair of blocks is a task that adds up the distances from its rows to the other's clusters, of all
    labellings at once. Work grows with the square of a series, a task with the square of a block.
    """
    from ..functions.storage import materialize

    rows = labelled.select(F.col(series).alias("_s"), *columns, *labels).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows, "silhouette")
    blocks = rows.groupBy("_s").agg(F.ceil(F.count("*") / block).cast("int").alias("_m"))
    dealt = rows.join(blocks, "_s").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    dealt = dealt.select("_s", "_id", "_b", *columns, *labels, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, b = np.column_stack([t[c].to_numpy() for c in columns]), t["_b"].to_numpy()
        ids, i, j = t["_id"].to_numpy(), key[1].as_py(), key[2].as_py()
        out = [[], [], [], []]
        for mine, other in {(i, j), (j, i)}:
            a, c = np.flatnonzero(b == mine), np.flatnonzero(b == other)
            own = {n: t[n].to_numpy()[c] for n in labels}
            for lo in range(0, len(a), 256):
                d = np.sqrt(((x[a[lo : lo + 256], None] - x[None, c]) ** 2).sum(axis=2))
                for n in labels:
                    names, number = np.unique(own[n], return_inverse=True)
                    s = d @ np.eye(len(names))[number]
                    out[0].append(np.repeat(ids[a[lo : lo + 256]], len(names)))
                    out[1].append(np.full(s.size, labels.index(n)))
                    out[2].append(np.tile(names, len(s)))
                    out[3].append(s.ravel())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], type=k) for c, v, k in zip(("_id", "l", "c", "d"), out, kinds, strict=True)})

    sums = dealt.groupBy("_s", "_i", "_j").applyInArrow(run, "_id long, l int, c int, d double").groupBy("_id", "l", "c").agg(F.sum("d").alias("d"))
    long: Column = F.inline(F.array(*[F.struct(F.lit(n).alias("l"), F.col(c).cast("int").alias("own")) for n, c in enumerate(labels)]))
    own = rows.select("_s", "_id", long)
    size = own.groupBy("_s", "l", F.col("own").alias("c")).agg(F.count("*").alias("n"))
    met = own.join(sums, ["_id", "l"]).join(size, ["_s", "l", "c"])
    near = F.min(F.when(F.col("c") != F.col("own"), F.col("d") / F.col("n")))
    mine = F.max(F.when(F.col("c") == F.col("own"), F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))))
    row = met.groupBy("_s", "l", "_id").agg(near.alias("b"), mine.alias("a"), F.max(F.when(F.col("c") == F.col("own"), F.col("n"))).alias("n"))
    value = F.when(F.col("b").isNull(), None).when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b"), F.lit(1e-300))).otherwise(0.0)
    name = F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("l") + 1)
    return row.groupBy("_s", "l").agg(F.avg(value).alias("silhouette")).select(F.col("_s").alias(series), name.alias("labelling"), "silhouette")
