"""Ordered work that spreads over tasks, where a window over a whole series would put the series into one.

Two ways. Ranks: rows are dealt out by ranges of the value, and what earlier ranges hold is added. Time: a series is cut into
blocks of consecutive rows, each with a halo of the rows before it that its windows look back on. Blocks are made of
whole units of time, so only a table of units is ordered, never the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

#: Rows of a block of time. A block is what one task holds at a time.
BLOCK = 100_000
#: Bytes of a comparison of windows with their last rows.
_CELLS = 1 << 21


def weigh(df: DataFrame, keys: list[str], x: str, ties: list[str], weight: Column | None = None) -> DataFrame:
    """df with less and same: the key's rows (or sums of a whole-number weight) with a smaller and with an equal x; x is not null.

    Rows are dealt out by ranges of (keys, x, ties), so a frequent value spreads over ranges too. Within a range a window counts; of
    each range only its total and the counts of its first and last value, which its neighbours may share, go any further.
    """
    dealt = df.withColumn("_w", (F.lit(1) if weight is None else weight).cast("long")).repartitionByRange(*keys, x, *ties)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    here = [*keys, "_range"]
    count = dealt.groupBy(*here, x).agg(F.sum("_w").alias("_n"))
    ranges = count.groupBy(*here).agg(F.sum("_n").alias("_total"), F.min(F.struct(F.col(x).alias("v"), F.col("_n").alias("n"))).alias("_a"), F.max(F.struct(F.col(x).alias("v"), F.col("_n").alias("n"))).alias("_b"))
    before = lambda w: w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select(*here, F.coalesce(F.sum("_total").over(before(Window.partitionBy(*keys))), F.lit(0)).alias("_base"))
    edges = ranges.select(*here, F.inline(F.array_distinct(F.array("_a", "_b"))))
    of_value = Window.partitionBy(*keys, "v")
    edges = edges.select(*here, F.col("v").alias(x), F.coalesce(F.sum("n").over(before(of_value)), F.lit(0)).alias("_earlier"), F.sum("n").over(of_value).alias("_all"))
    within = Window.partitionBy(*here)
    local = dealt.withColumns({"_same": F.sum("_w").over(Window.partitionBy(*here, x)), "_upto": F.sum("_w").over(within.orderBy(x))})
    both = local.join(base, here).join(edges, [*here, x], "left")
    less = F.col("_base") + F.col("_upto") - F.col("_same") - F.coalesce("_earlier", F.lit(0))
    return both.select(*df.columns, less.alias("less"), F.coalesce("_all", "_same").alias("same"))


def quantiles(df: DataFrame, keys: list[str], x: str, shares: tuple[float, ...]) -> DataFrame:
    """keys, q (array): the linearly interpolated quantiles of each key's values that are not null.

    Values are counted before they are dealt out by ranges; the few that a share falls on are picked by the counts before them.
    """
    values = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    ranked = weigh(values, keys, "_x", [], F.col("_c"))
    size = values.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for k, q in enumerate(shares)])
    wanted = size.select(*keys, F.inline(at)).withColumns({"low": F.floor("at"), "part": F.col("at") - F.floor("at")})
    held = lambda place: (place >= F.col("less")) & (place < F.col("less") + F.col("same"))
    wanted = wanted.groupBy(*keys).agg(F.collect_list(F.struct("k", "low", "part")).alias("_q"))  # one for each share
    met = ranked.join(wanted, keys).select(*keys, "_x", "less", "same", F.inline("_q")).filter(held(F.col("low")) | held(F.col("low") + 1))
    low, high = (F.max(F.when(held(F.col("low") + d), F.col("_x"))) for d in (0, 1))
    one = met.groupBy(*keys, "k").agg(low.alias("a"), high.alias("b"), F.max("part").alias("part"))
    value = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda s: s.v).alias("q"))


def in_blocks(df: DataFrame, keys: list[str], order: str, halo: int = 0, rows: int = BLOCK, unit: str = "month", step: int = 50) -> DataFrame:
    """df with _block and _own: each row in its block of time, and once more, not own, in a later one that looks back on it.

    A block is of consecutive units (of a date or time) or steps (of a number) with some rows rows together, more if one
    unit holds more; its halo is of units before it with halo rows or more. A row without a time stands before all others.
    """
    timely = isinstance(df.schema[order].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    at = F.coalesce(F.date_trunc(unit, order), F.lit("0001-01-01").cast("timestamp")) if timely else F.coalesce(F.floor(F.col(order) / step), F.lit(-(1 << 62)))
    df = df.withColumn("_unit", at)
    return df.join(_units(df, keys, halo, rows), [*keys, "_unit"]).withColumn("_block", F.explode("_in")).withColumn("_own", F.col("_block") == F.col("_mine")).drop("_unit", "_in", "_mine")


def _units(df: DataFrame, keys: list[str], halo: int, rows: int) -> DataFrame:
    """keys, _unit, _mine (its block), _in (its block and those that it is the halo of)."""
    w = Window.partitionBy(*keys).orderBy("_unit")
    n = df.groupBy(*keys, "_unit").agg(F.count("*").alias("_n"))
    n = n.withColumn("_end", F.sum("_n").over(w)).withColumn("_mine", F.floor((F.col("_end") - F.col("_n")) / rows))
    n = n.withColumn("_next", F.when(F.lead("_mine").over(w) != F.col("_mine"), F.lead("_mine").over(w)))
    # the next block begins where a unit ends; it looks back on the units that end less than halo rows before
    later = F.collect_list("_next").over(Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, halo - 1)) if halo else F.array().cast("array<bigint>")
    return n.select(*keys, "_unit", "_mine", F.concat(F.array("_mine"), later).alias("_in"))


def numbered(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """df with the number of each row in its key's order, from 0: the rows of the units before it and its place in its own unit."""
    units = in_blocks(df, keys, order, 0, 1)  # a block is one unit
    size = units.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = size.select(*keys, "_block", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    return units.join(before, [*keys, "_block"]).withColumn(out, F.col("_before") + place).select(*df.columns, out)


def by_block(df: DataFrame, keys: list[str], order: str, made: dict[str, T.DataType], run, keep_block: bool = False) -> DataFrame:
    """The own rows of df, as in_blocks gives it, with the columns that run(table in order of time) makes, in one task for each block."""
    keep = [c for c in df.columns if c not in ("_block", "_own") or (keep_block and c == "_block")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in made.items()])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out = run(table)
        whole = table.select(keep)
        for c in made:
            whole = whole.append_column(c, out[c])
        return whole.filter(table["_own"])

    return df.groupBy(*keys, "_block").applyInArrow(one, schema)


def _floats(table: pa.Table, x: str) -> np.ndarray:
    return table[x].cast(pa.float64()).to_numpy().astype(float)


def trailing_rank(df: DataFrame, series: str, order: str, x: str, out: str, n: int, min_rows: int | None = None, rows: int = BLOCK) -> DataFrame:
    """df with the average-tie rank of each value among the series' last n rows, as a share of those that are not null.

    Null with fewer than min_rows (n) of those and for a null value. A task holds a block and n - 1 rows before it.
    """
    least = n if min_rows is None else min_rows

    def run(table: pa.Table) -> dict:
        v = _floats(table, x)
        seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), v]), n)
        rank, step = np.full(len(v), np.nan), max(1, _CELLS // n)
        for lo in range(0, len(v), step):
            now, past = v[lo : lo + step, None], seen[lo : lo + step]
            size = (~np.isnan(past)).sum(axis=1)
            ok = (size >= least) & ~np.isnan(now[:, 0])
            share = (past < now).sum(axis=1) + ((past == now).sum(axis=1) + 1) / 2
            rank[lo : lo + step][ok] = share[ok] / size[ok]
        return {out: pa.array(rank, from_pandas=True)}

    return by_block(in_blocks(df, [series], order, n - 1, rows), [series], order, {out: T.DoubleType()}, run)


def earlier(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many before it are smaller and how many are equal, by merging halves of growing size."""
    less, same = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
    value, place = np.unique(v, return_inverse=True)[1], np.arange(len(v))
    for level in range(max(len(v) - 1, 0).bit_length()):
        node, left = place >> (level + 1), (place >> level) & 1 == 0
        order = np.lexsort((value, node))
        new_node = np.append(True, np.diff(node[order]) != 0)
        new_value = new_node | np.append(True, np.diff(value[order]) != 0)
        so_far = np.concatenate([[0], np.cumsum(left[order])])
        group = np.cumsum(new_value) - 1
        first, stop = np.flatnonzero(new_value), np.append(np.flatnonzero(new_value)[1:], len(v))
        start = np.flatnonzero(new_node)[np.cumsum(new_node) - 1]
        right = ~left[order]
        less[order[right]] += (so_far[first][group] - so_far[start])[right]
        same[order[right]] += (so_far[stop] - so_far[first])[group][right]
    return less, same


def expanding_rank(df: DataFrame, series: str, order: str, x: str, out: str, min_rows: int, rows: int = BLOCK) -> DataFrame:
    """df with the average-tie rank of each value among the series' values so far, as a share; null with fewer than min_rows.

    A block counts its own earlier values. Blocks are the leaves of a binary tree: in each of its nodes the values of the right half
    count those of the left half, all nodes and series at once by ranges of the value. No task holds a series.
    """

    def run(table: pa.Table) -> dict:
        v = _floats(table, x)
        ok = ~np.isnan(v)
        less, same = (np.zeros(len(v), dtype=np.int64) for _ in range(2))
        less[ok], same[ok] = earlier(v[ok])
        return {"_less": pa.array(less), "_same": pa.array(same), "_seen": pa.array(np.cumsum(ok))}

    long = T.LongType()
    local = by_block(in_blocks(df, [series], order, 0, rows), [series], order, {"_less": long, "_same": long, "_seen": long}, run, keep_block=True)
    local = materialize(local.withColumn("_id", F.monotonically_increasing_id()), "blocks")
    leaf = local.groupBy(series, "_block").agg(F.max("_seen").alias("_n"))
    before = leaf.select(series, "_block", F.coalesce(F.sum("_n").over(Window.partitionBy(series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    whole = local.join(before, [series, "_block"])
    depth = (leaf.agg(F.max("_block")).first()[0] or 0).bit_length()
    if depth:
        level = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_level")
        nodes = local.filter(F.col(x).isNotNull()).select(series, "_id", F.col(x).alias("_x"), "_block", level)
        nodes = nodes.select(series, "_id", "_x", "_level", F.expr("shiftright(_block, _level + 1)").alias("_node"), (F.expr("shiftright(_block, _level)") % 2 == 0).alias("_left"))
        met = weigh(nodes, [series, "_level", "_node"], "_x", ["_id"], F.col("_left").cast("long")).filter(~F.col("_left"))
        more = met.groupBy("_id").agg(F.sum("less").alias("_l"), F.sum("same").alias("_s"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        whole = whole.join(more, "_id", "left").withColumns({"_less": F.col("_less") + zero("_l"), "_same": F.col("_same") + zero("_s")})
    size = F.col("_before") + F.col("_seen")
    rank = F.when(F.col(x).isNotNull() & (size >= min_rows), (F.col("_less") + (F.col("_same") + 2) / 2) / size)
    return whole.withColumn(out, rank).select(*df.columns, out)


def ewm_means(df: DataFrame, series: str, order: str, x: str, spans: dict[str, int], rows: int = BLOCK) -> DataFrame:
    """df with exponentially weighted means of x: weights (1 - a)**age over their sum, a = 2 / (span + 1), ages in rows that have a value.

    Sum and weight after a block are affine in those before it. Each block works from nothing; the maps of the blocks are
    composed in order, and what stands before a block is added to its rows.
    """
    keeps = {c: 1 - 2 / (span + 1) for c, span in spans.items()}

    def run(table: pa.Table) -> dict:
        v = _floats(table, x)
        age = np.cumsum(~np.isnan(v))
        made = {"_age": pa.array(age)}
        for c, keep in keeps.items():
            mean = table[x].cast(pa.float64()).to_pandas().ewm(alpha=1 - keep, adjust=True, ignore_na=True).mean().to_numpy()
            made[f"_sum_{c}"] = pa.array(np.where(age > 0, np.nan_to_num(mean) * (1 - keep**age) / (1 - keep), 0.0))
        return made

    made = {"_age": T.LongType(), **{f"_sum_{c}": T.DoubleType() for c in keeps}}
    local = materialize(by_block(in_blocks(df, [series], order, 0, rows), [series], order, made, run, keep_block=True), "blocks")
    steps = local.groupBy(series, "_block").agg(F.max_by(F.struct(*made), F.struct("_age", order)).alias("_s")).select(series, "_block", "_s.*")
    past = F.collect_list(F.struct(*made)).over(Window.partitionBy(series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    pairs = F.struct(*[F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t")).alias(c) for c in keeps])

    def through(z: Column, step: Column) -> Column:
        fade = {c: F.pow(F.lit(k), step["_age"]) for c, k in keeps.items()}
        return F.struct(*[F.struct((step[f"_sum_{c}"] + fade[c] * z[c]["s"]).alias("s"), ((1 - fade[c]) / (1 - k) + fade[c] * z[c]["t"]).alias("t")).alias(c) for c, k in keeps.items()])

    carried = steps.select(series, "_block", F.aggregate(past, pairs, through).alias("_z"))
    both = local.join(carried, [series, "_block"])
    value = lambda c, k: (F.col(f"_sum_{c}") + F.pow(F.lit(k), "_age") * F.col(f"_z.{c}.s")) / F.nullif((1 - F.pow(F.lit(k), "_age")) / (1 - k) + F.pow(F.lit(k), "_age") * F.col(f"_z.{c}.t"), F.lit(0.0))
    return both.withColumns({c: value(c, k) for c, k in keeps.items()}).select(*df.columns, *keeps)
