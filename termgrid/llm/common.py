"""Shared helpers: table access, cutting lineage in the shared folder, and vectorised text kernels.

The kernels work on the bytes of an Arrow string column, so a task handles a few megabytes of text per numpy call
and never loops over words in Python.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize, shared_dir  # noqa: F401  the operators' own

#: Bytes of text that one kernel call works on; a single longer text is taken alone.
SLICE_BYTES = 1 << 18
#: Odd multiplier of the n-gram hashes, and the keys of two independent kinds of hash; any odd numbers would do.
_TIMES = np.uint64(0x9E3779B97F4A7C15)
KEY, OTHER_KEY = 0x51_7C_C1_B7_27_22_0A_95, 0xC2_B2_AE_3D_27_D4_EB_4F
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one with BLAKE2; a slice holds few of them.
_LONG = 128
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send rows of whole texts to Python in batches of this size, unless the session has a setting of its own.

    Spark's default of 10,000 rows takes tens of megabytes a batch, several times over, in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def few_files(df: DataFrame) -> DataFrame:
    """df in no more partitions than the cluster runs tasks, for a small result of a stage that follows a shuffle."""
    return df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key, rows: int) -> DataFrame:
    """At most rows rows, the first by the hash key (a long column) among a share of about twice as many.

    The share is taken where the rows are, so the one task that orders them reads few from each other task.
    """
    n = df.count()
    if n > 4 * rows:
        df = df.filter(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / n))
    return df.orderBy(key).limit(rows)


# ---------------------------------------------------------------- text kernels


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; equal contents have equal hashes wherever they stand.

    Eight bytes are mixed in at a time, each round a permutation of the state, so no arrangement of blocks cancels out.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * _LENGTH + np.uint64(key))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    here = np.flatnonzero((size > 0) & (size <= _LONG))
    done = 0
    while len(here):
        lane = eight[starts[here] + done] & _LANE[np.minimum(size[here] - done, 8)]
        h[here] = mix((h[here] ^ lane) * _TIMES + np.uint64(key))
        done += 8
        here = here[size[here] > done]
    for i in np.flatnonzero(size > _LONG):
        made = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key.to_bytes(8, "little"))
        h[i] = int.from_bytes(made.digest(), "little")
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries; n - 1 fewer than words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= _TIMES
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LINE = np.zeros(256, dtype=bool)
_LINE[0x0A] = True


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, one past the last row, bytes, offsets of the rows in the bytes) for slices of at most limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def pieces(data: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE):
    """Starts and ends of the maximal runs without separators, and the row of each; rows never share a run."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def words_of(data: np.ndarray, off: np.ndarray):
    """Hashes of the words and, for n rows, n + 1 offsets of the rows in them."""
    starts, ends, row = pieces(data, off)
    return span_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(off))), starts, ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))


def bitmap(df: DataFrame, column: str, bits: int):
    """A broadcast bit set of 2**bits bits with the bit of each hash in a long column set.

    Its size is fixed by the parameter, whatever the number of rows; a set bit may stand for several hashes, so callers
    use it only to leave out what surely is not there. At most 2**(bits - 6) rows reach the driver.
    """
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    words = df.select(F.shiftright(at, 6).alias("w"), at.alias("at")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def split_by(df: DataFrame, column: str, bits, deflate: str = "", rest=None, schema=None, edit=None, edited=None) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash in a long column may be in the bit set, and those whose hash surely is not.

    The string column deflate of the first ones, which go to a shuffle, becomes compressed bytes; inflated() undoes it.
    rest turns the batches of the second ones into rows of schema in the same pass, and so in the same worker; edit changes
    those of the first ones, to rows of the schema edited if that differs.
    """

    def part(yes: bool) -> DataFrame:
        def run(batches):
            import zstandard

            press = zstandard.ZstdCompressor(level=1).compress
            for batch in batches:
                h = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
                batch = batch.filter(pa.array(has_bit(bits.value, h) == yes))
                batch = edit(batch) if yes and edit else batch
                if yes and deflate:
                    small = pa.array([None if x is None else press(x.encode()) for x in batch.column(deflate).to_pylist()], pa.binary())
                    batch = batch.set_column(batch.schema.get_field_index(deflate), deflate, small)
                yield batch

        if rest and not yes:
            return df.mapInArrow(lambda batches: rest(run(batches)), schema)
        return df.mapInArrow(run, df.withColumn(deflate, F.lit(None).cast("binary")).schema if yes and deflate else edited if yes and edited else df.schema)

    return part(True), part(False)


def inflated(batches, column: str):
    """Batches whose compressed string column is text again, at most 1000 rows each."""
    import zstandard

    press = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            text = pa.array([None if x is None else press(x).decode() for x in batch.column(column).to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index(column), column, text)


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], heads: int = 1000) -> DataFrame:
    """The inner join of rows with keyed, which has one row a key, so that no task gets a large share of the rows by one key.

    Keys that hold over 1 / heads of the rows are met by broadcast: there are at most heads such keys, whatever the size.
    The others go by shuffle. Both inputs are read more than once, so they should be cheap to read.
    """
    total = rows.count()
    hot = rows.groupBy(*keys).count().filter(F.col("count") * heads > total).select(*keys)
    hot = materialize(keyed.join(F.broadcast(hot), keys, "left_semi"), "hot-keys")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(keyed, keys))
