"""Fill-in-middle transformation: texts are cut at random places and their parts reordered around sentinels.

The work on a text is on whole integers with one bit a byte: bytes.translate makes the mask of a class of bytes, shifted
boolean operations mark where units begin, bit_count counts them, and halving finds the byte where a unit of given rank begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_batches

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are transformed, and of those the ones in a hundred with the suffix first.
RATE, SPM_RATE = 90, 20
SEED = 1
#: Bits below which a mask is searched without further halving.
_SMALL = 64


def _table(members) -> bytes:
    return bytes(0x31 if b in members else 0x30 for b in range(256))


_STARTS = _table({b for b in range(256) if not 0x80 <= b < 0xC0})
_BLANK = _table({0x20, *range(0x09, 0x0E)})
_NEWLINE = _table({0x0A})


def mask(data: bytes, members: bytes) -> int:
    """The integer whose bit i tells whether byte i is of the class; members translates bytes to the digits 0 and 1."""
    return int(data.translate(members)[::-1], 2) if data else 0


def unit_starts(data: bytes, unit: str = "char") -> int:
    """Bits at the bytes where code points, words or lines begin; of words and lines the first one begins at byte 0."""
    if unit == "char":
        return mask(data, _STARTS)
    if unit == "word":
        blank = mask(data, _BLANK)
        return ((blank << 1 & ~blank) | 1) & ((1 << len(data)) - 1) if data else 0
    if unit == "line":
        return ((mask(data, _NEWLINE) << 1) | 1) & ((1 << len(data)) - 1) if data else 0
    raise ValueError(f"unknown unit: {unit}")


def select_bit(bits: int, rank: int) -> int:
    """The place of the set bit of that rank, counted from 0, by halving: the lower half is counted and one half is kept."""
    at, width = 0, bits.bit_length()
    while width > _SMALL:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    for _ in range(rank):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def holds(data: bytes, word: bytes) -> bool:
    """Whether word stands in data: the masks of its bytes, each shifted back by its place, have a bit in common."""
    found = -1
    for i, b in enumerate(word):
        found &= mask(data, _table({b})) >> i
        if not found:
            return False
    return found > 0


def cut_points(doc_id, n: int, seed: int) -> tuple[int, int, int, int]:
    """Units of the prefix, units before the suffix, and two numbers below 100, from a hash of the seed and the id alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100, h4 % 100


def transform(doc_id, data: bytes, seed: int, rate: int, spm_rate: int, unit: str, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, units of prefix and middle (None if plain) and the output of one text."""
    starts = unit_starts(data, unit)
    n = starts.bit_count()
    a, b, chance, order = cut_points(doc_id, n, seed)
    if not data or chance >= rate or any(holds(data, m) for m in marks):
        return n, "plain", None, None, data
    i, j = (len(data) if k == n else select_bit(starts, k) for k in (a, b))
    p, s, m = marks
    if order < spm_rate:
        return n, "spm", a, b - a, b"".join((s, data[j:], p, data[:i], m, data[i:j]))
    return n, "psm", a, b - a, b"".join((p, data[:i], s, data[j:], m, data[i:j]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "char", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output: each whole text, reordered around sentinels.

    unit: char (code points), word or line; n counts them. The places of the two cuts, whether a text is transformed (rate
    in a hundred) and whether its suffix comes first (spm_rate) follow from seed and doc_id alone, so a task that runs
    again gives the same rows and repeated rows get the same answer. Forms: psm (prefix, suffix, middle), spm (suffix first), plain (as it is: the empty
    text, a text that holds a sentinel, and those that chance leaves out). A null text is an empty one; a null doc_id is hashed as
    the empty string. Other columns are left out. Nothing is shuffled; a task holds one batch of texts, and one text takes
    about four times its bytes. Sentinels that are, or begin with, parts of one another are refused.
    """
    unit_starts(b"", unit)  # refuse an unknown unit here and not in a task
    coded = tuple(m.encode() for m in marks)
    if any(a[k:] and b.startswith(a[k:]) for a in coded for b in coded for k in range(a is b, len(a))) or any(a in b for a in coded for b in coded if a is not b):
        raise ValueError(f"sentinels overlap: {marks}")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, t()) for c, t in (("n", T.LongType), ("form", T.StringType), ("prefix_units", T.LongType), ("middle_units", T.LongType), ("output", T.StringType))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            made = [transform(i.as_py(), t.as_py() or b"", seed, rate, spm_rate, unit, coded) for i, t in zip(batch.column(0), texts, strict=True)]
            columns = zip(*made, strict=True) if made else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            *rest, output = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, output.cast(pa.string())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that fill_in_middle made output of, from output and form alone; each sentinel stands there once."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    back = digest(restored(F.col("form"), F.col("output")))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"))
