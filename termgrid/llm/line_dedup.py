"""Line dedup by winnowing over line hashes: later copies of repeated runs of lines go."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_batches
from .winnow import Family, cover, mark_repeats

#: Words from which one line, or two, count as a run.
LONG = 50
#: Every repeated run of 2 + 2 - 1 = 3 lines is found, and every repeated line or pair of lines of as many words.
RUNS = (Family(2, 2), Family(2, 1, LONG), Family(1, 1, LONG))
#: Bits of the set of repeated grams: 4 MB on each worker.
BITS = 25


def remove_repeated_lines(docs: DataFrame, runs: tuple[Family, ...] = RUNS, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept, and the columns named in carry: each text without the lines that a later copy of a run covers.

    A line is a non-empty run without newlines, unchanged. A run is of three lines or more, or of one or two that hold LONG
    words (between ASCII white space) together; of equal runs
    the first by (doc_id, place) stays, and the lines of later ones go, overlapping ones included. Kept lines are joined
    by one newline, so empty lines go too where something is removed; a text that loses nothing is returned as it is. A
    null text has no lines and kept is null; a null doc_id comes after all others; repeated rows, and others of one id, do not
    remove each other. Other columns are left out unless carried.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, null = [], batch.column("text").is_null().to_pylist()
            for (doc, raw, starts, ends, covered), none in zip(cover(batch, "line", runs), null, strict=True):
                if covered.any():
                    raw = b"\n".join(raw[a:b] for a, b, gone in zip(starts, ends, covered, strict=True) if not gone)
                rows.append((doc, len(starts), int(covered.sum()), None if none else raw.decode()))
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *[batch.column(c) for c in carry]], [*names, *carry])

    names = ["doc_id", "n_lines", "n_removed", "kept"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "kept" else T.LongType()) for n in names] + [docs.schema[c] for c in carry])
    return mark_repeats(docs.select("doc_id", "text", *carry), "line", runs, True, bits, finish, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the SHA-256 of what is kept."""
    text_batches(spark)
    kept = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
