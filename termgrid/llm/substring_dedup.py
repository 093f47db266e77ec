"""Substring dedup by seed and extend: documents meet on winnowed anchors, matches extend both ways, maximal repeats go."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_batches
from .winnow import Family, cover, mark_repeats

#: Words of a seed and seeds in a window: 5 + 9 - 1 = 13 words are the shortest repeat.
SEED, SEEDS = 5, 9
#: Bits of the set of repeated seeds: 16 MB on each worker.
BITS = 27


def remove_repeated_words(docs: DataFrame, seed: int = SEED, seeds: int = SEEDS, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each text that no repeat covers, joined by one blank.

    A word goes if a window of seed + seeds - 1 consecutive words covers it whose word sequence also starts in a
    document with a smaller doc_id. Words are runs without ASCII white space. A null or empty text has no words; a null
    doc_id comes after all others; repeated rows get the same answer each and do not remove each other. Other columns
    are left out. Windows are compared by 96-bit hashes.
    """

    families = (Family(seed, seeds),)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, starts, _, covered in cover(batch, "word", families):
                words = raw.split()
                rows.append((doc, len(starts), int(covered.sum()), b" ".join(compress(words, ~covered) if covered.any() else words).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return mark_repeats(docs.select("doc_id", "text"), "word", families, False, bits, finish, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    kept = remove_repeated_words(table(spark, sf_dir, "documents"))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) as kept_sha256")
