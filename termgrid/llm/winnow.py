"""Repeated runs of words or lines, by winnowed fingerprints.

A run is a window of g = k + w - 1 units. Of the w k-grams in each window the least hash is its fingerprint, so equal
windows always share one. Three passes follow, none of which pairs the members of a group:

1. count the fingerprints; those met once are out. What is left is kept as a bit set of fixed size.
2. read the texts again and, from each fingerprint that is left, extend both ways to all windows that hold it; the
   first holder of each window is a minimum by the window's 96-bit hash, combined before the shuffle.
3. windows of later holders go back to their texts. Consecutive windows join up to maximal runs. A text is shuffled
   only if it has such a window.

Windows of words are many times the texts, so step 2 first takes each stretch of windows around one fingerprint as a
whole: copies share most of theirs. All windows of a stretch go from every holder but its first; only the first one's
are compared window by window, as other stretches may hold some of them too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LINE, _SPACE, OTHER_KEY, bitmap, gram_hashes, has_bit, inflated, materialize, mix, pieces, signed, slices, span_hashes, split_by

LAST = (1 << 63) - 1
#: log2 of the bits of the set of ids that several rows share.
_SHARED_BITS = 22


@dataclass(frozen=True)
class Family:
    """Windows of gram + window - 1 units; with least_words, only those that hold as many words."""

    gram: int
    window: int
    least_words: int = 0

    @property
    def units(self) -> int:
        return self.gram + self.window - 1


class Windows:
    """All windows of a slice: hash, 32 bits of a second one if both, fingerprint, its unit, row, place in the row, units; and of the units
    starts, ends, row offsets. Without families only the units."""

    def __init__(self, data: np.ndarray, off: np.ndarray, unit: str, families: tuple[Family, ...], both: bool = False):
        self.starts, self.ends, row = pieces(data, off, _LINE if unit == "line" else _SPACE)
        self.at = np.searchsorted(row, np.arange(len(off)))
        if not families:
            return
        h = span_hashes(data, self.starts, self.ends)
        h2 = span_hashes(data, self.starts, self.ends, OTHER_KEY) if both else None
        words = np.searchsorted(pieces(data, off)[0], np.stack([self.starts, self.ends])) if any(f.least_words for f in families) else None
        parts = [self._family(f, h, h2, row, words, k) for k, f in enumerate(families)]
        made = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(families) > 1:
            order = np.argsort(made[4], kind="stable")
            made = [x[order] for x in made]
        self.whole, self.second, self.least, self.unit_at, self.row, self.place, self.size = made

    def _family(self, f: Family, h: np.ndarray, h2, row: np.ndarray, words, number: int) -> tuple:
        g, n = f.units, len(h) - f.units + 1
        if n < 1:
            none = np.empty(0, dtype=np.int64)
            return none.view(np.uint64), none.astype(np.int32), none.view(np.uint64), none, none, none, none
        grams, whole = gram_hashes(h, f.gram), gram_hashes(h, g)
        second = whole if h2 is None else gram_hashes(h2, g)
        least, unit_at = grams[:n].copy(), np.arange(n)
        for j in range(1, f.window):  # of equal hashes the first counts
            less = np.flatnonzero(grams[j : n + j] < least)
            least[less], unit_at[less] = grams[less + j], less + j
        ok = row[:n] == row[g - 1 :]
        if f.least_words:
            ok &= words[1][g - 1 :] - words[0][:n] >= f.least_words
        ok = np.flatnonzero(ok)
        salt = np.uint64(number * 0x2127599BF4325C37 & LAST)
        return whole[ok] ^ salt, (second[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32), least[ok] ^ salt, unit_at[ok], row[ok], ok - self.at[row[ok]], np.full(len(ok), g)


def _stretches(whole: np.ndarray, second: np.ndarray, unit_at: np.ndarray) -> tuple:
    """The stretches of consecutive windows of one fingerprint: first window, number of windows, hash and 32 bits of a second one."""
    if not len(whole):
        none = np.empty(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none.astype(np.int32)
    start = np.flatnonzero(np.append(True, unit_at[1:] != unit_at[:-1]))
    n = np.diff(np.append(start, len(whole)))
    step = (np.arange(len(whole)) - np.repeat(start, n)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    h = np.add.reduceat(mix(whole + step), start)
    h2 = np.add.reduceat(mix(second.view(np.uint32).astype(np.uint64) + step + np.uint64(1)), start)
    return start, n, h, (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _once(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first of equal hashes in each row, in order."""
    return np.sort(np.unique(mix(h + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)[1])


def _fingerprints(unit: str, families: tuple[Family, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch.column(0)):
                w = Windows(data, off, unit, families)
                first = np.ones(len(w.least), dtype=bool)  # neighbours mostly share theirs
                first[1:] = (w.unit_at[1:] != w.unit_at[:-1]) | (w.least[1:] != w.least[:-1])
                h, n = np.unique(w.least[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "n"])

    return run


def _told_apart(batch: pa.RecordBatch, shared) -> pa.RecordBatch:
    """The batch with _row set to 0 where the id belongs to one row only."""
    several = has_bit(shared.value, batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64))
    row = np.where(several, batch.column("_row").to_numpy(zero_copy_only=False), 0)
    return batch.set_column(batch.schema.get_field_index("_row"), "_row", pa.array(row))


def _extended(unit: str, families: tuple[Family, ...], twice, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _told_apart(batch, shared)
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_row"))
            for lo, _, data, off in slices(batch.column("text")):
                w = Windows(data, off, unit, families, both=True)
                got = has_bit(twice.value, w.least)
                whole, second, row, place = w.whole[got], w.second[got], w.row[got], w.place[got]
                key = mix(whole + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                order = np.argsort(first)
                first, n = first[order], n[order]
                columns = {"h": signed(whole[first]), "h2": second[first], "doc": ids[lo + row[first]], "row": rows[lo + row[first]], "place": place[first].astype(np.int32), "again": n > 1}
                yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})

    return run


def _anchored(unit: str, family: Family, twice, shared, stretch: bool, lead=None, wanted=None) -> Callable:
    """Hash, 32 bits of a second one, doc and row of each stretch if stretch, and of each window of those in lead; with wanted, only hashes in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _told_apart(batch, shared)
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_row"))
            for lo, _, data, off in slices(batch.column("text")):
                w = Windows(data, off, unit, (family,), both=True)
                got = has_bit(twice.value, w.least)
                whole, second, row = w.whole[got], w.second[got], w.row[got]
                start, n, h, h2 = _stretches(whole, second, w.unit_at[got])
                parts = [(h, h2, row[start])] if stretch else []
                if lead:
                    mine = np.repeat(has_bit(lead.value, h ^ ids[lo + row[start]].view(np.uint64)), n)
                    parts.append((whole[mine], second[mine], row[mine]))
                for h, h2, row in parts:
                    if wanted:
                        yes = has_bit(wanted.value, h)
                        h, h2, row = h[yes], h2[yes], row[yes]
                    at = _once(h, row)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(h2[at]), pa.array(ids[lo + row[at]]), pa.array(rows[lo + row[at]])], ["h", "h2", "doc", "row"])

    return run


def _gone_within(keyed: DataFrame, unit: str, families: tuple[Family, ...], twice, shared) -> DataFrame:
    found = keyed.mapInArrow(_extended(unit, families, twice, shared), "h long, h2 int, doc long, row long, place int, again boolean")
    found = materialize(found, f"{unit}-windows")
    first = found.groupBy("h", "h2").agg(F.min(F.struct("doc", "place")).alias("least"), F.max("doc").alias("last"), F.bool_or("again").alias("again"))
    first = first.filter("least.doc < last or again").select("h", "h2", "least")
    gone = found.join(first, ["h", "h2"]).filter("doc > least.doc or again").select("doc", "row", "h", F.expr("if(doc > least.doc, -1, place)").alias("spare"))
    gone = gone.groupBy("doc", "row").agg(F.collect_set(F.struct("h", "spare")).alias("both")).select("doc", "row", F.col("both.h").alias("gone"), F.col("both.spare").alias("spare"))
    return materialize(gone, f"{unit}-gone")


def _gone_across(keyed: DataFrame, unit: str, family: Family, twice, shared, bits: int) -> DataFrame:
    """As _gone_within, without places to spare; gone lists hashes of stretches and of windows.

    A window in a document is gone if the window, or its stretch, has a holder of a smaller id: every holder of a stretch
    but the first loses all of it, and a first one loses the windows that have an earlier holder in another stretch.
    """

    def found(*args) -> DataFrame:
        return keyed.mapInArrow(_anchored(unit, family, twice, shared, *args), "h long, h2 int, doc long, row long")

    def first(holders: DataFrame) -> DataFrame:
        return holders.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("last"))

    stretches = materialize(first(found(True)), f"{unit}-stretches")
    lead = bitmap(stretches.select(F.col("h").bitwiseXOR(F.col("least")).alias("h")), "h", bits)
    windows = materialize(first(found(False, lead)).filter("least < last"), f"{unit}-windows")
    firsts = stretches.filter("least < last").unionByName(windows).select("h", "h2", "least")
    wanted = bitmap(firsts, "h", bits)
    gone = found(True, lead, wanted).join(firsts, ["h", "h2"]).filter("doc > least")
    gone = materialize(gone.groupBy("doc", "row").agg(F.collect_set("h").alias("gone")), f"{unit}-gone")
    lead.destroy()  # no later plan reads them
    wanted.destroy()
    return gone.withColumn("spare", F.lit(None).cast("array<int>"))


def mark_repeats(docs: DataFrame, unit: str, families: tuple[Family, ...], within: bool, bits: int, finish: Callable, schema) -> DataFrame:
    """docs: doc_id long, text string. finish(batches of docs with gone and spare) makes the result's rows with that schema.

    gone lists the hashes (64 bits, as they are looked up in one text alone) and spare the places to spare, or -1 (none if not within), of the windows that an earlier document holds or, if within, that
    stand earlier in the same one. If not within, there is one family, and a hash may be that of a stretch of windows. A null doc_id comes after all others. Rows with equal doc_ids do not count as each
    other's earlier holders; they and rows without an id are told apart by a hash of their texts, so no list is longer than
    one text. Columns named _doc, _row and _h are replaced.
    """
    names = [c for c in docs.columns if c not in ("_doc", "_row", "_h")]
    keyed = docs.select(*names, F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_row"), F.xxhash64(F.coalesce("doc_id", F.lit(LAST))).alias("_h"))
    shared = bitmap(keyed.groupBy("_doc").agg(F.count("*").alias("n"), F.first("_h").alias("_h")).filter(f"n > 1 or _doc = {LAST}"), "_h", _SHARED_BITS)

    prints = docs.select("text").mapInArrow(_fingerprints(unit, families), "h long, n long")
    twice = bitmap(prints.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "h", bits)
    told = keyed.select("_doc", "_row", "_h", "text")
    gone = _gone_within(told, unit, families, twice, shared) if within else _gone_across(told, unit, *families, twice, shared, bits)
    twice.destroy()  # no later plan reads it
    some = bitmap(gone.select(F.xxhash64("doc").alias("h")), "h", min(bits, 25))

    def nothing_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("gone", pa.nulls(batch.num_rows, pa.list_(pa.int64()))).append_column("spare", pa.nulls(batch.num_rows, pa.list_(pa.int32())))

    touched, clean = split_by(keyed, "_h", some, "text", lambda batches: finish(nothing_gone(batches)), schema, lambda batch: _told_apart(batch, shared))
    touched = touched.join(gone.withColumnsRenamed({"doc": "_doc", "row": "_row"}), ["_doc", "_row"], "left").select(*names, "gone", "spare")
    return touched.mapInArrow(lambda batches: finish(inflated(batches, "text")), schema).unionByName(clean)


def cover(batch: pa.RecordBatch, unit: str, families: tuple[Family, ...]) -> Iterator[tuple]:
    """For each row: doc_id, its bytes, starts and ends of its units, and which of them are covered by a window that is gone."""
    ids, gone = batch.column("doc_id").to_pylist(), batch.column("gone")
    lengths = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.zeros(len(gone) + 1, dtype=np.int64)
    np.cumsum(lengths, out=begin[1:])
    hashes = gone.flatten().to_numpy(zero_copy_only=False)
    across = batch.column("spare").null_count == len(gone)
    spare = np.full(len(hashes), -1) if across else batch.column("spare").flatten().to_numpy(zero_copy_only=False)
    for lo, hi, data, off in slices(batch.column("text")):
        some = begin[lo] < begin[hi]
        w = Windows(data, off, unit, families if some else ())
        split = np.searchsorted(w.row, np.arange(hi - lo + 1)) if some else None
        if some and across:
            _, n, h, _ = _stretches(w.whole, w.second, w.unit_at)
            stretch = np.repeat(signed(h), n)
        for i in range(hi - lo):
            n = w.at[i + 1] - w.at[i]
            covered = np.zeros(n, dtype=bool)
            a, b = begin[lo + i], begin[lo + i + 1]
            if a < b:
                order = np.argsort(hashes[a:b])
                known, keep = hashes[a:b][order], spare[a:b][order]
                mine = signed(w.whole[split[i] : split[i + 1]])
                spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                p, g = w.place[split[i] : split[i + 1]], w.size[split[i] : split[i + 1]]
                on = (known[spot] == mine) & (keep[spot] != p)
                if across:
                    on |= np.isin(stretch[split[i] : split[i + 1]], known)
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, p[on], 1)
                np.add.at(edge, p[on] + g[on], -1)
                covered = np.cumsum(edge[:-1]) > 0
            yield ids[lo + i], data[off[i] : off[i + 1]].tobytes(), w.starts[w.at[i] : w.at[i + 1]] - off[i], w.ends[w.at[i] : w.at[i + 1]] - off[i], covered
