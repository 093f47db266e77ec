"""Data sources for files that Spark has no reader for: fixed-layout record files and sheets of workbooks.

Each is read in parts by the executors, through any file system that Arrow knows by its address. The columns of a schema
that the caller gives are the only ones that are made.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that a part of an uncompressed file holds, and bytes that are decoded at a time.
PART_RECORDS, CHUNK = 1_000_000, 1 << 22
#: Day 0 of a workbook's dates.
_DAY_0 = dt.date(1899, 12, 30)
_NUMBERS = {"i1": T.ByteType, "i2": T.ShortType, "i4": T.IntegerType, "i8": T.LongType, "u1": T.ShortType, "u2": T.IntegerType, "u4": T.LongType, "f4": T.FloatType, "f8": T.DoubleType}


def _files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """The address and size of each file of a folder, or of one file, in order of their names."""
    if "://" in path:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        prefix = path[: len(path) - len(at)] if path.endswith(at) else path.split("://", 1)[0] + "://"
    else:
        fs, at, prefix = pyarrow.fs.LocalFileSystem(), path, ""
    info = fs.get_file_info(at)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(at)) if info.type == pyarrow.fs.FileType.Directory else []
    found = sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.path.lower().endswith(endings))
    if not found:
        raise FileNotFoundError(f"no files ending in {', '.join(endings)} at {path}")
    return [(f"{prefix}{p}", size) for p, size in found]


def _open(address: str):
    if "://" in address:
        fs, at = pyarrow.fs.FileSystem.from_uri(address)
        return fs.open_input_file(at)
    return pyarrow.fs.LocalFileSystem().open_input_file(address)


@dataclass
class Part(InputPartition):
    """A file, or some records of it."""

    address: str
    first: int = 0
    count: int = -1


# ---------------------------------------------------------------- records


def record_layout(layout: str) -> list[tuple[str, str, float]]:
    """(name, numpy type, scale) of each field of "name:type[:scale], ..."; types as i8, u4, f8, S12, and x4 for bytes to skip."""
    out = []
    for k, field in enumerate(layout.split(",")):
        name, kind, *scale = field.strip().split(":")
        if not re.fullmatch(r"[iu][1248]|f[48]|S\d+|x\d+", kind) or kind == "u8":
            raise ValueError(f"unknown field type {kind} in {field.strip()}")
        out.append((f"_skip{k}" if kind[0] == "x" else name, f"V{kind[1:]}" if kind[0] == "x" else kind, float(scale[0]) if scale else 1.0))
    return out


class RecordSource(DataSource):
    """spark.read.format("records"): files of equal records, little-endian, .bin or, compressed, .bin.zst.

    Options: path (a file or folder), layout (see record_layout), header (bytes before the first record). A scaled field is a
    double; times are whole numbers, for the caller to convert. Plain files are cut into parts of records, compressed ones are one part.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        kinds = [(n, T.DoubleType if scale != 1.0 else T.StringType if k[0] == "S" else _NUMBERS[k]) for n, k, scale in record_layout(self.options["layout"]) if k[0] != "V"]
        return T.StructType([T.StructField(n, k()) for n, k in kinds])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordReader(self.options["path"], self.options["layout"], int(self.options.get("header", 0)), int(self.options.get("records", PART_RECORDS)), schema)


class RecordReader(DataSourceReader):
    def __init__(self, path: str, layout: str, header: int, records: int, schema: T.StructType):
        self.path, self.header, self.records, self.schema = path, header, records, schema
        fields = record_layout(layout)
        self.scale = {n: s for n, _, s in fields}
        self.layout = [(n, k if k[0] in "SV" else f"<{k}") for n, k, _ in fields]
        unknown = [n for n in schema.names if n not in self.scale]
        if unknown:
            raise ValueError(f"not in the layout: {unknown}")

    def partitions(self) -> list[Part]:
        width, out = np.dtype(self.layout).itemsize, []
        for address, size in _files(self.path, (".bin", ".bin.zst")):
            if address.endswith(".zst"):
                out.append(Part(address))
                continue
            if (size - self.header) % width:
                raise ValueError(f"{address} does not hold whole records of {width} bytes")
            n = (size - self.header) // width
            out += [Part(address, k, min(self.records, n - k)) for k in range(0, n, self.records)]
        return out

    def _chunks(self, part: Part) -> Iterator[bytes]:
        width = np.dtype(self.layout).itemsize
        with _open(part.address) as f:
            if part.count >= 0:
                f.seek(self.header + part.first * width)
                left = part.count * width
                while left:
                    got = f.read(min(left, CHUNK // width * width or width))
                    left -= len(got)
                    yield got
                return
            import zstandard

            stream, held, skip = zstandard.ZstdDecompressor().stream_reader(f), b"", self.header
            while got := stream.read(CHUNK):
                held += got
                cut = min(skip, len(held))
                held, skip = held[cut:], skip - cut
                whole = len(held) // width * width
                if whole:
                    yield held[:whole]
                    held = held[whole:]
            if held:
                raise ValueError(f"{part.address} does not hold whole records of {width} bytes")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kind, target = np.dtype(self.layout), {f.name: f.dataType for f in self.schema}
        for chunk in self._chunks(part):
            table = np.frombuffer(chunk, dtype=kind)
            columns = []
            for name, spark_type in target.items():
                v = table[name]
                if v.dtype.kind == "S":
                    columns.append(pa.array([x.decode() for x in v.tolist()], pa.string()))
                else:
                    v = v * self.scale[name] if self.scale[name] != 1.0 else v
                    columns.append(pa.array(np.ascontiguousarray(v)).cast(_arrow(spark_type)))
            yield pa.RecordBatch.from_arrays(columns, list(target))


def _arrow(kind: T.DataType) -> pa.DataType:
    known = {T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64()}
    if type(kind) not in known:
        raise ValueError(f"no records are read as {kind.simpleString()}")
    return known[type(kind)]


# ---------------------------------------------------------------- workbooks


class WorkbookSource(DataSource):
    """spark.read.format("workbook"): the rows of one sheet of each .xlsx workbook of a folder, under the names in its first row.

    Options: path, sheet. Without a schema the columns are the first workbook's and text. With one, its columns are taken by name and converted; one that a
    workbook lacks, or a cell that does not convert, is null. source_file in a schema is the workbook's name.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        address, _ = _files(self.options["path"], (".xlsx",))[0]
        with _open(address) as f:
            names = next(sheet_rows(f, self.options.get("sheet")), [])
        return T.StructType([T.StructField(n, T.StringType()) for n in [*[x for x in names if x], "source_file"]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: T.StructType):
        self.path, self.sheet, self.schema = path, sheet, schema

    def partitions(self) -> list[Part]:
        return [Part(address) for address, _ in _files(self.path, (".xlsx",))]

    def read(self, part: Part) -> Iterator[tuple]:
        with _open(part.address) as f:
            rows = sheet_rows(f, self.sheet)
            header = next(rows, [])
            at = {n: k for k, n in enumerate(header) if n}
            file = part.address.rsplit("/", 1)[-1]
            for row in rows:
                if any(v is not None for v in row):
                    yield tuple(file if f.name == "source_file" else _converted(row[at[f.name]] if at.get(f.name, len(row)) < len(row) else None, f.dataType) for f in self.schema)


def _converted(value: str | None, kind: T.DataType):
    """A cell's text as a type; null where it does not convert. Dates may be day numbers or ISO text."""
    if value is None or value == "" or isinstance(kind, T.StringType):
        return value or None
    try:
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(value[:10]) if "-" in value[1:] else _DAY_0 + dt.timedelta(days=int(float(value)))
        if isinstance(kind, T.IntegralType):
            return int(float(value))
        return float(value)
    except ValueError:
        return None


def sheet_rows(file, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The cells of each row of a sheet (the first, if none is named) as text, read row by row; an absent cell is None."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(file) as z:
        sheets = {s.get("name"): s.get(link) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet}; there are {sorted(sheets)}")
        wanted = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{main}row":
                    continue
                row: list[str | None] = []
                for c in e.iter(f"{main}c"):
                    column = 0
                    for letter in re.sub("[^A-Z]", "", c.get("r") or ""):
                        column = column * 26 + ord(letter) - 64
                    column = column - 1 if column else len(row)
                    v = c.find(f"{main}v")
                    text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    row += [None] * (column - len(row)) + [text]
                yield row
                e.clear()


def register(spark: SparkSession) -> None:
    """Make the formats records and workbook known to a session."""
    spark.dataSource.register(RecordSource)
    spark.dataSource.register(WorkbookSource)
