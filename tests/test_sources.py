"""Record files, workbooks, fingerprints of inputs and the unique key, on files that the tests write."""

from __future__ import annotations

import os
import zipfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from termgrid.operators import panel
from termgrid.sources import files, io

LAYOUT = "ts:i8, kind:u1, pad:x3, close:i8:1e-9, symbol:S6, volume:u4"


@pytest.fixture(scope="module")
def records(tmp_path_factory, spark):
    """Two plain files and a compressed one, each with a header of 5 bytes."""
    files.register(spark)
    folder = tmp_path_factory.mktemp("records")
    kind, rows = np.dtype([("ts", "<i8"), ("kind", "u1"), ("pad", "V3"), ("close", "<i8"), ("symbol", "S6"), ("volume", "<u4")]), []
    for name, first, n in (("a.bin", 0, 250), ("b.bin.zst", 250, 40_000), ("c.bin", 40_250, 3)):
        t = np.zeros(n, dtype=kind)
        t["ts"], t["kind"], t["volume"] = np.arange(first, first + n), 7, np.arange(n) % 1000
        t["close"], t["symbol"] = (np.arange(n) - 5) * 10**9 // 4, [f"ZC{i % 50}".encode() for i in range(n)]
        raw = b"HEAD\n" + t.tobytes()
        (folder / name).write_bytes(zstandard.compress(raw) if name.endswith("zst") else raw)
        rows += [(int(r["ts"]), float(r["close"]) * 1e-9, r["symbol"].decode(), int(r["volume"])) for r in t]
    return str(folder), rows


def reader(spark, folder, **options):
    return spark.read.format("records").options(path=folder, layout=LAYOUT, header=5, **options)


def test_records_are_read_in_parts(spark, records):
    folder, rows = records
    df = reader(spark, folder, records=100).load()
    assert df.dtypes == [("ts", "bigint"), ("kind", "smallint"), ("close", "double"), ("symbol", "string"), ("volume", "bigint")]
    assert sorted(tuple(r) for r in df.select("ts", "close", "symbol", "volume").collect()) == rows
    assert df.rdd.getNumPartitions() == 3 + 1 + 1


def test_only_the_columns_of_a_schema_are_made(spark, records):
    folder, rows = records
    got = reader(spark, folder).schema("symbol string, ts long").load()
    assert got.columns == ["symbol", "ts"]
    assert {(r.ts, r.symbol) for r in got.collect()} == {(t, s) for t, _, s, _ in rows}
    made = files.RecordReader(folder, LAYOUT, 5, 100, got.schema)
    assert [b.schema.names for b in made.read(made.partitions()[0])] == [["symbol", "ts"]]


def test_broken_record_files_are_named(spark, records, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"HEAD\n" + b"1" * 31)
    with pytest.raises(Exception, match="whole records"):
        reader(spark, str(tmp_path)).load().count()
    with pytest.raises(Exception, match="no files"):
        reader(spark, str(tmp_path / "nothing")).load().count()
    with pytest.raises(Exception, match="unknown field type"):
        spark.read.format("records").options(path=str(tmp_path), layout="a:q9").load()


def workbook(path, sheets, shared):
    """A workbook as spreadsheet programs write it; shared puts texts into the shared table."""
    texts: list[str] = []

    def cell(r, c, v):
        at = f"{chr(65 + c)}{r}" if c < 26 else f"A{chr(65 + c - 26)}{r}"
        if v is None:
            return ""
        if isinstance(v, str):
            if not shared:
                return f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            texts.append(v)
            return f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        if texts:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    old = [["TradeDate", "Name", "Low", "Close"], [40182, "YM", 0, 1500.5], [40183, "XX", 3, 1], [40183, "YM", 7, None], [None, None, None, None]]
    new = [["TradeDate", "Extra", "Name", "Close", "Low", "OI"], ["2010-01-05", "e", "YM", 9999, 5, 12], ["2010-01-06", None, "WM", "n/a", 6, 30], [40185, None, "WM", 2.25, None, 31]]
    workbook(folder / "2010.xlsx", {"Other": [["a"], [1]], "Prices": old}, True)
    workbook(folder / "2011.xlsx", {"Prices": new}, False)
    return str(folder)


def test_workbooks_are_one_table(spark, books):
    import datetime as dt

    df = io.load_workbooks(spark, books, "Prices", {"TradeDate": "date", "Name": "string", "Low": "double", "Close": "double", "OI": "int"}, {"Name": ["YM", "WM"]}, ["TradeDate", "Name"], ("Low",))
    assert {tuple(r) for r in df.select("TradeDate", "Name", "Low", "Close", "OI", "source_file").collect()} == {
        (dt.date(2010, 1, 4), "YM", None, 1500.5, None, "2010.xlsx"), (dt.date(2010, 1, 5), "YM", 7.0, None, None, "2010.xlsx"),
        (dt.date(2010, 1, 6), "WM", 6.0, None, 30, "2011.xlsx"), (dt.date(2010, 1, 7), "WM", None, 2.25, 31, "2011.xlsx"),
    }


def test_workbooks_without_a_schema_are_text(spark, books):
    files.register(spark)
    df = spark.read.format("workbook").options(path=books, sheet="Prices").load()
    assert df.columns == ["TradeDate", "Name", "Low", "Close", "source_file"] and df.count() == 6 and df.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").schema("a string").options(path=books, sheet="Missing").load().count()


def test_a_changed_input_is_parsed_again(spark, tmp_path):
    path, made = tmp_path / "in", []
    for k in range(2):
        spark.range(5).coalesce(1).write.mode("append").parquet(str(path))
    source = lambda: spark.read.parquet(str(path))
    build = lambda: made.append(1) or source().agg(F.count("*").alias("n"))
    take = lambda: io.cached_layer(spark, str(tmp_path), "p", "t", build, inputs=(source(),)).first().n
    assert (take(), take(), len(made)) == (10, 10, 1)
    spark.range(3).coalesce(1).write.mode("append").parquet(str(path))
    assert (take(), take(), len(made)) == (13, 13, 2)
    one = next(p for p in sorted(path.iterdir()) if p.name.endswith(".parquet"))
    os.utime(one, (1, 1))
    assert (take(), len(made)) == (13, 3)


def test_two_offshore_rows_of_a_key_are_an_error(spark):
    rows = [(1, "a", 2.0), (1, "b", 3.0)]
    df = spark.createDataFrame(rows, "dt int, expiry string, cbot double")
    assert sorted(tuple(r) for r in panel.unique(df, "dt", "expiry").collect()) == rows
    with pytest.raises(Exception, match="rows share"):
        panel.unique(df.unionByName(df.limit(1)), "dt", "expiry").collect()


