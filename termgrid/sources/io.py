"""Reading and writing: price files, drifting schemas, named layers of tables."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("raw", "processed", "features")


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column: NaN would order above all numbers and spoil averages."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def load_prices(spark: SparkSession, path: str, schema: str, date_column: str = "date") -> DataFrame:
    """A CSV file with a header; the date column is parsed, NaN becomes null. Order is left to the consumer's windows."""
    df = spark.read.csv(path, header=True, schema=schema)
    return clean_nan(df.withColumn(date_column, F.to_date(date_column)))


def union_drifting(frames: list[DataFrame], core: list[str] | dict[str, str] | None = None) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there. core names the columns to keep, all of which exist after,
    and, where it is a dictionary, their types."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if core is None:
        return out
    kinds = core if isinstance(core, dict) else {c: dict(out.dtypes).get(c, "string") for c in core}
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def load_workbook_rows(spark: SparkSession, paths: list[str], core: list[str] | dict[str, str], codes: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Rows landed as CSV, one file a workbook, in order of preference: keep the first row of each key.

    codes maps a column to the values that are kept. Adds source_file and file_rank.
    """
    from ..operators.panel import keep_first

    frames = [spark.read.csv(p, header=True).withColumns({"source_file": F.element_at(F.split(F.input_file_name(), "/"), -1), "file_rank": F.lit(k)}) for k, p in enumerate(paths)]
    if not frames:
        raise FileNotFoundError("no workbook files")
    kinds = core if isinstance(core, dict) else dict.fromkeys(core, "string")
    df = union_drifting(frames, kinds | {"source_file": "string", "file_rank": "int"})
    for column, values in codes.items():
        df = df.filter(F.col(column).isin(*values))
    return keep_first(df, keys, ["file_rank"])


def load_workbooks(spark: SparkSession, folder: str, sheet: str, core: dict[str, str], codes: dict[str, list[str]], keys: list[str], zero_to_missing: tuple[str, ...] = ()) -> DataFrame:
    """The core columns of a sheet of every workbook of a folder, with codes' values only, zeros of some columns as null, and of
    each key the row of the first workbook by name. Adds source_file. A column that a workbook lacks is null."""
    from ..operators.panel import keep_first, zero_to_null
    from .files import register

    register(spark)
    schema = ", ".join(f"`{c}` {t}" for c, t in (core | {"source_file": "string"}).items())
    df = spark.read.format("workbook").schema(schema).option("path", folder).option("sheet", sheet).load()
    for column, values in codes.items():
        df = df.filter(F.col(column).isin(*values))
    return keep_first(zero_to_null(df, *zero_to_missing) if zero_to_missing else df, keys, ["source_file"])


def data_path(root: str, product: str, layer: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"the layer is one of {LAYERS}")
    return f"{root.rstrip('/')}/{product}/data/{layer}"


def save_layer(df: DataFrame, root: str, product: str, name: str, layer: str = "processed", partition_by: tuple[str, ...] = ()) -> str:
    path = f"{data_path(root, product, layer)}/{name}.parquet"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def load_layer(spark: SparkSession, root: str, product: str, name: str, layer: str = "processed") -> DataFrame:
    """Spark's own error names the path where the table is absent."""
    return spark.read.parquet(f"{data_path(root, product, layer)}/{name}.parquet")


def input_fingerprint(*inputs: DataFrame) -> str:
    """A hash of the path, size and time of change of every file that the file-based inputs read.

    The files' own metadata columns are read, no data columns, and combined by one aggregate of three numbers for each input.
    """
    parts = []
    for df in inputs:
        files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
        parts.append(files.agg(F.count("*"), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first())
    return hashlib.sha256(repr([tuple(p) for p in parts]).encode()).hexdigest()[:16]


def cached_layer(spark: SparkSession, root: str, product: str, name: str, build, layer: str = "processed", fingerprint: str | None = None, inputs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The stored table, or build()'s result stored first. The files of inputs, or a fingerprint that the caller gives, name the
    table, so that it is built anew once one of them has changed; without either, whether it is stale is the caller's to know."""
    fingerprint = input_fingerprint(*inputs) if inputs else fingerprint
    name = f"{name}-{fingerprint}" if fingerprint else name
    from pyspark.errors import AnalysisException

    try:
        return load_layer(spark, root, product, name, layer)
    except AnalysisException:
        save_layer(build(), root, product, name, layer)
        return load_layer(spark, root, product, name, layer)


def stack_ohlcv(frames: dict[str, DataFrame]) -> DataFrame:
    """Daily bars of several names in one long table with a name column."""
    return union_drifting([df.withColumn("name", F.lit(n)) for n, df in frames.items()])
