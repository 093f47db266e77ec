"""The streamed roll against the batch one, on half a year of legs cut into several arrivals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termgrid.operators import panel, roll
from termgrid.sources import roles
from termgrid.streaming import held

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def legs(spark, tmp_path_factory):
    """Each leg in four files by time, and one far later row that lets the watermark pass the last day."""
    folder, out = tmp_path_factory.mktemp("legs"), {}
    cut = F.col("dt") < "1995-07-01"
    made = {"domestic": roles.domestic(spark, SF).select("contract", "dt", "expiry", "price", "oi"), "offshore": roles.offshore(spark, SF).select("dt", "expiry", "cbot"), "fx": roles.fx(spark, SF)}
    last = {"domestic": ("Z", "2040-01-01", "2041-01", 1.0, 1.0), "offshore": ("2040-01-01", "2041-01", 1.0), "fx": ("2040-01-01", 1.0)}
    for name, df in made.items():
        df = df.filter(cut)
        for k, (a, b) in enumerate((("1990-01-01", "1995-03-01"), ("1995-03-01", "1995-05-01"), ("1995-05-01", "1995-07-01"))):
            df.filter((F.col("dt") >= a) & (F.col("dt") < b)).coalesce(1).write.parquet(f"{folder}/{name}/part{k}")
        end = spark.createDataFrame([last[name]], ", ".join(f"{c} {'string' if c == 'dt' else t}" for c, t in df.dtypes)).withColumn("dt", F.to_date("dt"))
        end.select(*df.columns).coalesce(1).write.parquet(f"{folder}/{name}/part3")
        out[name] = (f"{folder}/{name}", df.schema, df)
    return out


def test_held_days_equal_the_batch_roll(spark, legs, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    held.use_state_store(spark)
    try:
        streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path) for path, schema, _ in legs.values()]
        out = held.held_stream(held.stream_panel(*streams))
        q = out.writeStream.format("memory").queryName("held_days").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.table("held_days").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = roll.roll_spine(panel.build_spread(*[df for _, _, df in legs.values()]))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
