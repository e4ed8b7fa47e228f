"""Streams give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import metrics
from tidewell.streaming import incremental


def test_limits_as_in_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("key"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.limit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 600)
    running = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert sorted(spark.table("limits").collect()) == sorted(metrics.limit_first_hit(rows, 2, 600).collect())


def test_ingest_skips_what_is_known(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame(rows, "document string, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        source = spark.readStream.schema("document string, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        incremental.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    arrive(1, [("a", "x"), ("b", "y")])
    arrive(2, [("a", "x"), ("b", "z"), ("c", "w")])
    got = {(r.document, r.version, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z"), ("c", 1, "w")}


def test_ingest_stores_every_version_of_a_batch_in_order(spark, tmp_path):
    def stored(source, at, order=()):
        incremental.ingest_stream(source, str(tmp_path / f"out{at}"), str(tmp_path / f"cp{at}"), order).awaitTermination(120)
        return sorted((r.document, r.version, r.text) for r in spark.read.parquet(str(tmp_path / f"out{at}")).collect())

    def arrive(n, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    schema = "document string, text string, nth long"
    arrive(1, [("a", "x", 9), ("a", "x", 8), ("a", "y", 7), ("b", None, 6), ("a", "x", 5)], schema)
    source = arrive(2, [("a", "x", 4), *((f"fill{i}", "f" * 500, 0) for i in range(200)), ("a", "z", 3), ("b", "", 2), ("b", "w", 1)], schema)
    mine = lambda rows: [r for r in rows if r[0] in "ab"]
    assert mine(stored(source, 1)) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 1, None), ("b", 2, "w")]
    assert mine(stored(source, 2, ["nth"])) == [("a", 1, "z"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, "w"), ("b", 2, "")]
    source = arrive(3, [("a", "z", 10), ("a", "v", 11), ("b", "w", 12), ("b", "u", 13), ("c", "t", 14), ("c", "s", 15)], schema)
    assert stored(source, 1)[:6] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("a", 5, "v"), ("b", 1, None)]
    assert [r for r in stored(source, 1) if r[0] in "bc"] == [("b", 1, None), ("b", 2, "w"), ("b", 3, "u"), ("c", 1, "t"), ("c", 2, "s")]
