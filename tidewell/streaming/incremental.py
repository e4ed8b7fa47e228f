"""Streaming forms: ingestion of new document versions, and request limits whose window opens at the first hit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tidewell.operators import corpus


def limit_stream(requests: DataFrame, limit: int, seconds: int = 86_400) -> DataFrame:
    """(key, id, allowed) of a stream (key, ts, id); within a key, requests must arrive in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (-1e18, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"], ignore_index=True)
        allowed = []
        for at in rows["at"]:
            opened, n = (at, 1) if at >= opened + seconds else (opened, n + 1)
            allowed.append(n <= limit)
        state.update((float(opened), int(n)))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "allowed": allowed})

    timed = requests.select("key", F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("id").cast("long"))
    return timed.groupBy("key").applyInPandasWithState(run, "key bigint, id bigint, allowed boolean", "opened double, n int", "append", GroupStateTimeout.NoTimeout)


def window_counts(requests: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests of each key in each clock-aligned window; those later than ``late`` are left out."""
    timed = requests.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "key").agg(F.count("*").alias("n"))


def ingest_stream(arriving: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Append new and changed documents (document, text) of a stream to the table at ``path``.

    Every version of a document in a batch is stored, in order of arrival; a
    row is skipped if its text is that of the version before it. The order is
    that of the columns ``order`` (equal ones in the order of their checksums),
    or, for files, that of their times, their paths and the rows in them. Rows
    without a document are left out. A batch that is run again after a failure
    replaces its own folder, so nothing is stored twice.
    """
    file = () if order else ("file_modification_time", "file_path", "file_block_start")
    keys = [f"__at{i}" for i in range(len(order or file))]
    arrived = arriving.select("document", "text", *[F.col(c if order else f"_metadata.{c}").alias(k) for c, k in zip(order or file, keys, strict=True)])

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = F.lit(0) if order else F.monotonically_increasing_id()  # rows of a file's part lie in one partition
        hashed = batch.withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("__nth", last)
        schema = "document string, version int, checksum string, text string"
        try:
            stored = spark.read.schema(f"{schema}, batch bigint").parquet(path).where(F.col("batch") < number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], schema)
        now = corpus.latest(stored).select("document", F.col("checksum").alias("__stored"), F.col("version").alias("__version"))
        w = Window.partitionBy("document").orderBy(*keys, "__nth", "checksum")
        before = F.coalesce(F.lag("checksum").over(w), F.col("__stored"))
        fresh = hashed.where("document is not null").join(now, "document", "left").withColumn("__before", before).where(~F.col("checksum").eqNullSafe(F.col("__before")))
        version = (F.coalesce("__version", F.lit(0)) + F.row_number().over(w)).cast("int").alias("version")
        fresh.select("document", version, "checksum", "text").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
