"""Measures of searches: percentiles, recall, crossover; and limits on requests by window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def percentile(values: Column, p: float) -> Column:
    """The value at index floor(p * (n - 1)) of a sorted array, without interpolation."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def latencies(samples: DataFrame, by: str, value: str) -> DataFrame:
    """n, p50, p95 and rate (n over the sum) for each group, by rank within it, so no group is gathered."""
    w = Window.partitionBy(by)
    ranked = samples.where(F.col(value).isNotNull()).withColumn("__at", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("__at") == F.floor(F.lit(p) * (F.col("__n") - 1)), F.col(value)))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.count("*") / F.sum(value), 6).alias("rate"))


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact best ``k`` that the approximate best ``k`` hold."""
    e, a = (x.where(F.col("rank") <= k).select("query_id", "corpus_row") for x in (exact, approximate))
    hits = e.join(a, ["query_id", "corpus_row"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return e.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def crossover(sweep: DataFrame) -> DataFrame:
    """``sweep`` (n, exact, approximate) with the speedup, and the sizes where it first passes 1."""
    speedup = F.when(F.col("approximate") > 0, F.col("exact") / F.col("approximate")).otherwise(0.0)
    rated = sweep.withColumn("speedup", F.round(speedup, 6))
    before = F.lag("speedup").over(Window.orderBy("n"))  # a row for each size measured
    return rated.withColumn("crossover", (F.col("speedup") > 1) & (before.isNull() | (before <= 1)))


def limit_aligned(requests: DataFrame, limit: int, window: str = "1 day") -> DataFrame:
    """(key, ts, id, allowed): the first ``limit`` requests of each clock-aligned window pass."""
    w = Window.partitionBy("key", F.window("ts", window)).orderBy("ts", "id")
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


def _walk(limit: int, seconds: int):
    """Requests sorted by key and time pass once; a key's window goes on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = object()
        key, opened, n = missing, -np.inf, 0
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            allowed = np.zeros(len(keys), dtype=bool)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key:
                    key, opened, n = keys[start], -np.inf, 0
                i = start
                while i < end:
                    if at[i] >= opened + seconds:
                        opened, n = at[i], 0
                    upto = max(i + 1, start + int(np.searchsorted(at[start:end], opened + seconds)))
                    allowed[i:upto] = n + np.arange(1, upto - i + 1) <= limit
                    n, i = n + upto - i, upto
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed)], names=["key", "id", "allowed"])

    return run


def limit_first_hit(requests: DataFrame, limit: int, seconds: int = 86_400) -> DataFrame:
    """(key, id, allowed): a key's window opens with a request and lasts ``seconds``; requests in order of time and id.

    A key's requests stream past in one task, as each window hangs on the one
    before; none are gathered.
    """
    timed = requests.select("key", F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("id").cast("long").alias("id")).where("at is not null")
    placed = timed.repartition("key").sortWithinPartitions("key", "at", "id")
    return placed.mapInArrow(_walk(limit, seconds), T.StructType([requests.schema["key"], T.StructField("id", T.LongType()), T.StructField("allowed", T.BooleanType())]))
