"""Sharding (operator 4): a uniform shuffle into shards of exact size, with DataFrame functions only.

How many rows of each input partition go to each shard is one draw from the
multivariate hypergeometric distribution: what a uniform shuffle of all rows
would give. Rows are permuted within their partition, dealt out by those exact
counts, and permuted again within their shard. The second permutation cuts a
shard into ranges of a random key, so no task sorts a whole shard.

Only a row's key, size and checksum move; the counts on the driver are at most
``MAX_PARTS`` times the number of shards, however large the table is.

Defined cases: a null text has no bytes and the checksum of an empty one;
repeated rows, ties and null keys are dealt like any others; very long texts are
only measured, and never moved; an empty table gives no rows; columns of ``rows``
beyond the listed ones are kept out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.storage import materialize

#: Input partitions beyond this many are counted together.
MAX_PARTS = 4096
#: Rows of a shard that one task sorts at a time.
SORTED_ROWS = 4096


def _outwards(ratio: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Chances of the values beyond the mode, relative to the mode's, until they no longer count."""
    found = np.ones(1)
    while len(found) <= steps and found[-1] > 1e-25:
        at = np.arange(len(found) - 1, min(steps, 2 * len(found) + 62), dtype=np.float64)
        found = np.concatenate([found, found[-1] * np.cumprod(ratio(at))])
    return found[1:]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good`` + ``bad``, by inversion of the chances of all values, however many rows there are."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    up = _outwards(lambda x: (good - mode - x) * (draws - mode - x) / ((mode + x + 1) * (bad - draws + mode + x + 1)), high - mode)
    down = _outwards(lambda x: (mode - x) * (bad - draws + mode - x) / ((good - mode + x + 1) * (draws - mode + x + 1)), mode - low)
    chances = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return mode - len(down) + int(min(np.searchsorted(chances, rng.random() * chances[-1], side="right"), len(chances) - 1))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: the law of a uniform shuffle, margins exact."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    matrix = []
    for n in counts:
        rest, want, row = sum(left), n, []
        for room in left:
            take = _hypergeometric(rng, room, rest - room, want)
            row.append(take)
            rest -= room
            want -= take
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_rows(rows: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: shard sizes differ by one at most, and every order is equally likely."""
    spark = rows.sparkSession
    names = rows.columns
    numbered = rows.withColumn("__part", F.spark_partition_id() % MAX_PARTS).withColumn("__row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    counted = sorted((r["__part"], r["n"]) for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counted)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([n for _, n in counted], sizes, seed)
    bounds = [(part, [int(x) for x in np.cumsum(row)]) for (part, _), row in zip(counted, matrix, strict=True)]
    table = spark.createDataFrame(bounds, T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__upto", T.ArrayType(T.LongType()))]))

    within = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), F.col("__row")), "__row")
    local = numbered.withColumn("__rank", F.row_number().over(within) - 1)
    dealt = local.join(F.broadcast(table), "__part").withColumn("shard", F.size(F.filter("__upto", lambda x: x <= F.col("__rank"))))

    cuts = 1 << max(0, math.ceil(math.log2(max(1, total / shards / SORTED_ROWS))))
    key = F.xxhash64(F.lit(seed + 1), F.col("__row"))
    dealt = dealt.select(*names, "shard", "__row", key.alias("__key")).withColumn("__cut", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("__key")), F.lit(cuts)))
    dealt = materialize(dealt, "dealt")
    held = dealt.groupBy("shard", "__cut").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("shard", "__cut", F.coalesce(before, F.lit(0)).alias("__before"))
    again = Window.partitionBy("shard", "__cut").orderBy("__key", "__row")
    placed = dealt.withColumn("__place", F.row_number().over(again) - 1).join(held, ["shard", "__cut"])
    return placed.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("__before") + F.col("__place")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """Documents (doc_id, text) with their size and checksum in shards whose counts are at most one apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
