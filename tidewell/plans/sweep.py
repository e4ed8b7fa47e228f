"""Exact against approximate search over corpora of growing size, made of tiled vectors with noise."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import metrics, vectors
from tidewell.storage import materialize, scratch


def synthetic(seeds: DataFrame, n: int, sigma: float = 0.01, seed: int = 42) -> DataFrame:
    """(corpus_row, seed_row, embedding): ``n`` rows that repeat ``seeds`` (corpus_row, embedding) in turn, with normal noise.

    The noise of a number is drawn from a hash of its row and place, so the
    result doesn't hang on how the rows are partitioned.
    """
    size = seeds.count()
    if not size:
        raise ValueError("there is no vector to repeat")
    numbered = seeds.select((F.row_number().over(_order()) - 1).cast("long").alias("seed_row"), "embedding")  # a small table
    rows = seeds.sparkSession.range(n).select(F.col("id").alias("corpus_row"), (F.col("id") % size).alias("seed_row"))
    even = lambda *of: (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    normal = lambda i: F.sqrt(-2.0 * F.log(even(F.col("corpus_row"), i, F.lit(1)))) * F.cos(2 * 3.141592653589793 * even(F.col("corpus_row"), i, F.lit(2)))
    moved = F.transform("embedding", lambda x, i: (x + sigma * normal(i)).cast("float"))
    return rows.join(numbered, "seed_row").select("corpus_row", "seed_row", moved.alias("embedding"))


def _order():
    from pyspark.sql.window import Window

    return Window.orderBy("corpus_row")


def timed(run, times: int, warm: int = 1) -> list[float]:
    """Milliseconds of each of ``times`` runs, after some that aren't counted."""
    took = []
    for i in range(warm + times):
        began = time.perf_counter()
        run()
        if i >= warm:
            took.append((time.perf_counter() - began) * 1000)
    return took


def sweep(seeds: DataFrame, queries: DataFrame, sizes: Sequence[int], k: int = 5, times: int = 3, sigma: float = 0.01) -> DataFrame:
    """(n, exact, exact_p95, approximate, approximate_p95, recall, speedup, crossover) for each size; milliseconds a batch of queries."""
    spark, rows = seeds.sparkSession, []
    for n in sizes:
        corpus = materialize(synthetic(seeds, n, sigma), "sweep")
        index = vectors.CellIndex.build(corpus, scratch(spark, "sweep-index"))
        exact, near = vectors.search(corpus, queries, k), index.search(queries, k)
        a, b = (timed(lambda: x.write.format("noop").mode("overwrite").save(), times) for x in (exact, near))  # noqa: B023
        found = metrics.recall(exact, near, k).agg(F.avg("recall")).first()[0]
        rows += [(n, "exact", t, found) for t in a] + [(n, "approximate", t, found) for t in b]
    measured = spark.createDataFrame(rows, "n long, kind string, ms double, recall double")
    stats = metrics.latencies(measured.withColumn("of", F.concat_ws(":", "n", "kind")), "of", "ms").select(F.split("of", ":")[0].cast("long").alias("n"), F.split("of", ":")[1].alias("kind"), "p50", "p95")
    wide = stats.groupBy("n").pivot("kind", ["exact", "approximate"]).agg(F.first("p50").alias("p50"), F.first("p95").alias("p95"))
    wide = wide.select("n", F.col("exact_p50").alias("exact"), "exact_p95", F.col("approximate_p50").alias("approximate"), "approximate_p95")
    return metrics.crossover(wide.join(measured.groupBy("n").agg(F.first("recall").alias("recall")), "n"))


def same_after_loading(seeds: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, same): whether an index that is saved and opened again finds the same rows, twice."""
    path = scratch(seeds.sparkSession, "kept-index")
    first = vectors.CellIndex.build(seeds, path).search(queries, k)
    listed = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "corpus_row", "score"))).alias(name))
    again, third = (vectors.CellIndex(seeds.sparkSession, path).search(queries, k) for _ in range(2))
    joined = listed(first, "a").join(listed(again, "b"), "query_id").join(listed(third, "c"), "query_id")
    return joined.select("query_id", ((F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))).alias("same"))
