"""Exact and approximate nearest-vector search.

Exact search is a matrix product for each Arrow batch of the corpus, keeping
each query's best rows of the batch; the best of all batches are then ranked.
Queries are sent to the executors in blocks of at most ``BLOCK`` vectors.

Approximate search reads an inverted file that is kept as tables: rows lie
sorted by the nearest of about sqrt(N) centres, and a query meets only the rows
of the cells nearest to it, as many as reach a stated recall on a sample. New
rows are added to their cells; the centres stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.bm25 import best
from tidewell.operators.ranking import best_of_batch

#: Queries that are sent at a time, and rows that are scored at a time.
BLOCK, ROWS = 4096, 1024
#: Vectors that centres are fitted to, and the recall on them that decides how many cells are probed.
SAMPLE, RECALL = 20_000, 0.95
_CELLS = "corpus_row bigint, embedding array<float>, cell int"
TINY = 1e-12
METRICS = ("cosine", "dot", "l2")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a vector shorter than 1e-12 stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length < TINY, 1.0).otherwise(length))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def similarity(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is nearer: cosine, inner product, or the negated squared distance."""
    if metric == "cosine":
        return (rows / (np.linalg.norm(rows, axis=1, keepdims=True) + TINY)) @ (queries / (np.linalg.norm(queries, axis=1, keepdims=True) + TINY)).T
    dots = rows @ queries.T
    if metric == "dot":
        return dots
    return 2 * dots - (rows * rows).sum(axis=1)[:, None] - (queries * queries).sum(axis=1)[None, :]


def _nearest(ids: np.ndarray, queries: np.ndarray, metric: str, k: int, probed: np.ndarray | None = None):
    """``probed`` (cell, query) says which rows, by their cell in the third column, a query meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                rows, x = part.column(0).to_numpy(), matrix(part.column(1))
                if x.shape[1] != queries.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} numbers meet queries of {queries.shape[1]}")
                if probed is None:
                    scores = np.round(similarity(x, queries, metric), 6) + 0.0
                else:
                    scores = np.full((len(rows), len(ids)), -np.inf)
                    cells = part.column(2).to_numpy()
                    for cell in np.unique(cells):
                        which = probed[cell].nonzero()[0]
                        mine = (cells == cell).nonzero()[0]
                        if len(which):
                            scores[np.ix_(mine, which)] = np.round(similarity(x[mine], queries[which], metric), 6) + 0.0
                query, found, values = best_of_batch(rows, scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(values)], names=["query_id", "corpus_row", "score"])

    return run


def blocks_of(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of ``queries`` (query_id, embedding), at most ``BLOCK`` or so at a time."""
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), "embedding")
    first = asked.limit(BLOCK + 1).toArrow().combine_chunks()
    n = 1 if first.num_rows <= BLOCK else -(-asked.count() // BLOCK)
    for i in range(n):
        block = first if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow().combine_chunks()
        if block.num_rows:
            yield block.column(0).to_numpy(), matrix(block.column(1).combine_chunks())


_FOUND = "query_id bigint, corpus_row bigint, score double"


def _ranked(spark: SparkSession, found: list[DataFrame], k: int) -> DataFrame:
    if not found:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    return best(reduce(DataFrame.unionByName, found), k).withColumn("rank", F.col("rank").cast("int"))


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, corpus_row, score, rank): ``corpus`` (corpus_row, embedding), ``queries`` (query_id, embedding)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = corpus.where("embedding is not null").select(F.col("corpus_row").cast("long"), "embedding")
    found = [rows.mapInArrow(_nearest(ids, x, metric, k), _FOUND) for ids, x in blocks_of(queries)]
    return _ranked(corpus.sparkSession, found, k)


def checked(ids: DataFrame, dim: int, key: str = "corpus_row") -> DataFrame:
    """``ids`` (key, embedding, ...) as they are; a null id, a repeated id or a vector of another width is an error."""
    odd = ids.agg(F.count(F.when(F.col(key).isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim), 1)).alias("n")).first()["n"]
    if odd:
        raise ValueError(f"{odd} rows have no id or no vector of {dim} numbers")
    twice = ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the id {twice[0][key]} is there {twice[0]['n']} times")
    return ids


def search_scoped(corpus: DataFrame, queries: DataFrame, k: int, allowed: Column, fetch: int | None = None) -> DataFrame:
    """Only rows for which ``allowed`` holds: before the ranking, or, with ``fetch``, after the best ``fetch`` of all."""
    if fetch is None:
        return search(corpus.where(allowed), queries, k)
    wide = search(corpus, queries, fetch).drop("rank").join(corpus.drop("embedding"), "corpus_row").where(allowed)
    return best(wide.select("query_id", "corpus_row", "score"), k).withColumn("rank", F.col("rank").cast("int"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)


def _centres(x: np.ndarray, cells: int, metric: str) -> np.ndarray:
    """Centres of ``x`` by rounds of Lloyd's algorithm, the first spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(10):
        near = similarity(x, centres, metric).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        begins = np.searchsorted(near[order], np.arange(cells))
        some = np.diff(begins, append=len(x)) > 0
        centres[some] = np.add.reduceat(x[order], begins[some], axis=0) / np.diff(begins, append=len(x))[some, None]
        if metric == "cosine":
            centres = _unit(centres)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, metric: str, recall: float, k: int = 10, asked: int = 200) -> int:
    """The fewest cells in which vectors of the sample find ``recall`` of their best ``k`` others."""
    own = similarity(x, centres, "cosine" if metric == "cosine" else "l2").argmax(axis=1)
    some = x[:: max(1, len(x) // asked)]
    order = np.argsort(-similarity(some, centres, metric), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    top = np.argsort(-similarity(some, x, metric), axis=1, kind="stable")[:, : k + 1]
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


class CellIndex:
    """An inverted file below ``path``: tables of centres, of rows by cell, and of parameters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.params = spark.read.json(f"{path}/params").first().asDict()
        kept = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        self.centres = matrix(kept.column("centre").combine_chunks()) if kept.num_rows else np.zeros((0, self.params["dim"]))

    @staticmethod
    def build(corpus: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, recall: float = RECALL, sample: int = SAMPLE, seed: int = 42) -> CellIndex:
        """Index ``corpus`` (corpus_row, embedding); centres and probes come from at most ``sample`` rows, all rows are indexed."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        spark = corpus.sparkSession
        rows = corpus.where("corpus_row is not null and embedding is not null").select(F.col("corpus_row").cast("long"), F.col("embedding").cast("array<float>"))
        n = rows.count()
        chosen = rows.orderBy(F.xxhash64(F.lit(seed), "corpus_row"), "corpus_row").limit(sample).select("embedding").toArrow().combine_chunks()
        x = matrix(chosen.column(0).combine_chunks()) if chosen.num_rows else np.zeros((0, 1))
        x = _unit(x) if metric == "cosine" else x
        cells = min(len(x), cells or min(4096, math.ceil(math.sqrt(n))))
        centres = _centres(x, cells, "cosine" if metric == "cosine" else "l2") if cells else np.zeros((0, x.shape[1]))
        probes = _probes(x, centres, metric, recall) if cells else 0
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        spark.createDataFrame([(metric, int(x.shape[1]), cells, probes)], "metric string, dim int, cells int, probes int").coalesce(1).write.mode("overwrite").json(f"{path}/params")
        index = CellIndex(spark, path)
        index._write(rows, "overwrite")
        return index

    def _write(self, rows: DataFrame, mode: str) -> None:
        near = "cosine" if self.params["metric"] == "cosine" else "l2"
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                    cell = similarity(matrix(part.column(1)), centres, near).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell)], names=["corpus_row", "embedding", "cell"])

        assigned = rows.mapInArrow(run, _CELLS) if len(centres) else self.spark.createDataFrame([], _CELLS)
        # A cell that holds very many rows is cut by their ids.
        assigned.repartitionByRange("cell", F.pmod(F.xxhash64("corpus_row"), F.lit(64))).sortWithinPartitions("cell", "corpus_row").write.mode(mode).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/rows")

    def add(self, rows: DataFrame) -> None:
        """Index further rows (corpus_row, embedding) with the same centres; an empty index is built anew."""
        rows = rows.where("corpus_row is not null and embedding is not null").select(F.col("corpus_row").cast("long"), F.col("embedding").cast("array<float>"))
        if not len(self.centres):
            made = CellIndex.build(rows, self.path, self.params["metric"])
            self.params, self.centres = made.params, made.centres
        else:
            self._write(checked(rows, self.params["dim"]), "append")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, corpus_row, score, rank) among the rows of each query's nearest cells, scored exactly there."""
        metric, found = self.params["metric"], []
        rows = self.rows() if allowed is None else self.rows().join(allowed, "corpus_row", "left_semi").select("corpus_row", "embedding", "cell")
        for ids, x in blocks_of(queries) if len(self.centres) else ():
            few = min(len(self.centres), probes or self.params["probes"])
            probed = np.zeros((len(self.centres), len(ids)), dtype=bool)
            order = np.argsort(-similarity(x, self.centres, metric), axis=1, kind="stable")[:, :few]
            probed[order, np.arange(len(ids))[:, None]] = True
            cells = probed.any(axis=1).nonzero()[0].tolist()
            mine = rows if len(cells) == len(self.centres) else rows.where(F.col("cell").isin(cells))
            found.append(mine.mapInArrow(_nearest(ids, x, metric, k, probed), _FOUND))
        return _ranked(self.spark, found, k)
