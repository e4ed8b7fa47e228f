"""Okapi BM25 over a corpus of texts.

Terms that more than half of the rows hold have a negative inverse document
frequency; they get a quarter of the mean over the vocabulary instead.

Frequencies are counted in each Arrow batch before they are shuffled. Scores are
computed where the rows lie, as a product of a batch's term weights with those
of a block of queries, and each batch keeps a query's best ``k``: neither
postings nor pairs of rows and queries are shuffled. What is sent for a block of
queries is bounded by ``BLOCK_TERMS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import tokens
from tidewell.operators.ranking import best_of_batch
from tidewell.storage import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct terms of a block of queries, and queries in it.
BLOCK_TERMS, BLOCK_QUERIES = 4096, 1024


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tokens.slices(batches, 1):
        row, code, times, names = tokens.counted(part.column(1))
        length = np.bincount(row, weights=times, minlength=part.num_rows).astype(np.int64)
        ids = part.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, pa.array(length[row]), names.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64())], names=["corpus_row", "dl", "term", "tf"])


def postings(corpus: DataFrame, row: str = "corpus_row", text: str = "text") -> DataFrame:
    """(corpus_row, dl, term, tf) for every term of every row."""
    return corpus.select(F.col(row).cast("long"), _text(text)).mapInArrow(_postings, "corpus_row bigint, dl bigint, term string, tf bigint")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, tf) of each batch; a row without a term has the number of rows."""
    for part in tokens.slices(batches, 0, rows=16_384):
        _, code, times, names = tokens.counted(part.column(0))
        df, tf = np.bincount(code, minlength=len(names)), np.bincount(code, weights=times, minlength=len(names))
        term = pa.concat_arrays([names.cast(pa.string()), pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_arrays([term, pa.array(np.append(df, part.num_rows), pa.int64()), pa.array(np.append(tf, 0).astype(np.int64))], names=["term", "df", "tf"])


def frequencies(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, tf) of the corpus, and a row with a null term and the number of rows as df; written to the shared folder."""
    counted = corpus.select(_text(text)).mapInArrow(_frequencies, "term string, df bigint, tf bigint")
    return materialize(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "frequencies")


def inverse_frequencies(counts: DataFrame) -> tuple[DataFrame, float]:
    """(term, df, idf) with the floor for common terms, and the mean number of terms of a row."""
    n, total = counts.agg(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.sum("tf")).first()
    n, total = n or 0, total or 0
    known = counts.where("term is not null").select("term", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = known.agg(F.avg("raw")).first()[0] or 0.0
    return known.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf")), (total / n if n else 0.0)


def _score(ids: np.ndarray, names: pa.Array, weights: np.ndarray, avgdl: float, k: int | None, matched: bool):
    """Best ``k`` rows of each batch for every query; weights: (term, query)."""
    named = ["query_id", "corpus_row", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.slices(batches, 1):
            n = part.num_rows
            row, code, times, held = tokens.counted(part.column(1))
            length = np.bincount(row, weights=times, minlength=n)
            column = pc.fill_null(pc.index_in(held, value_set=names), -1).to_numpy()[code] if len(held) else code
            met = column >= 0
            row, column, times = row[met], column[met], times[met]
            share = np.zeros((n, len(names)))
            if avgdl:
                share[row, column] = times * (K1 + 1) / (times + K1 * (1 - B + B * length[row] / avgdl))
            scores = np.round(share @ weights, 6) + 0.0
            if matched:
                scores[(share > 0).astype(np.float32) @ (weights != 0).astype(np.float32) == 0] = -np.inf
            query, rows, scores = best_of_batch(part.column(0).to_numpy(zero_copy_only=False), scores, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(rows), pa.array(scores)], names=named)

    return run


def _scored(corpus: DataFrame, queries: DataFrame, allowed: DataFrame | None, k: int | None, matched: bool) -> DataFrame:
    spark = corpus.sparkSession
    idf, avgdl = inverse_frequencies(frequencies(corpus))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), _text("text").alias("text"))
    every = asked.select("query_id").distinct()
    terms = postings(asked, "query_id").select(F.col("corpus_row").alias("query_id"), "term", F.col("tf").alias("times"))
    weighted = materialize(every.join(terms.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "query_id", "left"), "query-weights")
    rows = corpus if allowed is None else corpus.join(allowed, "corpus_row", "left_semi")
    rows = rows.where("corpus_row is not null").select(F.col("corpus_row").cast("long"), _text("text"))
    size = weighted.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).first()
    blocks = max(1, -(-size["n"] // BLOCK_TERMS), -(-size["q"] // BLOCK_QUERIES))
    found = []
    for block in range(blocks):
        mine = (weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        if not mine.num_rows:
            continue
        ids, query = np.unique(mine.column(0).to_numpy(), return_inverse=True)
        term = mine.column(1).cast(pa.large_binary()).combine_chunks().dictionary_encode()
        weights = np.zeros((len(term.dictionary), len(ids)))
        some = pc.is_valid(mine.column(1)).to_numpy(zero_copy_only=False)
        weights[term.indices.fill_null(0).to_numpy()[some], query[some]] = mine.column(2).to_numpy(zero_copy_only=False)[some]
        found.append(rows.mapInArrow(_score(ids, term.dictionary, weights, avgdl, k, matched), "query_id bigint, corpus_row bigint, score double"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id bigint, corpus_row bigint, score double")


def scores(corpus: DataFrame, queries: DataFrame, allowed: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, corpus_row, score) of rows that share a term with a query (query_id, text).

    ``allowed`` (corpus_row) restricts rows; the statistics stay those of all.
    With ``k``, at least the best ``k`` of each query, which ``best`` then ranks.
    """
    return _scored(corpus, queries, allowed, k, True)


def best(scored: DataFrame, k: int, tie: str = "corpus_row", by: tuple[str | Column, ...] = ("query_id",)) -> DataFrame:
    """The best ``k`` rows for each query, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Top ``k`` rows for each query; a row without any of its terms scores 0, which is above a negative score."""
    found = best(_scored(corpus, queries, allowed, k, False), k)
    return found.select("query_id", "corpus_row", "score", F.col("rank").cast("int").alias("rank"))
