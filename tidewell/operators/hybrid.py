"""Hybrid retrieval: dense and keyword candidates, min-max scaled, weighted, merged, diversified, re-ranked."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.text import terms
from tidewell.operators import bm25, vectors
from tidewell.operators.bm25 import best
from tidewell.storage import materialize


def minmax(scored: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``scaled`` from 0 to 1 within each query; 1 for all where scores don't differ."""
    w = Window.partitionBy(*by)
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return scored.withColumn("scaled", F.when(span < 1e-12, 1.0).otherwise((F.col("score") - low) / span))


def fuse(dense: DataFrame, sparse: DataFrame, semantic: float = 0.65, keyword: float = 0.35) -> DataFrame:
    """(query_id, corpus_row, score) of the union of both sides; a side that lacks a row gives it 0."""
    d = minmax(dense).select("query_id", "corpus_row", (semantic * F.col("scaled")).alias("part"))
    s = minmax(sparse).select("query_id", "corpus_row", (keyword * F.col("scaled")).alias("part"))
    return d.unionByName(s).groupBy("query_id", "corpus_row").agg(F.round(F.sum("part"), 6).alias("score"))


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 6, fetch: int = 200, semantic: float = 0.65, keyword: float = 0.35, allowed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Best ``5 * k`` rows of ``corpus`` (corpus_row, text, embedding) for ``queries`` (query_id, text, embedding).

    ``allowed`` (corpus_row) scopes the keyword side before its ranking and the
    dense side after its own; ``deleted`` (corpus_row) leaves rows out of both.
    """
    live = corpus if deleted is None else corpus.join(deleted, "corpus_row", "left_anti")
    dense = vectors.search(live, queries, fetch).drop("rank")
    if allowed is not None:
        dense = dense.join(allowed, "corpus_row", "left_semi")
    sparse = bm25.search(live, queries, fetch, allowed).drop("rank")
    return best(fuse(dense, sparse, semantic, keyword), 5 * k).withColumn("rank", F.col("rank").cast("int"))


def merge_variants(found: DataFrame) -> DataFrame:
    """One row for each (query_id, corpus_row) of several variants: the best score, the first variant on ties."""
    w = Window.partitionBy("query_id", "corpus_row").orderBy(F.desc("score"), "variant")
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query_id", "corpus_row", "variant", "score")


def mmr_order(scores: np.ndarray, units: np.ndarray, k: int, weight: float = 0.7, most: float = 0.92) -> list[int]:
    """Greedy choice by ``weight * score - (1 - weight) * likeness`` to what is chosen; the too similar are out."""
    near = np.full(len(scores), -np.inf)
    chosen: list[int] = []
    free = np.ones(len(scores), dtype=bool)
    while len(chosen) < k:
        value = scores if not chosen else weight * scores - (1 - weight) * near
        value = np.where(free & (near < most), value, -np.inf)
        best_at = int(value.argmax()) if len(value) else 0
        if not len(value) or value[best_at] == -np.inf:
            break
        chosen.append(best_at)
        free[best_at] = False
        near = np.maximum(near, units @ units[best_at])
    return chosen


def diversify(found: DataFrame, corpus: DataFrame, k: int, weight: float = 0.7, most: float = 0.92) -> DataFrame:
    """(query_id, corpus_row, score, mmr_rank). ``found`` should be ranked and cut before: a query's rows meet in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "corpus_row"], ascending=[False, True], ignore_index=True)
        x = np.array(rows["embedding"].tolist(), dtype=np.float64)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + vectors.TINY)
        chosen = mmr_order(rows["score"].to_numpy(), x, k, weight, most)
        out = rows.iloc[chosen][["query_id", "corpus_row", "score"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    found = materialize(found.select("query_id", "corpus_row", "score"), "candidates")
    joined = found.join(corpus.select("corpus_row", "embedding"), "corpus_row")
    return joined.groupBy("query_id").applyInPandas(run, "query_id bigint, corpus_row bigint, score double, mmr_rank int")


def overlap_score(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of a question's terms that a text holds. It knows no meaning."""
    asked = F.array_distinct(terms(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(0.0)


def rerank(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Best ``k`` by ``scorer`` (question, text); ties keep the smaller corpus_row."""
    joined = found.select("query_id", "corpus_row").join(corpus.select("corpus_row", "text"), "corpus_row").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    scored = joined.select("query_id", "corpus_row", F.round(scorer(F.col("question"), F.col("text")), 6).alias("score"))
    return best(scored, k).withColumn("rank", F.col("rank").cast("int"))


def retrieve_variants(corpus: DataFrame, variants: DataFrame, k: int = 6, **options) -> DataFrame:
    """(query_id, variant, corpus_row, score): ``retrieve`` for every one of ``variants`` (query_id, variant, text, embedding)."""
    keyed = materialize(variants.select(F.col("query_id").alias("asked"), "variant", "text", "embedding").withColumn("query_id", F.monotonically_increasing_id()), "variants")
    found = retrieve(corpus, keyed.select("query_id", "text", "embedding"), k, **options)
    return found.join(keyed.select("query_id", "asked", "variant"), "query_id").select(F.col("asked").alias("query_id"), "variant", "corpus_row", "score")


def smart_retrieve(corpus: DataFrame, variants: DataFrame, k: int = 6, use_hybrid: bool = True, use_rerank: bool = True, scorer: Callable[[Column, Column], Column] = overlap_score, **options) -> DataFrame:
    """Variants (query_id, variant, text, embedding; variant 1 is the question) to the best ``k`` rows of each query."""
    weights = {} if use_hybrid else {"semantic": 1.0, "keyword": 0.0}
    cut = best(merge_variants(retrieve_variants(corpus, variants, k, **weights, **options)), 5 * k)
    diverse = diversify(cut, corpus, max(3 * k, k))
    if use_rerank:
        return rerank(diverse, variants.where("variant = 1"), corpus, k, scorer)
    return diverse.where(F.col("mmr_rank") <= k).withColumnRenamed("mmr_rank", "rank")
