"""Models of the caller's: embedders, rewriters, generators, re-rankers and tokenizers, run over Arrow batches.

A model is given as a function that makes it, called once in each Python worker,
so weights are loaded where they are used and nothing large is sent. The
stand-ins here know no meaning; they let plans run and be tested without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

# What passages and questions begin with for the embedding model.
PASSAGE, QUERY = "passage: ", "query: "


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Rewriter(Protocol):
    def __call__(self, questions: Sequence[str]) -> Sequence[str | None]: ...


class Generator(Protocol):
    def __call__(self, prompts: Sequence[str]) -> Sequence[str]: ...


class Reranker(Protocol):
    def __call__(self, questions: Sequence[str], texts: Sequence[str]) -> Sequence[float]: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> Sequence[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...


def hashed_embedder(dim: int = 64) -> Callable[[], Embedder]:
    """A stand-in: unit vectors of signed term counts, by hash. It knows no meaning."""

    def make() -> Embedder:
        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for term in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return make


def embedding(text: Column, make: Callable[[], Embedder], prefix: str = PASSAGE, dim: int | None = None, batch: int = 32) -> Column:
    """The unit vector of ``prefix`` and the text; a null text counts as empty. Another width than ``dim`` is an error."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            found: list[list[float]] = []
            for at in range(0, len(part), batch):
                x = np.asarray(model(part.iloc[at : at + batch].tolist()), dtype=np.float64)
                if dim is not None and x.shape[1] != dim:
                    raise ValueError(f"the model gives {x.shape[1]} numbers for a text, not {dim}")
                found += (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist()
            yield pd.Series(found, index=part.index, dtype=object)

    return embed(prefixed(text, prefix))


def prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))


def embed_queries(queries: DataFrame, make: Callable[[], Embedder], dim: int | None = None) -> DataFrame:
    """``queries`` (query_id, text, ...) with their ``embedding``."""
    return queries.withColumn("embedding", embedding(F.col("text"), make, QUERY, dim))


def identity_rewriter() -> Rewriter:
    """A stand-in that has no other wording, so every question stands for itself."""
    return lambda questions: [None] * len(questions)


def rewrite(queries: DataFrame, make: Callable[[], Rewriter] = identity_rewriter, most: int = 3) -> DataFrame:
    """(query_id, variant, text): the question, variant 1, and up to ``most`` rewrites that differ from it.

    A rewriter answers with a JSON list; where it fails for a batch or answers
    something else, the question stands alone.
    """

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            try:
                yield pd.Series(list(model(part.tolist())), index=part.index, dtype=object)
            except Exception:  # a model that can't be reached rewrites nothing
                yield pd.Series([None] * len(part), index=part.index, dtype=object)

    listed = T.rewrites(ask(F.col("text")), F.col("text"), most)
    own = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    every = F.when(F.array_contains("listed", F.col("text")), F.col("listed")).otherwise(F.concat(F.array("text"), F.col("listed")))
    first = F.array_distinct(F.concat(F.array("text"), every))
    found = own.withColumn("listed", listed).select("query_id", F.posexplode(first).alias("nth", "text"))
    return found.select("query_id", (F.col("nth") + 1).alias("variant"), "text")


def echo_generator() -> Generator:
    """A stand-in that answers with the prompt itself."""
    return lambda prompts: list(prompts)


def generated(prompt: Column, make: Callable[[], Generator] = echo_generator) -> Column:
    """The model's answer to each prompt, stripped; null for a null prompt."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            some = part.dropna()
            found = pd.Series([a.strip() for a in model(some.tolist())], index=some.index, dtype=object) if len(some) else pd.Series([], dtype=object)
            yield found.reindex(part.index).where(lambda s: s.notna(), None)

    return answer(prompt)


def scorer(make: Callable[[], Reranker]) -> Callable[[Column, Column], Column]:
    """A scorer for ``hybrid.rerank`` from a model of (question, text) pairs."""

    def score(question: Column, text: Column) -> Column:
        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for q, t in parts:
                yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), index=q.index, dtype=float)

        return run(question, text)

    return score


def token_windows(text: Column, make: Callable[[], Tokenizer], size: int, overlap: int) -> Column:
    """Windows of a tokenizer's ids, decoded, stripped, without empty ones."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and under the size of a chunk")

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            out = []
            for whole in part:
                ids = model.encode(whole)
                n = 0 if not ids else 1 if len(ids) <= size else -(-(len(ids) - size) // (size - overlap)) + 1
                found = [model.decode(ids[i * (size - overlap) : i * (size - overlap) + size]).strip() for i in range(n)]
                out.append([x for x in found if x])
            yield pd.Series(out, index=part.index, dtype=object)

    return cut(F.coalesce(text, F.lit("")))
