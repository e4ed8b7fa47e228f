"""Questions to answers over a corpus: scopes and filters, search, passages with citations, prompts, answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.models import Generator, echo_generator, generated
from tidewell.operators import corpus, vectors

TOP_K = 6
# A fixed value: the answer where nothing was found.
NOTHING = "I could not find relevant context for that question in your indexed documents."
_UUID = re.compile(r"[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}")


def top_k_or(k: Column, default: int = TOP_K) -> Column:
    """How many passages are asked for; none or 0 stands for the default."""
    return F.coalesce(F.nullif(k.cast("int"), F.lit(0)), F.lit(default))


def asked_documents(several: Column, one: Column) -> Column:
    """The documents that a request names: a list that isn't empty, else the single one, else none."""
    return F.when(F.size(F.coalesce(several, F.array().cast("array<string>"))) > 0, several).when(one.isNotNull(), F.array(one.cast("string"))).otherwise(F.array().cast("array<string>"))


def owned(documents: DataFrame, owner: str, ids: Sequence[str]) -> DataFrame:
    """Those of ``documents`` (document, owner_id) that the owner has and asks for; an error if that leaves none."""
    odd = [x for x in ids if not _UUID.fullmatch(x)]
    if odd:
        raise ValueError(f"{odd[0]!r} is no document id")
    found = documents.where((F.col("owner_id") == owner) & F.col("document").isin(list(ids))).select("document").distinct()
    if found.isEmpty():
        raise LookupError("none of the documents is there")
    return found


def filters(source_type: str | None = None, filename_contains: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """What a request says of passages: their kind, a part of their filename in any case, and when they were ingested."""
    out = F.lit(True)
    kind, name = (source_type or "").strip().lower(), (filename_contains or "").strip().lower()
    if kind:
        out = out & (F.lower(F.coalesce("source_type", F.lit(""))) == kind)
    if name:
        out = out & F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(name))
    if date_from is not None:
        out = out & (F.col("ingested_at") >= F.to_timestamp(F.lit(date_from)))
    if date_to is not None:
        out = out & (F.col("ingested_at") <= F.to_timestamp(F.lit(date_to)))
    return out


def search_corpus(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, documents: DataFrame | None = None, where: Column | None = None, deleted: DataFrame | None = None, index: vectors.CellIndex | None = None) -> DataFrame:
    """(query_id, corpus_row, score, rank) of the nearest chunks.

    With ``documents`` (document), a filter or no index, exact search among the
    rows that remain; else the index, over-fetched threefold for deleted rows.
    ``deleted`` has the column corpus_row.
    """
    if documents is None and where is None and index is not None:
        found = index.search(queries, 3 * k)
        return found.where(F.col("rank") <= k) if deleted is None else corpus.overfetch(found, deleted, k)
    rows = chunks if where is None else chunks.where(where)
    if documents is not None:
        rows = rows.join(documents, "document", "left_semi")
    if deleted is not None:
        rows = rows.join(deleted, "corpus_row", "left_anti")
    return vectors.search(rows, queries, k)


def hydrate(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` (query_id, rank, score, citation_id) with the text of the chunk that the id names; others are left out.

    An id without a version means any version's chunk of that index.
    """
    named = found.withColumn("__id", T.citation_parts(F.col("citation_id"))).where("__id is not null")
    given = chunks.select(F.col("document").alias("__doc"), F.col("version").alias("__version"), F.col("chunk_index").alias("__index"), F.col("text").alias("text"))
    same = (F.col("__id.document_id") == F.col("__doc")) & (F.col("__id.chunk_index") == F.col("__index")) & (F.col("__id.version").isNull() | (F.col("__id.version") == F.col("__version")))
    return named.join(given, same).drop("__id", "__doc", "__version", "__index")


def answers(questions: DataFrame, contexts: DataFrame, make: Callable[[], Generator] = echo_generator) -> DataFrame:
    """(query_id, n, answer) for every question (query_id, text); the fixed answer where it has no passage."""
    joined = questions.select("query_id", F.col("text").alias("question")).join(contexts, "query_id", "left")
    prompt = F.when(F.col("n") > 0, T.prompt(F.col("question"), F.col("contexts")))
    return joined.withColumn("prompt", prompt).select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(generated(F.col("prompt"), make), F.lit(NOTHING)).alias("answer"))
