"""From documents to training sequences: toxic ones go, repeated lines go, near copies go, the rest is packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``, which may have any names.

Defined cases: null and empty texts pass the first three stages as the operators
state, and are one piece in the last; without labels no document is
rejected; rows that repeat a document are kept or dropped together; rows with a null doc_id are never near-duplicates; very long
texts are read whole by every stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.line_dedup import ADDED, drop_repeated_lines
from tidewell.llm.near_dedup import near_duplicates
from tidewell.llm.packing import pack_documents
from tidewell.llm.toxicity import held_out, score, train
from tidewell.storage import broadcast_if_small, discard, free, materialize, scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under a half, the text judged by itself."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out("id"))
    if not len(model[0]):
        return docs  # nothing was learnt, so nothing is rejected
    name = free("__score", docs.columns)
    return score(docs, model, docs.columns, name).where(F.col(name) < 0.5).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller doc_id holds already; n_chars follows the text."""
    added = tuple(free(x, docs.columns) for x in ADDED)
    out = drop_repeated_lines(docs, added=added)
    out = out.withColumn("text", F.col(added[2])).withColumn("n_chars", F.char_length(added[2]).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of documents alike in 0.8 of their five-word shingles."""
    name = free("__gone", docs.columns)
    found = near_duplicates(docs, size=5, percent=80)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone", (found,))
    return docs.join(broadcast_if_small(gone, 16), docs["doc_id"] == F.col(name), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express a fitted model or best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
