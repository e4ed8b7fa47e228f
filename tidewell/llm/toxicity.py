"""Toxicity (operator 8): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, stems (the first few bytes of a
word), word pairs and pairs with one word between, hashed to ``2 ** BITS`` places. Every place has its own learning rate,
and L1 keeps most weights at zero, so what is left is small enough to send to
every executor. The model learns in one task from at most ``SAMPLE`` labelled
documents, taken by a hash of their id, and from no more than ``PLACES`` features
of them, which bounds the task's memory where texts are very long; scoring reads
every document whole.

Defined cases: a null or empty text has only the bias and gets its score;
labels without a value or without a document are left out; where a document has
several labels the largest counts; without any label the score is 0.5 for all.
Scores depend on the text alone, so equal texts have equal scores. Rows that
repeat a document are learnt from as often as they occur and scored each; very
long texts are read whole, in slices; an empty table gives no rows; columns of
``docs`` may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.llm.textvec import PUNCTUATION, mix, pieces, stems
from tidewell.storage import bound_batches, free, materialize, scope

BITS = 20
#: Lengths of stems in bytes.
STEMS = (4, 5, 6)
#: The most labelled documents that the model learns from.
SAMPLE = 24_000
#: The most features that they may have together.
PLACES = 1 << 26
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all words, stems, pairs and skip-grams, repeated as often as they occur."""
    rows, (one, *short) = stems(column, PUNCTUATION, (None, *STEMS))
    out_rows, out = [rows] * (1 + len(STEMS)), [mix(x + np.uint64(1 + 8 * i)) for i, x in enumerate((one, *short))]
    for gap in (1, 2):
        if len(rows) > gap:
            same = rows[gap:] == rows[:-gap]
            out_rows.append(rows[:-gap][same])
            out.append(mix(one[:-gap][same] * np.uint64(0xA0761D6478BD642F) + one[gap:][same] + np.uint64(gap << 1)))
    return np.concatenate(out_rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal updates with a learning rate for each coordinate; the last one is the bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, 256):
        rows, places = features(part.column(2))
        both = np.unique((rows << BITS) | places)
        bounds = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
        values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(both & ((1 << BITS) - 1), pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values], names=["nth", "label", "places"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = []
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        seen.append((batch.column(1).to_pylist(), batch.column(2).flatten().to_numpy(), offsets - offsets[0]))
    model, bias = Ftrl(), np.array([1 << BITS])
    for _ in range(EPOCHS if any(labels for labels, _, _ in seen) else 0):
        for labels, places, offsets in seen:
            for label, a, b in zip(labels, offsets[:-1], offsets[1:], strict=True):
                model.learn(np.append(places[a:b], bias), label)
    w = model.weights(slice(None))
    at = w.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights learnt from labelled documents; ``where`` chooses rows of ``labels``."""
    bound_batches(docs.sparkSession)
    with scope():
        chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
        if where is not None:
            chosen = chosen.where(where)
        chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).withColumn("nth", F.xxhash64(F.lit(8), "id"))
        chosen = materialize(chosen.orderBy("nth", "id").limit(sample), "labelled")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("nth", "label", "text")
        rows = materialize(found.mapInArrow(_featurise, "nth bigint, label int, places array<int>").withColumn("row", F.monotonically_increasing_id()), "features")
        order = ["nth", "label", "row"]
        few = rows.select(*order, F.size("places").cast("long").alias("n")).orderBy(*order).limit(sample)
        before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of at most ``sample`` rows
        few = few.withColumn("before", before).where(F.col("before") + F.col("n") <= PLACES).select("row")
        rows = rows.join(F.broadcast(few), "row", "left_semi").drop("row")
        fitted = rows.repartition(1).sortWithinPartitions("nth", "label", F.xxhash64("places")).mapInArrow(_train, "place int, weight double").collect()
    return np.array([r["place"] for r in fitted], dtype=np.int64), np.array([r["weight"] for r in fitted], dtype=np.float64)


def _score(places: np.ndarray, weights: np.ndarray, keep: list[str], text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        table[places] = weights
        for part in pieces(batches, 256):
            rows, found = features(part.column(text))
            hit = table[found] != 0
            both = np.unique((rows[hit] << BITS) | found[hit])
            sums = table[-1] + np.bincount(both >> BITS, weights=table[both & ((1 << BITS) - 1)], minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), pa.array(score)], names=[*keep, name])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str], name: str = "__score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``name``, the toxicity of its text from 0 to 1."""
    schema = T.StructType([*docs.select(keep).schema, T.StructField(name, T.DoubleType())])
    text = free("__text", [*docs.columns, name])
    return docs.select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(_score(*model, keep, text, name), schema)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, where=~held_out("id"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
