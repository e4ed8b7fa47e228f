"""Best-fit packing (operator 3) of documents into sequences of several permitted lengths.

Lengths are the ids that a vocabulary file gives for a text, and one for its end;
without a vocabulary, words between white space stand for tokens, which says
nothing of texts without blanks. Documents are cut, at token positions, into
pieces no longer than the largest sequence. Pieces are dealt by a hash into
groups of about ``group`` pieces, and each group is packed on its own: longest
piece first, into the open bin with the least room that holds it. Where none
does, a bin opens. The permitted lengths compete for it: each is filled, longest
piece first, from what is still to be packed, shrunk to what it then holds, and
the one opens that costs least for a token. At the end each bin shrinks to the
shortest permitted length that holds its contents. Groups are of bounded size
however large the table is, and what the cut between groups wastes is less than
a sequence for each group.

Defined cases: a null or empty text is one piece with only its end-of-document
token; equal lengths are packed in the order of document and piece; rows that
repeat a document are packed as often as they occur; a null doc_id is packed like
any other; very long texts are cut into as many pieces as they need; an empty
table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bpe
from tidewell.llm.textvec import BLANKS, bounds, pieces, raw
from tidewell.storage import bound_batches, materialize

#: Permitted sequence lengths in tokens.
SIZES = (512, 1024, 2048, 4096, 8192)
GROUP = 2048


def sequence_cost(size: int) -> float:
    """A sequence costs its tokens, for attention a part that grows with its square, as much again at 8,192, and 64 for its launch."""
    return size + size * size / 8192 + 64.0


def _opened(need: int, rest: Sequence[int], n: int, sizes: Sequence[int], cost: Callable[[int], float]) -> int:
    """The size to open for ``need``, when the first ``n`` of ``rest`` (ascending) are still to be packed; the larger of equals."""
    best, least = 0, float("inf")
    for size in reversed(sizes):
        if size < need:
            break
        used, at = need, n
        while at:
            at = bisect_right(rest, size - used, 0, at) - 1
            if at < 0:
                break
            used += rest[at]
        value = cost(next(s for s in sizes if s >= used)) / used
        if value < least - 1e-12:
            best, least = size, value
    return best


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and its offset there; for each bin its length at the end."""
    sizes = sorted(sizes)
    bin_of, offset_of = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room: list[int] = []
    open_at: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some open bin has r tokens of room
    rest = sorted(lengths)
    for nth, i in enumerate(sorted(range(len(lengths)), key=lambda j: -lengths[j])):
        need = lengths[i]
        above = rooms >> need
        if above:
            r = need + (above & -above).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                rooms &= ~(1 << r)
        else:
            b = len(used)
            used.append(0)
            room.append(_opened(need, rest, len(rest) - nth - 1, sizes, cost))
        bin_of[i], offset_of[i] = b, used[b]
        used[b] += need
        room[b] -= need
        open_at.setdefault(room[b], []).append(b)
        rooms |= 1 << room[b]
    return bin_of, offset_of, [next(s for s in sizes if s >= u) for u in used]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offs = raw(batch.column(1))
        counts = np.zeros(batch.num_rows, dtype=np.int64)
        for at, _, starts, _ in bounds(data, offs, BLANKS):
            counts += np.bincount(np.searchsorted(offs, starts + at, side="right") - 1, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): ids by the vocabulary file, or words between white space, and one token for the document's end."""
    if vocabulary is not None:
        return bpe.counts(docs, vocabulary).withColumn("n_tokens", F.col("n_tokens") + 1)
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count_words, "doc_id bigint, n_tokens bigint")


def pack(lengths: DataFrame, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost, group: int = GROUP) -> DataFrame:
    """Pack documents (doc_id, n_tokens) and return a row for each piece.

    doc_id, piece, start (its first token in the document), n_tokens, bin_id,
    bin_offset (its first token in the bin) and bin_size.
    """
    top = max(sizes)
    counted = lengths.select("doc_id", F.greatest(F.col("n_tokens").cast("long"), F.lit(1)).alias("total"))
    cut = counted.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {top}"))).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("total") - F.col("piece") * top).cast("int").alias("n_tokens"))
    cut = materialize(cut.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "nth"], kind="stable", na_position="first", ignore_index=True)
        bins, offsets, ends = best_fit(rows["n_tokens"].tolist(), sizes, cost)
        rows["bin_id"] = (int(key[0]) << 32) + np.array(bins, dtype=np.int64)
        rows["bin_offset"] = np.array(offsets, dtype=np.int32)
        rows["bin_size"] = np.array(ends, dtype=np.int32)[bins]
        return rows[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_size"]]

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("nth", "doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(run, "doc_id bigint, piece bigint, start bigint, n_tokens int, bin_id bigint, bin_offset int, bin_size int")


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES, vocabulary: str | None = None) -> DataFrame:
    return pack(token_counts(docs, vocabulary), sizes)
