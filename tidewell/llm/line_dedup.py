"""Line dedup (operator 1): every line that documents share stays in the smallest doc_id that holds it.

Hashes of line keys are range-partitioned together with the document, so the
rows of a line that half of all documents hold lie in many partitions. Each
partition, sorted by hash, document and position, streams past once: the first
document of a run keeps its lines, the others lose theirs. A run that begins in
an earlier partition is settled afterwards from one row for each partition
edge. What comes back for a document is a compressed bitmap of kept lines, not
its text.

Defined cases: a null or empty text is one empty line. Keys under ``least``
code points are never dropped. Rows that repeat a doc_id count as the same
document: lines they share stay in both. A null doc_id sorts before all others.
Very long texts are split whole, and what is gathered for a document are numbers
of lines; an empty table gives no rows; columns of ``docs`` may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.textvec import pieces
from tidewell.storage import bound_batches, broadcast_if_small, files, free, materialize, scope

BLANK = " \t\n\x0b\x0c\r"
_LINES = "line_hash binary, doc_id bigint, text_hash binary, n_lines int, positions array<int>"
_MARKS = "kind string, " + _LINES


def text_hash() -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def line_key(line: str, least: int) -> bytes | None:
    """The line without blanks around it and with A-Z lower-cased; none if that is too short to count."""
    inner = line.strip(BLANK)
    return inner.encode().lower() if len(inner) >= least else None


def _lines_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("line_hash", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.binary()), ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32()))])
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                lines = (text.as_py() or "").split("\n")
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = line_key(line, least)
                    if key is not None:
                        at.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for h, positions in at.items():
                    for column, value in zip(out, (h, doc, of, len(lines), positions), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and document: 'drop' for those after a run's first document.

    'head' marks first-document rows of the partition's first run, 'tail' those of its last run.
    """
    missing = object()
    now: bytes | None = None
    first: object = missing
    runs, last = 0, None

    def tagged(kind: str, batch: pa.RecordBatch, take: list[int]) -> pa.RecordBatch:
        part = batch.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(take), pa.string()), *part.columns], names=["kind", *part.schema.names])

    for batch in batches:
        drop, head = [], []
        for i, (h, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if h != now:
                now, first, runs = h, doc, runs + 1
                last = batch.slice(i, 1)
                if runs == 1:
                    head.append(i)
            elif doc != first:
                drop.append(i)
            elif runs == 1:
                head.append(i)
        if drop:
            yield tagged("drop", batch, drop)
        if head:
            yield tagged("head", batch, head)
    if last is not None:
        yield tagged("tail", last, [0])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, dtype=bool)
            bits[[p for part in dropped for p in part]] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keep, pa.binary())], names=["doc_id", "text_hash", "n_lines", "keep"])


def unpack(keep: bytes | None, n: int) -> np.ndarray:
    """The bitmap of kept lines; without one, every line stays."""
    if keep is None:
        return np.ones(n, dtype=bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = 10, partitions: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep) for every document that loses a line.

    ``keep`` is a zlib-compressed bitmap with a bit for each line; documents
    that are not in the result keep all their lines.
    """
    bound_batches(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    lines = materialize(given.mapInArrow(_lines_of(least), _LINES), "lines")  # range partitioning reads it twice
    placed = lines.repartitionByRange(n, "line_hash", "doc_id").sortWithinPartitions("line_hash", "doc_id")
    marks = materialize(placed.mapInArrow(_stream, _MARKS), "line-marks", (lines,))
    edges = marks.where("kind <> 'drop'")
    earliest = edges.groupBy("line_hash").agg(F.min(F.struct("doc_id")).alias("earliest"))
    late = edges.where("kind = 'head'").join(earliest, "line_hash").where(~F.struct("doc_id").eqNullSafe(F.col("earliest")))
    columns = ["doc_id", "text_hash", "n_lines", "positions"]
    gone = marks.where("kind = 'drop'").select(columns).unionByName(late.select(columns))
    grouped = gone.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("positions").alias("dropped"))
    return grouped.mapInArrow(_bitmaps, "doc_id bigint, text_hash binary, n_lines int, keep binary").coalesce(files(lines))


#: What ``drop_repeated_lines`` adds.
ADDED = ("__n_lines", "__n_dropped", "__kept")


def _apply(names: list[str], bitmap: str, added: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n_lines, n_dropped, kept = [], [], []
            for text, bits in zip(batch.column("text"), batch.column(bitmap), strict=True):
                lines = (text.as_py() or "").split("\n")
                stay = unpack(bits.as_py(), len(lines))
                n_lines.append(len(lines))
                n_dropped.append(int((~stay).sum()))
                kept.append("\n".join(lines[i] for i in stay.nonzero()[0]))
            rest = [batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, *added])

    return run


def drop_repeated_lines(docs: DataFrame, least: int = 10, added: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` with all its columns but ``text``, and n_lines, n_dropped and kept (the text that stays).

    The new columns are named as ``added`` says; a column of ``docs`` with such
    a name is an error, which ``storage.free`` helps to avoid.
    """
    if taken := set(added) & set(docs.columns):
        raise ValueError(f"the columns {sorted(taken)} are there already")
    with scope() as keep:
        bitmaps = keep(materialize(keep_bitmaps(docs, least), "line-bitmaps"))
    doc, of, bitmap, own = (free(x, docs.columns) for x in ("__doc", "__hash", "__keep", "__text_hash"))
    small = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(of), F.col("keep").alias(bitmap))
    side = broadcast_if_small(small, F.octet_length(bitmap) + 64)
    joined = docs.withColumn("text", F.col("text").cast("string")).withColumn(own, text_hash())
    joined = joined.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(of)), "left").drop(doc, of, own)
    rest = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*rest, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType()), T.StructField(added[2], T.StringType())])
    return joined.mapInArrow(_apply([f.name for f in rest], bitmap, added), schema)
