"""Document fingerprints (operator 9) by locally consistent parsing.

A text's bytes are parsed into phrases, those into longer phrases, and so on.
Where a phrase begins is decided by deterministic coin tossing: equal
neighbours are first drawn together, then every symbol is replaced by the place
and value of the lowest bit in which it differs from the one before, until
labels are small, and local maxima of the labels begin phrases. A boundary so
depends on a few symbols around it only, so equal substrings are parsed alike
inside, wherever they lie. A phrase's name is a hash of its symbols. The
fingerprint keeps, for each of 64 ranges of names, the smallest name.

Defined cases: a null text counts as empty; empty texts have the fingerprint of
zeros, and are like each other (1.0) and unlike all others (0.0). Documents
follow each other by doc_id, rows that repeat one by their text, null ids first;
the only row of a table follows itself. Very long texts are parsed whole; an
empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.textvec import mix, pieces
from tidewell.storage import bound_batches, materialize

#: Phrases of these levels count; a level's phrases are about three of the one below.
LEVELS = (2, 3, 4)
BINS = 64
#: Hex digits that a fingerprint keeps of each name.
DIGITS = 8
#: Bytes of text that are parsed together.
CHUNK = 1 << 20

#: A random odd number for each byte, and for each place in a phrase.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _lowest() -> np.ndarray:
    return np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], dtype=np.uint8)


_LOW8 = _lowest()


def _toss8(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing on labels under 256."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ 1
    place = _LOW8[labels ^ before]
    return (place << 1) | ((labels >> place) & 1)


def _toss64(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ np.uint64(1)
    differ = names ^ before
    lowest = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(lowest - np.uint64(1)).astype(np.uint8)
    return (place << 1) | ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def _level(symbols: np.ndarray, starts: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of every text, and where each text's phrases start. No text is empty."""
    n = len(symbols)
    new = np.ones(n, dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[starts] = True
    at = new.nonzero()[0]
    runs = np.diff(at, append=n)
    kept = symbols[at]
    first = np.searchsorted(at, starts)
    names = codes[kept] if codes is not None else kept
    many = (runs > 1).nonzero()[0]
    if len(many):
        names = names.copy() if codes is None else names
        names[many] = mix(names[many] + runs[many].astype(np.uint64))
    labels = _toss8(kept, first) if codes is not None else _toss64(names, first)
    for _ in range(3):
        labels = _toss8(labels, first)
    top = np.zeros(len(labels), dtype=bool)
    if len(labels) > 2:
        top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], len(labels)) - 1
    top[last] = False
    after = first + 1
    top[after[after < len(labels)]] = False  # the first phrase of a text has two symbols at least, if the text has
    top[first] = True
    begins = top.nonzero()[0]
    sizes = np.diff(begins, append=len(labels))
    inside = np.arange(len(labels)) - np.repeat(begins, sizes)
    step = _STEP[np.minimum(inside, 63)]
    far = (inside > 63).nonzero()[0]
    step[far] = mix(inside[far].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    sums = np.add.reduceat(names * step, begins)
    return mix(sums + sizes.astype(np.uint64)), np.searchsorted(begins, first)


def names_by_level(texts: list[bytes], levels: int = max(LEVELS)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: names of all phrases, and the text of each phrase. No text is empty."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out = []
    codes: np.ndarray | None = CODES
    for _ in range(levels):
        symbols, starts = _level(symbols, starts, codes)
        codes = None
        owner = np.repeat(np.arange(len(texts)), np.diff(starts, append=len(symbols)))
        out.append((symbols, owner))
    return out


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of ``BINS`` short names for each text; 0 where a range of names has none."""
    out = np.zeros((len(texts), BINS), dtype=np.uint64)
    some = [i for i, t in enumerate(texts) if t]
    at = 0
    while at < len(some):
        end, size = at, 0
        while end < len(some) and (end == at or size + len(texts[some[end]]) <= CHUNK):
            size += len(texts[some[end]])
            end += 1
        part = some[at:end]
        found = names_by_level([texts[i] for i in part])
        flat = np.full(len(part) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for level in LEVELS:
            names, owner = found[level - 1]
            names = mix(names + np.uint64(level))
            np.minimum.at(flat, owner * BINS + (names >> np.uint64(58)).astype(np.int64), names)
        empty = flat == np.iinfo(np.uint64).max
        short = mix(flat) % np.uint64(16**DIGITS - 1) + np.uint64(1)
        short[empty] = 0
        out[part] = short.reshape(len(part), BINS)
        at = end
    return out


def fingerprint(row: np.ndarray) -> bytes:
    return row.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the estimated share of names in common, 0 to 1."""
    any_name = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(any_name == 0, 1.0, same / np.maximum(any_name, 1))


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What is written on the way holds bytes, half as long as their hex digits.
_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _describe(ids: list, texts: list[str], after: list[str], known: np.ndarray, of_next: np.ndarray) -> list[pa.Array]:
    changed = [edit(t, f).encode() for t, f in zip(texts, after, strict=True)]
    other = sketches(changed)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([sha256(t).digest() for t in changed], pa.binary()),
        pa.array([fingerprint(r) for r in known], pa.binary()),
        pa.array([fingerprint(r) for r in other], pa.binary()),
        pa.array(likeness(known, other), pa.float64()),
        pa.array(likeness(known, of_next), pa.float64()),
    ]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition; its first and last document come back as text, as 'head' and 'tail'."""
    names = ["kind", *_NAMES, "text"]
    held: tuple[list, list[str], np.ndarray] | None = None
    seen = False

    def edge(kind: str, doc: int | None, text: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([doc], pa.int64()), *empty, pa.array([text], pa.string())], names=names)

    for part in pieces(batches):
        ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        if not seen:
            seen = True
            yield edge("head", ids[0], texts[0])
        known = sketches([t.encode() for t in texts])
        if held is not None:
            ids, texts, known = [*held[0], *ids], [*held[1], *texts], np.concatenate([held[2], known])
        held = (ids[-1:], texts[-1:], known[-1:])
        if len(ids) > 1:
            out = _describe(ids[:-1], texts[:-1], texts[1:], known[:-1], known[1:])
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * (len(ids) - 1)), *out, pa.nulls(len(ids) - 1, pa.string())], names=names)
    if held is not None:
        yield edge("tail", held[0][0], held[1][0])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, after = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
        known, of_next = sketches([t.encode() for t in texts]), sketches([t.encode() for t in after])
        yield pa.RecordBatch.from_arrays(_describe(batch.column(0).to_pylist(), texts, after, known, of_next), names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    bound_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows that repeat an id are parted by how their texts begin, in the order of the texts.
    placed = docs.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    streamed = placed.mapInArrow(_stream, f"kind string, {_RESULT}, text string").withColumn("part", F.spark_partition_id())
    streamed = materialize(streamed, "fingerprints")
    # Two rows for each partition: the tail of one is followed by the head of the next that has rows.
    heads = streamed.where("kind = 'head'").select("part", "doc_id", "text")
    tails = streamed.where("kind = 'tail'").select("part", "doc_id", "text")
    order = Window.orderBy("part")
    follows = heads.select("part").withColumn("after", F.lead("part").over(order)).withColumn("after", F.coalesce("after", F.min("part").over(Window.partitionBy(F.lit(0)))))
    pairs = tails.join(follows, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
    last = pairs.select("doc_id", "text", "following").mapInArrow(_at_edges, _RESULT)
    out = streamed.where("kind = 'row'").select(_NAMES).unionByName(last)
    return out.select(*(F.lower(F.hex(x)).alias(x) if kind == "binary" else F.col(x) for x, kind in (y.split() for y in _RESULT.split(", "))))
