"""Words of texts, computed over whole Arrow batches.

Words become codes of a dictionary, which Arrow builds from their bytes, so
within a batch equal codes mean equal words and nothing else. Between batches
words are known by 128 bits of xxh3, taken once for each distinct word. Slices
of texts hold about ``SLICE`` bytes and end between words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table


#: A-Z to a-z; all other bytes stay.
LOWER = _lower()

#: Only [\x20\x09-\x0D] parts words.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Every ASCII character but digits and letters parts words.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(c).isalnum() for c in range(128)]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and of about ``size`` bytes of text, or one row alone.

    What a task makes of a batch is many times its text, so this bounds a
    worker's memory where long texts lie together.
    """
    for batch in batches:
        total = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(total)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def _slices(data: np.ndarray, offs: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + SLICE, n)
        if end < n:
            doc = int(offs[np.searchsorted(offs, end, side="right") - 1])
            back = parts[data[max(at, doc) : end]].nonzero()[0]
            cut = max(doc, max(at, doc) + int(back[-1]) + 1 if len(back) else 0)
            if cut <= at:  # one word fills the slice: go on to where it ends
                stop = int(offs[np.searchsorted(offs, end, side="left")])
                step = end
                cut = stop
                while step < stop:
                    ahead = parts[data[step : min(step + SLICE, stop)]].nonzero()[0]
                    if len(ahead):
                        cut = step + int(ahead[0]) + 1
                        break
                    step += SLICE
            end = cut
        yield at, end
        at = end


def bounds(data: np.ndarray, offs: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: where it begins, which of its bytes are in words, and where its words start and end."""
    for at, end in _slices(data, offs, parts):
        inner = ~parts[data[at:end]]
        edge = offs[np.searchsorted(offs, at, side="left") : np.searchsorted(offs, end, side="left")] - at
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        first[edge] = inner[edge]
        last = inner.copy()
        last[:-1] &= ~inner[1:]
        before = edge[edge > 0] - 1
        last[before] = inner[before]
        starts = first.nonzero()[0]
        if len(starts):
            yield at, inner, starts, last.nonzero()[0] + 1


def coded(column: pa.Array, parts: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word, in order, the row it is in and its code; and the words (A-Z lower-cased) by code."""
    data, offs = raw(column)
    rows, chunks = [], []
    for at, inner, starts, ends in bounds(data, offs, parts):
        flat = LOWER[data[at : at + len(inner)][inner]]
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        chunks.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]))
        rows.append(np.searchsorted(offs, starts + at, side="right") - 1)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    found = pa.concat_arrays(chunks).dictionary_encode()
    return np.concatenate(rows), found.indices.to_numpy().astype(np.int64), found.dictionary


def names(distinct: pa.Array) -> np.ndarray:
    """128 bits for each word, as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in distinct.to_pylist()]), dtype=np.uint64).reshape(-1, 2)


def words(column: pa.Array, parts: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """For every word, in order: the row it is in, and 64 bits of its name."""
    rows, codes, distinct = coded(column, parts)
    return rows, names(distinct)[codes, 0]


def stems(column: pa.Array, parts: np.ndarray, sizes: Sequence[int | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """As ``words``, but for each of ``sizes`` the hashes of no more than so many bytes from each word's start."""
    rows, codes, distinct = coded(column, parts)
    found = distinct.to_pylist()
    return rows, [np.array([xxhash.xxh3_64_intdigest(w[:size]) for w in found], dtype=np.uint64)[codes] for size in sizes]


def _runs(rows: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where runs of ``size`` words begin, and for each place in a run where its word is and whether there is one.

    A row with fewer words has its whole sequence as one run.
    """
    n = len(rows)
    whole = np.zeros(n, dtype=bool)
    if n >= size:
        whole[: n - size + 1] = rows[: n - size + 1] == rows[size - 1 :]
    first = np.ones(n, dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    starts = first.nonzero()[0]
    first[starts] = np.diff(starts, append=n) < size
    begins = (whole | first).nonzero()[0]
    places = []
    for k in range(size):
        at = np.minimum(begins + k, n - 1)
        places.append((at, (begins + k < n) & (rows[at] == rows[begins])))
    return begins, places


_STEPS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_NONE = np.uint64(0x8EBC6AF09C88C6E3)


def shingles(rows: np.ndarray, hashes: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words; a row with fewer words has its whole sequence as one.

    The rows of the result ascend, as those of ``words`` do. Two lanes of the
    words' names give 128 bits of a run's name.
    """
    begins, places = _runs(rows, size)
    out = np.full(len(begins), size, dtype=np.uint64)
    for at, there in places if len(begins) else ():
        out = mix(out * _STEPS[lane] + np.where(there, hashes[at], _NONE))
    return rows[begins], out


def numbered(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but with numbers that are equal for equal runs of codes and for no others: nothing is hashed."""
    begins, places = _runs(rows, size)
    if not len(begins):
        return rows, codes
    none = int(codes.max()) + 1
    out = codes[begins]
    for k, (at, there) in enumerate(places[1:]):
        if k:  # products of two numbers under 2**31 fit into 63 bits
            out = np.unique(out, return_inverse=True)[1]
        out = out * (none + 1) + np.where(there, codes[at], none)
    return rows[begins], out


def sets(rows: np.ndarray, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each of ``n`` rows its distinct hashes, ascending."""
    at = np.searchsorted(rows, np.arange(n + 1))
    for i in range(n):
        part = np.sort(hashes[at[i] : at[i + 1]])
        if len(part) > 1:
            fresh = np.empty(len(part), dtype=bool)
            fresh[0] = True
            np.not_equal(part[1:], part[:-1], out=fresh[1:])
            part = part[fresh]
        yield part
