"""Search terms of texts over whole Arrow batches: runs of a-z, 0-9 and _ in lower-cased text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
SLICE = 4 << 20
_IN = np.zeros(256, dtype=bool)
_IN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("_")]] = True


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 1024, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and about ``size`` bytes of the text column, or one row alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For every term of the lower-cased texts, in order, the row it is in and its bytes."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inner = np.zeros(len(whole) + 1, dtype=bool)
    inner[:-1] = _IN[whole]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    first[offs] = inner[offs]  # a text's end ends a term
    starts = first[:-1].nonzero()[0]
    places = np.cumsum(inner[:-1])  # of a byte among those in terms
    lead = places[starts] - 1 if len(starts) else starts
    ends = np.append(lead, places[-1] if len(places) else 0)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole[inner[:-1]])])
    return np.searchsorted(offs, starts, side="right") - 1, found


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, times) of every distinct term of every row, and the terms by code."""
    rows, found = terms(column)
    encoded = found.dictionary_encode()
    wide = max(1, len(encoded.dictionary))
    both, times = np.unique(rows * wide + encoded.indices.to_numpy().astype(np.int64), return_counts=True)
    return both // wide, both % wide, times, encoded.dictionary
