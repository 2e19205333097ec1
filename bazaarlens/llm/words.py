"""Splitting Arrow batches of texts into words, for operators that work in Python on whole batches.

A text is never cut: slices of a batch hold whole texts, as many as fit in
``SLICE_BYTES`` (one at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000


class Words(NamedTuple):
    """Words of some texts: ``codes`` index into ``distinct``; text i has codes[offsets[i]:offsets[i + 1]]."""

    distinct: pa.Array
    codes: np.ndarray
    offsets: np.ndarray


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``SLICE_BYTES`` of text, or of one row."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_utf8())).fill_null(0)
    yield from slices_by(batch, sizes.to_numpy(zero_copy_only=False), SLICE_BYTES)


def slices_by(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose rows have ``sizes`` of at most ``most`` together, or of one row."""
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(column).cast(pa.large_utf8()).fill_null("")


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case. The texts are copied first, as ``ascii_lower`` of pyarrow 23 misreads cast slices."""
    return pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))


def split_words(texts: pa.Array, separators: str | None = None) -> Words:
    """Non-empty words between runs of ``separators`` (a regex; by default ASCII white space)."""
    lists = pc.ascii_split_whitespace(texts) if separators is None else pc.split_pattern_regex(texts, separators)
    flat, bounds = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    encoded = flat.filter(pa.array(kept)).dictionary_encode()
    return Words(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), before[bounds])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the spans of ``offsets``; 0 for an empty span."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``words`` in a row and the offsets of each."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]
