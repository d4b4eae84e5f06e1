"""Texts of Arrow batches as one array of letters, and slices of such an array as texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def joined(texts: pa.Array, end: str = "") -> tuple[str, np.ndarray]:
    """All texts in one, each with ``end`` behind it, and where each begins (and the last ends)."""
    if end:
        texts = pc.binary_join_element_wise(texts, "", end)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = texts.buffers()[2]
    whole = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().decode() if data is not None else ""
    return whole, starts(pc.utf8_length(texts).to_numpy(zero_copy_only=False))


def numbers(text: str) -> np.ndarray:
    """The letters of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<i4")


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where stretches of these sizes begin that lie end to end (and the last ends)."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def widths(of: np.ndarray) -> np.ndarray:
    """How many bytes letters take."""
    return 1 + (of > 0x7F).astype(np.int8) + (of > 0x7FF) + (of > 0xFFFF)


def encoded(of: np.ndarray) -> np.ndarray:
    """UTF-8."""
    return np.frombuffer(of.astype("<i4").tobytes().decode("utf-32-le").encode(), np.uint8)


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element of stretches of these sizes: which stretch it is of, and its place in it."""
    at = starts(sizes)
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return of, np.arange(at[-1], dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), sizes)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts that lie end to end."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts between these bytes, which may overlap."""
    at = starts(high - low)
    return strings(data[np.arange(at[-1], dtype=np.int32) + np.repeat((low - at[:-1]).astype(np.int32), high - low)], at)


def page(lines: pa.Array) -> pa.RecordBatch:
    """Lines (at least one) as one value, which takes a writer of text files a step instead of one for each."""
    return pa.RecordBatch.from_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")], ["value"])


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most so much together, or of one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high
