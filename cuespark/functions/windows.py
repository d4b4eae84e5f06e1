"""Events of windows of words with letter n-grams as cues, as short lines (``functions.packed``) made from their texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import letters as L
from .packed import BLANKS, END, HEADER

_MARK = ord("#")
#: About so many letters of texts are worked on at once.
TEXT = 1 << 16


def _lines(texts: pa.Array, most: int, n: int) -> pa.Array:
    """A window's words and n-grams lie side by side in its text, and what it doesn't share with the window before it is the text behind that one."""
    whole, begin = L.joined(texts)
    x = L.numbers(whole)
    if any((x == b).any() for b in BLANKS):
        raise ValueError(f"a tab or a line end within a value: {next(t for t in texts.to_pylist() if set(map(chr, BLANKS)) & set(t))}")
    marks = np.flatnonzero(x == _MARK)  # one ahead of each word, and one behind the last
    first = np.searchsorted(marks, begin)  # of each text
    words = np.diff(first) - 1
    most = np.minimum(most, words)
    text, place = L.spread(words + most - 1)
    first, most, words = first[text], most[text], words[text]
    start = place + 1 - most
    left, right = np.maximum(start, 0), np.minimum(start + most, words)
    known = np.where(place > 0, np.minimum(start - 1 + most, words), left)  # where the window before ends
    low, high, behind = marks[first + left], marks[first + right], marks[first + known]
    own = known - left
    grams = np.where(own > 0, behind - low + 2 - n, 0)
    new = np.where(own > 0, behind + 1, low)  # from here on letters are written
    places = L.starts(L.widths(x))
    cues = L.slices(L.encoded(x), places[new], places[high + 1])
    outcomes = L.slices(L.encoded(np.where(x == _MARK, np.int32(END), x)), places[np.minimum(behind + 1, high)], places[high])
    kind = pa.array(["0", str(n)]).take(pa.array((new <= high).astype(np.int8)))
    return pc.binary_join_element_wise(pa.array(grams).cast(pa.string()), kind, cues, pa.array(own).cast(pa.string()), "0", outcomes, "\t")


def ngram_lines(most: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines, behind the header, of texts ``#w1#w2#``; a value holds many.

    Windows are those of ``text.window_starts``, of up to ``most`` words; cues are their ``text.ngrams`` (``n`` is 2 or 3), repeats included.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            texts = batch.column(0)
            for low, high in L.parts(pc.binary_length(texts).to_numpy(zero_copy_only=False), TEXT):
                if not begun:
                    yield pa.RecordBatch.from_pydict({"value": [HEADER]})
                    begun = True
                yield L.page(_lines(texts.slice(low, high - low), most, n))

    return found
