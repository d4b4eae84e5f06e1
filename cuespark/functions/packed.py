"""Events in a short form of lines: what an event shares with the one before isn't written again.

A line holds, for cues and for outcomes, three columns: how many of the first tokens are the last ones of the line before; a
number ``n``; and the tokens behind these.  With ``n`` = 0 they are joined with ``_``.  Otherwise each has ``n`` letters, of which all
but the last are the last letters of the token before it (letter n-grams in a row), and that letter alone is written; the first token of a line
that shares none is whole.  The first line of a file shares none, so a file is read by itself.

Events of overlapping windows repeat each n-gram several times, beyond what gzip finds.  Any events can be written so; the form is exact.
Letters of a batch are worked on as one array, each token with a ``_`` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import letters as L

#: The first line of each file.
HEADER = "shared cues\tn\tcues\tshared outcomes\tn\toutcomes"
END, BLANKS = ord("_"), (ord("\t"), ord("\n"), ord("\r"))
#: About so many letters are worked on at once.
LETTERS = 1 << 20
#: So many lines are unpacked at once.
LINES = 10_000
#: A place at which the line before might go on is sought by so many letters, and so many places are tried.
LOOK, TRIES = 8, 3


def _shared(whole: str, x: np.ndarray, begin: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, at which token the tokens of the row before begin with which it begins; none: its own first token.

    ``begin`` and ``first``: where rows begin, as letters and as tokens.
    """
    at = first[:-1].copy()
    t = np.flatnonzero(x[tokens[: first[-2]]] == np.repeat(x[begin[1:-1]], np.diff(first[:-1])))  # tokens of all rows but the last
    row = np.searchsorted(first, t, "right")
    goes = begin[row]  # where the next row begins
    rest = goes - tokens[t]
    for d in range(LOOK):
        same = (d >= rest) | (x[np.minimum(tokens[t] + d, len(x) - 1)] == x[np.minimum(goes + d, len(x) - 1)])
        if not d:
            same &= rest <= begin[row + 1] - goes
        t, goes, rest, row = t[same], goes[same], rest[same], row[same]
    for _ in range(TRIES):
        if not len(t):
            break
        chosen = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # of each row the longest
        old, low, size = (v[chosen].tolist() for v in (tokens[t], goes, rest))
        good = np.fromiter((whole[a : a + k] == whole[b : b + k] for a, b, k in zip(old, low, size)), bool, len(chosen))
        at[row[chosen[good]]] = t[chosen[good]]
        left = np.ones(len(t), bool)
        left[chosen] = False
        left &= ~np.isin(row, row[chosen[good]])
        t, goes, rest, row = t[left], goes[left], rest[left], row[left]
    return at


def _pack(texts: pa.Array, before: str | None) -> list[pa.Array]:
    """The three columns of joined tokens behind a line before, if there is one."""
    whole, begin = L.joined(texts if before is None else pa.concat_arrays([pa.array([before], pa.string()), texts]), "_")
    x = L.numbers(whole)
    if any((x == b).any() for b in BLANKS):
        raise ValueError(f"a tab or a line end within a value: {next(t for t in texts.to_pylist() if set(map(chr, BLANKS)) & set(t))}")
    ends = np.flatnonzero(x == END)
    tokens = np.concatenate([[0], ends + 1])  # where tokens begin
    first = np.searchsorted(tokens, begin)
    at = _shared(whole, x, begin, tokens, first)
    shared = first[:-1] - at
    new = begin[:-1] + (begin[:-1] - tokens[at])  # where what isn't shared begins
    blank = (shared > 0) & (begin[1:] - new == 1)  # an empty token alone isn't told from none
    shared[blank], new[blank] = 0, begin[:-1][blank]
    if before is not None:
        shared, new, begin, first = shared[1:], new[1:], begin[1:], first[1:]
    size = begin[1:] - new
    n = ends[first[1:] - 1] - tokens[first[1:] - 1]  # letters of the last token
    base = np.searchsorted(tokens, new) - 1  # the last token that is shared
    length = np.where(shared > 0, new - 1 - tokens[base], 0)
    rows = (n > 1) & (size > 0) & (size % (n + 1) == 0) & np.where(shared > 0, length >= n - 1, size > n + 1)
    n = np.where(rows, n, 0)
    of, place = L.spread(size)
    here, wide = new[of] + place, n[of]
    letter = place % (wide + 1)
    end = x[here] == END
    goes_on = (letter < wide - 1) & ((shared[of] > 0) | (place > wide))
    wrong = (wide > 0) & ((end != (letter == wide)) | (goes_on & (x[here] != x[np.maximum(here - wide, 0)])))
    n[np.bincount(of, wrong, len(size)) > 0] = 0
    wide = n[of]
    kept = np.where(wide > 0, (letter == wide - 1) | ((shared[of] == 0) & (place < wide)), place < size[of] - 1)
    written = x[here[kept]]
    places = L.starts(L.widths(written))[L.starts(np.bincount(of[kept], minlength=len(size)))]
    return [pa.array(shared).cast(pa.string()), pa.array(n).cast(pa.string()), L.strings(L.encoded(written), places)]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of (cues, outcomes), tokens joined with ``_``, behind the header; a value holds many.  A tab or line end in a value is an error."""
    before: list[str] | None = None
    for batch in batches:
        sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in batch.columns)
        for low, high in L.parts(sizes, LETTERS):
            part = [c.slice(low, high - low) for c in batch.columns]
            columns = [x for k, c in enumerate(part) for x in _pack(c, before and before[k])]
            lines = pc.binary_join_element_wise(*columns, "\t")
            if before is None:
                yield pa.RecordBatch.from_pydict({"value": [HEADER]})
            before = [c[-1].as_py() for c in part]
            yield L.page(lines)


def _plain(shared: np.ndarray, texts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_tokens`` of lines without n-grams; bytes do for these."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    there = (shared == 0) | (size > 0)
    new = pc.if_else(pa.array(there), pc.binary_join_element_wise(texts, "", "_"), "")
    data = np.frombuffer(f"{before}_{L.joined(new)[0]}".encode(), np.uint8)
    places = np.concatenate([[0], np.flatnonzero(data == END) + 1])
    stop = np.searchsorted(places, len(before.encode()) + 1 + L.starts(np.where(there, size + 1, 0)))
    return data, places, stop


def _grams(shared: np.ndarray, n: int, texts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_tokens`` of lines that add only n-grams of one length, or nothing: each ends at a letter."""
    whole, begin = L.joined(texts)
    x = L.numbers(before + whole)
    fresh, size = shared == 0, np.diff(begin)
    if (fresh & (size < n)).any():
        raise ValueError("no line of packed events")
    ending = np.ones(len(x), bool)
    ending[: len(before)] = False
    for k in range(n - 1):
        ending[len(before) + begin[:-1][fresh] + k] = False
    ends = np.flatnonzero(ending)
    grams, wide, sizes = np.full((len(ends), n + 1), END, "<i4"), L.widths(x), np.ones(len(ends), np.int64)
    for k in range(n):
        at = np.maximum(ends - n + 1 + k, 0)
        grams[:, k] = x[at]
        sizes += wide[at]
    old = np.diff(np.flatnonzero(np.frombuffer(f"{before}_".encode(), np.uint8) == END), prepend=-1)
    stop = len(old) + L.starts(np.where(fresh, size - n + 1, size))
    return np.concatenate([np.frombuffer(f"{before}_".encode(), np.uint8), L.encoded(grams)]), L.starts(np.concatenate([old, sizes])), stop


def _any(shared: np.ndarray, n: np.ndarray, texts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_tokens`` of any lines."""
    whole, begin = L.joined(texts)
    coded, begin = L.numbers(before + whole), begin + len(before)
    size = np.diff(begin)
    wide = np.where(n > 0, n, size)
    count = np.where(n > 0, size - np.where(shared > 0, 0, n - 1), (shared == 0) | (size > 0))  # plain tokens as one
    if (count < 0).any():
        raise ValueError("no line of packed events")
    of, place = L.spread(count * (wide + 1))
    token, letter = np.divmod(place, wide[of] + 1)
    start = np.where((n > 0) & (shared > 0), begin[:-1] - n + 1, begin[:-1])
    here = start[of] + token + letter
    new = np.where(letter == wide[of], np.int32(END), coded[np.clip(here, 0, len(coded) - 1)] if len(coded) else np.int32(END))
    x = np.concatenate([L.numbers(before + "_"), new])
    tokens = np.concatenate([[0], np.flatnonzero(x == END) + 1])
    return L.encoded(x), L.starts(L.widths(x))[tokens], np.searchsorted(tokens, len(before) + 1 + L.starts(count * (wide + 1)))


def _tokens(shared: np.ndarray, n: np.ndarray, texts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the line before holds and what each adds, in UTF-8; where its tokens begin; and how many there are before and behind each line."""
    if not n.any():
        return _plain(shared, texts, before)
    adds = pc.not_equal(texts, "").to_numpy(zero_copy_only=False) | (shared == 0)
    if (n[adds] == (one := int(n.max()))).all():
        return _grams(shared, one, texts, before)
    return _any(shared, n, texts, before)


def _unpack(shared: np.ndarray, n: np.ndarray, texts: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in UTF-8, and from where to where those of each line stand."""
    if (shared < 0).any() or (n < 0).any():
        raise ValueError("no line of packed events")
    data, places, stop = _tokens(shared, n, texts, before)
    first = stop[:-1] - shared
    if (first < 0).any():
        raise ValueError("a line of packed events shares more than there is")
    return data, places[first], places[stop[1:]] - 1


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """event_id, cues, outcomes (joined with ``_``) of (event_id, value) in the order of the lines, without headers."""
    before = ["", ""]
    for batch in batches:
        for k in range(0, batch.num_rows, LINES):
            ids, lines = (c.slice(k, LINES) for c in batch.columns)
            fields = pc.split_pattern(lines, "\t")
            if not pc.all(pc.equal(pc.list_value_length(fields), 6)).as_py():
                raise ValueError("a line of packed events has six columns")
            flat = fields.flatten()
            columns = [flat.take(pa.array(np.arange(c, len(flat), 6))) for c in range(6)]
            both = []
            for c in (0, 3):
                shared, n = (columns[c + d].cast(pa.int64()).to_numpy() for d in (0, 1))
                both.append(_unpack(shared, n, columns[c + 2], before[c // 3]))
            before = [data[low[-1] : high[-1]].tobytes().decode() for data, low, high in both]
            for a, b in L.parts(sum(high - low for _, low, high in both), 4 * LETTERS):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(L.slices(data, low[a:b], high[a:b]) for data, low, high in both)], ["event_id", "cues", "outcomes"])
