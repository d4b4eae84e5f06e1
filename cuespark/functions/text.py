"""Text to tokens to occurrences, as column expressions."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the document marker; the dots match any character.
MARKER = "(---end.of.document---|---END.OF.DOCUMENT---)"
# Fixed value: marks stripped from words before counting.
PUNCTUATION = "!?,.:;/\"'()^@*~"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean(c: Column, allowed_symbols: str | Callable[[str], bool] = "all", lower_case: bool = False) -> Column:
    """Lower case, reserved characters to blanks, then every symbol that isn't allowed to a blank.

    ``allowed_symbols``: ``"all"``, the inside of a character class, or a test of one character
    (the one form that needs a Python function; it runs on Arrow batches).
    """
    if lower_case:
        c = F.lower(c)
    c = F.translate(c, "#_\t", "   ")
    if callable(allowed_symbols):
        test = allowed_symbols

        def keep(batch: pd.Series) -> pd.Series:
            return batch.map(lambda t: None if t is None else "".join(x if test(x) else " " for x in t))

        return F.pandas_udf(keep, StringType())(c)
    if allowed_symbols == "all":
        return c
    re.compile(f"[^{allowed_symbols}]")
    return F.regexp_replace(c, f"[^{allowed_symbols}]", " ")


def tokens(c: Column) -> Column:
    """Words between single blanks, stripped; empty ones go."""
    return F.filter(F.transform(F.split(c, " "), strip), lambda w: w != "")


#: White space other than blanks, tabs and line ends.
_ODD = r"(?U)[\s\x1c-\x1f&&[^ \t\n]]"


def words(c: Column, shape: Callable[[Column], Column] = lambda t: t) -> Column:
    """Words of all lines of a text; ``shape`` makes blanks of tabs and what else isn't allowed.

    Without white space other than blanks, tabs and line ends nothing is left to strip, so the text is split at once.
    """
    by_lines = F.flatten(F.transform(F.split(c, "\n"), lambda t: tokens(shape(strip(t)))))
    at_once = F.array_remove(F.split(F.translate(shape(c), "\t\n", "  "), " "), "")
    return F.when(c.rlike(_ODD), by_lines).otherwise(at_once)


def contexts(c: Column) -> Column:
    """The parts of a text between document markers."""
    return F.split(c, MARKER)


def window_starts(words: Column, n: int) -> Column:
    """Where the windows of up to ``n`` words start, ragged at both ends: A, AB, ABC, BCD, CD, D."""
    size = F.size(words)
    return F.when(size > 0, F.sequence(F.lit(1) - F.least(F.lit(n), size), size - 1)).otherwise(F.array().cast("array<int>"))


def window_at(words: Column, start: Column, n: int) -> Column:
    """The window of up to ``n`` words at one of these starts."""
    size = F.size(words)
    return F.slice(words, F.greatest(start, F.lit(0)) + 1, F.least(start + F.least(F.lit(n), size), size) - F.greatest(start, F.lit(0)))


def neighbours_at(words: Column, place: Column, before: int, after: int) -> Column:
    """The words before and after a place (from 1)."""
    first = F.greatest(place - before, F.lit(1))
    left = F.slice(words, first, place - first)
    right = F.when(place < F.size(words), F.slice(words, F.least(place + 1, F.size(words)), F.lit(after))).otherwise(F.array().cast("array<string>"))
    return F.concat(left, right)


def consecutive_words(words: Column, n: int) -> Column:
    """All windows of up to ``n`` words."""
    return F.transform(window_starts(words, n), lambda i: window_at(words, i, n))


def word_to_word(words: Column, before: int, after: int) -> Column:
    """(cues: the neighbours, outcomes: the word) of each word."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(neighbours_at(words, i, before, after).alias("cues"), F.slice(words, i, 1).alias("outcomes")))


def ngrams(words: Column, n: int) -> Column:
    """Letter n-grams of ``#w1#w2#``; they cross word borders and keep their order and repeats.

    One pattern finds them all: at every place it looks ahead for ``n`` letters, and takes one, which may be a pair of code units.
    """
    text = F.concat(F.lit("#"), F.array_join(words, "#"), F.lit("#"))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def distinct_ngrams(words: Column, n: int) -> Column:
    """The different ones of ``ngrams`` (``n`` up to 3), in the order of their first places.

    Letters are numbers of 21 bits, so an n-gram is one number, and Arrow batches are worked on as arrays of them.
    """

    def find(texts: pa.Array) -> pa.Array:
        found, sizes = [np.empty(0, np.int64)], []
        for text in texts:
            letters = np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4").astype(np.int64)
            own = np.zeros(max(0, len(letters) - n + 1), np.int64)
            for k in range(n):
                own = own << 21 | letters[k : k + len(own)]
            found.append(pd.unique(own))
            sizes.append(len(found[-1]))
        places, grams = pd.factorize(np.concatenate(found))
        letters = np.stack([(grams >> 21 * (n - 1 - k)) & ((1 << 21) - 1) for k in range(n)], axis=1).astype("<u4")
        whole = letters.tobytes().decode("utf-32-le")
        values = pa.array([whole[k : k + n] for k in range(0, len(whole), n)], pa.string()).take(pa.array(places))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

    text = F.concat(F.lit("#"), F.array_join(words, "#"), F.lit("#"))
    return F.arrow_udf(find, "array<string>")(text)


def counted_words(c: Column, lower_case: bool = False) -> Column:
    """Words for counting: split at any white space, marks stripped, then lower case; empty ones stay out."""
    words = F.transform(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    words = F.transform(words, F.lower) if lower_case else words
    return F.filter(words, lambda w: w != "")


def time_code(c: Column) -> Column:
    """Seconds of ``H:M:S,F`` or ``H:M:S:F``; the last part counts thirtieths of a second."""
    parts = F.split(F.translate(c, ",", ":"), ":")
    hours, minutes, seconds, frames = (F.element_at(parts, k).cast("double") for k in (1, 2, 3, 4))
    return hours * 3600 + minutes * 60 + seconds + frames / 30


def warn_reserved() -> None:
    warnings.warn("'#', '_' and tabs have a meaning of their own and are replaced by blanks", stacklevel=2)
