"""Operator 11: periodic runs of words, found by bit-parallel lags.

The words of a text get numbers; bit b of all numbers, laid end to end, is a bit plane, held as one
big integer.  XOR of a plane with itself shifted by p marks the words that differ from the word p
places on in that bit; OR over the planes marks all that differ.  A stretch of words without a mark
is a run of period p.  AND with shifted copies of itself, whose shifts double, leaves the
places where at least as many unmarked words follow as a run needs.

Lags are tried in ascending order, so a run is found with its smallest period first; a multiple of it finds the same
words again, which is then no new run (of a run four periods long, any period is a multiple of the smallest).

Lags that can't hold a run aren't tried.  Those of [s, 2s), s a power of two, need 3s unmarked words, so some window of
2s words that starts at a multiple of s equals the window p places on.  Hashes of windows tell: n comparisons
for each s.  What is left are lags with a repetition of more than two periods somewhere (or a collision, which only costs a
try), of which a text of n words has in the order of the root of n.  A match inside a known run
of smaller period can only be that run again and is left out, else one word n times over would try each lag.

Texts are split over tasks by Spark; a text is one task's, in time n log n and the lags' own n / 64 words
a plane, so very long texts are read whole.

Nulls: null, empty and blank texts have no words and no runs; their collapsed text is empty.  Each row counts by itself:
repeated rows give repeated results, a null id is passed on.  An empty table gives no rows; extra columns are ignored.
Ties: runs are ordered by start, then period; no two have both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room, pick

_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows whose results are sent back at once.
ROWS_AT_ONCE = 64


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIXER
    return x ^ (x >> np.uint64(29))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as a big integer, the first id lowest."""
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def zero_stretches(planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of at least ``least`` words that equal the word ``lag`` places on."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    full = (1 << (n - lag)) - 1
    same = ~differ & full
    have = 1
    while have < least and same:
        shift = min(have, least - have)
        same &= same >> shift
        have += shift
    if not same:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(same.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    turns = np.flatnonzero(np.diff(bits, prepend=np.uint8(0), append=np.uint8(0)))
    return turns[::2], turns[1::2] + least - 1


def runs_of(ids: np.ndarray, powers: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs that are ``powers`` periods and ``least`` words long, by start and period.

    ``powers`` is 4 or more: shorter runs need not be multiples of one period only, nor pass the windows.
    """
    if powers < 4:
        raise ValueError("runs are at least four periods long")
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    planes: list[int] = []
    windows, step = _spread((ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER), 1
    while step * powers <= n:
        windows = _spread(windows[: n - 2 * step + 1] * _MULTIPLIER + windows[step:])  # of 2 * step words
        rows = -(-(len(windows) - step) // step)
        if rows < 1:
            break
        later = np.zeros(rows * step, np.uint64)
        later[: len(windows) - step] = windows[step:]
        row, column = np.nonzero(windows[: rows * step : step, None] == later.reshape(rows, step))
        start, lag = row * step, column + step
        fits = (start + lag < len(windows)) & (lag * powers <= n)
        if found:
            known = np.array(sorted(found), np.int64)
            reach = np.maximum.accumulate(known[:, 1])
            at = np.searchsorted(known[:, 0], start, "right") - 1
            fits &= (at < 0) | (reach[at] < start + 2 * step + lag)
        for p in np.unique(lag[fits]).tolist():
            planes = planes or bit_planes(ids)
            for a, b in zip(*zero_stretches(planes, n, p, max(least, powers * p) - p)):
                found.setdefault((int(a), int(b) + p), p)
        step *= 2
    return sorted((a, b - a, p) for (a, b), p in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, powers: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed (each run's first period and all other words) of every row."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(text: str | None) -> tuple[int, list[dict[str, int]], bytes]:
        words = (text or "").encode().split()  # bytes: ASCII white space alone
        if not words:
            return 0, [], b""
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words))
        runs = runs_of(ids, powers, least)
        if runs:
            keep = kept_words(len(words), runs)
            words = [words[i] for i in np.flatnonzero(keep)]
        return len(ids), [{"start": a, "length": b, "period": p} for a, b, p in runs], b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("periodic")
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(k, ROWS_AT_ONCE)
                ns, runs, kept = zip(*(one(text.as_py()) for text in part.column(1)))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(runs, run_type), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text; the texts of a tenth of the ids, chosen by a hash of the id, repeat some of their words from a place on.

    Texts of null ids stay as they are.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, _words(F.col("text"))))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    changed = F.expr("concat_ws(' ', slice(words, 1, a), transform(sequence(0, n - a - 1), i -> get(words, a + i % p)))")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every row."""
    found = find_runs(with_planted_runs(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
