"""The ordered fold as a vectorised kernel, parallel over chunks of outcomes or over ranges of events.

The encoded events lie in the shared folder, sorted by ``event_id`` over all files.

By chunks (``run``): each task owns a chunk of the rows of W (transposed: inputs x chunk), streams the files in order, a batch at a
time, and returns its rows.  Memory: the chunk of W and a batch; no event is shuffled to a chunk.

By ranges (``run_ranges``), for a W of few rows and inputs: the events of a file change W by an affine map,
W -> M W + V, whatever W is.  Each task folds a file to its M (what becomes of the unit matrix) and V (of
zero); maps of neighbouring files are composed in a tree, and the last one is applied to the start state.
Only the cues that a file holds are in its map, the others stay.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem, materialise, scratch
from . import vectors


@dataclass
class Rule:
    """Rates (one, one for each cue, or the folder of a table of them), and vectors where inputs or targets are real."""

    alpha: float | np.ndarray | str
    betas: tuple[float, float]
    lambda_: float
    cue_vectors: vectors.Vectors | None = None
    outcome_vectors: vectors.Vectors | None = None


def _loaded(rule: Rule, n_inputs: int) -> Rule:
    """The rule for one task, with the rates of its folder (id, rate) read."""
    rule = replace(rule, **{k: v.fresh() for k in ("cue_vectors", "outcome_vectors") if (v := getattr(rule, k)) is not None})
    if not isinstance(rule.alpha, str):
        return rule
    rates = np.zeros(n_inputs)
    fs, folder = filesystem(rule.alpha)
    for name in _files(rule.alpha):
        with fs.open_input_file(posixpath.join(folder, name)) as source:
            for batch in pq.ParquetFile(source).iter_batches(1_000_000, columns=["id", "rate"]):
                rates[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False)
    return replace(rule, alpha=rates)


def write_encoded(encoded: DataFrame, files: int | None = None) -> str:
    """Files whose names sort as their events do."""
    path = scratch(encoded.sparkSession, "encoded-events")
    laid = encoded.repartitionByRange("event_id") if files is None else encoded.repartitionByRange(files, "event_id")
    laid.sortWithinPartitions("event_id").write.parquet(path)
    return path


def _files(path: str) -> list[str]:
    fs, folder = filesystem(path)
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.startswith("part-"))


def _batches(path: str, names: list[str] | None = None, since: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(cue offsets, cue ids, outcome offsets, outcome ids) of the events in order, of all files or those named.

    Row groups whose events are all before the one ``since`` aren't read.
    """
    fs, folder = filesystem(path)
    for name in _files(path) if names is None else names:
        with fs.open_input_file(posixpath.join(folder, name)) as source:
            file = pq.ParquetFile(source)
            groups = [k for k in range(file.metadata.num_row_groups) if since is None or _reaches(file, k, since)]
            for batch in file.iter_batches(50_000, row_groups=groups, columns=["cue_ids", "outcome_ids"]):
                if not batch.num_rows:
                    continue
                out = []
                for column in batch.columns:
                    out += [column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(np.int64)]
                yield tuple(out)


def _reaches(file: pq.ParquetFile, group: int, since: int) -> bool:
    """Whether a row group may have an event of this id or a later one."""
    column = file.metadata.row_group(group).column(file.schema_arrow.get_field_index("event_id"))
    known = column.path_in_schema == "event_id" and column.statistics is not None and column.statistics.has_min_max
    return not known or column.statistics.max >= since


#: Events that are solved together.
BLOCK = 64
#: Maps that one task composes.
FAN = 8


def learn(w: np.ndarray, batches: Iterator[tuple[np.ndarray, ...]], rule: Rule, low: int, high: int, lead: int = 0, width: int = 1) -> None:
    """Fold the events into ``w`` (inputs x rows low..high), in place.

    The updates u of a block of events X are linear in each other: an event sees W as the block found it,
    plus what the events before it in the block changed.  So u solves (1 + B L) u = B (targets - X W), with
    the rates B and L the strictly lower part of X alpha X', and W grows by alpha X' u: the
    same fold, by matrix products.

    In front of the rows stand ``lead`` columns without targets; a row may be ``width`` columns, of which the last has the target.
    """
    x, y = rule.cue_vectors, rule.outcome_vectors
    for batch in batches:
        n = len(batch[0]) - 1
        held = max(BLOCK, vectors.SUM_NUMBERS // max(1, 0 if x is None else x.wide, 0 if y is None else high - low) // BLOCK * BLOCK)
        for start in range(0, n, held):
            inputs, targets = (
                None if v is None else v.sums(*_slice(offsets, ids, start, held), *columns)
                for v, offsets, ids, columns in ((x, *batch[:2], ()), (y, *batch[2:], (low, high)))
            )
            for e in range(start, min(n, start + held), BLOCK):
                at = slice(e - start, e - start + BLOCK)
                cues = _slice(batch[0], batch[1], e) if inputs is None else inputs[at]
                outs = _slice(batch[2], batch[3], e) if targets is None else targets[at]
                _block(w, cues, outs, rule, low, high, lead, width)


def _slice(offsets: np.ndarray, ids: np.ndarray, at: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a block's events: the event and the id of each token, and how many events."""
    own = offsets[at : at + (size or BLOCK) + 1]
    return np.repeat(np.arange(len(own) - 1), np.diff(own)), ids[own[0] : own[-1]], len(own) - 1


def _block(w: np.ndarray, cues: tuple | np.ndarray, outs: tuple | np.ndarray, rule: Rule, low: int, high: int, lead: int = 0, width: int = 1) -> None:
    """A block's cues and outcomes are tokens, or a row of sums for each event."""
    used = None
    if isinstance(cues, np.ndarray):
        x, rows, alpha = cues, w, 1.0
    else:
        event, ids, n = cues
        used, place = np.unique(ids, return_inverse=True)
        x = np.zeros((n, len(used)))
        np.add.at(x, (event, place), 1.0)
        rows = w[used]
        alpha = rule.alpha[used] if isinstance(rule.alpha, np.ndarray) else rule.alpha
    n = len(x)
    lower = np.tril((x * alpha) @ x.T, -1)
    want = np.zeros((n, w.shape[1]))
    real = isinstance(outs, np.ndarray)
    if real:
        want[:, lead:] = outs
    else:
        event, ids, _ = outs
        own = (ids >= low) & (ids < high)
        event, ids = event[own], ids[own] - low
        want[event, lead + ids * width + width - 1] = rule.lambda_
    rest = want - x @ rows
    b1, b2 = rule.betas
    if real or b1 == b2:
        u = np.linalg.solve(np.eye(n) + b1 * lower, b1 * rest)
    else:
        u = _unequal(lower, rest, b1, b2, event, lead + ids * width, width)
    change = (x * alpha).T @ u
    if used is None:
        w += change
    else:
        w[used] = rows + change


def _unequal(lower: np.ndarray, rest: np.ndarray, b1: float, b2: float, event: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """The updates where an outcome's rate depends on its presence.

    All are solved as if absent.  Each presence (event, first of its columns) then adds what its other rate makes of the gap that the
    event finds, and what follows from that for later events: a column of the inverse.
    """
    inverse = np.linalg.inv(np.eye(len(lower)) + b2 * lower)
    u = inverse @ (b2 * rest)
    starts = np.searchsorted(event, np.arange(len(lower) + 1))
    for e in np.unique(event).tolist():
        first = np.unique(column[starts[e] : starts[e + 1]])
        own = first if width == 1 else (first[:, None] + np.arange(width)).ravel()
        gap = (b1 - b2) * (rest[e, own] - lower[e, :e] @ u[:e, own])
        u[e:, own] += np.multiply.outer(inverse[e:, e], gap)
    return u


def write_state(initial: DataFrame, chunk: int, places: DataFrame | None = None) -> str:
    """A former W (row, input, weight) in the shared folder, a folder for each chunk of rows, in the order of their ids or of (row, place)."""
    path = scratch(initial.sparkSession, "start-state")
    placed = initial.withColumn("place", F.col("row")) if places is None else initial.join(places.select("row", "place"), "row")
    laid = placed.select(F.floor(F.col("place") / chunk).cast("int").alias("chunk"), "row", "input", "weight")
    laid.repartition("chunk", F.floor(F.col("input") / 100_000)).sortWithinPartitions("chunk").write.partitionBy("chunk").parquet(path)
    return path


def _read_state(path: str | None, number: int, w: np.ndarray, rows: np.ndarray) -> None:
    """A chunk's numbers into ``w``, whose columns are the rows of ascending ids, a batch at a time."""
    if path is not None:
        for batch in vectors.read_batches(posixpath.join(path, f"chunk={number}"), ["row", "input", "weight"]):
            row, at, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            w[at.astype(np.int64), np.searchsorted(rows, row)] = weight


def _rows_of(w: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """row, weights of the columns of ``w``."""
    for s in range(0, w.shape[1], 256):
        part = np.ascontiguousarray(w[:, s : s + 256].T)
        offsets = np.arange(len(part) + 1, dtype=np.int32) * len(w)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows[s : s + 256], pa.int32()), lists], ["row", "weights"])


def run(
    spark: SparkSession, path: str, rule: Rule, n_inputs: int, n_rows: int, chunk: int, initial: DataFrame | None = None, places: DataFrame | None = None
) -> DataFrame:
    """row, weights (a number for each input) of every row of W.

    ``initial``: row, input, weight of a former W; each task reads those of its chunk.
    ``places``: (row, place, first) put rows that begin to change at about the same event into one chunk, which reads the events
    from the ``first`` of any of its rows on (null: from the start).  Without it chunks are ranges of ids, which read all.
    """
    chunks, by_range = -(-n_rows // chunk), places is None
    sent = spark.sparkContext.broadcast(rule)  # of vectors and tables of rates, the folders only
    start = None if initial is None else write_state(initial, chunk, places)

    def learned(rule: Rule, number: int, rows: np.ndarray, since: int | None) -> Iterator[pa.RecordBatch]:
        w = np.zeros((n_inputs, len(rows)))
        _read_state(start, number, w, rows)
        if by_range:
            learn(w, _batches(path), rule, int(rows[0]), int(rows[-1]) + 1)
        else:
            learn(w, _among(_batches(path, since=since), rows), rule, 0, len(rows))
        yield from _rows_of(w, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = _loaded(sent.value, n_inputs)
        for batch in batches:
            for r in batch.to_pylist():
                number = r["chunk"]
                rows = np.arange(number * chunk, min(n_rows, (number + 1) * chunk)) if by_range else np.sort(np.array(r["rows"], np.int64))
                yield from learned(rule, number, rows, r.get("since"))

    if by_range:
        todo = spark.range(0, chunks, 1, chunks).select(F.col("id").cast("int").alias("chunk"))
    else:  # a chunk holds a bounded number of rows
        since = F.when(F.count_if(F.col("first").isNull()) == 0, F.min("first")).alias("since")
        todo = places.groupBy(F.floor(F.col("place") / chunk).cast("int").alias("chunk")).agg(F.collect_list("row").alias("rows"), since)
        todo = todo.repartitionByRange(chunks, "chunk")
    return todo.mapInArrow(work, "row int, weights array<double>")


def _among(batches: Iterator[tuple[np.ndarray, ...]], rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Outcome ids as places among the ascending rows, -1 for all others."""
    for *cues, offsets, ids in batches:
        at = np.minimum(np.searchsorted(rows, ids), len(rows) - 1)
        yield *cues, offsets, np.where(rows[at] == ids, at, -1)


def rows_by_first_event(path: str, outcomes: DataFrame, n_rows: int, initial: DataFrame | None, number) -> DataFrame:
    """row, place, first: rows in the order of the event at which they begin to change.

    A row without former weights stays 0 up to its outcome's first event.  Rows with some have no first event (null) and stand in
    front; rows without weights and events never change.  ``number`` gives (row, place) for (first, row) in ascending order.
    """
    spark = outcomes.sparkSession
    events = spark.read.parquet(path).select("event_id", F.explode("outcome_ids").alias("row"))
    found = outcomes.select(F.col("id").alias("row")).join(events.groupBy("row").agg(F.min("event_id").alias("first")), "row", "left")
    found = found.withColumn("first", F.coalesce(F.col("first").cast("long"), F.lit(2**63 - 1)))
    if initial is not None:
        held = initial.select("row", F.lit(True).alias("held")).distinct()
        found = found.join(held, "row", "left").withColumn("first", F.when(F.col("held").isNull(), F.col("first"))).drop("held")
    found = materialise(found.select("first", "row"), "first-events")
    return materialise(found.join(number(found, n_rows), "row").select("row", "place", "first"), "places")


# ranges ----------------------------------------------------------------------------------


@dataclass
class Change:
    """W[ids] -> m W[ids] + v.  ``m`` holds one matrix for all rows of W, or one for each row where presence sets the rate."""

    ids: np.ndarray
    m: np.ndarray
    v: np.ndarray

    def on(self, w: np.ndarray) -> np.ndarray:
        """The change of the columns of w, whose inputs are the ids."""
        return (self.m[0] @ w if len(self.m) == 1 else np.einsum("gij,jg->ig", self.m, w)) + self.v

    def among(self, ids: np.ndarray) -> Change:
        """The same over more inputs, which stay as they are."""
        at = np.searchsorted(ids, self.ids)
        m = np.repeat(np.eye(len(ids))[None], len(self.m), axis=0)
        m[:, at[:, None], at] = self.m
        v = np.zeros((len(ids), self.v.shape[1]))
        v[at] = self.v
        return Change(ids, m, v)

    def then(self, other: Change) -> Change:
        ids = np.union1d(self.ids, other.ids)
        a, b = self.among(ids), other.among(ids)
        return Change(ids, b.m @ a.m, b.on(a.v))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.astype("<i8").tobytes(), self.m.tobytes(), self.v.tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, m: bytes, v: bytes) -> Change:
        at = np.frombuffer(ids, "<i8")
        return cls(at, np.frombuffer(m).reshape(-1, len(at), len(at)), np.frombuffer(v).reshape(len(at), -1))


def change_size(rule: Rule, n_inputs: int, n_rows: int) -> int:
    """How many numbers the change of a range holds at most."""
    one = rule.outcome_vectors is not None or rule.betas[0] == rule.betas[1]
    return n_inputs * (n_inputs * (1 if one else n_rows) + n_rows)


def change_of(batches: list[tuple[np.ndarray, ...]], rule: Rule, n_inputs: int, n_rows: int) -> Change:
    """What the events of these batches make of any W."""
    if rule.cue_vectors is None:
        ids = np.unique(np.concatenate([np.zeros(1, np.int64), *[b[1][b[0][0] : b[0][-1]] for b in batches]]))  # one at least
        batches = [(b[0], np.searchsorted(ids, b[1]), *b[2:]) for b in batches]
        rule = replace(rule, alpha=rule.alpha[ids]) if isinstance(rule.alpha, np.ndarray) else rule
    else:
        ids = np.arange(n_inputs)
    c = len(ids)
    if rule.outcome_vectors is not None or rule.betas[0] == rule.betas[1]:
        w = np.hstack([np.eye(c), np.zeros((c, n_rows))])
        learn(w, iter(batches), rule, 0, n_rows, lead=c)
        return Change(ids, w[None, :, :c].copy(), w[:, c:].copy())
    w = np.tile(np.hstack([np.eye(c), np.zeros((c, 1))]), n_rows)
    learn(w, iter(batches), rule, 0, n_rows, width=c + 1)
    w = w.reshape(c, n_rows, c + 1)
    return Change(ids, np.ascontiguousarray(w[:, :, :c].transpose(1, 0, 2)), w[:, :, c].copy())


_CHANGE = "place long, ids binary, m binary, v binary"


def run_ranges(spark: SparkSession, path: str, rule: Rule, n_inputs: int, n_rows: int, initial: DataFrame | None = None) -> DataFrame:
    """The same as ``run``, with a task for each file of events."""
    names = _files(path)
    sent = spark.sparkContext.broadcast(rule)
    start = None if initial is None else write_state(initial, n_rows)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = _loaded(sent.value, n_inputs)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                change = None
                for part in _batches(path, [names[place]]):
                    one = change_of([part], rule, n_inputs, n_rows)
                    change = one if change is None else change.then(one)
                change = change_of([], rule, n_inputs, n_rows) if change is None else change
                yield pa.RecordBatch.from_pylist([dict(zip(("place", "ids", "m", "v"), (place, *change.packed())))])

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        whole = Change.unpacked(*(rows[0][c] for c in ("ids", "m", "v")))
        for r in rows[1:]:
            whole = whole.then(Change.unpacked(r["ids"], r["m"], r["v"]))
        return pa.Table.from_pylist([dict(zip(("place", "ids", "m", "v"), (rows[0]["place"] // FAN, *whole.packed())))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w = np.zeros((n_inputs, n_rows))
                _read_state(start, 0, w, np.arange(n_rows))
                change = Change.unpacked(r["ids"], r["m"], r["v"])
                w[change.ids] = change.on(w[change.ids])
                yield from _rows_of(w, np.arange(n_rows))

    parts = max(1, len(names))
    if not names:
        return spark.createDataFrame([], "row int, weights array<double>")
    changes = spark.range(0, parts, 1, parts).mapInArrow(fold, _CHANGE)
    while parts > 1:  # groups of a fixed number of neighbours
        changes = changes.groupBy(F.floor(F.col("place") / FAN).alias("above")).applyInArrow(compose, _CHANGE)
        parts = -(-parts // FAN)
    return changes.mapInArrow(finish, "row int, weights array<double>")
