"""Activations and correlations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.vectors import add_rows, read_batches
from ..storage import filesystem, scratch
from . import counts
from .filters import apply_duplicates

#: Values of outcome columns that a task holds at once.
BLOCK_VALUES = 4_000_000


def activation(
    events: DataFrame, weights: DataFrame | Mapping[str, Mapping[str, float]], *, remove_duplicates: bool | None = None, ignore_missing_cues: bool = False, dense: bool = True
) -> DataFrame:
    """event_id, outcome, activation: the sum of the weights of an event's cues.

    ``weights``: (outcome, cue, weight), or a dictionary of dictionaries.  A cue without any weight in a table, or that
    the dictionary of an outcome lacks, is an error unless ignored; in default dictionaries it counts 0.  With ``dense`` pairs that
    no cue points to have a row of 0 each (events times outcomes rows, the form of a matrix), by tiles of W; without it, none, by a join.
    """
    least = 1  # weights that a cue must have
    if isinstance(weights, Mapping):
        least = sum(not isinstance(row, defaultdict) for row in weights.values())
        rows = [(o, c, float(w), not isinstance(row, defaultdict)) for o, row in weights.items() for c, w in row.items()]
        weights = events.sparkSession.createDataFrame(rows, "outcome string, cue string, weight double, strict boolean")
        strict, weights = weights.where("strict"), weights.drop("strict")
    else:
        strict = weights.select("cue").distinct()
    events = apply_duplicates(events.select("event_id", "cues"), remove_duplicates, ("cues",))
    if not ignore_missing_cues and least:
        known = strict.groupBy("cue").count().where(F.col("count") >= least)
        missing = events.select(F.explode("cues").alias("cue")).distinct().join(known, "cue", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0]["cue"])
    if dense:
        return _by_tiles(events, weights)
    parts = events.select("event_id", F.explode("cues").alias("cue"))
    return parts.join(weights.where("weight <> 0"), "cue").groupBy("event_id", "outcome").agg(F.sum("weight").alias("activation"))


#: Cues and outcomes of a tile of W, and events that meet it at once.
TILE = (16_384, 256)
EVENTS_AT_ONCE = 16_384


def _by_tiles(events: DataFrame, weights: DataFrame) -> DataFrame:
    """The sums for every event and every outcome.

    W lies in the shared folder as tiles of cues x outcomes, a file each.  A task takes its events as rows of cue
    ids, goes through the tiles of each range of outcomes, adds up the weights' rows of the cues that a tile has, and returns
    the sums: neither events nor weights are joined, and events aren't shuffled.  Memory: one tile, and
    the sums of some events for a range of outcomes.
    """
    cues, outcomes, n_cues, n_outcomes, *_ = counts.vocabularies(weights.select(F.array("cue").alias("cues"), F.array("outcome").alias("outcomes")))
    folder = scratch(events.sparkSession, "tiles")
    high, wide = TILE
    named = weights.where("weight <> 0").join(cues.select(F.col("key").alias("cue"), F.col("id").alias("c")), "cue")
    named = named.join(outcomes.select(F.col("key").alias("outcome"), F.col("id").alias("o")), "outcome")
    tile = [F.floor(F.col("o") / wide).cast("int").alias("across"), F.floor(F.col("c") / high).cast("int").alias("down")]
    laid = named.select(*tile, (F.col("c") % high).cast("int").alias("c"), (F.col("o") % wide).cast("int").alias("o"), F.col("weight").cast("double").alias("weight"))
    laid.repartition("across", "down").write.partitionBy("across", "down").parquet(f"{folder}/w")
    outcomes.select("key").repartitionByRange(max(1, -(-n_outcomes // counts.SMALL_KEYS)), "key").sortWithinPartitions("key").write.parquet(f"{folder}/names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([b.column(0) for b in read_batches(f"{folder}/names", ["key"])])
        for whole in batches:
            for k in range(0, whole.num_rows, EVENTS_AT_ONCE):
                part = whole.slice(k, EVENTS_AT_ONCE)
                at = part.column(1).offsets.to_numpy().astype(np.int64)
                ids = part.column(1).values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
                event = np.repeat(np.arange(part.num_rows), np.diff(at))
                for across in range(0, -(-n_outcomes // wide)):
                    own = names.slice(across * wide, wide)
                    sums = np.zeros((part.num_rows, len(own)))
                    for down in range(0, -(-n_cues // high)):
                        here = ids // high == down
                        if here.any():
                            add_rows(sums, event[here], ids[here] - down * high, _tile(f"{folder}/w/across={across}/down={down}", high, len(own)))
                    for s in range(0, part.num_rows, max(1, 65_536 // wide)):
                        block = sums[s : s + max(1, 65_536 // wide)]
                        place = np.arange(block.size)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s + place // len(own))), own.take(pa.array(place % len(own))), pa.array(block.ravel())], ["event_id", "outcome", "activation"])

    kind = events.schema["event_id"].dataType.simpleString()
    return _known_ids(events, cues, n_cues).mapInArrow(run, f"event_id {kind}, outcome string, activation double")


def _known_ids(events: DataFrame, cues: DataFrame, n: int) -> DataFrame:
    """event_id, ids of the cues that have one."""
    if n > counts.SMALL_KEYS:
        parts = events.select("event_id", F.explode_outer("cues").alias("key")).join(cues, "key", "left")
        return parts.groupBy("event_id").agg(F.collect_list("id").alias("ids"))
    sent = events.sparkSession.sparkContext.broadcast([r["key"] for r in cues.orderBy("id").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            column = batch.column(1)
            ids = pc.index_in(column.flatten(), value_set=known)
            owner = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            held = ids.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(owner[held], minlength=len(column))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids.drop_null())], ["event_id", "ids"])

    return events.select("event_id", "cues").mapInArrow(run, f"event_id {events.schema['event_id'].dataType.simpleString()}, ids array<int>")


def _tile(path: str, high: int, wide: int) -> np.ndarray:
    w = np.zeros((high, wide))
    for batch in read_batches(path, ["c", "o", "weight"]):
        c, o, weight = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        np.add.at(w, (c, o), weight)
    return w


def _columns(table: DataFrame, key: str) -> DataFrame:
    """key, v: the values of a column in the order of the dimensions."""
    gathered = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("value").cast("double").alias("value")))).alias("v"))
    return gathered.select(F.col(key).alias("key"), F.transform("v", lambda x: x["value"]).alias("v"))


def _standardised(column: pa.ListArray) -> np.ndarray:
    """A row for each vector, of mean 0 and standard deviation 1; NaN without variance."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("a column lacks a dimension")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x - x.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / x.std(axis=1, ddof=1, keepdims=True) if x.shape[1] > 1 else np.full(x.shape, np.nan)


def correlation(semantics: DataFrame, activations: DataFrame, *, allow_nan: bool = False) -> DataFrame:
    """outcome, event_id, r: Pearson's correlation of every outcome's with every event's values over ``dim``.

    ``semantics``: dim, outcome, value; ``activations``: dim, event_id, value.  Both need the same
    dimensions in every column.  The outcomes' columns lie in the shared folder; a task holds some events' columns, reads the
    outcomes' in blocks and returns their products, so only the columns themselves are shuffled.
    """
    dims = [t.select("dim").distinct() for t in (semantics, activations)]
    if not dims[0].join(dims[1], "dim", "left_anti").isEmpty() or not dims[1].join(dims[0], "dim", "left_anti").isEmpty():
        raise AssertionError("the dimensions differ")
    if not allow_nan:
        for t, key in ((semantics, "outcome"), (activations, "event_id")):
            spread = t.groupBy(key).agg(F.stddev_samp("value").alias("sd"))
            if not spread.where("sd is null or sd = 0 or isnan(sd)").isEmpty():
                raise ValueError("a column has no variance or holds NaN")
    folder = scratch(semantics.sparkSession, "semantics")
    outcomes, events = _columns(semantics, "outcome"), _columns(activations, "event_id")
    outcomes.write.parquet(folder)
    kinds = (outcomes.schema["key"].dataType.simpleString(), events.schema["key"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                y = _standardised(part.column(1))
                for names, x in _blocks(folder):
                    r = np.clip(x @ y.T / max(y.shape[1] - 1, 1), -1, 1) if y.shape[1] == x.shape[1] else np.full((len(x), len(y)), np.nan)
                    at = np.arange(r.size)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at // len(y))), part.column(0).take(pa.array(at % len(y))), pa.array(r.ravel())], ["outcome", "event_id", "r"])

    return events.mapInArrow(run, f"outcome {kinds[0]}, event_id {kinds[1]}, r double")


def _blocks(folder: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(names, standardised columns) of the outcomes, some at a time."""
    fs, path = filesystem(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda x: x.base_name):
        if info.base_name.startswith("part-"):
            with fs.open_input_file(info.path) as source:
                file = pq.ParquetFile(source)
                wide = max(1, file.metadata.row_group(0).column(1).num_values // max(file.metadata.num_rows, 1)) if file.metadata.num_row_groups else 1
                for batch in file.iter_batches(max(1, min(1024, BLOCK_VALUES // wide))):
                    yield batch.column(0), _standardised(batch.column(1))
