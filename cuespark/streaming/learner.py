"""Learning on a stream: W lives in keyed state, a row for each cue of an outcome bucket; events arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import kernel
from ..storage import scratch

_OUT = "outcome string, cue string, weight double, last_event long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Events of a block, which is one row on the way to the learners.
BLOCK = 5_000
_CODED = pa.dictionary(pa.int32(), pa.string())
_BLOCK = pa.schema([("event_id", pa.int64()), ("cues", pa.list_(_CODED)), ("outcomes", pa.list_(_CODED)), ("buckets", pa.list_(pa.int32()))])


def _bucket(outcome, buckets: int):
    return F.pmod(F.xxhash64(outcome), F.lit(buckets)).cast("int")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block: event_id, cues, outcomes and their buckets of up to ``BLOCK`` events, each token written once."""
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            columns = [part.column(0)]
            if part.column(1).flatten().null_count:
                raise ValueError("a cue is null")
            for column, kind in zip(part.columns[1:], (_CODED, _CODED, pa.int32())):
                offsets = pa.array(np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()]), pa.int32())
                values = column.flatten()
                columns.append(pa.ListArray.from_arrays(offsets, values.dictionary_encode().cast(kind) if kind is _CODED else values))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _BLOCK) as out:
                out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_BLOCK))
            yield pa.RecordBatch.from_pydict({"block": [sink.getvalue().to_pybytes()]})


class Tokens:
    """Tokens of the events of a batch as numbers, a block at a time; ``seen`` are the tokens in the order of their numbers."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []

    def add(self, column: pa.ListArray, kept: np.ndarray | None = None) -> None:
        values, sizes = column.values, np.diff(column.offsets.to_numpy())
        codes = values.indices.to_numpy(zero_copy_only=False)
        if kept is not None:
            codes, sizes = codes[kept], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        names, own = values.dictionary.to_pylist(), np.unique(codes)
        numbers = np.zeros(len(names), np.int32)
        numbers[own] = [self.seen.setdefault(names[k], len(self.seen)) for k in own.tolist()]
        self.codes.append(numbers[codes])
        self.sizes.append(sizes.astype(np.int32))

    def sorted(self, order: np.ndarray | None, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets, and the places of the tokens, of the events in an order (none: as they came)."""
        place = np.array([places[t] for t in self.seen], np.int32)
        sizes, codes = np.concatenate(self.sizes), np.concatenate(self.codes)
        if order is not None:
            starts, sizes = (np.cumsum(sizes, dtype=np.int64) - sizes)[order], sizes[order]
            ends = np.cumsum(sizes, dtype=np.int64)
            codes = codes[np.arange(len(codes)) + np.repeat(starts - ends + sizes, sizes)]
        return np.cumsum(np.concatenate([[0], sizes]), dtype=np.int64), place[codes] if len(place) else codes


class Learner(StatefulProcessor):
    """A bucket's outcomes (their places are those of the weights in a cue's row), its last event, and a row of weights for each cue.

    A batch reads and writes the rows of its own cues.  A row is as long as the outcomes were when it was last
    written; what it lacks is 0, which is exact: before its first event an outcome has nothing to unlearn.
    """

    def __init__(self, alpha: float, betas: tuple[float, float], lambda_: float) -> None:
        self.rule = kernel.Rule(alpha, betas, lambda_)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event long")
        self.outcomes = handle.getValueState("outcomes", "names array<string>")
        self.rows = handle.getMapState("rows", "cue string", "weights binary")

    def _names(self, new: Iterator[str]) -> dict[str, int]:
        """The outcomes with their places, new ones at the end."""
        held = list(self.outcomes.get()[0]) if self.outcomes.exists() else []
        names = {o: i for i, o in enumerate(held)}
        for o in sorted(set(new).difference(names)):
            names[o] = len(names)
        if len(names) > len(held):
            self.outcomes.update((list(names),))
        return names

    def _row(self, cue: str, n: int) -> np.ndarray:
        row = np.zeros(n)
        if self.rows.containsKey((cue,)):
            held = np.frombuffer(self.rows.getValue((cue,))[0])
            row[: len(held)] = held
        return row

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, cued, named = [], Tokens(), Tokens()
        for block in (b for frame in rows for b in frame["block"]):
            (part,) = pa.ipc.open_stream(block)
            found.append(part.column(0).to_numpy())
            cued.add(part.column(1))
            named.add(part.column(2), part.column(3).values.to_numpy() == key[0])
        ids, last, order = np.concatenate(found), self.last.get()[0] if self.last.exists() else None, None
        if (np.diff(ids) <= 0).any():
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
        late = np.flatnonzero(np.diff(ids) <= 0)
        if len(late) or (last is not None and ids[0] <= last):
            raise ValueError(f"event {ids[late[0] + 1] if len(late) else ids[0]} comes after event {ids[late[0]] if len(late) else last}")
        self.last.update((int(ids[-1]),))
        names = self._names(named.seen)
        if not names:  # nothing to unlearn yet
            return
        cues = {c: i for i, c in enumerate(sorted(cued.seen))}
        before = np.array([self._row(c, len(names)) for c in cues]).reshape(len(cues), len(names))
        w = before.copy()
        kernel.learn(w, iter([(*cued.sorted(order, cues), *named.sorted(order, names))]), self.rule, 0, len(names))
        for cue, at in cues.items():
            self.rows.updateValue((cue,), (w[at].tobytes(),))
        at, of = np.nonzero(w != before)
        found = {"outcome": np.array(list(names), object)[of], "cue": np.array(list(cues), object)[at], "weight": w[at, of], "last_event": np.full(len(at), ids[-1])}
        yield pd.DataFrame(found)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        names = self._names(initialState["outcome"])
        for cue, part in initialState.groupby("cue"):
            row = self._row(cue, len(names))
            row[[names[o] for o in part["outcome"]]] = part["weight"]
            self.rows.updateValue((cue,), (row.tobytes(),))

    def close(self) -> None:
        pass


def stream_learn(
    events: DataFrame, alpha: float = 0.1, betas: tuple[float, float] = (0.1, 0.1), lambda_: float = 1.0, buckets: int = 8, weights: DataFrame | None = None
) -> DataFrame:
    """outcome, cue, weight, last_event after each micro-batch, in update mode.

    Every event goes to every bucket, as absent outcomes unlearn as well; an outcome belongs to the bucket of its
    hash.  Events travel in packed blocks, and a task holds a micro-batch as numbers: limit what the source gives a batch.  Within a batch events are sorted; an id that is not above the last one seen is an error.
    ``weights`` (outcome, cue, weight) of former learning are the state's start; with a checkpoint that has one already they aren't read.
    The session's state store must be the one on RocksDB, which ``learn_available`` sets.
    """
    told = F.filter("outcomes", lambda o: o.isNotNull())
    shaped = events.select("event_id", "cues", told.alias("outcomes"), F.transform(told, lambda o: _bucket(o, buckets)).alias("buckets"))
    blocks = shaped.mapInArrow(pack, "block binary")
    start = None
    if weights is not None:  # a table of its own, as the stream's plan can't hold any plan
        path = scratch(events.sparkSession, "stream-start")
        weights.select(_bucket("outcome", buckets).alias("bucket"), "outcome", "cue", "weight").where("weight <> 0").write.parquet(path)
        start = events.sparkSession.read.parquet(path).groupBy("bucket")
    grouped = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).groupBy("bucket")
    return grouped.transformWithStateInPandas(Learner(alpha, betas, lambda_), _OUT, "Update", "None", start)


def on_rocks(spark: SparkSession) -> None:
    """Keyed state with several variables needs this state store; streams that run already keep theirs."""
    spark.conf.set(_PROVIDER, _ROCKS)


def learn_available(events: DataFrame, checkpoint: str, out: str, buckets: int = 8, **rates) -> DataFrame:
    """Run the stream over what is there, in as many micro-batches as its source gives; the last weights of each pair.

    The trigger for what is available takes one batch alone from a source in Python, so the stream runs until nothing is left.
    """
    spark = events.sparkSession
    on_rocks(spark)
    query = stream_learn(events, buckets=buckets, **rates).writeStream.outputMode("update").option("checkpointLocation", checkpoint)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces its own

    parts = spark.conf.get(_PARTS)
    spark.conf.set(_PARTS, 2 * buckets)  # each is a state store; more than a few stay empty
    try:
        running = query.foreachBatch(keep).start()
    finally:
        spark.conf.set(_PARTS, parts)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    last = spark.read.parquet(out).groupBy("outcome", "cue").agg(F.max_by("weight", "last_event").alias("weight"))
    return last
