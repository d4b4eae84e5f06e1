"""Rescorla-Wagner and Widrow-Hoff learning of weights from ordered events."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import closed, fold, kernel
from ..plans.vectors import write_vectors
from ..storage import materialise, scratch
from . import counts
from .corpus import number_events
from .filters import apply_duplicates

#: A task's part of W takes up to this many numbers (8 bytes each).
CHUNK_NUMBERS = 32_000_000
#: Fewer rows than this aren't split over tasks: each task reads all events and solves their equations.
CHUNK_ROWS = 64
#: Up to this many numbers in the change that a range of events makes, few rows are learned by ranges.
CHANGE_NUMBERS = 4_000_000
#: Events of a range, at least and at most.
RANGE_EVENTS = (1_000, 500_000)


@dataclass
class Weights:
    """W: ``table`` (row label, column label, weight), the label tables and metadata.

    ``rows`` and ``columns`` are (key, id).  Missing pairs have weight 0.
    """

    table: DataFrame
    rows: DataFrame
    columns: DataFrame
    axes: tuple[str, str] = ("outcome", "cue")
    attrs: dict[str, str] = field(default_factory=dict)

    def dense(self) -> DataFrame:
        """Every row label with every column label."""
        pairs = self.rows.select(F.col("key").alias(self.axes[0])).crossJoin(self.columns.select(F.col("key").alias(self.axes[1])))
        return pairs.join(self.table, list(self.axes), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))

    def lookup(self, row: str, column: str) -> DataFrame:
        return self.dense().where((F.col(self.axes[0]) == row) & (F.col(self.axes[1]) == column))

    def wide(self) -> DataFrame:
        """A row for each row label, a column for each column label."""
        return self.dense().groupBy(self.axes[0]).pivot(self.axes[1]).agg(F.first("weight"))

    def write(self, path: str) -> None:
        self.table.write.parquet(f"{path}/table")
        self.rows.write.parquet(f"{path}/rows")
        self.columns.write.parquet(f"{path}/columns")
        spark = self.table.sparkSession
        spark.createDataFrame([(json.dumps({"axes": self.axes, "attrs": self.attrs}),)], "meta string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def read(cls, spark, path: str) -> Weights:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        parts = [spark.read.parquet(f"{path}/{x}") for x in ("table", "rows", "columns")]
        return cls(*parts, tuple(meta["axes"]), meta["attrs"])


def from_table(table: DataFrame, axes: tuple[str, str] = ("outcome", "cue")) -> Weights:
    """Weights of a long table; its labels are the axes."""
    rows, columns = (table.select(F.col(a).alias("key")).distinct() for a in axes)
    return Weights(table, _ids(rows), _ids(columns), axes)


def _ids(keys: DataFrame) -> DataFrame:
    return counts.vocabulary(keys.select(F.array("key").alias("k")), "k")


def _attrs(old: Weights | None, started: float, **values) -> dict[str, str]:
    """What is known of a run; of a continued one the old values stand in front of the new."""
    import getpass
    import socket

    import pandas as pd
    import pyspark

    now = {k: str(v) for k, v in values.items()} | {
        "hostname": socket.gethostname(), "username": getpass.getuser(), "cpu_time": f"{time.process_time():.3f}", "pandas": pd.__version__,
        "date": time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(started)), "wall_time": f"{time.time() - started:.3f}",
        "spark": pyspark.__version__, "numpy": np.__version__,
    }
    if old is None or not old.attrs:
        return now
    return {k: " | ".join(x for x in (old.attrs.get(k, ""), now.get(k, "")) if x) for k in {**old.attrs, **now}}


def _known(old: Weights | None, *axes: int) -> DataFrame | None:
    """(axis, key) of a former W, of cues (0) and outcomes (1)."""
    if old is None or not axes:
        return None
    tables = [(old.columns, old.rows)[a].select(F.lit(a).alias("axis"), "key") for a in axes]
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def _events(events: DataFrame | str | Iterable, remove_duplicates: bool | None) -> tuple[DataFrame, str]:
    """event_id, cues, outcomes of a table, an event file or pairs; and the file."""
    from ..sources import readers

    path = ""
    if isinstance(events, str):
        path, events = events, readers.read_events(SparkSession.active(), events)
    elif not isinstance(events, DataFrame):
        events = readers.events_from_list(SparkSession.active(), events)
    return apply_duplicates(events.select("event_id", "cues", "outcomes"), remove_duplicates), path


def _learned(
    events: DataFrame, n_events: int, cues: DataFrame, outcomes: DataFrame, rule: kernel.Rule, n_inputs: int, n_rows: int, initial: DataFrame | None, per_chunk: int | None
) -> DataFrame:
    """row, weights of W: by ranges of events if its rows are too few for all tasks and the ranges' changes are small, else by chunks of rows."""
    spark = events.sparkSession
    if not n_inputs or not n_rows:
        return spark.createDataFrame([], "row int, weights array<double>")
    parallel = spark.sparkContext.defaultParallelism
    encoded = counts.encode(events, cues, outcomes)
    if per_chunk is None and n_rows < CHUNK_ROWS * parallel and kernel.change_size(rule, n_inputs, n_rows) <= CHANGE_NUMBERS:
        found = kernel.run_ranges(spark, kernel.write_encoded(encoded, _ranges(n_events, parallel)), rule, n_inputs, n_rows, initial)
    else:
        path, places = kernel.write_encoded(encoded), None
        if rule.outcome_vectors is None and events.schema["event_id"].dataType.simpleString() in ("int", "bigint"):
            places = kernel.rows_by_first_event(path, outcomes, n_rows, initial, _placed)
        found = kernel.run(spark, path, rule, n_inputs, n_rows, _chunk(n_inputs, n_rows, parallel, per_chunk), initial, places)
    return materialise(found, "weights")


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """row, place (from 0) of (first, row), in that order."""
    if n <= counts.SMALL_KEYS:
        return rows.select("row", (F.row_number().over(Window.orderBy("first", "row")) - 1).alias("place"))
    numbered = number_events(rows.select("first", "row", F.array("row").alias("cues"), F.lit(None).alias("outcomes")), "first", "row")
    return numbered.select(F.col("cues")[0].alias("row"), F.col("event_id").alias("place"))


def _ranges(n_events: int, parallel: int) -> int:
    """Ranges of events: as many as tasks at once, within the sizes of a range."""
    least, most = RANGE_EVENTS
    return max(1, -(-n_events // most), min(parallel, -(-n_events // least)))


def _chunk(n_inputs: int, n_rows: int, parallel: int, per_chunk: int | None) -> int:
    if per_chunk is not None:
        if per_chunk < 1:
            raise ValueError("a chunk holds at least one row")
        return per_chunk
    return max(1, min(max(-(-n_rows // parallel), CHUNK_ROWS), CHUNK_NUMBERS // max(n_inputs, 1)))


def _table(found: DataFrame, rows: DataFrame, columns: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """Dense rows of ids to (label, label, weight), without the zeros."""
    long = found.select("row", F.posexplode("weights").alias("input", "weight")).where("weight <> 0")
    named = long.join(rows.select(F.col("id").alias("row"), F.col("key").alias(axes[0])), "row").join(columns.select(F.col("id").alias("input"), F.col("key").alias(axes[1])), "input")
    return named.select(*axes, "weight")


def rw_learn(
    events: DataFrame | str | Iterable,
    alpha: float | Mapping[str, float] | DataFrame = 0.1,
    betas: tuple[float, float] = (0.1, 0.1),
    lambda_: float = 1.0,
    *,
    weights: Weights | None = None,
    remove_duplicates: bool | None = None,
    strategy: str | None = None,
    outcomes_per_chunk: int | None = None,
) -> Weights:
    """Learn W from events (event_id, cues, outcomes), in the order of ``event_id``.

    Every outcome's row changes at every event; events without the outcome count against its cues.
    Events may be an event file's path or pairs of cues and outcomes, too.  ``alpha`` may be a number for each cue, as a
    mapping or, for large vocabularies, as a table (key, rate) that stays on the executors.  With ``weights`` learning continues; its outcomes and cues stay on the axes.
    ``strategy``: ``closed`` (one cue an event, fresh W: a scan over ranges of events), ``fold`` (expressions), ``kernel``.
    """
    started = time.time()
    events, path = _events(events, remove_duplicates)
    cues, outcomes, n_cues, n_outcomes, n, several = counts.vocabularies(events, _known(weights, 0, 1))
    varying = isinstance(alpha, (Mapping, DataFrame))
    # single-cue events have a closed form; all else goes to the kernel
    strategy = strategy or ("kernel" if weights is not None or varying or several else "closed")
    if strategy == "closed":
        table = closed.closed_form(events, float(alpha), betas, lambda_, _ranges(n, events.sparkSession.sparkContext.defaultParallelism))
    elif strategy == "fold":
        if weights is not None:
            raise ValueError("the fold starts from zero")
        names = [[r["key"] for r in t.orderBy("id").collect()] for t in (cues, outcomes)]
        table = fold.fold_binary(events, *names, alpha, betas, lambda_).where("weight <> 0")
    elif strategy == "kernel":
        rule = kernel.Rule(_rates(alpha, cues, n_cues) if varying else alpha, betas, lambda_)
        initial = None if weights is None else _initial(weights, outcomes, cues)
        found = _learned(events, n, cues, outcomes, rule, n_cues, n_outcomes, initial, outcomes_per_chunk)
        table = _table(found, outcomes, cues, ("outcome", "cue"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rate = "varying" if varying else alpha
    attrs = _attrs(weights, started, event_path=path, function="rw_learn", number_events=n, alpha=rate, betas=betas, **{"lambda": lambda_}, method=strategy, remove_duplicates=remove_duplicates)
    return Weights(table, outcomes, cues, ("outcome", "cue"), attrs)


def _rates(alpha: Mapping[str, float] | DataFrame, cues: DataFrame, n: int) -> np.ndarray | str:
    """A number for each cue: in an array for a mapping; of a table (key, rate) the folder of (id, rate), which the tasks read."""
    if isinstance(alpha, DataFrame):
        joined = cues.join(alpha.select("key", F.col("rate").cast("double").alias("rate")), "key", "left")
        known = F.when(F.col("rate").isNull(), F.raise_error(F.concat(F.lit("a cue without a rate: "), F.col("key")))).otherwise(F.col("rate"))
        path = scratch(cues.sparkSession, "rates")
        joined.select("id", known.alias("rate")).write.parquet(path)
        return path
    rates = np.zeros(n)
    for r in cues.toLocalIterator():
        rates[r["id"]] = alpha[r["key"]]
    return rates


def _initial(old: Weights, rows: DataFrame, columns: DataFrame) -> DataFrame:
    a, b = old.axes
    t = old.table.where("weight <> 0").select(F.col(a).alias("_r"), F.col(b).alias("_c"), "weight")
    t = t.join(rows.select(F.col("key").alias("_r"), F.col("id").alias("row")), "_r").join(columns.select(F.col("key").alias("_c"), F.col("id").alias("input")), "_c")
    return t.select("row", "input", "weight")


def wh_learn(
    events: DataFrame | str | Iterable,
    eta: float,
    *,
    cue_vectors: DataFrame | None = None,
    outcome_vectors: DataFrame | None = None,
    cue_dims: list[str] | None = None,
    outcome_dims: list[str] | None = None,
    betas: tuple[float, float] | None = None,
    lambda_: float = 1.0,
    weights: Weights | None = None,
    remove_duplicates: bool | None = None,
    rows_per_chunk: int | None = None,
) -> Weights:
    """Learn by the Widrow-Hoff rule; vector tables are (label, vec), of any size: tasks read tiles of them.

    Without any vectors this is the Rescorla-Wagner rule with one rate.  Several cues' or outcomes' vectors
    add up.  Axes are the labels, or the names of the vectors' dimensions (by default their numbers).
    """
    betas = betas or (eta, eta)
    if cue_vectors is None and outcome_vectors is None:
        return rw_learn(events, 1.0, betas, lambda_, weights=weights, remove_duplicates=remove_duplicates, strategy="kernel", outcomes_per_chunk=rows_per_chunk)
    started = time.time()
    events, path = _events(events, remove_duplicates)
    spark = events.sparkSession
    known = _known(weights, *[k for k, v in ((0, cue_vectors), (1, outcome_vectors)) if v is None])
    cues, outcomes, n_inputs, n_rows, n, _ = counts.vocabularies(events, known)

    def dims(names: list[str] | None, size: int) -> DataFrame:
        names = names or [str(i) for i in range(size)]
        if len(names) != size:
            raise ValueError("a name for each dimension")
        return spark.createDataFrame([(k, i) for i, k in enumerate(names)], "key string, id int")

    x = y = None
    columns, rows = cues, outcomes
    if cue_vectors is not None:
        x = write_vectors(cue_vectors, cues, n_inputs, "cues")
        n_inputs = x.wide
        columns = dims(cue_dims, n_inputs)
    if outcome_vectors is not None:
        y = write_vectors(outcome_vectors, outcomes, n_rows, "outcomes")
        n_rows = y.wide
        rows = dims(outcome_dims, n_rows)
    axes = ("outcome" if y is None else "outcome_dim", "cue" if x is None else "cue_dim")
    initial = None if weights is None else _initial(weights, rows, columns)
    found = _learned(events, n, cues, outcomes, kernel.Rule(1.0, betas, lambda_, x, y), n_inputs, n_rows, initial, rows_per_chunk)
    table = _table(found, rows, columns, axes)
    attrs = _attrs(weights, started, event_path=path, function="wh_learn", number_events=n, eta=eta, betas=betas, **{"lambda": lambda_}, method="kernel", remove_duplicates=remove_duplicates)
    return Weights(table, rows, columns, axes, attrs)
