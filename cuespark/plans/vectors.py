"""Vectors in the shared folder as tiles of id ranges, read by the tasks when their events need them."""

from __future__ import annotations

import posixpath
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import filesystem, scratch

#: Numbers of a tile, of the tiles that a task keeps, and of the sums that it holds at once.
TILE_NUMBERS = 1_000_000
KEPT_NUMBERS = 32_000_000
SUM_NUMBERS = 4_000_000


def read_batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a folder's files in the order of their names; nothing if there is no such folder."""
    fs, folder = filesystem(path)
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.base_name):
            if info.base_name.startswith("part-"):
                with fs.open_input_file(info.path) as source:
                    yield from pq.ParquetFile(source).iter_batches(1_000_000, columns=columns)


def add_rows(sums: np.ndarray, event: np.ndarray, row: np.ndarray, tile: np.ndarray) -> None:
    """Add the tile's rows to the sums of their events; events ascend."""
    size = max(1, 2_000_000 // max(1, tile.shape[1]))
    for k in range(0, len(event), size):
        own, first = np.unique(event[k : k + size], return_index=True)
        sums[own] += np.add.reduceat(tile[row[k : k + size]], first, axis=0)


@dataclass
class Vectors:
    """``path`` holds a folder ``tile=k`` for each range of ``rows`` ids; a vector has ``wide`` numbers."""

    path: str
    wide: int
    rows: int
    kept: OrderedDict[int, np.ndarray] = field(default_factory=OrderedDict, repr=False)

    def fresh(self) -> Vectors:
        """The same without tiles; a task's tiles end with it."""
        return Vectors(self.path, self.wide, self.rows)

    def sums(self, event: np.ndarray, ids: np.ndarray, n: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """For each of n events the sum of its ids' vectors, from dimension low to high; events ascend."""
        out = np.zeros((n, (self.wide if high is None else high) - low))
        tiles = ids // self.rows
        for number in np.unique(tiles).tolist():
            here = tiles == number
            add_rows(out, event[here], ids[here] - number * self.rows, self._tile(number)[:, low:high])
        return out

    def _tile(self, number: int) -> np.ndarray:
        """A tile, read if it isn't held; those that were used least recently go."""
        if number in self.kept:
            self.kept.move_to_end(number)
            return self.kept[number]
        tile = np.zeros((self.rows, self.wide))
        for batch in read_batches(posixpath.join(self.path, f"tile={number}"), ["place", "vec"]):
            tile[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.wide)
        self.kept[number] = tile
        while len(self.kept) > 1 and sum(t.size for t in self.kept.values()) > KEPT_NUMBERS:
            self.kept.popitem(last=False)
        return tile


def write_vectors(table: DataFrame, keys: DataFrame, n_keys: int, what: str) -> Vectors:
    """The vectors of (label, vec) for the ids of (key, id).

    Every key needs one vector, all of one length and without nulls; other labels may have any.
    """
    vec = F.col("vec").cast("array<double>")
    named = keys.join(table.select(F.col("label").alias("key"), vec.alias("vec")), "key", "left")
    gaps = F.exists("vec", lambda x: x.isNull())
    seen = named.agg(
        F.count("*").alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"),
        F.min(F.when(F.col("vec").isNull(), F.col("key"))).alias("missing"), F.min(F.when(gaps, F.col("key"))).alias("gap"),
    ).first()
    if seen["missing"] is not None:
        raise ValueError(f"{what} without a vector: {seen['missing']!r}")
    if seen["gap"] is not None:
        raise ValueError(f"{what} with a null in the vector: {seen['gap']!r}")
    if seen["n"] != n_keys:
        raise ValueError(f"{what} with several vectors")
    if seen["low"] != seen["high"]:
        raise ValueError(f"{what} vectors differ in length")
    wide = seen["high"] if n_keys else table.agg(F.max(F.size("vec"))).first()[0]
    rows = max(1, min(n_keys, TILE_NUMBERS // max(1, wide or 0)))
    path = scratch(table.sparkSession, "vectors")
    laid = named.select(F.floor(F.col("id") / rows).cast("int").alias("tile"), (F.col("id") % rows).cast("int").alias("place"), "vec")
    laid.repartition("tile").write.partitionBy("tile").parquet(path)
    return Vectors(path, wide or 0, rows)
