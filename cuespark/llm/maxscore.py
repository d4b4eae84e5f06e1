"""Operator 4: exact top-k inner products by MaxScore over shards of vectors.

Vectors are packed into shards that keep a list a dimension (the postings) and the
smallest and largest value of each.  A term of a query is one of its components; its
score bound in a shard is the larger of query * least and query * largest.  Terms in descending order
of bounds split into essential ones, whose lists are traversed for every vector, and
non-essential ones, which together cannot lift a vector to the query's threshold (its k-th best score
so far); those are probed, a few at a time, only for vectors that partial score plus
remaining bounds keep competitive.  A task carries thresholds from shard to shard; the
shards' top lists meet in a ranked merge.

Queries meet candidates in blocks of rows: a stated query set against all rows.  Each task holds some of its
shards, and reads the query blocks one by one from the shared folder; only the top lists are shuffled.

Scores are whole numbers.  Where a query's and a shard's components let them pass 2^53 they are summed in
64-bit integers, without bounds; where they might pass 2^63 the job fails.

Nulls: vectors that are null, empty or hold null or non-finite components take no part, nor do
null ids.  Shorter vectors count as padded with zeros.  Ties go to the smaller id.  Rows of
the query's own id are not its candidates; other repeated rows all count.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, materialise, pick, scratch

PROBE = 8
#: Shards that a task holds while the query blocks pass by.
SHARDS_BYTES = 64 << 20


#: Sums of whole numbers below this are exact in float64; those below the other one in int64.
EXACT, WHOLE = 2.0**53, 2.0**63


class Postings:
    """A shard: a list of values for each dimension, and their bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        self.lists = np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def top(self, query: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k that reach the threshold; ties by id."""
        reach = float(np.abs(query) @ self.most)
        if reach >= EXACT:  # no bounds here: whole numbers throughout
            if not reach < WHOLE:
                raise OverflowError(f"inner products of query {own} may not fit into 64 bits")
            scores = query.astype(np.int64) @ self.lists.astype(np.int64)
            keep = self.ids != own
            return best(self.ids[keep], scores[keep], k)
        edge = -np.inf if threshold is None else float(threshold)
        bounds = np.maximum(query * self.low, query * self.high)
        order = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0.0]])  # bound of the terms from i on
        essential = int(np.argmax(rest < edge)) if (rest < edge).any() else len(order)
        first = order[:essential]
        partial = query[first] @ self.lists[first] if essential else np.zeros(len(self.ids))
        alive = np.flatnonzero((partial + rest[essential] >= edge) & (self.ids != own))
        partial = partial[alive]
        for at in range(essential, len(order), PROBE):
            if not len(alive):
                break
            dims = order[at : at + PROBE]
            partial = partial + query[dims] @ self.lists[np.ix_(dims, alive)]
            keep = partial + rest[min(at + PROBE, len(order))] >= edge
            alive, partial = alive[keep], partial[keep]
        return best(self.ids[alive], partial.astype(np.int64), k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def quantise(vector: Column, factor: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("double"))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


_BLOCK = pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary())])


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors, as float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        values: list[list[float]] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            values += batch.column(1).to_pylist()
            while len(ids) >= rows:
                yield block(ids[:rows], values[:rows])
                ids, values = ids[rows:], values[rows:]
        if ids:
            yield block(ids, values)

    def block(ids: list[int], values: list[list[float]]) -> pa.RecordBatch:
        dims = max(map(len, values))
        dense = np.array([v + [0.0] * (dims - len(v)) for v in values], "<f8")
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([dense.tobytes()], pa.binary())], schema=_BLOCK)

    return vectors.mapInArrow(run, "ids binary, dims int, vectors binary")


def _open(ids: bytes, dims: int, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    dense = np.frombuffer(data, "<f8").reshape(len(names), dims)
    return names, np.pad(dense, ((0, 0), (0, width - dims))) if width > dims else dense


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: float = 64.0,
    shard_rows: int = 8192,
    query_rows: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; ``is_query`` is a condition on ``vec_id``."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("vector"), factor).alias("vector"))
    shards = materialise(pack(rows, shard_rows), "vectors")
    folder = scratch(vectors.sparkSession, "queries")
    pack(rows.where(is_query), query_rows).write.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["vectors"])
                if size >= SHARDS_BYTES:
                    yield from against_queries(held)
                    held, size = [], 0
        if held:
            yield from against_queries(held)

    def against_queries(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Top lists of all query blocks, one block in memory at a time; thresholds go from shard to shard."""
        width = max(row["dims"] for row in rows)
        opened = [(width, [Postings(*_open(row["ids"], row["dims"], row["vectors"], width)) for row in rows])]
        for block in query_blocks(folder):
            if block["dims"] > opened[0][0]:
                opened = [(block["dims"], [Postings(*_open(row["ids"], row["dims"], row["vectors"], block["dims"])) for row in rows])]
            names, queries = _open(block["ids"], block["dims"], block["vectors"], opened[0][0])
            out: tuple[list, list, list] = ([], [], [])
            for i, query in zip(names.tolist(), queries):
                have: tuple[np.ndarray, np.ndarray] | None = None
                for shard in opened[0][1]:
                    got = shard.top(query, i, k, int(have[1][-1]) if have is not None and len(have[0]) == k else None)
                    have = got if have is None else best(np.concatenate([have[0], got[0]]), np.concatenate([have[1], got[1]]), k)
                for column, values in zip(out, (np.full(len(have[0]), i, np.int64), *have)):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = shards.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_blocks(folder: str) -> Iterator[dict]:
    """The rows of the packed queries, one at a time."""
    fs, path = filesystem(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda x: x.base_name):
        if info.base_name.startswith("part-") and info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                file = pq.ParquetFile(source)
                for batch in file.iter_batches(1):
                    yield from batch.to_pylist()
