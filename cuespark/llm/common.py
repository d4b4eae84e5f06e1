"""What the training-data operators share: column picking, the shared scratch folder, files.

Scratch data live below ``spark.checkpoint.dir`` (a folder that the driver and all
executors share), so a lost executor never takes intermediate results along.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import posixpath
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []
_held: dict[tuple[str, str], object] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, as ``out=source``; other columns may have any names.

    Works by position, so columns that differ in case only, or appear twice, do no harm.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(src)}").alias(out) for out, src in cols.items()])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; a local one only where none is set and Spark itself is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="cuespark-"))
        base = _fallback[0]
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Once the table is written nothing reads the shuffle files behind it, and Spark deletes them.
    ``batch_rows`` bounds the rows that are sent to Python at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no plan reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two more columns that name each of them, the same whenever they are read; and these columns' names.

    Rows of Parquet files are named by file and place.  Anything but columns and conditions over
    such a scan is written to the shared folder first.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    taken = {c.lower() for c in df.columns}
    if plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet" and "_metadata" not in taken:
        named = df
    else:
        named = materialise(df.toDF(*[f"_{i}" for i in range(len(df.columns))]), "named")
    names = []
    for name in ("row_file", "row_place"):
        while name in taken:
            name += "_"
        names.append(name)
    found = named.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    return found.toDF(*df.columns, *names), names


def held(operator: str, key: str, make: Callable[[], object]) -> object:
    """A model or cache of this Python worker, which its later tasks use again; those of other operators go first."""
    make_room(operator)
    if (operator, key) not in _held:
        _held[operator, key] = make()
    return _held[operator, key]


def make_room(operator: str) -> None:
    """Give back what other operators hold in this worker."""
    others = [k for k in _held if k[0] != operator]
    if not others:
        return
    for k in others:
        del _held[k]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def shrink(kept: dict, most: int, part: float = 0.75) -> None:
    """Beyond ``most`` entries the oldest stay, which hold the frequent ones."""
    if len(kept) > most:
        oldest = list(itertools.islice(kept.items(), int(most * part)))
        kept.clear()
        kept.update(oldest)
