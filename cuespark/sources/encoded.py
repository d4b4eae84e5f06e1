"""Encoded events as a data source: binary files with a header and an index, read and written in slices.

``spark.read.format("encoded_events")`` gives event_id, cue_ids, outcome_ids of a folder in the order it was written, or of one file.
Options: ``path``; ``start`` and ``stop`` (excluded) for a slice; ``events_per_task``.  A folder's
``_events.json`` lists its files and how many events each holds, so slices are planned without opening
any; a file's index says where each event begins, so a task reads its own events only.  Files of
other programs have no index and are walked through once.

Writing (``write_events``): each task writes the events of its partition to a file of a new name; the commit lists the files of the attempts that
succeeded.  What a lost attempt wrote isn't listed.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.filters import apply_duplicates
from ..storage import filesystem, remove

# Fixed values of the format: unsigned 32-bit little-endian words.  Magic number, version and the number of events; then of each
# event the number of its cues, their ids, the number of its outcomes, their ids.
MAGIC, VERSION, WORD = 14159265, 2263, "<u4"
HEADER = 12
#: Behind the events: the word at which each begins (64 bits), then this mark and the number of events (32 bits).
MARK = b"EVIX"
LISTING = "_events.json"
NAME = "encoded_events"
_SCHEMA = "event_id long, cue_ids array<int>, outcome_ids array<int>"
_KINDS = pa.schema([("event_id", pa.int64()), ("cue_ids", pa.list_(pa.int32())), ("outcome_ids", pa.list_(pa.int32()))])


class Exhausted(Exception):
    """There were fewer events than the slice asked for; those were written.  ``number``: how many."""

    def __init__(self, number: int) -> None:
        super().__init__(f"the events ended before the slice, after {number}")
        self.number = number


def _places(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... so many as counts[0]; then the next."""
    ends = np.cumsum(counts)
    return np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)


def packed(cue_ids: pa.ListArray, outcome_ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the events, and where each begins."""
    sides = []
    for lists in (cue_ids, outcome_ids):
        at = lists.offsets.to_numpy().astype(np.int64)
        sides.append((np.diff(at), lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]))
    (n, cues), (m, outcomes) = sides
    sizes = n + m + 2
    begins = np.cumsum(sizes) - sizes
    words = np.empty(int(sizes.sum()), WORD)
    words[begins], words[begins + 1 + n] = n, m
    words[_places(n, begins + 1)], words[_places(m, begins + 2 + n)] = cues, outcomes
    return words, begins


def unpacked(words: np.ndarray, begins: np.ndarray, first: int) -> pa.RecordBatch:
    """Events that begin at these words; their ids count from ``first``."""
    n = words[begins].astype(np.int64)
    m = words[begins + 1 + n].astype(np.int64)
    columns = [pa.array(np.arange(first, first + len(begins)))]
    for counts, starts in ((n, begins + 1), (m, begins + 2 + n)):
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(offsets, words[_places(counts, starts)].astype(np.int32)))
    return pa.RecordBatch.from_arrays(columns, schema=_KINDS)


def header_of(source: pa.NativeFile, name: str) -> int:
    """The number of events of a file, whose header must be right."""
    data = source.read(HEADER)
    head = np.frombuffer(data, WORD) if len(data) == HEADER else [0]
    if head[0] != MAGIC:
        raise ValueError(f"{name} isn't a file of encoded events")
    if head[1] != VERSION:
        raise ValueError(f"{name} has version {head[1]}, not {VERSION}")
    return int(head[2])


def _begins(source: pa.NativeFile, n: int, low: int, high: int) -> np.ndarray:
    """Where events low to high (included) of a file begin, in words from the header on; by its index, else by a walk."""
    size = source.size()
    if size >= HEADER + 8:
        source.seek(size - 8)
        tail = source.read(8)
        if tail[:4] == MARK and int.from_bytes(tail[4:], "little") == n:
            at = size - 8 - 8 * n
            source.seek(at + 8 * low)
            found = np.frombuffer(source.read(8 * (min(high + 1, n) - low)), "<i8")
            return found if high < n else np.append(found, (at - HEADER) // 4)
    source.seek(HEADER)
    words, at, found = np.frombuffer(source.read(), WORD), 0, []
    for event in range(high + 1):
        if event >= low:
            found.append(at)
        if event < high:
            for _ in range(2):
                at += 1 + int(words[at])
    return np.array(found, np.int64)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, number of events) of a folder in order, or of one file."""
    fs, at = filesystem(path)
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == pafs.FileType.File:
        with fs.open_input_file(at) as source:
            return [("", header_of(source, path))]
    with fs.open_input_file(posixpath.join(at, LISTING)) as source:
        return [(f["name"], f["events"]) for f in json.loads(source.read())["files"]]


@dataclass
class Part(InputPartition):
    """Events low to high (excluded) of a file; ``first`` is the id of the first of them."""

    name: str
    low: int
    high: int
    first: int


class EncodedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", 1 << 62))
        self.most = int(options.get("events_per_task", 1_000_000))

    def partitions(self) -> Sequence[Part]:
        parts, before = [], 0
        for name, n in listed(self.path):
            low, high = max(self.start - before, 0), min(self.stop - before, n)
            parts += [Part(name, a, min(a + self.most, high), before + a) for a in range(low, high, self.most)]
            before += n
        return parts or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.high <= partition.low:
            return
        fs, at = filesystem(self.path)
        with fs.open_input_file(posixpath.join(at, partition.name) if partition.name else at) as source:
            n = header_of(source, partition.name or self.path)
            begins = _begins(source, n, partition.low, partition.high)
            for k in range(0, len(begins) - 1, 50_000):
                own = begins[k : k + 50_001]
                source.seek(HEADER + 4 * int(own[0]))
                words = np.frombuffer(source.read(4 * int(own[-1] - own[0])), WORD)
                yield unpacked(words, own[:-1] - own[0], partition.first + k)


@dataclass
class Written(WriterCommitMessage):
    place: int
    name: str
    events: int


class EncodedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.events"
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        target, n, at, begins = posixpath.join(folder, name), 0, 0, []
        body = target + ".body"  # the header holds the number of events, which is known at the end
        with fs.open_output_stream(body) as out:
            for batch in iterator:
                words, own = packed(batch.column("cue_ids"), batch.column("outcome_ids"))
                out.write(words.tobytes())
                begins.append(own + at)
                at, n = at + len(words), n + len(own)
        if n:
            with fs.open_output_stream(target) as out, fs.open_input_stream(body) as source:
                out.write(np.array([MAGIC, VERSION, n], WORD).tobytes())
                while chunk := source.read(1 << 22):
                    out.write(chunk)
                for own in begins:
                    out.write(own.astype("<i8").tobytes())
                out.write(MARK + n.to_bytes(4, "little"))
        fs.delete_file(body)
        return Written(place, name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files = [{"name": m.name, "events": m.events} for m in sorted((m for m in messages if m), key=lambda m: m.place) if m.events]
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(posixpath.join(folder, LISTING)) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            if m and m.events:
                fs.delete_file(posixpath.join(folder, m.name))


class EncodedEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> EncodedReader:
        return EncodedReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EncodedWriter:
        return EncodedWriter(dict(self.options))


def read_events(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """event_id, cue_ids, outcome_ids of a slice; ids are places in the whole."""
    spark.dataSource.register(EncodedEvents)
    reader = spark.read.format(NAME).option("start", start)
    return (reader if stop is None else reader.option("stop", stop)).load(path)


def write_events(encoded: DataFrame, path: str, *, start: int = 0, stop: int | None = None, remove_duplicates: bool | None = None, files: int | None = None) -> int:
    """The events (event_id, cue_ids, outcome_ids) of [start, stop), in order, into a new folder; returns how many.

    ``remove_duplicates`` as everywhere: None raises on an id twice in an event.  If the events end
    before ``stop``, those that there are get written, and Exhausted tells how many; without any, there is no folder.
    """
    spark = encoded.sparkSession
    fs, folder = filesystem(path)
    if fs.get_file_info(folder).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    spark.dataSource.register(EncodedEvents)
    rows = encoded.where(F.col("event_id") >= start)
    rows = rows if stop is None else rows.where(F.col("event_id") < stop)
    rows = apply_duplicates(rows, remove_duplicates, ("cue_ids", "outcome_ids"))
    laid = rows.repartitionByRange("event_id") if files is None else rows.repartitionByRange(files, "event_id")
    kinds = [F.col("event_id").cast("long").alias("event_id"), *[F.col(c).cast("array<int>").alias(c) for c in ("cue_ids", "outcome_ids")]]
    laid.sortWithinPartitions("event_id").select(*kinds).write.format(NAME).mode("append").save(path)
    n = sum(events for _, events in listed(path))
    if not n:
        remove(spark, path)
    if stop is not None and n < stop - start:
        raise Exhausted(n)
    return n
