"""Event files as an ordered stream: a streaming data source whose offsets are (file, line).

``spark.readStream.format("event_files").load(folder)`` gives event_id, cues, outcomes of the files of a folder
in the order of their names; new files join at the end.  Options: ``files_per_batch`` (by default all that
there are), ``lines_per_batch`` for plain files, which then may be read in parts; ``compression``: ``gzip`` or ``none``.

An offset says how many files, and how many lines of the next one, have been read, and the name of the last file; so a batch that is run again
holds the same events.  An event's id is its file's place times 2^40 plus its own place in the file, which rises over
batches.  A file that turns up before one that has been read would change the order, and is an error.
Each file of a batch is one task's; lines are read as a stream.
"""

from __future__ import annotations

import gzip
import io
import itertools
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..storage import filesystem

NAME = "event_files"
#: Places of events within a file.
FILE_BITS = 40
_SCHEMA = "event_id long, cues array<string>, outcomes array<string>"
_KINDS = pa.schema([("event_id", pa.int64()), ("cues", pa.list_(pa.string())), ("outcomes", pa.list_(pa.string()))])


def event_of(line: str) -> tuple[list[str], list[str], int]:
    """Cues, outcomes and frequency of a line."""
    columns = line.split("\t")
    if len(columns) not in (2, 3):
        raise ValueError(f"an event has two or three columns: {line}")
    return columns[0].split("_"), columns[1].split("_"), int(columns[2]) if len(columns) == 3 else 1


@dataclass
class Lines(InputPartition):
    """Events low to high (excluded; none: all) of a file, which is the so many-th."""

    place: int
    name: str
    low: int
    high: int | None


class EventFileStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.files = int(options["files_per_batch"]) if "files_per_batch" in options else None
        self.lines = int(options["lines_per_batch"]) if "lines_per_batch" in options else None
        if self.lines and self.packed:
            raise ValueError("packed files are read whole")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": 0, "line": 0, "last": ""}

    def _names(self) -> list[str]:
        fs, folder = filesystem(self.path)
        names = (x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File)
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def _open(self, name: str) -> Iterator[str]:
        """The lines behind the header."""
        fs, folder = filesystem(self.path)
        with fs.open_input_stream(posixpath.join(folder, name), compression=None) as source:
            data = gzip.GzipFile(fileobj=source) if self.packed else source
            with io.TextIOWrapper(io.BufferedReader(data) if self.packed else data, encoding="utf-8", newline="\n") as text:
                yield from itertools.islice((x.rstrip("\n") for x in text), 1, None)

    def _after(self, start: dict, names: list[str]) -> dict:
        """Where the batch ends that starts there."""
        if start["last"] and (len(names) < start["file"] or names[start["file"] - 1] != start["last"]):
            raise ValueError(f"the files up to {start['last']} aren't those that were read")
        if self.lines:
            if start["file"] == len(names):
                return start
            there = sum(1 for _ in itertools.islice(self._open(names[start["file"]]), start["line"] + self.lines + 1))
            if there > start["line"] + self.lines:
                return {**start, "line": start["line"] + self.lines}
            return {"file": start["file"] + 1, "line": 0, "last": names[start["file"]]}
        end = len(names) if self.files is None else min(len(names), start["file"] + self.files)
        return {"file": end, "line": 0, "last": names[end - 1]} if end > start["file"] else start

    def latestOffset(self) -> dict:
        self.at = self._after(self.initialOffset() if self.at is None else self.at, self._names())
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[Lines]:
        self.at = end  # after a restart the next batch goes on from here
        names, out = self._names(), []
        if end["last"] and (len(names) < end["file"] or names[end["file"] - 1] != end["last"]):
            raise ValueError(f"the files up to {end['last']} aren't those that were read")
        for k in range(start["file"], end["file"] + (end["line"] > 0)):
            low = start["line"] if k == start["file"] else 0
            out.append(Lines(k, names[k], low, end["line"] if k == end["file"] else None))
        return out or [Lines(0, "", 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        place = (partition.place << FILE_BITS) + partition.low
        lines = itertools.islice(self._open(partition.name), partition.low, partition.high)
        while part := list(itertools.islice(lines, 10_000)):
            ids, cues, outcomes = [], [], []
            for line in part:
                c, o, times = event_of(line)
                if self.lines and times != 1:
                    raise ValueError("files with frequencies are read whole")
                for _ in range(times):
                    ids.append(place)
                    cues.append(c)
                    outcomes.append(o)
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, cues, outcomes), _KINDS)], schema=_KINDS)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> EventFileStream:
        return EventFileStream(dict(self.options))


def stream_events(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The stream of a folder's event files."""
    spark.dataSource.register(EventFiles)
    reader = spark.readStream.format(NAME)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)
