"""Sinks: event files, encoded events, counters, corpora; and paths that overwrite nothing."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import pack
from ..storage import filesystem, scratch


def _tsv(df: DataFrame, path: str, compression: str | None) -> None:
    """Rows as lines of plain text, columns between tabs, each file behind a header; nulls are empty.  A tab or line end in a value is an error.

    The order of the rows within their partitions stays.  Files of a table format aren't used: they quote values that begin with ``#``.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    broken = F.lit(False)
    for v in values:
        broken = broken | v.rlike("[\t\n\r]")
    line = F.concat_ws("\t", *values)
    line = F.when(broken, F.raise_error(F.concat(F.lit("a tab or a line end within a value: "), line))).otherwise(line)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition
    lines = df.select(place.alias("place"), line.alias("line"))
    header = F.lit("\t".join(df.columns))
    lines = lines.select(F.explode(F.when(F.col("place") == 0, F.array(header, F.col("line"))).otherwise(F.array("line"))).alias("value"))
    lines.write.mode("errorifexists").option("compression", compression or "none").text(path)


def write_events(events: DataFrame, path: str, *, compression: str | None = "gzip", columns: tuple[str, str] = ("cues", "outcomes"), compatible: bool = False, one_file: bool = False, per_file: int | None = None, laid_out: bool = False, packed: bool = False) -> None:
    """Tab-separated files whose names sort as their events' ``event_id``, each with a header, tokens joined with ``_``.

    ``per_file`` is about how many events a file holds (none: as many as a task gets).  Events that are ``laid_out`` stand in order over all
    partitions, as ``corpus.laid_events`` gives them; they stay there, and need no ``event_id``.

    ``packed`` files have the short lines of ``functions.packed``, which only ``read_events`` reads: events of overlapping windows take
    about two fifths of the disk.

    ``one_file`` is for other programs that read a single file: all events pass through one task then.
    """
    if packed and (compatible or compression != "gzip"):
        raise ValueError("packed events are gzip files of their own form")
    names = ("Cues", "Outcomes") if compatible else columns
    kinds = dict(events.dtypes)
    parts = [(F.array_join(c, "_") if kinds[c].startswith("array") else F.col(c)).alias(n) for c, n in zip(columns, names)]
    if compatible:
        warnings.warn("with a Frequency column, as other programs expect it", stacklevel=2)
        parts.append(F.lit(1).alias("Frequency"))
    if laid_out:
        laid = events
    elif one_file:
        laid = events.coalesce(1).sortWithinPartitions("event_id")
    elif per_file is None:
        laid = events.repartitionByRange("event_id").sortWithinPartitions("event_id")
    else:
        laid = events.repartitionByRange(max(1, -(-events.count() // per_file)), "event_id").sortWithinPartitions("event_id")
    if not packed:
        return _tsv(laid.select(*parts), path, compression)
    values = [F.coalesce(c.cast("string"), F.lit("")) for c in parts]
    write_packed(laid.select(*values).mapInArrow(pack, "value string"), path)


def write_packed(lines: DataFrame, path: str) -> None:
    """Gzip files of lines that ``functions.packed`` gives, or ``corpus.packed_ngrams``, as they are laid out."""
    lines.write.mode("errorifexists").option("compression", "gzip").option("zlib.compress.level", "FOUR").text(path)


def write_arrivals(events: DataFrame, path: str, per_file: int) -> None:
    """Parquet files of about so many events, written one after the other in the order of ``event_id``: a stream of files takes them by their times."""
    spark, laid = events.sparkSession, scratch(events.sparkSession, "arrivals")
    events.repartitionByRange(max(1, -(-events.count() // per_file)), "event_id").write.parquet(laid)
    fs, folder = filesystem(laid)
    for name in sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.startswith("part-")):
        spark.read.schema(events.schema).parquet(f"{laid}/{name}").coalesce(1).write.mode("append").parquet(path)


def write_encoded(encoded: DataFrame, path: str, *, start: int = 0, stop: int | None = None, events_per_file: int = 10_000_000, overwrite: bool = False) -> int:
    """Encoded events of [start, stop) as Parquet, in order over all files; returns how many."""
    if events_per_file < 2:
        raise ValueError("a file holds at least two events")
    rows = encoded.where(F.col("event_id") >= start)
    if stop is not None:
        rows = rows.where(F.col("event_id") < stop)
    ordered = rows.repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", events_per_file).parquet(path)
    return encoded.sparkSession.read.parquet(path).count()


def write_counter(counter: DataFrame, path: str, header: tuple[str, str] = ("key", "freq")) -> None:
    """key, freq by descending frequency, over all files in the order of their names."""
    order = [F.desc(header[1]), F.col(header[0])]
    _tsv(counter.toDF(*header).repartitionByRange(*order).sortWithinPartitions(*order), path, None)


def write_corpus(lines: DataFrame, path: str) -> None:
    """Corpus text of (path, line_no, text), in that order."""
    lines.repartitionByRange("path").sortWithinPartitions("path", "line_no").select("text").write.mode("errorifexists").text(path)


def write_list(names: DataFrame, path: str) -> None:
    """The text column in ascending order, at ``path`` or, if that is taken, at it with a number."""
    path = path if ":" in path else str(safe_path(path, "{path.name}-{counter}"))
    names.sort(*names.columns).write.mode("errorifexists").text(path)


def write_subtitles(sentences: DataFrame, path: str, *order: str, per_document: int = 20_000) -> None:
    """Gzip files of subtitle sentences (column ``sentence``, XML), in the given order; a document holds about so many."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if not begun:
                yield pa.RecordBatch.from_pydict({"value": ['<?xml version="1.0" encoding="utf-8"?>', "<document>"]})
                begun = True
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        if begun:
            yield pa.RecordBatch.from_pydict({"value": ["</document>"]})

    documents = max(1, -(-sentences.count() // per_document))
    ordered = sentences.repartitionByRange(documents, *order).sortWithinPartitions(*order).select("sentence")
    ordered.mapInArrow(wrap, "value string").write.mode("errorifexists").option("compression", "gzip").text(path)


def safe_path(path: str | Path, template: str = "{path.stem}-{counter}{path.suffix}") -> Path:
    """The path, or the first numbered one by the template that doesn't exist."""
    path = Path(path)
    if not path.exists():
        return path
    counter = 1
    while (other := path.parent / template.format(path=path, counter=counter)).exists():
        counter += 1
    return other
