"""Scans: event files, corpora, counters, subtitles; and events from rows."""

from __future__ import annotations

import codecs
import gzip
import io
import itertools
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.packed import unpack
from ..operators.corpus import number_events
from ..schema import COUNTER, EVENTS
from ..storage import materialise


def _lines(spark: SparkSession, path: str, compression: str | None, end: str | None = None) -> DataFrame:
    """path, block, at, value: ``at`` rises within a block, so the three sort lines (or what else ends in ``end``) as they stand."""
    if compression not in ("gzip", None):
        raise ValueError("compression is 'gzip' or None")
    lines = spark.read.text(path, lineSep=end)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _numbered(lines: DataFrame, header: bool = False, frequencies: bool = True) -> tuple[DataFrame, bool]:
    """(event_id, value) of all lines in the order of path, block and place, headers left out; and whether any has a third column, if there may be ``frequencies``.

    Blocks are counted and laid end to end, so no line is moved.  Should the splits of the files differ between counting and
    reading, a place lies outside of its block, which is an error.
    """
    skip = F.when(F.col("block") == 0, 1).otherwise(0) if header else F.lit(0)
    third = F.max(F.substring_index("value", "\t", 2) != F.col("value") if frequencies else F.lit(False)).alias("third")
    counts = materialise(lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), third), "blocks")  # a row for each block
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", "first", "n", F.coalesce(F.sum(F.col("n") - skip).over(before), F.lit(0)).alias("start"))
    placed = lines.join(F.broadcast(starts), ["path", "block"], "left").withColumn("place", F.col("at") - F.col("first"))
    lost = F.raise_error(F.concat(F.lit("read otherwise than it was counted: "), F.col("path")))
    there = (F.col("place") >= 0) & (F.col("place") < F.col("n"))
    own = F.when(there, F.col("place")).otherwise(lost.cast("long")) - skip
    body = F.when(F.col("place") >= 0, F.col("value")).alias("value")  # so that no condition on values is tried on headers
    numbered = placed.select("start", own.alias("place"), "value").where("place >= 0").select((F.col("start") + F.col("place")).alias("event_id"), body)
    return numbered, bool(counts.agg(F.max("third")).first()[0])


def read_events(spark: SparkSession, path: str, compression: str | None = "gzip", start: int = 0, step: int = 1, packed: bool = False, joined: bool = False) -> DataFrame:
    """event_id, cues, outcomes of an event file: a header, then two or three tab-separated columns.

    Cues and outcomes are split at ``_``; an empty column is the token ``''``.  A third column repeats
    the row so often.  ``start`` and ``step`` pick lines, before that.  ``packed`` files are those that ``write_events`` wrote so.
    With ``joined`` cues and outcomes stay texts, as they stand in the file.
    """
    if packed and compression != "gzip":
        raise ValueError("packed events are gzip files")
    numbered, third = _numbered(_lines(spark, path, compression), header=True, frequencies=not packed)
    picked = (F.col("event_id") >= start) & ((F.col("event_id") - start) % step == 0)
    place = F.expr(f"(event_id - {start}) div {step}").alias("event_id")
    tokens = lambda c: c if joined else F.split(c, "_")
    if packed:  # a line needs the one before, and gzip files aren't split
        chosen = numbered.mapInArrow(unpack, "event_id long, cues string, outcomes string").where(picked)
        return chosen.select(place, *(tokens(F.col(c)).alias(c) for c in ("cues", "outcomes")))
    chosen = numbered.where(picked)
    columns = F.split("value", "\t")
    n = F.size(columns)
    ok = F.when((n == 2) | (n == 3), columns).otherwise(F.raise_error(F.concat(F.lit("an event has two or three columns: "), F.col("value"))))
    rows = chosen.select("event_id", ok.alias("c")).select("event_id", tokens(F.col("c")[0]).alias("cues"), tokens(F.col("c")[1]).alias("outcomes"), "c")
    rows = rows.withColumn("freq", F.when(F.size("c") == 3, F.get("c", F.lit(2)).cast("int")).otherwise(1))
    if third and not rows.where("freq <> 1").isEmpty():
        return expand_frequency(rows.select("event_id", "cues", "outcomes", "freq"))
    return rows.select(place, "cues", "outcomes")


def expand_frequency(events: DataFrame) -> DataFrame:
    """Rows with ``freq`` repeated in place, with new ids."""
    repeated = events.where("freq >= 1").withColumn("_rep", F.explode(F.sequence(F.lit(1), "freq"))).withColumnRenamed("event_id", "_row")
    return number_events(repeated, "_row", "_rep")


def events_from_dataframe(df: DataFrame, columns: tuple[str, str] = ("cues", "outcomes"), order: str = "event_id") -> DataFrame:
    """Events of a table with ``_``-joined or array columns, in the order of a column."""
    kinds = dict(df.dtypes)
    parts = [F.col(c) if kinds[c].startswith("array") else F.split(c, "_") for c in columns]
    return df.select(F.col(order).alias("event_id"), parts[0].alias("cues"), parts[1].alias("outcomes"))


def events_from_list(spark: SparkSession, events: Iterable[tuple[str | list[str], str | list[str]]]) -> DataFrame:
    """Events of pairs (any iterable); their places are the ids."""
    split = lambda x: x.split("_") if isinstance(x, str) else list(x)
    return spark.createDataFrame([(i, split(c), split(o)) for i, (c, o) in enumerate(events)], EVENTS)


#: Where rows of a corpus end; other forms of the marker split the rows later on.
ROW_END = "---END.OF.DOCUMENT---"


def read_corpus(spark: SparkSession, path: str, by_document: bool = True) -> DataFrame:
    """doc_id, text of each document (markers and files end documents), or each line; in the order of files and places.

    Large files are split at the markers, so no task reads a corpus whole.
    """
    numbered, _ = _numbered(_lines(spark, path, None, ROW_END if by_document else None))
    return numbered.select(F.col("event_id").alias("doc_id"), F.col("value").alias("text"))


def read_counter(spark: SparkSession, path: str) -> DataFrame:
    """key, freq of a counter file; keys that repeat are an error."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=COUNTER, quote="", emptyValue="", nullValue="\u0000").select(F.trim("key").alias("key"), "freq")
    twice = rows.groupBy("key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {twice[0]['key']!r} occurs twice")
    return rows


# Fixed values of the subtitle format.
GLUED = frozenset(".,:;?!()[]'")
FRAMES_PER_SECOND = 30


def seconds(code: str) -> float:
    hours, minutes, whole, frames = map(float, code.replace(",", ":").split(":"))
    return 3600 * hours + 60 * minutes + whole + frames / FRAMES_PER_SECOND


def sentences(parts: Iterable[bytes], break_duration: float = 2.0) -> Iterator[str]:
    """Sentences of one subtitle file, read part by part.  A line break goes in front for each start that lies long after the last end.

    Sentences without words are as if they weren't there, their times included.
    """
    decode, parser = codecs.getincrementaldecoder("utf-8-sig")().decode, ElementTree.XMLPullParser(["start", "end"])
    open_tags: list[ElementTree.Element] = []
    ended = 0.0

    def found(last: bool) -> Iterator[ElementTree.Element]:
        if last:
            parser.feed(decode(b"", True))
            parser.close()
        for event, element in parser.read_events():
            if event == "start":
                open_tags.append(element)
                continue
            open_tags.pop()
            if len(open_tags) == 1:
                if element.tag == "s":
                    yield element
                open_tags[0].clear()  # a file's elements aren't kept

    def all_found() -> Iterator[ElementTree.Element]:
        for part in parts:
            parser.feed(decode(part))
            yield from found(False)
        yield from found(True)

    for sentence in all_found():
        words = [w.text for w in sentence.iterfind("w")]
        if None in words:
            raise ValueError("a word without text")
        text = "".join(w if w in GLUED else f" {w}" for w in words).strip()
        if not text:
            continue
        breaks = 0
        for tag in sentence.iterfind("time"):
            kind, at = tag.attrib["id"][-1:], seconds(tag.attrib["value"])
            if kind == "E":
                ended = at
            elif kind == "S":
                breaks += at - ended > break_duration
            else:
                raise ValueError(f"a time tag of kind {kind!r}")
        yield "\n" * breaks + text


def subtitle_lines(content: bytes, break_duration: float = 2.0) -> list[str]:
    """All sentences of a subtitle file."""
    return list(sentences([content], break_duration))


def subtitle_files(spark: SparkSession, directory: str, *, skip_missing: bool = False) -> DataFrame:
    """path, content of all ``.gz`` files below a directory, as listed now; files that are gone when they are read are an error unless skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").option("ignoreMissingFiles", skip_missing)
    return found.load(directory).select("path", "content")


_PARSED = "path string, line_no long, text string, error string"


#: Lines that a task holds of a file; a file's text is read in parts of so many bytes.
LINES, PART = 10_000, 1 << 20


def parse_subtitles(files: DataFrame, break_duration: float = 5.0) -> DataFrame:
    """path, line_no, text, error of (path, content): the lines of each file; of one that can't be read those ahead of the damage and a row of the error.

    An error's ``line_no`` is how many lines stand ahead of it, which aren't to be used: ``sort_subtitles`` leaves them out.
    """

    def lines_of(content: bytes) -> Iterator[str]:
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as source:
            for sentence in sentences(iter(lambda: source.read(PART), b""), break_duration):
                yield from sentence.split("\n")
        yield from ("", "---END.OF.DOCUMENT---", "")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                lines, n = lines_of(content), 0
                try:
                    while part := list(itertools.islice(lines, LINES)):
                        yield pd.DataFrame({"path": path, "line_no": range(n, n + len(part)), "text": part, "error": None})
                        n += len(part)
                except (OSError, EOFError, zlib.error, ValueError, KeyError, ElementTree.ParseError) as e:
                    yield pd.DataFrame({"path": [path], "line_no": [n], "text": [None], "error": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(parse, _PARSED)


def read_subtitles(spark: SparkSession, directory: str, break_duration: float = 5.0) -> DataFrame:
    """path, line_no, text of all ``.gz`` subtitle files below a directory; a file is one task's unit, a bad one an error."""
    parsed = parse_subtitles(subtitle_files(spark, directory), break_duration)
    failed = F.raise_error(F.concat("path", F.lit(": "), "error"))
    return parsed.select(F.when(F.col("error").isNotNull(), failed).otherwise(F.col("path")).alias("path"), "line_no", "text")


class Subtitles(NamedTuple):
    """Lines (path, line_no, text), files that can't be read (path, error), files that are gone (path), and how many lines, files and damaged files."""

    lines: DataFrame
    damaged: DataFrame
    missing: DataFrame
    counts: dict[str, int]


def sort_subtitles(spark: SparkSession, directory: str, break_duration: float = 5.0) -> Subtitles:
    """Lines and bad files from one pass over the contents; what was listed and then gave neither is missing."""
    files = subtitle_files(spark, directory, skip_missing=True)
    listed = materialise(files.select("path"), "listed")
    seen = Observation()
    bad = F.col("error").isNotNull()
    first = (F.col("line_no") == 0) & ~bad
    parsed = parse_subtitles(files, break_duration)
    ahead = F.coalesce(F.sum(F.when(bad, F.col("line_no"))), F.lit(0))  # lines and first lines of damaged files don't count
    good = F.count_if(first) - F.count_if(bad & (F.col("line_no") > 0))
    parsed = materialise(parsed.observe(seen, (F.count_if(~bad) - ahead).alias("lines"), good.alias("files"), F.count_if(bad).alias("damaged")), "subtitles")
    counts, damaged = dict(seen.get), parsed.where(bad).select("path", "error")
    lines = parsed.where(~bad).drop("error")
    if counts["damaged"]:
        lines = lines.join(damaged.select("path"), "path", "left_anti")
    missing = listed.join(parsed.where(first | bad).select("path"), "path", "left_anti")
    return Subtitles(lines, damaged, missing, counts)
