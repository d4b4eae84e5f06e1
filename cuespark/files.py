"""From files to files: corpora of subtitles, event files, filtered event files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import corpus, filters
from .sources import readers, sinks


def create_corpus(spark: SparkSession, directory: str, path: str, break_duration: float = 5.0) -> dict[str, int]:
    """The corpus of all ``.gz`` subtitle files below a directory, in the order of their paths; ``path`` must be new.

    Files that were listed but are gone, and files that can't be read (with the reason, behind a tab), stay out: they are listed in
    ``path.not_found`` and ``path.damaged``, which are there only if there are such files.  Returns how many
    lines, files and damaged files there are.
    """
    found = readers.sort_subtitles(spark, directory, break_duration)
    sinks.write_corpus(found.lines, path)
    reason = F.regexp_replace("error", r"\s+", " ")
    for name, bad in (("not_found", found.missing), ("damaged", found.damaged.select(F.concat_ws("\t", "path", reason).alias("path")))):
        if not bad.isEmpty():
            sinks.write_list(bad, f"{path}.{name}")
    return found.counts


def create_event_file(spark: SparkSession, corpus_path: str, event_path: str, *, context_structure: str = "document", **options) -> None:
    """Events of a corpus as an event file, which must be new; the options are those of ``corpus_to_events``."""
    texts = readers.read_corpus(spark, corpus_path, by_document=context_structure == "document")
    sinks.write_events(corpus.laid_events(texts, context_structure=context_structure, **options), event_path, laid_out=True)


def filter_event_file(spark: SparkSession, input_path: str, output_path: str, **rules) -> None:
    """An event file with some cues and outcomes kept, removed or mapped; the rules are those of ``filter_events``."""
    sinks.write_events(filters.filter_events(readers.read_events(spark, input_path), **rules), output_path)
