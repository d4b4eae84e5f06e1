"""Corpora to events: contexts, occurrences, cues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.packed import pack
from ..functions.windows import ngram_lines


def _words(corpus: DataFrame, order: tuple[str, ...], text_col: str, context_structure: str, allowed_symbols: str | Callable[[str], bool], lower_case: bool) -> DataFrame:
    """(order columns, context, words) of the parts of the texts that have words."""
    text = F.col(text_col)
    parts = X.contexts(text) if context_structure == "document" else F.array(text)
    rows = corpus.select(*order, F.posexplode(parts).alias("context", "part"))
    if callable(allowed_symbols):  # a Python function can't stand inside a lambda: clean first, split afterwards
        rows = rows.withColumn("part", X.clean(F.col("part"), lambda c: c == "\n" or allowed_symbols(c), lower_case))
        line_words = X.words(F.col("part"))
    else:
        line_words = X.words(F.col("part"), lambda t: X.clean(t, allowed_symbols, lower_case))
    return rows.select(*order, "context", line_words.alias("words")).where(F.size("words") > 0)


def corpus_to_events(
    corpus: DataFrame,
    *,
    allowed_symbols: str | Callable[[str], bool] = "all",
    context_structure: str = "document",
    event_structure: str = "consecutive_words",
    event_options: tuple[int, ...] = (3,),
    cue_structure: str = "trigrams_to_word",
    lower_case: bool = False,
    remove_duplicates: bool = True,
    order: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    warn: bool = False,
) -> DataFrame:
    """(order columns, context, place, cues, outcomes) of every occurrence of the texts.

    A row's text is a document (or several with markers between), or one line in the ``line``
    context.  The order columns, ``context`` and ``place`` sort the events; ``number_events`` turns
    them into ``event_id``.  It is column expressions, and for the different n-grams a function on Arrow batches; documents are the unit of parallelism.
    With ``warn`` a pass ahead looks for a reserved character, and warns of the first.
    """
    if context_structure not in ("document", "line"):
        raise NotImplementedError(f"context structure {context_structure!r}")
    if event_structure not in ("consecutive_words", "word_to_word", "line"):
        raise NotImplementedError(f"event structure {event_structure!r}")
    if cue_structure not in ("bigrams_to_word", "trigrams_to_word", "word_to_word"):
        raise NotImplementedError(f"cue structure {cue_structure!r}")
    if warn and not corpus.where(F.col(text_col).rlike("[#_\\t]")).limit(1).isEmpty():
        X.warn_reserved()
    words = _words(corpus, order, text_col, context_structure, allowed_symbols, lower_case)
    none = F.array().cast("array<string>")
    # places are exploded first and the lists cut behind, which stays within generated code
    if event_structure == "consecutive_words":
        places = words.select(*order, "context", "words", F.posexplode(X.window_starts(F.col("words"), *event_options)).alias("place", "_start"))
        cues, outcomes = X.window_at(F.col("words"), F.col("_start"), *event_options), none
    elif event_structure == "word_to_word":
        places = words.select(*order, "context", "words", F.posexplode("words").alias("place", "_word"))
        cues, outcomes = X.neighbours_at(F.col("words"), F.col("place") + 1, *event_options), F.array("_word")
    else:
        places = words.withColumn("place", F.lit(0))
        cues, outcomes = F.col("words"), F.col("words") if cue_structure == "word_to_word" else none
    found = places.select(*order, "context", "place", cues.alias("cues"), outcomes.alias("outcomes"))
    if cue_structure == "word_to_word":
        found = found.where(F.size("cues") > 0)
    else:
        both = F.concat("cues", "outcomes")
        n = 2 if cue_structure == "bigrams_to_word" else 3
        grams = X.distinct_ngrams if remove_duplicates else X.ngrams
        found = found.select(*order, "context", "place", grams(both, n).alias("cues"), both.alias("outcomes"))
    if remove_duplicates and cue_structure != "word_to_word":
        return found.withColumn("outcomes", F.array_distinct("outcomes"))
    if remove_duplicates:
        found = found.withColumns({c: F.array_distinct(c) for c in ("cues", "outcomes")})
    return found


def _by_texts(corpus: DataFrame, order: tuple[str, ...]) -> DataFrame | None:
    """The texts laid out; none if some share their order columns."""
    if corpus.groupBy(*order).count().where("count > 1").isEmpty():
        return corpus.repartitionByRange(*order).sortWithinPartitions(*order)
    return None


def laid_events(corpus: DataFrame, *, order: tuple[str, ...] = ("doc_id",), text_col: str = "text", **options) -> DataFrame:
    """The events of ``corpus_to_events`` in their order over all partitions.

    Texts are laid out ahead, so the many times larger events aren't moved.  Only where texts share their order columns, whose events
    stand among each other, the events are.
    """
    corpus = corpus.select(*order, text_col)
    if (laid := _by_texts(corpus, order)) is not None:
        return corpus_to_events(laid, order=order, text_col=text_col, **options)
    by = (*order, "context", "place")
    return corpus_to_events(corpus, order=order, text_col=text_col, **options).repartitionByRange(*by).sortWithinPartitions(*by)


def packed_ngrams(corpus: DataFrame, *, order: tuple[str, ...] = ("doc_id",), text_col: str = "text", window: int = 3, n: int = 3, context_structure: str = "document", allowed_symbols: str | Callable[[str], bool] = "all", lower_case: bool = False) -> DataFrame:
    """Short lines (``functions.packed``, for ``sinks.write_packed``) of the events of windows of words with all letter ``n``-grams (2 or 3), in their order.

    They are those of ``laid_events`` with ``remove_duplicates=False``; unless texts share their order columns, they are made without the events.
    """
    corpus = corpus.select(*order, text_col)
    shape = {"context_structure": context_structure, "allowed_symbols": allowed_symbols, "lower_case": lower_case}
    if (laid := _by_texts(corpus, order)) is not None:
        words = _words(laid, order, text_col, **shape)
        return words.select(F.concat(F.lit("#"), F.array_join("words", "#"), F.lit("#"))).mapInArrow(ngram_lines(window, n), "value string")
    cues = {2: "bigrams_to_word", 3: "trigrams_to_word"}[n]
    events = laid_events(corpus, order=order, text_col=text_col, event_options=(window,), cue_structure=cues, remove_duplicates=False, **shape)
    return as_text(events).mapInArrow(pack, "value string")


def number_events(events: DataFrame, *order: str) -> DataFrame:
    """event_id (from 0, without gaps, in the given order), cues, outcomes.

    Rows are range-partitioned and numbered within partitions; partitions are laid end to end by
    their counts, so no task sees all rows.
    """
    from ..storage import materialise

    laid = materialise(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = laid.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*order)
    numbered = laid.withColumn("_place", F.row_number().over(own) - 1).join(F.broadcast(starts), "_part")
    return numbered.select((F.col("_start") + F.col("_place")).alias("event_id"), "cues", "outcomes")


def as_text(events: DataFrame, *keep: str) -> DataFrame:
    """Cues and outcomes joined with ``_``, the form of event files."""
    return events.select(*keep, F.array_join("cues", "_").alias("cues"), F.array_join("outcomes", "_").alias("outcomes"))
