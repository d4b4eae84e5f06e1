"""Counts, vocabularies, encoding, band sampling."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..storage import materialise
from .corpus import number_events


class CuesOutcomes(NamedTuple):
    n_events: int
    cues: DataFrame
    outcomes: DataFrame


class WordsSymbols(NamedTuple):
    words: DataFrame
    symbols: DataFrame


def count_tokens(events: DataFrame, column: str) -> DataFrame:
    """key, freq of a token column, repeats included."""
    return events.select(F.explode(column).alias("key")).groupBy("key").agg(F.count("*").alias("freq"))


def cues_outcomes(events: DataFrame) -> CuesOutcomes:
    return CuesOutcomes(events.count(), count_tokens(events, "cues"), count_tokens(events, "outcomes"))


def words_symbols(corpus: DataFrame, lower_case: bool = False, text_col: str = "text") -> WordsSymbols:
    words = corpus.select(F.explode(X.counted_words(F.col(text_col), lower_case)).alias("key"))
    counted = words.groupBy("key").agg(F.count("*").alias("freq"))
    # characters of each distinct word, weighted by its count
    chars = counted.select(F.explode(F.filter(F.split("key", ""), lambda c: c != "")).alias("key"), "freq")
    return WordsSymbols(counted, chars.groupBy("key").agg(F.sum("freq").alias("freq")))


#: Vocabularies of up to this many keys are numbered by one window, and broadcast for encoding; larger ones are numbered by ranges and joined.
SMALL_KEYS = 500_000


def vocabulary(events: DataFrame, column: str) -> DataFrame:
    """key, id (from 0, in the order of the keys), from the shared folder."""
    keys = materialise(events.select(F.explode(column).alias("key")).distinct(), "keys")
    if keys.count() <= SMALL_KEYS:
        return materialise(keys.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("id")), "vocabulary")
    numbered = number_events(keys.select("key", F.array("key").alias("cues"), F.lit(None).alias("outcomes")), "key")
    return materialise(numbered.select(F.col("cues")[0].alias("key"), F.col("event_id").cast("int").alias("id")), "vocabulary")


class Vocabularies(NamedTuple):
    """Cues and outcomes as (key, id), how many there are, how many events, and whether one has another number of cues than 1."""

    cues: DataFrame
    outcomes: DataFrame
    n_cues: int
    n_outcomes: int
    n_events: int
    several: bool


def vocabularies(events: DataFrame, more: DataFrame | None = None) -> Vocabularies:
    """All of it from one pass over the events; ``more``: (axis: 0 for cues or 1 for outcomes, key) besides."""
    kind = F.array(F.when(F.size("cues") == 1, "one").otherwise("several"))  # the third axis counts events
    tokens = events.select(F.posexplode(F.array("cues", "outcomes", kind)).alias("axis", "tokens")).select("axis", F.explode("tokens").alias("key"))
    tokens = tokens if more is None else tokens.unionByName(more)
    keys = materialise(tokens.groupBy("axis", "key").agg(F.count("*").alias("freq")), "keys")
    sizes = {r["axis"]: r for r in keys.groupBy("axis").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"), F.max("key").alias("last")).collect()}
    n_cues, n_outcomes = (sizes[k]["n"] if k in sizes else 0 for k in (0, 1))
    if max(n_cues, n_outcomes) <= SMALL_KEYS:
        by_axis = Window.partitionBy("axis").orderBy("key")
        both = materialise(keys.where("axis < 2").select("axis", "key", (F.row_number().over(by_axis) - 1).alias("id")), "vocabulary")
        tables = [both.where(F.col("axis") == k).select("key", "id") for k in (0, 1)]
    else:
        tables = [vocabulary(keys.where(F.col("axis") == k).select(F.array("key").alias("k")), "k") for k in (0, 1)]
    return Vocabularies(*tables, n_cues, n_outcomes, sizes[2]["freq"] if 2 in sizes else 0, 2 in sizes and sizes[2]["last"] == "several")


def encode(events: DataFrame, cues: DataFrame, outcomes: DataFrame, sort_within_event: bool = False) -> DataFrame:
    """event_id, cue_ids, outcome_ids; a token without an id fails the job."""
    if max(cues.count(), outcomes.count()) <= SMALL_KEYS:
        return _encode_small(events, cues, outcomes, sort_within_event)
    out = events.select("event_id", "cues", "outcomes")
    for column, table, name in (("cues", cues, "cue_ids"), ("outcomes", outcomes, "outcome_ids")):
        parts = out.select("event_id", F.posexplode_outer(column).alias("_at", "key"))
        joined = parts.join(table, "key", "left")
        known = F.when(F.col("id").isNull() & F.col("key").isNotNull(), F.raise_error(F.concat(F.lit("unknown token "), F.col("key")))).otherwise(F.col("id"))
        ids = F.filter(F.collect_list(F.struct("_at", known.alias("id"))), lambda x: x["id"].isNotNull())
        gathered = joined.groupBy("event_id").agg(F.transform(F.array_sort(ids), lambda x: x["id"]).alias(name))
        if sort_within_event:
            gathered = gathered.withColumn(name, F.array_sort(name))
        out = out.join(gathered, "event_id")
    return out.select("event_id", "cue_ids", "outcome_ids")


def _encode_small(events: DataFrame, cues: DataFrame, outcomes: DataFrame, sort_within_event: bool) -> DataFrame:
    """One pass over the events, without a shuffle: vocabularies of a checked size go to every task."""
    keys = [[r["key"] for r in t.orderBy("id").collect()] for t in (cues, outcomes)]
    sent = events.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [pa.array(k, pa.string()) for k in sent.value]
        for batch in batches:
            out = [batch.column(0)]
            for column, known in zip(batch.columns[1:], sets):
                tokens = column.flatten()
                ids = pc.index_in(tokens, value_set=known)
                if ids.null_count:
                    raise ValueError(f"unknown token {tokens.filter(pc.is_null(ids))[0]}")
                ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0).cast(pa.int32()))
                out.append(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), ids))
            yield pa.RecordBatch.from_arrays(out, ["event_id", "cue_ids", "outcome_ids"])

    kind = events.schema["event_id"].dataType.simpleString()
    found = events.select("event_id", "cues", "outcomes").mapInArrow(run, f"event_id {kind}, cue_ids array<int>, outcome_ids array<int>")
    return found.withColumns({c: F.array_sort(c) for c in ("cue_ids", "outcome_ids")}) if sort_within_event else found


def bandsample(counter: DataFrame, sample_size: int = 50_000, *, cutoff: int = 5, seed: int | None = None) -> DataFrame:
    """A sample of the keys that covers the frequency band evenly.

    Keys of at least ``cutoff`` stand in ascending order of (freq, key).  A running sum of the frequencies gives
    out a key whenever it passes another ``sum / sample_size``; a key that passes several steps at once gives out
    the nearest less frequent keys that are still in.

    So keys are pushed on a stack, one each, and popped as the sum passes steps.  After i keys with the sum S, E = min(S passes, i)
    have been popped and D = i - E are left.  A key is popped when the stack first gets as low as it was before
    the key came: if the least D from the key on isn't above the D before it.  Sums and places up to a key, and least values
    from it on, are taken within ranges of keys, and joined with what the ranges before and behind
    have altogether; so each range settles its own keys, and no task sees the vocabulary.
    """
    if seed is not None:
        raise NotImplementedError("ties are broken by key, so there is nothing to seed")
    if sample_size < 1:
        raise ValueError("a sample holds at least one key")
    order = ["freq", "key"]
    kept = counter.where(F.col("freq") >= cutoff).select("key", F.col("freq").cast("long").alias("freq"))
    laid = materialise(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "band")
    parts = laid.groupBy("part").agg(F.count("*").alias("n"), F.sum("freq").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    every = Window.partitionBy()
    starts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ns"], F.sum("s").over(every).alias("total"))
    up_to = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.withColumn("n", F.count("*").over(up_to)).withColumn("s", F.sum("freq").over(up_to)).join(F.broadcast(starts), "part")
    rows = rows.withColumn("n", F.col("n") + F.col("n0")).withColumn("s", F.col("s") + F.col("s0"))
    left = lambda n, s: f"{n} - least(cast({s} as decimal(20)) * {sample_size} div total, {n})"
    rows = rows.select("part", "key", "freq", F.expr(left("n", "s")).alias("left"), F.expr(left("(n - 1)", "(s - freq)")).alias("was"))
    rows = materialise(rows, "band-stack")
    behind = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy("part").agg(F.min("left").alias("least"))
    later = least.select("part", F.min("least").over(behind).alias("later"))
    from_here = Window.partitionBy("part").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("lowest", F.min("left").over(from_here)).join(F.broadcast(later), "part")
    return found.where(F.least("lowest", "later") <= F.col("was")).select("key", "freq")


def by_frequency(counter: DataFrame) -> DataFrame:
    return counter.orderBy(F.desc("freq"), "key")


def replicate(events: DataFrame, times: int) -> DataFrame:
    """The event list so many times in a row."""
    size = events.agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).first()[0]
    return events.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("event_id", F.col("event_id") + F.col("_rep") * size).drop("_rep")


def slice_list(values: list, size: int) -> list[list]:
    """Consecutive parts of a list of distinct values."""
    if size < 1:
        raise ValueError("parts hold at least one value")
    if len(set(values)) != len(values):
        raise AssertionError("values repeat")
    return [values[i : i + size] for i in range(0, len(values), size)]
