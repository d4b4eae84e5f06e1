"""Filters and remaps of cues and outcomes, and the duplicate policy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many tokens are written into the plan; more are joined.
INLINE = 2000
Tokens = str | Iterable[str] | None


def _pick(c: Column, keep: Tokens, remove: Tokens, remap: Mapping[str, str] | None) -> Column:
    given = [keep not in ("all", None), remove is not None, remap is not None]
    if sum(given) > 1:
        raise ValueError("keep, remove and map exclude each other")
    if remap is not None:
        table = F.create_map(*[F.lit(x) for pair in remap.items() for x in pair]) if remap else None
        if table is None:
            return F.array().cast("array<string>")
        return F.filter(F.transform(c, lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull() & (t != ""))
    if remove is not None:
        return F.filter(c, lambda t: ~t.isin(list(remove)))
    if keep in ("all", None):
        return c
    return F.filter(c, lambda t: t.isin(list(keep)))


def _joined(events: DataFrame, column: str, table: DataFrame, how: str) -> DataFrame:
    """Large token tables: explode, join on the token, and gather each event's again in order."""
    rest = [x for x in events.columns if x != column]
    parts = events.select("event_id", F.posexplode(column).alias("_at", "token"))
    kept = parts.join(table, "token", how)
    value = F.col("target") if "target" in table.columns else F.col("token")
    gathered = kept.where(value.isNotNull() & (value != "") if "target" in table.columns else F.lit(True))
    gathered = gathered.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_at", value.alias("v")))).alias("_all"))
    back = events.select(*rest).join(gathered, "event_id", "left")
    return back.withColumn(column, F.coalesce(F.transform("_all", lambda x: x["v"]), F.array().cast("array<string>"))).drop("_all").select(*events.columns)


def _table(events: DataFrame, tokens: Tokens | Mapping[str, str] | DataFrame) -> Tokens | Mapping[str, str] | DataFrame:
    """Tokens or a map as a table (token[, target]) if they are too many for the plan."""
    if tokens is None or isinstance(tokens, (str, DataFrame)):
        return tokens
    tokens = tokens if isinstance(tokens, Mapping) else list(tokens)
    if len(tokens) <= INLINE:
        return tokens
    if isinstance(tokens, Mapping):
        return events.sparkSession.createDataFrame(list(tokens.items()), "token string, target string")
    return events.sparkSession.createDataFrame([(t,) for t in tokens], "token string")


def filter_events(
    events: DataFrame,
    *,
    keep_cues: Tokens | DataFrame = "all",
    keep_outcomes: Tokens | DataFrame = "all",
    remove_cues: Tokens | DataFrame = None,
    remove_outcomes: Tokens | DataFrame = None,
    cue_map: Mapping[str, str] | DataFrame | None = None,
    outcome_map: Mapping[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Events with filtered or remapped tokens.

    Events without a cue left go; events without an outcome stay (they are background).  Tables
    (``token``[, ``target``]) stand for sets too large for the plan; collections of more than ``INLINE``
    tokens become such tables, which are joined by ``event_id``.  Duplicates are kept.
    """
    for column, keep, remove, remap in (("cues", keep_cues, remove_cues, cue_map), ("outcomes", keep_outcomes, remove_outcomes, outcome_map)):
        keep, remove, remap = (_table(events, x) for x in (keep, remove, remap))
        frames = [(x, how) for x, how in ((keep, "left_semi"), (remove, "left_anti"), (remap, "inner")) if isinstance(x, DataFrame)]
        if frames:
            if len(frames) + sum(x is not None and not isinstance(x, DataFrame) and x != "all" for x in (keep, remove, remap)) > 1:
                raise ValueError("keep, remove and map exclude each other")
            events = _joined(events, column, *frames[0])
        else:
            events = events.withColumn(column, _pick(F.col(column), keep, remove, remap))
    return events.where(F.size("cues") > 0)


def filter_line(line: str, **rules) -> str | None:
    """One line of an event file through the rules of ``filter_events``; None if it goes."""
    parts = line.rstrip("\n").split("\t")
    if len(parts) != 2:
        raise ValueError("an event has two columns")

    def one(text: str, keep, remove, remap) -> list[str]:
        if sum((keep not in ("all", None), remove is not None, remap is not None)) > 1:
            raise ValueError("keep, remove and map exclude each other")
        found = text.split("_")
        if remap is not None:
            return [remap[t] for t in found if remap.get(t)]
        if remove is not None:
            return [t for t in found if t not in remove]
        return found if keep in ("all", None) else [t for t in found if t in keep]

    cues = one(parts[0], rules.get("keep_cues", "all"), rules.get("remove_cues"), rules.get("cue_map"))
    outcomes = one(parts[1], rules.get("keep_outcomes", "all"), rules.get("remove_outcomes"), rules.get("outcome_map"))
    return "_".join(cues) + "\t" + "_".join(outcomes) + "\n" if cues else None


def apply_duplicates(events: DataFrame, remove_duplicates: bool | None, columns: tuple[str, ...] = ("cues", "outcomes")) -> DataFrame:
    """True: each token once; False: all stay; None: duplicates are an error."""
    if remove_duplicates not in (None, True, False):
        raise ValueError("remove_duplicates is None, True or False")
    if remove_duplicates:
        return events.withColumns({c: F.array_distinct(c) for c in columns})
    if remove_duplicates is None:
        bad = F.lit(False)
        for c in columns:
            bad = bad | (F.size(F.array_distinct(c)) < F.size(c))
        found = events.where(bad).limit(1).collect()
        if found:
            raise ValueError(f"event {found[0]['event_id']} has a cue or an outcome twice: {found[0]}; say what to do by remove_duplicates")
    return events
