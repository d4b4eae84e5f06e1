"""The ordered fold as Catalyst expressions, for few cues and short histories.

One ``aggregate`` over the sorted events of each outcome; no Python.  Each outcome's events are one
array, so the planner picks this for small inputs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_binary(events: DataFrame, cues: list[str], outcomes: list[str], alpha: float | dict[str, float], betas: tuple[float, float], lambda_: float) -> DataFrame:
    """outcome, cue, weight of all outcomes and cues by the Rescorla-Wagner rule."""
    names = F.array(*[F.lit(c) for c in cues])
    rate = F.array(*[F.lit(float(alpha[c] if isinstance(alpha, dict) else alpha)) for c in cues])
    history = F.array_sort(F.collect_list(F.struct("event_id", "cues", F.array_contains("outcomes", F.col("outcome")).alias("present"))))
    wide = events.withColumn("outcome", F.explode(F.array(*[F.lit(o) for o in outcomes])))
    grouped = wide.groupBy("outcome").agg(history.alias("events"))

    def total(w: Column, e: Column) -> Column:
        return F.aggregate(e["cues"], F.lit(0.0), lambda a, c: a + F.element_at(w, F.array_position(names, c).cast("int")))

    def step(w: Column, e: Column) -> Column:
        error = F.when(e["present"], F.lit(float(betas[0])) * (F.lit(float(lambda_)) - total(w, e))).otherwise(F.lit(float(betas[1])) * (F.lit(0.0) - total(w, e)))
        times = lambda c: F.size(F.filter(e["cues"], lambda x: x == c)).cast("double")
        return F.transform(F.arrays_zip(names.alias("c"), w.alias("w"), rate.alias("r")), lambda p: p["w"] + p["r"] * times(p["c"]) * error)

    zeros = F.transform(names, lambda c: F.lit(0.0))
    folded = grouped.select("outcome", F.aggregate("events", zeros, step).alias("w"))
    return folded.select("outcome", F.explode(F.arrays_zip(names.alias("cue"), F.col("w").alias("weight"))).alias("e")).select("outcome", "e.cue", "e.weight")
