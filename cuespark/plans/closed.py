"""Closed form of the Rescorla-Wagner rule for events with one cue each: a scan over ranges of events.

A cue's weights change in its own events only: w <- (1 - alpha*beta) w + alpha*beta1*lambda*[present],
with beta by presence.  The weight after all of them is the sum, over events with the outcome, of
alpha*beta1*lambda times the decay of every later event of the cue.

The decay of later ranges is one factor for all of a range's events.  So each range sums up its own pairs and counts
its cues, counts are added up from the last range back, and sums times factors are added.  A cue's events
are spread over the ranges that hold them: a frequent cue is as many groups as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise


def closed_form(events: DataFrame, alpha: float, betas: tuple[float, float], lambda_: float, ranges: int = 1) -> DataFrame:
    """outcome, cue, weight of the pairs that occur together; all other weights are 0."""
    b1, b2 = (F.lit(1.0 - alpha * b) for b in betas)

    def decay(later: Column, present: Column) -> Column:
        return F.pow(b1, present) * F.pow(b2, later - present)

    one = events.select("event_id", F.element_at("cues", 1).alias("cue"), F.array_distinct("outcomes").alias("outcomes"))
    one = one.repartitionByRange(ranges, "event_id").withColumn("part", F.spark_partition_id())
    latest_first = Window.partitionBy("part", "cue").orderBy(F.desc("event_id"))
    ranked = one.withColumn("later", F.row_number().over(latest_first) - 1).withColumn("total", F.count("*").over(Window.partitionBy("part", "cue")))
    # an event without outcomes counts for its cue: a row of no outcome
    pairs = ranked.select("part", "cue", "event_id", "later", "total", F.explode_outer("outcomes").alias("outcome"))
    present = F.row_number().over(Window.partitionBy("part", "cue", "outcome").orderBy(F.desc("event_id"))) - 1
    pairs = pairs.withColumn("present", present)
    within = pairs.groupBy("part", "cue", "outcome").agg(F.sum(decay(F.col("later"), F.col("present"))).alias("own"), F.count("*").alias("n"), F.first("total").alias("total"))
    within = materialise(within, "ranges-of-cues")

    def behind(column: str, *keys: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    of_cues = within.groupBy("part", "cue").agg(F.first("total").alias("total")).select("part", "cue", behind("total", "cue").alias("later"))
    of_pairs = within.where("outcome is not null").withColumn("present", behind("n", "cue", "outcome"))
    scaled = of_pairs.join(of_cues, ["part", "cue"]).withColumn("term", F.col("own") * decay(F.col("later"), F.col("present")))
    return scaled.groupBy("outcome", "cue").agg((F.lit(alpha * betas[0] * lambda_) * F.sum("term")).alias("weight"))
