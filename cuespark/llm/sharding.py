"""Operator 1: weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from a hash of both; the
record goes to the shard with the largest ``-weight / ln(u)``.  A shard's score for a key
depends on no other shard, so one more shard takes rows only into itself, and removing one
moves only its own rows.  The expected share of a shard is its part of the total weight.

Nulls: a null key is hashed as the text ``\\N`` and sorts first.  Null text has size 1
(no bytes plus 1) and crc32 0, as an empty text.  Repeated keys go to one shard and get slots of their
own.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pick

_BITS = 52


def unit_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) of 52 hash bits of ``shard:key``."""
    digest = F.md5(F.concat(F.lit(f"{shard}:"), key))
    bits = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**_BITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best score; on equal scores the smallest."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    scores = [
        F.struct((F.lit(-float(w)) / F.log(unit_hash(text, s))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    grown_weight: float | None = 1.0,
    rows_per_bucket: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``slot`` numbers the rows of a shard without gaps from 0, by hash bucket, key, crc32 and size.  Rows are
    range-partitioned by these (and their place, so that equal rows are split too), numbered within each
    part of a shard, and the parts are laid end to end by their counts: no task sees a whole shard or key.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    shard = rendezvous(F.col("doc_id"), weights)
    grown = rendezvous(F.col("doc_id"), [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    buckets = max(8, -(-rows.count() // (rows_per_bucket * len(weights))))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")
    keyed = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        shard.alias("shard"),
        grown.alias("grown_shard"),
        bucket.alias("bucket"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["shard", "bucket", "doc_id", "text_crc32", "size", "place"]
    keyed = materialise(keyed, "sharded")
    laid = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")
    counts = laid.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy(*order)
    return (
        laid.withColumn("at", F.row_number().over(own) - 1)
        .join(starts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard",
        )
    )
