"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

``activation_tiles``: 20,000 events of 30 cues, 20,000 cues, 2,000 outcomes, a tenth of the weights set; all 40 million sums.
``rw_5850`` to ``rw_292500`` repeat the published workload: 5,850 one-word events with letter
trigrams as cues, in sequence 1, 10 and 50 times; counting, encoding and learning together.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cuespark import queries as q  # noqa: E402
from cuespark.operators import corpus, counts, infer, learn  # noqa: E402
from cuespark.storage import scratch  # noqa: E402

WORKLOAD = 5_850
HEADLINE = [
    "rw_weights", "rw_closed_form", "wh_real_real", "stream_rw", "activation", "correlation", "count_words",
    "ngrams_trigram", "window_consecutive_3", "filter_keep", "events_encoded", "bandsample",
]


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,850 words of the corpus as events, written once."""
    docs = q.table(spark, sf_dir, "documents").where("lang = 'en'")
    found = corpus.corpus_to_events(docs.orderBy("doc_id").limit(60), allowed_symbols="a-zA-Z0-9", event_options=(1,), lower_case=True)
    numbered = corpus.number_events(found, "doc_id", "context", "place").where(F.col("event_id") < WORKLOAD)
    path = scratch(spark, "bench")
    numbered.write.parquet(path)
    return spark.read.parquet(path)


def activations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events and weights of the published shape of an activation, from hashes."""
    cue = lambda x: F.concat(F.lit("c"), F.pmod(x, F.lit(20_000)))
    ids = spark.range(20_000).select(F.col("id").alias("event_id"), F.array(*[cue(F.xxhash64("id", F.lit(k))) for k in range(30)]).alias("cues"))
    pairs = spark.range(4_000_000).select(F.concat(F.lit("o"), F.col("id") % 2_000).alias("outcome"), cue(F.floor(F.col("id") / 200)).alias("cue"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("weight"))
    for name, table in (("events", ids), ("weights", pairs)):
        table.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/events"), spark.read.parquet(f"{folder}/weights")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)

    events = workload(spark, sf_dir)
    learn.rw_learn(events.limit(100), 0.1, (0.1, 0.1)).table.write.format("noop").mode("overwrite").save()  # starts the workers
    for times in (1, 10, 50):
        timed(f"rw_{WORKLOAD * times}", lambda t=times: learn.rw_learn(counts.replicate(events, t), 0.1, (0.1, 0.1)).table)
    given = activations(spark, scratch(spark, "bench"))
    timed("activation_tiles", lambda: infer.activation(*given, remove_duplicates=False, ignore_missing_cues=True))
    for name in HEADLINE:
        timed(name, lambda n=name: q.QUERIES[n](spark, sf_dir))
    print(json.dumps({"metric": "headline queries, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
