"""Band sampling over ranges of keys against the walk, a key at a time."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from cuespark.operators import counts

# How many outcomes of the published event file have a frequency, and the frequencies that a sample of 50 of them gives out.
SPECTRUM = {
    3: 481, 6: 149, 9: 66, 12: 28, 15: 15, 18: 12, 21: 11, 24: 6, 27: 6, 30: 5, 33: 2, 36: 3, 39: 6, 42: 4, 45: 4, 48: 1, 54: 1, 57: 2,
    60: 1, 63: 1, 66: 1, 69: 4, 84: 1, 90: 2, 108: 1, 126: 1, 132: 1, 171: 1, 177: 1, 192: 1, 204: 1, 219: 1, 417: 1, 468: 1,
}
SAMPLED = [468, 417, 219, 204, 192, 177, 171, 132, 126, 108, 90, 90, 84, 69, 69, 69, 69, 63, 57, 48, 45, 42, 39, 36, 30, 27, 24, 21, 18, 15, 15, 12, 12, 9, 9, 9, *[6] * 6, *[3] * 8]


def walk(counter, size, cutoff):
    kept = sorted((f, k) for k, f in counter.items() if f >= cutoff)
    step, now, stack, out = Fraction(sum(f for f, _ in kept), size), Fraction(0), [], []
    for f, k in kept:
        stack.append((k, f))
        now += f
        while now >= step and stack:
            out.append(stack.pop())
            now -= step
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("seed", range(2))
def test_sample_equals_the_walk(spark, seed, partitions):
    rng = random.Random(seed)
    n = rng.choice([1, 30, 400])
    counter = {f"k{i}": int(rng.paretovariate(0.7)) if seed % 2 else rng.randint(1, 9) for i in range(n)}
    table = spark.createDataFrame(list(counter.items()), "key string, freq long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for size, cutoff in ((1, 1), (n // 3 + 1, 1), (n, 2), (3 * n, 1)):
            assert sorted(map(tuple, counts.bandsample(table, size, cutoff=cutoff).collect())) == walk(counter, size, cutoff)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_samples(spark):
    table = spark.createDataFrame([("a", 3)], "key string, freq long")
    assert counts.bandsample(table, 10, cutoff=4).collect() == []
    with pytest.raises(NotImplementedError):
        counts.bandsample(table, 10, seed=1)
    with pytest.raises(ValueError):
        counts.bandsample(table, 0)


def test_published_frequencies(spark):
    rows = [(f"{f}-{i}", f) for f, n in SPECTRUM.items() for i in range(n)]
    assert (len(rows), sum(f for _, f in rows)) == (822, 8310)
    got = counts.bandsample(spark.createDataFrame(rows, "key string, freq long"), 50, cutoff=1).collect()
    assert sorted((r.freq for r in got), reverse=True) == SAMPLED
