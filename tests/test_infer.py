"""Correlations by blocks against numpy, and activations of dictionary weights."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from cuespark.operators import counts, infer
from cuespark.sources import readers


def long(spark, matrix, key):
    rows = [(d, f"{key}{k}", float(v)) for k, column in enumerate(matrix) for d, v in enumerate(column)]
    return spark.createDataFrame(rows, f"dim int, {key} string, value double").repartition(3)


def test_correlation_by_blocks_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 12)), rng.normal(size=(9, 12))
    monkeypatch.setattr(infer, "BLOCK_VALUES", 24)  # two outcomes a block
    got = {(r.outcome, r.event_id): r.r for r in infer.correlation(long(spark, x, "outcome"), long(spark, y, "event_id")).collect()}
    expect = np.corrcoef(x, y)[:7, 7:]
    assert len(got) == 63
    assert all(got[f"outcome{i}", f"event_id{k}"] == pytest.approx(expect[i, k], abs=1e-12) for i in range(7) for k in range(9))


def test_correlation_without_variance(spark):
    x, y = [[1.0, 1.0, 1.0], [1.0, 2.0, 4.0]], [[3.0, 1.0, 2.0]]
    tables = long(spark, x, "outcome"), long(spark, y, "event_id")
    with pytest.raises(ValueError):
        infer.correlation(*tables)
    got = {r.outcome: r.r for r in infer.correlation(*tables, allow_nan=True).collect()}
    assert np.isnan(got["outcome0"]) and got["outcome1"] == pytest.approx(np.corrcoef(x[1], y[0])[0, 1])
    with pytest.raises(AssertionError):
        infer.correlation(tables[0].where("dim < 2"), tables[1])


def test_activation_of_dictionary_weights(spark):
    events = readers.events_from_list(spark, [("a_b", "X"), ("c", "X")])
    weights = {"X": defaultdict(float, {"a": 0.5, "b": 0.25}), "Y": defaultdict(float, {"a": -1.0})}
    got = {(r.event_id, r.outcome): r.activation for r in infer.activation(events, weights).collect()}
    assert got == {(0, "X"): 0.75, (0, "Y"): -1.0, (1, "X"): 0.0, (1, "Y"): 0.0}
    few = {(r.event_id, r.outcome) for r in infer.activation(events, weights, dense=False).collect()}
    assert few == {(0, "X"), (0, "Y")}
    for plain in ({"X": {"a": 0.5, "b": 0.25, "c": 1.0}, "Y": {"a": -1.0}}, {"X": {"a": 0.5}, "Y": weights["Y"]}):
        with pytest.raises(KeyError):  # each plain dictionary must have every cue
            infer.activation(events, plain)
    mixed = {"X": {"a": 0.5, "b": 0.25, "c": 1.0}, "Y": weights["Y"]}
    assert {(r.event_id, r.outcome): r.activation for r in infer.activation(events, mixed).collect()} == {(0, "X"): 0.75, (0, "Y"): -1.0, (1, "X"): 1.0, (1, "Y"): 0.0}


@pytest.mark.parametrize("tile,at_once,small", [((3, 2), 4, 500_000), ((16, 7), 1000, 500_000), ((5, 3), 7, 4)])
def test_activation_by_tiles_equals_dictionaries(spark, monkeypatch, tile, at_once, small):
    """Tiles in both directions, blocks of events, cues without weights, repeated cues and rows, and vocabularies that are joined."""
    monkeypatch.setattr(infer, "TILE", tile)
    monkeypatch.setattr(infer, "EVENTS_AT_ONCE", at_once)
    monkeypatch.setattr(counts, "SMALL_KEYS", small)
    rng = random.Random(1)
    rows = [([f"c{rng.randint(0, 14)}" for _ in range(rng.randint(0, 6))], ["x"]) for _ in range(40)]
    table = [(f"o{o}", f"c{c}", rng.choice([0.0, 1.5, -2.0, 0.25])) for o in range(8) for c in range(12) if rng.random() < 0.7]
    table.append(table[0])
    weights = spark.createDataFrame(table, "outcome string, cue string, weight double")
    got = infer.activation(readers.events_from_list(spark, rows), weights, remove_duplicates=False, ignore_missing_cues=True).collect()
    assert len(got) == len(rows) * len({t[0] for t in table})
    assert all(r.activation == pytest.approx(sum(w * rows[r.event_id][0].count(c) for o, c, w in table if o == r.outcome)) for r in got)
    plan = infer.activation(readers.events_from_list(spark, rows), weights, remove_duplicates=False, ignore_missing_cues=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stream_starts_from_weights(spark, tmp_path):
    """Learning the second half on a stream, from the first half's weights, equals learning all."""
    from cuespark.operators import learn
    from cuespark.streaming.learner import learn_available

    text = [("a_b", "X"), ("a", "Y"), ("b_c", "X_Y"), ("c_c", "Z"), ("a_c", "X"), ("b", ""), ("a_b", "Z"), ("d", "Y")] * 5
    events = readers.events_from_list(spark, [(c, o or []) for c, o in text])
    first = learn.rw_learn(events.where("event_id < 17"), remove_duplicates=False, strategy="kernel").table
    events.where("event_id >= 17").repartitionByRange(2, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = learn_available(stream, str(tmp_path / "check"), str(tmp_path / "out"), buckets=3, weights=first)
    whole = {(r.outcome, r.cue): r.weight for r in learn.rw_learn(events, remove_duplicates=False, strategy="kernel").table.collect()}
    found = {(r.outcome, r.cue): r.weight for r in got.collect()}
    assert found and all(whole[k] == pytest.approx(v, abs=1e-10) for k, v in found.items())
