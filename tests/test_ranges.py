"""Ranges of events against the rule, an event at a time; rates of a table; start states; paths and pairs as events."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cuespark.operators import learn
from cuespark.plans import kernel
from cuespark.sources import readers, sinks
from tests.test_blocks_and_subtitles import events, folded


@pytest.fixture
def many_ranges(monkeypatch):
    """Forty events a range, and a look at how many there were."""
    used = []
    run = kernel.run_ranges
    monkeypatch.setattr(learn, "RANGE_EVENTS", (10, 40))
    monkeypatch.setattr(kernel, "run_ranges", lambda spark, path, *a: used.append(len(kernel._files(path))) or run(spark, path, *a))
    return used


def weights(w):
    return {(r[0], r[1]): r[2] for r in w.table.collect()}


@pytest.mark.parametrize("betas", [(0.1, 0.1), (0.1, 0.05), (0.2, 0.0), (0.0, 0.1)])
@pytest.mark.parametrize("per_cue", [False, True])
def test_ranges_equal_single_events(spark, many_ranges, betas, per_cue):
    table, rows = events(spark, 700, 5)
    rates = {c: 0.05 * (1 + i % 3) for i, c in enumerate("abcdefgh")}
    got = weights(learn.rw_learn(table, rates if per_cue else 0.1, betas, 1.5, remove_duplicates=False, strategy="kernel"))
    expect = folded(rows, (lambda c: rates[c]) if per_cue else (lambda c: 0.1), betas, 1.5)
    assert many_ranges[0] > kernel.FAN
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())


def test_ranges_go_on_from_a_former_state(spark, many_ranges):
    table, rows = events(spark, 300, 6)
    first = learn.rw_learn(table.where("event_id < 130"), betas=(0.1, 0.03), remove_duplicates=False)
    later = table.where("event_id >= 130 and not array_contains(cues, 'h')")
    kept = [r for i, r in enumerate(rows) if i < 130 or "h" not in r[0]]
    got = weights(learn.rw_learn(later, betas=(0.1, 0.03), weights=first, remove_duplicates=False))
    expect = folded(kept, lambda c: 0.1, (0.1, 0.03), 1.0)
    assert len(many_ranges) == 2
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())


@pytest.mark.parametrize("kinds", ["xy", "x", "y"])
def test_ranges_with_vectors_equal_chunks(spark, many_ranges, kinds):
    table, _ = events(spark, 200)
    rng = np.random.default_rng(2)
    x, y = (spark.createDataFrame([(k, rng.normal(size=n).tolist()) for k in keys], "label string, vec array<double>") for keys, n in (("abcdefgh", 6), ("XYZUV", 4)))
    given = {"cue_vectors": x if "x" in kinds else None, "outcome_vectors": y if "y" in kinds else None, "remove_duplicates": False}
    first = learn.wh_learn(table, 0.01, **given)
    by_chunk = weights(learn.wh_learn(table, 0.01, rows_per_chunk=2, weights=first, **given))
    by_range = weights(learn.wh_learn(table, 0.01, weights=first, **given))
    assert len(many_ranges) == 2 and many_ranges[1] > 1
    assert by_chunk.keys() == by_range.keys()
    assert all(by_range[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in by_chunk.items())


def test_few_numbers_decide_between_ranges_and_chunks(spark, many_ranges, monkeypatch):
    table, rows = events(spark, 100)
    monkeypatch.setattr(learn, "CHANGE_NUMBERS", 10)
    got = weights(learn.rw_learn(table, remove_duplicates=False))
    assert not many_ranges
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0).items())


def test_unequal_rates_of_many_rows(spark):
    """More rows and outcomes an event than the small tests have; an outcome may be there at several events of a block."""
    rng = random.Random(9)
    rows = [([f"c{rng.randint(0, 20)}" for _ in range(3)], [f"o{rng.randint(0, 60)}" for _ in range(rng.randint(0, 4))]) for _ in range(150)]
    got = weights(learn.rw_learn(readers.events_from_list(spark, rows), 0.2, (0.3, 0.1), 1.0, remove_duplicates=False, outcomes_per_chunk=40))
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in folded(rows, lambda c: 0.2, (0.3, 0.1), 1.0).items())


@pytest.mark.parametrize("chunk", [None, 2])
def test_rates_of_a_table(spark, chunk):
    table, rows = events(spark, 120)
    rates = {c: 0.05 * (1 + i % 3) for i, c in enumerate("abcdefgh")}
    frame = spark.createDataFrame([*rates.items(), ("unused", 9.0)], "key string, rate double")
    got = learn.rw_learn(table, frame, (0.1, 0.05), remove_duplicates=False, outcomes_per_chunk=chunk)
    assert all(weights(got).get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in folded(rows, lambda c: rates[c], (0.1, 0.05), 1.0).items())
    assert got.attrs["alpha"] == "varying"
    with pytest.raises(Exception, match="a cue without a rate: a"):
        learn.rw_learn(table, frame.where("key <> 'a'"), remove_duplicates=False)


def test_a_start_state_of_several_chunks(spark):
    table, rows = events(spark, 160)
    first = learn.rw_learn(table.where("event_id < 90"), remove_duplicates=False, strategy="kernel", outcomes_per_chunk=2)
    got = weights(learn.rw_learn(table.where("event_id >= 90"), weights=first, remove_duplicates=False, outcomes_per_chunk=2))
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0).items())


def test_events_of_a_file_and_of_a_generator(spark, tmp_path):
    table, rows = events(spark, 50)
    sinks.write_events(table, str(tmp_path / "events"))
    by_file = learn.rw_learn(str(tmp_path / "events"), remove_duplicates=False)
    by_pairs = learn.wh_learn((r for r in rows), 0.01, betas=(0.01, 0.01), remove_duplicates=False)
    assert by_file.attrs["event_path"] == str(tmp_path / "events") and by_pairs.attrs["event_path"] == ""
    expect = folded([(c, o or [""]) for c, o in rows], lambda c: 0.1, (0.1, 0.1), 1.0)
    assert all(weights(by_file).get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())
    expect = folded(rows, lambda c: 0.01, (1, 1), 1.0)
    assert by_pairs.attrs["number_events"] == "50"


def test_no_events_leave_the_start_state(spark):
    table, _ = events(spark, 40)
    first = learn.rw_learn(table, remove_duplicates=False)
    got = learn.rw_learn(table.where("false"), weights=first)
    assert weights(got) == weights(first)
    nothing = learn.rw_learn(table.where("false"), strategy="kernel")
    assert nothing.table.collect() == [] and nothing.attrs["number_events"] == "0"
