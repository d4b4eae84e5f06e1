"""The closed form over ranges of events against the rule, an event at a time."""

from __future__ import annotations

import random

import pytest

from cuespark.operators import learn
from cuespark.plans.closed import closed_form
from cuespark.sources import readers
from tests.test_blocks_and_subtitles import folded


def single_cues(spark, n=600, seed=3):
    """Nine in ten events have one cue; outcomes repeat, and some events have none."""
    rng = random.Random(seed)
    rows = [(["hot" if rng.random() < 0.9 else rng.choice("abc")], [rng.choice("XYZ") for _ in range(rng.randint(0, 3))]) for _ in range(n)]
    return readers.events_from_list(spark, rows), rows


@pytest.mark.parametrize("betas", [(0.1, 0.1), (0.1, 0.03), (0.2, 0.0), (0.0, 0.1), (1.0, 1.0)])
@pytest.mark.parametrize("ranges", [1, 7])
def test_ranges_equal_single_events(spark, betas, ranges):
    table, rows = single_cues(spark)
    alpha = 1.0 if betas[0] == 1.0 else 0.2
    got = {(r.outcome, r.cue): r.weight for r in closed_form(table, alpha, betas, 1.5, ranges).collect()}
    expect = folded(rows, lambda c: alpha, betas, 1.5)
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-12) for k, v in expect.items())
    assert got.keys() == {(o, c[0]) for c, own in rows for o in own}


def test_a_frequent_cue_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(learn, "RANGE_EVENTS", (10, 50))
    table, rows = single_cues(spark)
    ranges = []
    real = learn.closed.closed_form
    monkeypatch.setattr(learn.closed, "closed_form", lambda *a: ranges.append(a[-1]) or real(*a))
    found = learn.rw_learn(table, 0.1, (0.1, 0.05), remove_duplicates=True)
    got = {(r.outcome, r.cue): r.weight for r in found.table.collect()}
    assert ranges == [12] and found.attrs["method"] == "closed"
    expect = folded(rows, lambda c: 0.1, (0.1, 0.05), 1.0)
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-12) for k, v in expect.items())


def test_gaps_and_unordered_rows(spark):
    table, rows = single_cues(spark, 80)
    spread = table.selectExpr("event_id * event_id * 1000 - 7 as event_id", "cues", "outcomes").orderBy("outcomes")
    got = {(r.outcome, r.cue): r.weight for r in closed_form(spread, 0.1, (0.1, 0.1), 1.0, 5).collect()}
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-12) for k, v in folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0).items())


def test_no_events(spark):
    table, _ = single_cues(spark, 4)
    assert closed_form(table.where("false"), 0.1, (0.1, 0.1), 1.0, 3).collect() == []
