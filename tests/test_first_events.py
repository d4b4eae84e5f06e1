"""Chunks of rows that begin to change late skip what lies before; against the rule, an event at a time."""

from __future__ import annotations

import random

import pytest

from cuespark.operators import counts, learn
from cuespark.plans import kernel
from cuespark.sources import readers
from tests.test_blocks_and_subtitles import folded


def late_outcomes(spark, n=240):
    """Every thirty events an outcome comes up for the first time; names don't tell which."""
    rng = random.Random(8)
    names = rng.sample("ABCDEFGH", 8)
    rows = [([rng.choice("abcdef") for _ in range(3)], rng.sample(names[: i // 30 + 1], min(2, i // 30 + 1))) for i in range(n)]
    return readers.events_from_list(spark, rows), rows, names


@pytest.fixture
def many_files(monkeypatch):
    real = kernel.write_encoded
    monkeypatch.setattr(kernel, "write_encoded", lambda encoded, files=None: real(encoded, 12))


def weights(w):
    return {(r.outcome, r.cue): r.weight for r in w.table.collect()}


@pytest.mark.parametrize("betas", [(0.1, 0.1), (0.1, 0.04)])
@pytest.mark.parametrize("small", [500_000, 3])
def test_late_rows_equal_single_events(spark, many_files, monkeypatch, betas, small):
    monkeypatch.setattr(counts, "SMALL_KEYS", small)
    table, rows, _ = late_outcomes(spark)
    got = weights(learn.rw_learn(table, 0.1, betas, remove_duplicates=False, outcomes_per_chunk=3))
    expect = folded(rows, lambda c: 0.1, betas, 1.0)
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())


def test_rows_with_former_weights_read_all(spark, many_files):
    """An outcome that is known from before is unlearned from the first event on, also if it comes late or never."""
    table, rows, names = late_outcomes(spark)
    before = [(["a", "b"], [names[7]]), (["c"], ["never"])] * 3
    first = learn.rw_learn(readers.events_from_list(spark, before), 0.1, remove_duplicates=False, strategy="kernel")
    got = weights(learn.rw_learn(table, 0.1, weights=first, remove_duplicates=False, outcomes_per_chunk=2))
    expect = folded(before + rows, lambda c: 0.1, (0.1, 0.1), 1.0)
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())


def test_events_before_the_first_are_not_read(spark, many_files):
    table, rows, names = late_outcomes(spark)
    cues, outcomes = (counts.vocabulary(table, c) for c in ("cues", "outcomes"))
    path = kernel.write_encoded(counts.encode(table, cues, outcomes))
    places = {r.row: (r.place, r.first) for r in kernel.rows_by_first_event(path, outcomes, 8, None, learn._placed).collect()}
    ids = {r.key: r.id for r in outcomes.collect()}
    firsts = [next(i for i, (_, own) in enumerate(rows) if n in own) for n in names]
    assert [places[ids[n]] for n in sorted(names, key=lambda n: firsts[names.index(n)])] == list(enumerate(sorted(firsts)))
    read = [sum(len(b[0]) - 1 for b in kernel._batches(path, since=k)) for k in (None, 0, 120, 239, 240)]
    assert read[:2] == [240, 240] and 120 <= read[2] <= 160 and 1 <= read[3] <= 40 and read[4] == 0
    held = spark.createDataFrame([(ids[names[5]], 0, 1.0)], "row int, input int, weight double")
    kept = {r.row: (r.place, r.first) for r in kernel.rows_by_first_event(path, outcomes, 8, held, learn._placed).collect()}
    assert kept[ids[names[5]]] == (0, None)
