"""Vectors by tiles: sums against plain ones, tiles that come and go, learning from several tiles, and bad tables."""

from __future__ import annotations

import numpy as np
import pytest

from cuespark.operators import counts, learn
from cuespark.plans import kernel, vectors
from tests.test_blocks_and_subtitles import events


def frame(spark, table):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in table.items()], "label string, vec array<double>")


def store(spark, table, n, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_NUMBERS", tile)
    keys = spark.createDataFrame([(f"k{i:03}", i) for i in range(n)], "key string, id int")
    return vectors.write_vectors(frame(spark, table), keys, n, "cues")


def test_sums_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    held = store(spark, {**{f"k{i:03}": v for i, v in enumerate(x)}, "unused": [1, 2]}, 50, monkeypatch, 12)
    assert held.rows == 4 and held.wide == 3
    event = np.sort(rng.integers(0, 20, 90))
    ids = rng.integers(0, 50, 90)
    plain = np.zeros((20, 3))
    np.add.at(plain, event, x[ids])
    monkeypatch.setattr(vectors, "KEPT_NUMBERS", 24)  # two tiles
    assert np.allclose(held.sums(event, ids, 20), plain, atol=1e-12)
    assert np.allclose(held.sums(event, ids, 20, 1, 2), plain[:, 1:2], atol=1e-12)
    assert len(held.kept) == 2 and not held.fresh().kept
    assert held.sums(event[:0], ids[:0], 3).tolist() == np.zeros((3, 3)).tolist()


def test_kept_tiles_are_read_once(spark, monkeypatch):
    held = store(spark, {f"k{i:03}": [i, 1] for i in range(12)}, 12, monkeypatch, 6)
    reads = []
    real = vectors.read_batches
    monkeypatch.setattr(vectors, "read_batches", lambda path, columns: reads.append(path[-1]) or real(path, columns))
    ids = np.array([0, 3, 11])
    for _ in range(3):
        assert held.sums(np.arange(3), ids, 3)[:, 0].tolist() == [0, 3, 11]
    assert reads == ["0", "1", "3"]


@pytest.mark.parametrize("kinds", ["xy", "x", "y"])
@pytest.mark.parametrize("chunk", [None, 2])
def test_learning_from_several_tiles(spark, monkeypatch, kinds, chunk):
    table, _ = events(spark, 150)
    rng = np.random.default_rng(5)
    x, y = (frame(spark, {k: rng.normal(size=n) for k in keys}) for keys, n in (("abcdefgh", 6), ("XYZUV", 4)))
    given = {"cue_vectors": x if "x" in kinds else None, "outcome_vectors": y if "y" in kinds else None, "remove_duplicates": False, "rows_per_chunk": chunk}
    one = {(r[0], r[1]): r[2] for r in learn.wh_learn(table, 0.01, **given).table.collect()}
    monkeypatch.setattr(vectors, "TILE_NUMBERS", 8)
    several = {(r[0], r[1]): r[2] for r in learn.wh_learn(table, 0.01, **given).table.collect()}
    assert one and one.keys() == several.keys()
    assert all(several[k] == pytest.approx(v, abs=1e-12) for k, v in one.items())


def test_sums_in_several_pieces(spark, monkeypatch):
    """The kernel itself, with one block's sums at a time and all at once."""
    table, _ = events(spark, 300)
    rng = np.random.default_rng(6)
    cues, outcomes = (counts.vocabulary(table, c) for c in ("cues", "outcomes"))
    x = vectors.write_vectors(frame(spark, {k: rng.normal(size=5) for k in "abcdefgh"}), cues, 8, "cues")
    y = vectors.write_vectors(frame(spark, {k: rng.normal(size=3) for k in "XYZUV"}), outcomes, 5, "outcomes")
    path = kernel.write_encoded(counts.encode(table, cues, outcomes))
    rule = kernel.Rule(1.0, (0.01, 0.01), 1.0, x, y)
    found = []
    for numbers in (1, 1_000, vectors.SUM_NUMBERS):
        monkeypatch.setattr(vectors, "SUM_NUMBERS", numbers)
        w = np.zeros((5, 2))
        kernel.learn(w, kernel._batches(path), rule, 1, 3)
        found.append(w)
    assert np.abs(found[0]).max() > 0
    assert np.allclose(found[0], found[1], atol=1e-14) and np.allclose(found[0], found[2], atol=1e-14)


def test_bad_tables(spark):
    keys = spark.createDataFrame([("a", 0), ("b", 1)], "key string, id int")
    good = {"a": [1, 2], "b": [3, 4]}
    for table, message in (
        ({"a": [1, 2]}, "without a vector: 'b'"), ({**good, "b": None}, "without a vector: 'b'"),
        ({**good, "a": [1, None]}, "null in the vector: 'a'"), ({**good, "b": [1]}, "differ in length"),
    ):
        with pytest.raises(ValueError, match=message):
            vectors.write_vectors(frame(spark, table), keys, 2, "cues")
    with pytest.raises(ValueError, match="several vectors"):
        vectors.write_vectors(frame(spark, good).union(frame(spark, {"a": [1, 2]})), keys, 2, "cues")


def test_no_events(spark):
    table, _ = events(spark, 5)
    got = learn.wh_learn(table.where("false"), 0.01, cue_vectors=frame(spark, {"a": [1, 2]}), outcome_vectors=frame(spark, {"X": [1, 2, 3]}))
    assert got.table.collect() == [] and got.rows.count() == 3 and got.columns.count() == 2
