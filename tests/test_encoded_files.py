"""Files of encoded events: round trips, slices, exhausted slices, bad files, files without an index."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pytest

from cuespark.sources import encoded

SCHEMA = "event_id long, cue_ids array<int>, outcome_ids array<int>"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.sample(range(1000), rng.randint(0, 6)), rng.sample(range(9), rng.randint(0, 2))) for i in range(n)]


def found(frame):
    return sorted((r.event_id, r.cue_ids, r.outcome_ids) for r in frame.collect())


def words(*events):
    """A file as other programs write it: no index."""
    out = [encoded.MAGIC, encoded.VERSION, len(events)]
    for cues, outcomes in events:
        out += [len(cues), *cues, len(outcomes), *outcomes]
    return struct.pack(f"<{len(out)}I", *out)


def test_round_trip_and_slices(spark, tmp_path, monkeypatch):
    events, path = rows(230), str(tmp_path / "e")
    assert encoded.write_events(spark.createDataFrame(events, SCHEMA).repartition(3), path, files=5) == 230
    assert len(encoded.listed(path)) > 1
    assert found(encoded.read_events(spark, path)) == events
    for start, stop in ((0, 1), (40, 120), (229, None), (230, None), (500, 600), (0, 9999)):
        assert found(encoded.read_events(spark, path, start, stop)) == events[start:stop]
    small = spark.read.format(encoded.NAME).option("events_per_task", 7).load(path)
    assert small.rdd.getNumPartitions() > 30 and found(small) == events
    with pytest.raises(FileExistsError):
        encoded.write_events(spark.createDataFrame(events, SCHEMA), path)


def test_a_slice_of_what_is_written(spark, tmp_path):
    frame = spark.createDataFrame(rows(20), SCHEMA)
    assert encoded.write_events(frame, str(tmp_path / "a"), start=5, stop=9) == 4
    assert [r[1:] for r in found(encoded.read_events(spark, str(tmp_path / "a")))] == [r[1:] for r in rows(20)[5:9]]
    with pytest.raises(encoded.Exhausted) as e:
        encoded.write_events(frame, str(tmp_path / "b"), start=15, stop=40)
    assert e.value.number == 5 and len(found(encoded.read_events(spark, str(tmp_path / "b")))) == 5
    with pytest.raises(encoded.Exhausted) as e:
        encoded.write_events(frame, str(tmp_path / "c"), start=20, stop=21)
    assert e.value.number == 0 and not (tmp_path / "c").exists()
    assert encoded.write_events(frame, str(tmp_path / "d"), start=20) == 0 and not (tmp_path / "d").exists()


def test_duplicates_in_an_event(spark, tmp_path):
    frame = spark.createDataFrame([(0, [1, 1, 2], [3, 3])], SCHEMA)
    with pytest.raises(ValueError, match="twice"):
        encoded.write_events(frame, str(tmp_path / "a"))
    encoded.write_events(frame, str(tmp_path / "b"), remove_duplicates=True)
    encoded.write_events(frame, str(tmp_path / "c"), remove_duplicates=False)
    assert found(encoded.read_events(spark, str(tmp_path / "b"))) == [(0, [1, 2], [3])]
    assert found(encoded.read_events(spark, str(tmp_path / "c"))) == [(0, [1, 1, 2], [3, 3])]


def test_files_of_other_programs_and_bad_ones(spark, tmp_path):
    events = [([1, 2, 3], [0]), ([], []), ([7], [1, 2])]
    (tmp_path / "plain").write_bytes(words(*events))
    whole = [(i, *e) for i, e in enumerate(events)]
    assert found(encoded.read_events(spark, str(tmp_path / "plain"))) == whole
    assert found(encoded.read_events(spark, str(tmp_path / "plain"), 1, 2)) == whole[1:2]
    for name, data, message in (("magic", b"\0" * 12, "isn't a file"), ("short", b"\0", "isn't a file"), ("version", struct.pack("<3I", encoded.MAGIC, 215, 0), "has version 215")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=message):
            encoded.read_events(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="nowhere"):
        encoded.read_events(spark, str(tmp_path / "nowhere")).collect()


def test_words_of_other_programs_are_a_prefix_of_ours(spark, tmp_path):
    encoded.write_events(spark.createDataFrame([(0, [5, 6], [1]), (1, [], [2])], SCHEMA), str(tmp_path / "e"), files=1)
    (name, _), = encoded.listed(str(tmp_path / "e"))
    plain = words(([5, 6], [1]), ([], [2]))
    assert (tmp_path / "e" / name).read_bytes()[: len(plain)] == plain


def test_sliced_lists_are_packed_from_where_they_start():
    lists = pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32())).slice(1)
    got, begins = encoded.packed(lists, lists)
    assert got.tolist() == [2, 1, 2, 2, 1, 2, 0, 0, 1, 3, 1, 3] and begins.tolist() == [0, 6, 8]
