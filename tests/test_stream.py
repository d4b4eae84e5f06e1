"""Learning on a stream: restarts, late events, saved weights; against the rule, an event at a time."""

from __future__ import annotations

import gzip

import numpy as np
import pytest

from cuespark.operators import learn
from cuespark.sources.event_stream import EventFileStream, event_of, stream_events
from cuespark.streaming.learner import learn_available
from tests.test_blocks_and_subtitles import events, folded

SCHEMA = "event_id long, cues array<string>, outcomes array<string>"


def stream(spark, path, files=1000):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(path))


def near(got, want):
    found = {(r.outcome, r.cue): r.weight for r in got.collect()}
    return all(found.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in want.items()) and found.keys() <= want.keys()


def test_a_stopped_stream_goes_on_with_its_rows(spark, tmp_path):
    """Later batches have outcomes that the first ones lack, and leave some cues alone."""
    table, rows = events(spark, 120, 8)
    rows = [(c if i < 60 else [x for x in c if x != "h"] or ["a"], [x for x in o if x != "V"] if i < 60 else o) for i, (c, o) in enumerate(rows)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    rates = {"alpha": 0.2, "betas": (0.1, 0.04), "lambda_": 1.5, "buckets": 2}
    got = None
    for low, high in ((0, 40), (40, 60), (60, 120)):  # three runs of the stream on one checkpoint
        table.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = learn_available(stream(spark, tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), **rates)
    assert near(got, folded(rows, lambda c: 0.2, (0.1, 0.04), 1.5))
    table.where("event_id = 7").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="event 7 comes after event 119"):
        learn_available(stream(spark, tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), **rates)


def test_a_stream_starts_from_saved_weights(spark, tmp_path):
    table, rows = events(spark, 80, 9)
    first = learn.rw_learn(table.where("event_id < 50"), remove_duplicates=False)
    first.write(str(tmp_path / "w"))
    table.where("event_id >= 50").coalesce(1).write.parquet(str(tmp_path / "in"))
    saved = learn.Weights.read(spark, str(tmp_path / "w"))
    got = learn_available(stream(spark, tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), buckets=3, weights=saved.table)
    whole = folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0)
    touched = {c for r in rows[50:] for c in r[0]}  # pairs whose weights changed on the stream
    assert touched == set("abcdefgh") and near(got, whole)


def test_an_id_twice_in_a_batch_is_late(spark, tmp_path):
    spark.createDataFrame([(1, ["a"], ["X"]), (1, ["b"], ["X"])], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="event 1 comes after event 1"):
        learn_available(stream(spark, tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), buckets=1)


# the source ------------------------------------------------------------------------------


def write_file(folder, name, rows, packed=True):
    folder.mkdir(exist_ok=True)
    text = "cues\toutcomes\n" + "".join(f"{'_'.join(c)}\t{'_'.join(o)}\n" for c, o in rows)
    (folder / name).write_bytes(gzip.compress(text.encode()) if packed else text.encode())


def test_event_files_are_learned_in_order_and_again(spark, tmp_path):
    """Files join later; a run from an empty checkpoint in other batches gives the same weights."""
    _, rows = events(spark, 90, 12)
    rows = [(c, o or [""]) for c, o in rows]
    folder, results = tmp_path / "in", []
    for low, high in ((0, 30), (30, 50), (50, 90)):
        write_file(folder, f"{low:03}.gz", rows[low:high])
        got = learn_available(stream_events(spark, str(folder), files_per_batch=1), str(tmp_path / "a"), str(tmp_path / "out-a"), buckets=2)
    results.append(got)
    results.append(learn_available(stream_events(spark, str(folder)), str(tmp_path / "b"), str(tmp_path / "out-b"), buckets=2))
    for got in results:
        assert near(got, folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0))


def reader(folder, **options):
    return EventFileStream({"path": str(folder), **{k: str(v) for k, v in options.items()}})


def read(source, start, end):
    return [r for p in source.partitions(start, end) for b in source.read(p) for r in b.to_pylist()]


def test_offsets_of_files_and_lines(tmp_path):
    rows = [([f"c{i}"], ["X"]) for i in range(25)]
    write_file(tmp_path / "in", "a", rows[:10], False)
    write_file(tmp_path / "in", "b", rows[10:], False)
    source = reader(tmp_path / "in", compression="none", lines_per_batch=4)
    at, seen = source.initialOffset(), []
    while (end := source.latestOffset()) != at:
        batch = read(source, at, end)
        assert len(batch) <= 4 and batch == read(reader(tmp_path / "in", compression="none"), at, end)  # a replay
        seen += batch
        at = end
    assert [r["cues"] for r in seen] == [c for c, _ in rows]
    assert [r["event_id"] for r in seen] == [*range(10), *((1 << 40) + i for i in range(15))]
    again = reader(tmp_path / "in", compression="none", lines_per_batch=4)
    again.partitions({"file": 0, "line": 4, "last": ""}, {"file": 0, "line": 8, "last": ""})  # the last batch of a stopped stream
    assert again.latestOffset() == {"file": 1, "line": 0, "last": "a"}


def test_files_before_those_read_are_an_error(tmp_path):
    write_file(tmp_path / "in", "b.gz", [(["a"], ["X"])])
    source = reader(tmp_path / "in")
    end = source.latestOffset()
    assert read(source, source.initialOffset(), end) and source.latestOffset() == end
    write_file(tmp_path / "in", "a.gz", [(["a"], ["X"])])
    with pytest.raises(ValueError, match="up to b.gz"):
        source.latestOffset()
    with pytest.raises(ValueError, match="read whole"):
        reader(tmp_path / "in", lines_per_batch=3)


def test_frequencies_and_bad_lines(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("Cues\tOutcomes\tFrequency\na_b\tX\t3\n#a\t\t1\n")
    source = reader(tmp_path / "in", compression="none")
    got = read(source, source.initialOffset(), source.latestOffset())
    assert [(r["event_id"], r["cues"], r["outcomes"]) for r in got] == [(0, ["a", "b"], ["X"]), (1, ["a", "b"], ["X"]), (2, ["a", "b"], ["X"]), (3, ["#a"], [""])]
    with pytest.raises(ValueError, match="two or three columns"):
        event_of("a")


# batches that are bounded -----------------------------------------------------------------


def batches(out):
    return sorted(int(p.name.split("=")[1]) for p in out.iterdir() if p.name.startswith("batch="))


def test_files_that_are_there_are_learned_in_several_batches(spark, tmp_path):
    _, rows = events(spark, 70, 5)
    rows = [(c, o or [""]) for c, o in rows]
    for low in range(0, 70, 20):
        write_file(tmp_path / "in", f"{low:03}.gz", rows[low : low + 20])
    got = learn_available(stream_events(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "state"), str(tmp_path / "out"), buckets=2)
    assert near(got, folded(rows, lambda c: 0.1, (0.1, 0.1), 1.0)) and batches(tmp_path / "out") == [0, 1, 2, 3]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert parts == "4"  # the session's own


def test_queries_take_bounded_batches(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from cuespark import queries, storage

    rows = [(i, 1 + i % 5, ("click", "view")[i % 2], float(i), "{}") for i in range(80)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    table.repartition(3, F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "PER_BATCH", 20)
    want = {(r.outcome, r.cue): r.weight for r in queries.rw_weights(spark, str(tmp_path)).collect()}
    for query in (queries.stream_rw, queries.stream_event_files):
        paths = []
        monkeypatch.setattr(queries, "scratch", lambda s, n: paths.append(storage.scratch(s, n)) or paths[-1])
        got = {(r.outcome, r.cue): r.weight for r in query(spark, str(tmp_path)).collect()}
        assert got == pytest.approx(want, abs=2e-6) and len(batches(type(tmp_path)(paths[-1]) / "out")) == 4


def test_events_travel_in_blocks(spark, monkeypatch):
    """Slices, lists without tokens, and a null list; tokens are written once for each block."""
    import pyarrow as pa

    from cuespark.streaming import learner

    monkeypatch.setattr(learner, "BLOCK", 3)
    rows = [(9, ["a", "b"], ["X"], [1]), (7, [], ["Y", "X"], [0, 1]), (8, None, [], []), (3, ["b"], ["Y"], [0])]
    kinds = pa.schema([("event_id", pa.int64()), ("cues", pa.list_(pa.string())), ("outcomes", pa.list_(pa.string())), ("buckets", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in [(0, ["q"], ["Q"], [1]), *rows]], schema=kinds).slice(1)
    packed = [b for r in learner.pack(iter([batch])) for b in r.column(0).to_pylist()]
    parts = [part for block in packed for part in pa.ipc.open_stream(block)]
    assert [p.num_rows for p in parts] == [3, 1] and [r for p in parts for r in p.column(1).to_pylist()] == [["a", "b"], [], [], ["b"]]
    cued, named = learner.Tokens(), learner.Tokens()
    for p in parts:
        cued.add(p.column(1))
        named.add(p.column(2), p.column(3).values.to_numpy() == 1)
    offsets, places = cued.sorted(np.array([3, 1, 2, 0]), {"a": 0, "b": 1})
    assert offsets.tolist() == [0, 1, 1, 1, 3] and places.tolist() == [1, 0, 1] and list(named.seen) == ["X"]
    assert named.sorted(None, {"X": 0})[0].tolist() == [0, 1, 2, 2, 2]
    with pytest.raises(ValueError, match="null"):
        list(learner.pack(iter([pa.RecordBatch.from_pylist([dict(zip(kinds.names, (1, [None], [], [])))], schema=kinds)])))
