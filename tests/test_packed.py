"""Event files in short lines: exact for any events, and small for those of windows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from cuespark import queries
from cuespark.functions import packed
from cuespark.operators import corpus
from cuespark.sources import readers, sinks


def through(rows: list[tuple[str, str]], per_write: int, per_read: int) -> list[tuple[str, str]]:
    """The rows through lines, in batches of such sizes."""
    batches = (pa.RecordBatch.from_pydict({"cues": [r[0] for r in part], "outcomes": [r[1] for r in part]}) for part in (rows[k : k + per_write] for k in range(0, len(rows), per_write)))
    lines = [x for b in packed.pack(batches) for value in b.column(0).to_pylist() for x in value.split("\n")]
    assert lines.pop(0) == packed.HEADER
    back = packed.unpack(pa.RecordBatch.from_pydict({"event_id": range(k, k + len(part)), "value": part}) for k, part in ((k, lines[k : k + per_read]) for k in range(0, len(lines), per_read)))
    got = [tuple(r.values()) for b in back for r in b.to_pylist()]
    assert [r[0] for r in got] == list(range(len(rows)))
    return [r[1:] for r in got]


def test_any_events_come_back_from_short_lines(monkeypatch):
    """Windows and others, n-grams of any length, empty, repeated and wide tokens, in batches and parts of any size."""
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.choice(["a", "ab", "abc_", "_", "#é日\U0001f600a"])
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 30))]
        grams, rows = rng.randint(0, 4), []
        for i in range(len(words)):
            own = words[i : i + rng.randint(1, 3)]
            text = f"#{'#'.join(own)}#"
            rows.append(("_".join(text[k : k + grams] for k in range(max(0, len(text) - grams + 1))) if grams else "_".join(own), rng.choice(["", "_".join(own)])))
        monkeypatch.setattr(packed, "LETTERS", rng.choice([5, 50, 1 << 20]))
        assert through(rows, rng.randint(1, 12), rng.randint(1, 12)) == rows
    aaa = [("_".join(["aa"] * k), "a") for k in (5, 3, 9, 9, 1, 2)]
    assert through(aaa, 2, 3) == aaa


def test_packed_event_files(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"one two {'three ' * (i % 4)}\U0001f600é w{i}") for i in range(50)], "doc_id long, text string")
    for remove, name in ((False, "all"), (True, "different")):
        laid = corpus.laid_events(texts, remove_duplicates=remove)
        for packs in (False, True):
            sinks.write_events(laid, str(tmp_path / f"{name}{packs}"), laid_out=True, packed=packs)
        for pick in ({}, {"start": 3, "step": 4}):
            plain, short = ([tuple(r) for r in readers.read_events(spark, str(tmp_path / f"{name}{p}"), packed=p, **pick).orderBy("event_id").collect()] for p in (False, True))
            assert plain == short and plain
    by_id = readers.events_from_list(spark, [(["a", "b"], []), (["b", ""], ["x"]), (["b"], ["x", "y"]), ([""], [""])])
    sinks.write_events(by_id.repartition(3), str(tmp_path / "ids"), packed=True, per_file=2)
    back = readers.read_events(spark, str(tmp_path / "ids"), packed=True).orderBy("event_id").collect()
    assert [(r.cues, r.outcomes) for r in back] == [(["a", "b"], [""]), (["b", ""], ["x"]), (["b"], ["x", "y"]), ([""], [""])]
    with pytest.raises(Exception, match="two or three columns"):
        readers.read_events(spark, str(tmp_path / "allTrue")).collect()
    with pytest.raises(Exception, match="six columns"):
        readers.read_events(spark, str(tmp_path / "allFalse"), packed=True).collect()
    for bad in ("a\tb", "a\nb", "a\rb"):
        with pytest.raises(Exception, match="a tab or a line end"):
            sinks.write_events(readers.events_from_list(spark, [([bad], ["x"])]), str(tmp_path / f"bad{ord(bad[1])}"), packed=True)
    for wrong in ({"compression": None}, {"compatible": True}):
        with pytest.raises(ValueError, match="packed"):
            sinks.write_events(by_id, str(tmp_path / "wrong"), packed=True, **wrong)


def test_the_event_file_of_all_documents_is_small(spark, tmp_path, monkeypatch):
    """It took 3.8 times the documents' bytes."""
    monkeypatch.setattr("cuespark.storage.scratch", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr("cuespark.queries.scratch", lambda s, name: str(tmp_path / name))
    folder = "/root/testdata/sf0.01"
    found = queries.event_file_trigrams(spark, folder)
    size = sum(p.stat().st_size for p in (tmp_path / "event-file").glob("part-*"))
    with open(f"{folder}/documents.parquet", "rb") as f:
        assert size < 2 * f.seek(0, 2)
    first = found.orderBy("event_id").first()
    assert first.event_id == 0 and len(first.cues) > 2


def test_lines_made_from_texts_are_those_of_their_events(spark, tmp_path):
    """Texts of one word, of words of one letter, of none, with markers; with ids of their own and shared ones."""
    rows = [(i, t) for i, t in enumerate(["a", "a b", "a a a a", "one two three four five", "", None, "\U0001f600 é日 x---END.OF.DOCUMENT---y z", "#_\t", " p\nq  r ", "A-b C"] * 3)]
    for name, shared in (("own", []), ("shared", [(3, "six seven"), (3, "a")])):
        table = spark.createDataFrame(rows + shared, "doc_id long, text string").repartition(4)
        for window, n in ((1, 2), (3, 3), (4, 2)):
            path, cues = f"{tmp_path}/{name}{window}", {2: "bigrams_to_word", 3: "trigrams_to_word"}[n]
            sinks.write_packed(corpus.packed_ngrams(table, window=window, n=n, allowed_symbols="a-zé日\U0001f600", lower_case=True), path)
            got = readers.read_events(spark, path, packed=True, joined=True).orderBy("event_id").collect()
            events = corpus.corpus_to_events(table, event_options=(window,), cue_structure=cues, remove_duplicates=False, allowed_symbols="a-zé日\U0001f600", lower_case=True)
            want = corpus.as_text(events.orderBy("doc_id", "context", "place")).collect()
            if name == "own":
                assert [(r.cues, r.outcomes) for r in got] == [tuple(r) for r in want]
            assert [r.event_id for r in got] == list(range(len(want))) and sorted((r.cues, r.outcomes) for r in got) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="a tab or a line end"):
        sinks.write_packed(corpus.packed_ngrams(spark.createDataFrame([(1, "a\rb")], "doc_id long, text string")), str(tmp_path / "bad"))
