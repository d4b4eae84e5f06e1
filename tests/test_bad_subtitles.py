"""Subtitle files that are damaged, malformed or gone: the others make the corpus, these are listed."""

from __future__ import annotations

import gzip

import pytest

from cuespark import files
from cuespark.sources import readers

PAGE = '<d><s><w>{}</w><w>!</w></s><s><time id="T1S" value="0:0:6,0"/><w>late</w></s></d>'


@pytest.fixture
def folder(tmp_path):
    """Two good files among a cut one, one that isn't gzip, bad XML, a bad time tag and a time without a value."""
    own = tmp_path / "in"
    (own / "deep").mkdir(parents=True)
    good = {k: gzip.compress(PAGE.format(k).encode()) for k in ("first", "second", "third")}
    (own / "a.gz").write_bytes(good["first"])
    (own / "deep" / "z.gz").write_bytes(good["second"])
    (own / "cut.gz").write_bytes(good["first"][:-12])
    (own / "plain.gz").write_bytes(PAGE.format("plain").encode())
    (own / "xml.gz").write_bytes(gzip.compress(b"<d><s><w>early</w></s><s>"))
    (own / "tag.gz").write_bytes(gzip.compress(PAGE.format("x").replace("T1S", "T1X").encode()))
    (own / "value.gz").write_bytes(gzip.compress(PAGE.format("x").replace("value", "other").encode()))
    (own / "letters.gz").write_bytes(gzip.compress(PAGE.format("x").encode() + b"\xff"))
    return own


def name(path):
    return path.rsplit("/", 1)[1]


def test_bad_files_are_listed_and_the_others_stay(spark, tmp_path, folder):
    counts = files.create_corpus(spark, str(folder), str(tmp_path / "corpus"))
    assert counts == {"lines": 12, "files": 2, "damaged": 6}
    text = "|".join(r.value for r in spark.read.text(str(tmp_path / "corpus")).collect())
    assert text == "|".join(f"{w}!||late||---END.OF.DOCUMENT---|" for w in ("first", "second"))
    bad = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "corpus.damaged")).collect()]
    assert [(name(path), reason.split(":")[0]) for path, reason in bad] == [
        ("cut.gz", "EOFError"), ("letters.gz", "UnicodeDecodeError"), ("plain.gz", "BadGzipFile"), ("tag.gz", "ValueError"), ("value.gz", "KeyError"), ("xml.gz", "ParseError"),
    ]
    assert not (tmp_path / "corpus.not_found").exists()


def test_files_that_went_are_listed(spark, tmp_path, folder, monkeypatch):
    real = readers.materialise

    def gone(df, what):
        out = real(df, what)
        if what == "listed":
            (folder / "a.gz").unlink()
        return out

    monkeypatch.setattr(readers, "materialise", gone)
    (tmp_path / "corpus.not_found").write_text("of a former run")
    counts = files.create_corpus(spark, str(folder), str(tmp_path / "corpus"))
    assert counts["files"] == 1 and counts["damaged"] == 6
    assert [name(r.value) for r in spark.read.text(str(tmp_path / "corpus.not_found-1")).collect()] == ["a.gz"]
    assert (tmp_path / "corpus.not_found").read_text() == "of a former run"


def test_good_files_alone_have_no_lists(spark, tmp_path, folder):
    assert files.create_corpus(spark, str(folder / "deep"), str(tmp_path / "corpus")) == {"lines": 6, "files": 1, "damaged": 0}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["corpus", "in"]
    with pytest.raises(Exception, match="exists"):
        files.create_corpus(spark, str(folder / "deep"), str(tmp_path / "corpus"))


def test_reading_stops_at_a_bad_file(spark, folder):
    for path in folder.glob("*.gz"):
        if path.name not in ("a.gz", "cut.gz"):
            path.unlink()
    with pytest.raises(Exception, match="cut.gz: EOFError"):
        readers.read_subtitles(spark, str(folder)).collect()


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = readers.sort_subtitles(spark, str(tmp_path / "in"))
    assert found.counts == {"lines": 0, "files": 0, "damaged": 0}
    assert found.lines.isEmpty() and found.damaged.isEmpty() and found.missing.isEmpty()


def test_a_long_file_is_parsed_in_parts(spark, tmp_path, monkeypatch):
    """Elements that are done are let go; a file that breaks off late leaves no lines, though many stood ahead."""
    import tracemalloc

    body = "".join(f'<s><time id="T1S" value="0:0:1,0"/><w>w{i}</w><w>é</w></s>' for i in range(60_000))
    whole = gzip.compress(f"﻿<d>{body}</d>".encode())
    whole_text = f"<d>{body}</d>".encode()
    tracemalloc.start()
    n = sum(1 for _ in readers.sentences(whole_text[k : k + 999] for k in range(0, len(whole_text), 999)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 25_000_000  # the text alone is 4 MB; its tree 60 MB and more
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(whole)
    (tmp_path / "in" / "b.gz").write_bytes(gzip.compress(f"<d>{body}".encode()))
    counts = files.create_corpus(spark, str(tmp_path / "in"), str(tmp_path / "corpus"))
    assert counts == {"lines": 60_003, "files": 1, "damaged": 1}
    got = [r.value for r in spark.read.text(str(tmp_path / "corpus")).collect()]
    assert got == [*(f"w{i} é" for i in range(60_000)), "", "---END.OF.DOCUMENT---", ""]


def test_documents_hold_a_bounded_number_of_sentences(spark, tmp_path):
    from cuespark.sources import sinks

    rows = spark.range(50).selectExpr("id", "concat('<s><w>w', id, '</w></s>') as sentence")
    sinks.write_subtitles(rows, str(tmp_path / "in"), "id", per_document=10)
    found = readers.sort_subtitles(spark, str(tmp_path / "in"))
    assert found.counts == {"lines": 50 + 3 * 5, "files": 5, "damaged": 0}
