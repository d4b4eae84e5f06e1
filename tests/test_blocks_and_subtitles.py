"""Blocks of events against single events, encoding with and without broadcast, subtitles, the import guard."""

from __future__ import annotations

import gzip
import os
import random

import numpy as np
import pytest

from cuespark.operators import corpus, counts, learn
from cuespark.plans import kernel
from cuespark.sources import readers, sinks


def events(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [([rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))], [rng.choice("XYZUV") for _ in range(rng.randint(0, 3))]) for _ in range(n)]
    return readers.events_from_list(spark, rows), rows


def folded(rows, alpha, betas, lam):
    """The rule, an event at a time, on dictionaries."""
    cues, outcomes = sorted({c for r in rows for c in r[0]}), sorted({o for r in rows for o in r[1]})
    w = {(o, c): 0.0 for o in outcomes for c in cues}
    for present, own in rows:
        for o in outcomes:
            a = sum(w[o, c] for c in present)
            u = betas[0] * (lam - a) if o in own else -betas[1] * a
            for c in present:
                w[o, c] += alpha(c) * u
    return w


@pytest.mark.parametrize("betas", [(0.1, 0.1), (0.1, 0.05), (0.2, 0.0)])
@pytest.mark.parametrize("per_cue", [False, True])
def test_blocks_equal_single_events(spark, betas, per_cue):
    table, rows = events(spark)
    rates = {c: 0.05 * (1 + i % 3) for i, c in enumerate("abcdefgh")} if per_cue else 0.1
    got = learn.rw_learn(table, rates, betas, 1.5, remove_duplicates=False, strategy="kernel")
    expect = folded(rows, (lambda c: rates[c]) if per_cue else (lambda c: 0.1), betas, 1.5)
    found = {(r.outcome, r.cue): r.weight for r in got.table.collect()}
    assert all(found.get(k, 0.0) == pytest.approx(v, abs=1e-10) for k, v in expect.items())


@pytest.mark.parametrize("kinds", ["xy", "x", "y"])
def test_blocks_equal_single_events_with_vectors(spark, kinds):
    table, rows = events(spark, 200)
    rng = np.random.default_rng(2)
    x, y = ({k: rng.normal(size=n) for k in keys} for keys, n in (("abcdefgh", 6), ("XYZUV", 4)))
    frames = [spark.createDataFrame([(k, v.tolist()) for k, v in t.items()], "label string, vec array<double>") for t in (x, y)]
    given = {"cue_vectors": frames[0] if "x" in kinds else None, "outcome_vectors": frames[1] if "y" in kinds else None}
    got = learn.wh_learn(table, 0.01, remove_duplicates=False, **given)
    x = x if "x" in kinds else dict(zip("abcdefgh", np.eye(8)))
    targets = y if "y" in kinds else dict(zip("UVXYZ", np.eye(5)))
    w = np.zeros((len(targets["X"]), len(x["a"])))
    for cues, outcomes in rows:
        want = sum((targets[o] for o in (outcomes if "y" in kinds else set(outcomes))), np.zeros(len(w)))
        own = sum(x[c] for c in cues)
        w += 0.01 * np.outer(want - w @ own, own)
    names = [[str(i) for i in range(n)] for n in w.shape]
    names = [names[0] if "y" in kinds else list("UVXYZ"), names[1] if "x" in kinds else list("abcdefgh")]
    found = {(r[0], r[1]): r.weight for r in got.table.collect()}
    assert all(found.get((names[0][i], names[1][j]), 0.0) == pytest.approx(w[i, j], abs=1e-10) for i in range(w.shape[0]) for j in range(w.shape[1]))


def test_encoding_is_the_same_by_broadcast_and_by_join(spark, monkeypatch):
    table, _ = events(spark, 60)
    table = table.union(spark.createDataFrame([(60, ["a", "a"], []), (61, [], ["X"])], table.schema))
    ids = [counts.vocabulary(table, c) for c in ("cues", "outcomes")]
    small = sorted((r.event_id, tuple(r.cue_ids), tuple(r.outcome_ids)) for r in counts.encode(table, *ids).collect())
    monkeypatch.setattr(counts, "SMALL_KEYS", 2)
    large = sorted((r.event_id, tuple(r.cue_ids), tuple(r.outcome_ids)) for r in counts.encode(table, *ids).collect())
    assert small == large and len(small) == 62
    again = [counts.vocabulary(table, c) for c in ("cues", "outcomes")]
    assert [sorted(map(tuple, t.collect())) for t in again] == [sorted(map(tuple, t.collect())) for t in ids]
    for most in (2, 1000):
        monkeypatch.setattr(counts, "SMALL_KEYS", most)
        with pytest.raises(Exception, match="unknown token"):
            counts.encode(table, ids[0].where("key <> 'a'"), ids[1]).collect()


def sentence(words, *times):
    tags = "".join(f'<time id="T{i}{kind}" value="{at}"/>' for i, (kind, at) in enumerate(times))
    return "<s>" + tags + "".join(f"<w>{w}</w>" for w in words) + "</s>"


def test_subtitle_lines():
    page = lambda *s: ("﻿<document>" + "".join(s) + "</document>").encode()
    # the end of a sentence without words doesn't count
    quiet = page(sentence(["A"], ("S", "0:0:1,0"), ("E", "0:0:2,0")), sentence([], ("S", "0:0:3,0"), ("E", "0:0:9,0")), sentence(["B"], ("S", "0:0:10,0")))
    assert readers.subtitle_lines(quiet) == ["A", "\nB"]
    # single marks are glued, brackets of two marks aren't one
    assert readers.subtitle_lines(page(sentence(["Well", ",", "(", "yes", ")", "()", "."]))) == ["Well,( yes) ()."]
    # half a second is fifteen frames; exactly the duration is no break
    assert readers.subtitle_lines(page(sentence(["A"], ("S", "0:0:2,0")), sentence(["B"], ("S", "0:0:2,15")))) == ["A", "\nB"]
    # nested sentences aren't the document's own
    assert readers.subtitle_lines(page("<p>" + sentence(["no"]) + "</p>", sentence(["yes"]))) == ["yes"]
    # each late start breaks
    assert readers.subtitle_lines(page(sentence(["A"], ("S", "0:1:0,0"), ("S", "0:2:0,0")))) == ["\n\nA"]
    for bad in (sentence(["A"], ("X", "0:0:0,0")), "<s><w/></s>"):
        with pytest.raises(ValueError):
            readers.subtitle_lines(page(bad))


def test_corpus_files(spark, tmp_path):
    """Subtitle files to a corpus, and the corpus to documents and lines, in the order of the paths."""
    for name, words in (("b/2.gz", "second"), ("a.gz", "first"), ("b/1.gz", "middle")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(gzip.compress(f"<d>{sentence([words, '!'])}{sentence(['late'], ('S', '0:0:6,0'))}</d>".encode()))
    (tmp_path / "in" / "other.txt").write_text("not read")
    sinks.write_corpus(readers.read_subtitles(spark, str(tmp_path / "in")), str(tmp_path / "corpus"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "corpus")).collect())
    assert text.replace("\n", "|") == "|".join(f"{w}!||late||---END.OF.DOCUMENT---|" for w in ("first", "middle", "second"))
    whole = readers.read_corpus(spark, str(tmp_path / "corpus"))
    words = corpus.corpus_to_events(whole, event_structure="line", cue_structure="word_to_word")
    assert sorted(r.cues for r in words.collect()) == [["first!", "late"], ["middle!", "late"], ["second!", "late"]]
    lines = readers.read_corpus(spark, str(tmp_path / "corpus"), by_document=False).orderBy("doc_id").collect()
    assert [r.text for r in lines][:3] == ["first!", "", "late"]


def test_reserved_characters_warn_once(spark):
    rows = spark.createDataFrame([(1, "a#b")], "doc_id long, text string")
    with pytest.warns(UserWarning):
        corpus.corpus_to_events(rows, warn=True)


def test_weights_by_frequency_and_wide(spark):
    counter = spark.createDataFrame([("b", 1), ("a", 3), ("c", 3)], "key string, freq long")
    assert [r.key for r in counts.by_frequency(counter).collect()] == ["a", "c", "b"]
    w = learn.from_table(spark.createDataFrame([("X", "a", 0.5), ("Y", "b", -1.0)], "outcome string, cue string, weight double"))
    assert sorted(map(tuple, w.wide().collect())) == [("X", 0.5, 0.0), ("Y", 0.0, -1.0)]


def test_files_to_files(spark, tmp_path):
    """A corpus of several documents in one file to events, and these filtered."""
    from cuespark import files

    (tmp_path / "texts.txt").write_text("one two\nthree\n---END.OF.DOCUMENT---\n\nfour---end.of.document---five six\n---END.OF.DOCUMENT---\n")
    files.create_event_file(spark, str(tmp_path / "texts.txt"), str(tmp_path / "events"), event_options=(2,), cue_structure="word_to_word", remove_duplicates=False)
    got = readers.read_events(spark, str(tmp_path / "events")).orderBy("event_id").collect()
    assert ["_".join(r.cues) for r in got] == ["one", "one_two", "two_three", "three", "four", "five", "five_six", "six"]
    files.filter_event_file(spark, str(tmp_path / "events"), str(tmp_path / "less"), remove_cues=["two", "four"])
    less = readers.read_events(spark, str(tmp_path / "less")).orderBy("event_id").collect()
    assert ["_".join(r.cues) for r in less] == ["one", "one", "three", "three", "five", "five_six", "six"]
    lines = corpus.corpus_to_events(readers.read_corpus(spark, str(tmp_path / "texts.txt"), by_document=False), context_structure="line", event_structure="line", cue_structure="word_to_word")
    assert sorted("_".join(sorted(r.cues)) for r in lines.collect())[-2:] == ["one_two", "three"]
    with pytest.raises(Exception, match="exists"):
        files.create_event_file(spark, str(tmp_path / "texts.txt"), str(tmp_path / "events"))


def test_metadata_of_a_continued_run(spark):
    table, _ = events(spark, 20)
    first = learn.rw_learn(table.where("event_id < 10"), remove_duplicates=False)
    both = learn.rw_learn(table.where("event_id >= 10"), 0.2, weights=first, remove_duplicates=False)
    keys = {"date", "number_events", "alpha", "betas", "lambda", "function", "method", "cpu_time", "wall_time", "hostname", "username", "numpy", "pandas", "spark"}
    assert keys <= first.attrs.keys() and keys <= both.attrs.keys()
    assert (both.attrs["number_events"], both.attrs["alpha"]) == ("10 | 10", "0.1 | 0.2")


CUE_STRUCTURES = [
    ("consecutive_words", (3,), "trigrams_to_word"), ("consecutive_words", (1,), "bigrams_to_word"), ("consecutive_words", (2,), "word_to_word"),
    ("word_to_word", (2, 1), "word_to_word"), ("word_to_word", (1, 1), "trigrams_to_word"), ("line", (), "bigrams_to_word"), ("line", (), "word_to_word"),
]


@pytest.mark.parametrize("structure,options,cues,remove_duplicates", [(*c, k % 2 == 0) for k, c in enumerate(CUE_STRUCTURES)])
def test_event_files_hold_what_was_written(spark, tmp_path, structure, options, cues, remove_duplicates):
    """Cues that begin and end with marks, quotes and blanks come back as they were, in order, and can be filtered."""
    from cuespark import files

    text = 'one "two" \'three\'\nfour, five\\ six\n---END.OF.DOCUMENT---\nÄhre 日本 one one\n'
    (tmp_path / "texts.txt").write_text(text)
    options = {"event_structure": structure, "event_options": options, "cue_structure": cues, "remove_duplicates": remove_duplicates}
    files.create_event_file(spark, str(tmp_path / "texts.txt"), str(tmp_path / "events"), **options)
    documents = readers.read_corpus(spark, str(tmp_path / "texts.txt"))
    want = corpus.number_events(corpus.corpus_to_events(documents, **options), "doc_id", "context", "place").orderBy("event_id").collect()
    got = readers.read_events(spark, str(tmp_path / "events")).orderBy("event_id").collect()
    split = lambda x: "_".join(x).split("_")  # noqa: E731  an empty list comes back as an empty token
    assert [(r.event_id, r.cues, r.outcomes) for r in got] == [(r.event_id, split(r.cues), split(r.outcomes)) for r in want] and got
    kept = want[0].cues[0]
    files.filter_event_file(spark, str(tmp_path / "events"), str(tmp_path / "less"), keep_cues=[kept])
    less = [r.cues for r in readers.read_events(spark, str(tmp_path / "less")).orderBy("event_id").collect()]
    assert less == [[kept] * r.cues.count(kept) for r in want if kept in r.cues] and less


def test_event_and_counter_files_are_plain_text(spark, tmp_path):
    table = spark.createDataFrame([(i, [f"#{i}", '"a'], ["#x#"] if i % 2 else []) for i in range(50)], "event_id long, cues array<string>, outcomes array<string>")
    sinks.write_events(table, str(tmp_path / "events"))
    lines = [x for p in sorted((tmp_path / "events").glob("part-*.gz")) for x in gzip.decompress(p.read_bytes()).decode().split("\n")[1:-1]]
    assert lines == [f'#{i}_"a\t{"#x#" if i % 2 else ""}' for i in range(50)]
    counter = spark.createDataFrame([("#a", 3), ('"b', 7), ("#", 7), ("c#", 1)], "key string, freq long")
    sinks.write_counter(counter, str(tmp_path / "counts"))
    files = sorted((tmp_path / "counts").glob("part-*.txt"))
    assert {p.read_text().split("\n")[0] for p in files if p.stat().st_size} == {"key\tfreq"}
    assert [x for p in files for x in p.read_text().split("\n")[1:-1]] == ['"b\t7', "#\t7", "#a\t3", "c#\t1"]
    assert sorted(map(tuple, readers.read_counter(spark, str(tmp_path / "counts")).collect())) == [('"b', 7), ("#", 7), ("#a", 3), ("c#", 1)]
    for bad in ("a\tb", "a\nb"):
        with pytest.raises(Exception, match="a tab or a line end"):
            sinks.write_events(readers.events_from_list(spark, [([bad], ["x"])]), str(tmp_path / f"bad{len(bad)}{ord(bad[1])}"))


@pytest.mark.skipif("GOLDEN_CORPUS" not in os.environ, reason="needs the text of the published counts")
def test_published_counts_of_a_corpus(spark, tmp_path):
    """2,772 events of three words; with duplicates 1,098 have other bigram cues and 66 other outcomes than without."""
    from cuespark import files

    read = []
    for remove in (False, True):
        path = str(tmp_path / str(remove))
        files.create_event_file(spark, os.environ["GOLDEN_CORPUS"], path, allowed_symbols="a-zA-Z", cue_structure="bigrams_to_word", remove_duplicates=remove)
        read.append({r.event_id: (r.cues, r.outcomes) for r in readers.read_events(spark, path).collect()})
    assert len(read[0]) == len(read[1]) == 2772
    assert sum(len(read[0][k][0]) != len(read[1][k][0]) for k in read[0]) == 1098
    assert sum(len(read[0][k][1]) != len(read[1][k][1]) for k in read[0]) == 66
    assert all(set(read[0][k][i]) == set(read[1][k][i]) for k in read[0] for i in (0, 1))
