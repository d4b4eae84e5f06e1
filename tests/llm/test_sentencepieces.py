"""SentencePiece search against the library, against all ways to cut a word, and on odd rows."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from cuespark.llm import queries, sentencepieces
from cuespark.llm.sentencepieces import MARK, PrefixViterbi


@pytest.fixture(scope="module")
def path() -> str:
    return queries.tokenizer_file("piece_bpe_32k.model")


def test_merge_model_equals_the_library(path):
    rng = random.Random(3)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), PrefixViterbi(path)
    letters = "abetrinsho ,.THEé中0123▁\t\n\U0001f600 "
    texts = ["", " ", "a", "a" * 500, "ab" * 700, "x" * 9_000, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(1500))]
    for text, data in zip(texts, mine.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == library.encode(text), text[:80]
    assert all(len(w) <= mine.LONG for w in mine.cache)


@pytest.mark.parametrize("seed", range(40))
def test_additive_model_finds_the_best_sum(seed):
    """Of all ways to cut a word, the one with the largest sum of scores; unknown letters cost a penalty each."""
    rng = random.Random(seed)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(14)}
    pieces = {p: (i + 1, -rng.random() * len(p)) for i, p in enumerate(sorted(names))}
    search = PrefixViterbi(pieces=pieces, additive=True)
    names_of = {i: p for p, (i, _) in pieces.items()}
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)})
    for word, ids in zip(words, search.words(words)):
        best = None
        for cuts in itertools.product((False, True), repeat=len(word) - 1):
            parts, at = [], 0
            for k, cut in enumerate(cuts, 1):
                if cut:
                    parts, at = [*parts, word[at:k]], k
            parts.append(word[at:])
            if all(p in pieces or len(p) == 1 for p in parts):
                score = sum(pieces[p][1] if p in pieces else search.penalty for p in parts)
                best = score if best is None else max(best, score)
        known = [names_of[i] for i in ids if i]
        got = sum(pieces[p][1] for p in known) + search.penalty * (len(word) - sum(map(len, known)))
        assert got == pytest.approx(best), word  # ways of equal sums are equally good
        rest = "[^/]+".join("".join(names_of.get(i, "/") for i in ids).split("/"))
        assert re.fullmatch(rest, word), word


@pytest.mark.parametrize("seed", range(20))
def test_merge_model_equals_plain_merging(seed):
    """Vocabularies of merges in random order, also of equal ranks, and of pieces that no merges make."""
    rng = random.Random(seed)
    names = list("abc")
    for _ in range(25):
        names.append(rng.choice(names) + rng.choice(names))
    names += ["".join(rng.choice("abc") for _ in range(4)) for _ in range(3)]
    names = list(dict.fromkeys(n for n in names if len(n) < 9))
    pieces = {p: (i + 1, -float(i // (2 if seed % 2 else 1))) for i, p in enumerate(names)}
    search = PrefixViterbi(pieces=pieces, additive=False)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(200)})
    for word, ids in zip(words, search.words(words)):
        assert ids == [pieces[p][0] for p in search.merged(word)], word


def test_prefix_states_are_shared(path, monkeypatch):
    """Only letters behind the common prefix of neighbours are searched."""
    search = PrefixViterbi(path)
    looked = []
    monkeypatch.setattr(search, "ending", type("Seen", (), {"__getitem__": lambda self, k, ending=search.ending: looked.append(k) or ending[k]})())
    list(search.words([MARK + "nation", MARK + "national", MARK + "nationally"]))
    assert len(looked) == len(MARK + "nationally")


def test_rows(spark, path):
    """Repeated rows and ids, null ids and texts, clashing columns, an empty table."""
    rows = [(1, "One text.", "x"), (1, "One text.", "x"), (1, "Another", "y"), (None, "No id", "z"), (5, None, "n"), (6, "", "n")]
    table = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string").withColumnRenamed("TEXT2", "ids")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expect = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    for got in (sentencepieces.decode(sentencepieces.encode(table, path), path), sentencepieces.encode_and_decode(table, path)):
        assert sorted(((r.doc_id, list(r.ids), r.text) for r in got.collect()), key=str) == expect
    assert {(r.doc_id, r.n_tokens, r.restored) for r in sentencepieces.round_trip(table, path).collect()} >= {(5, 0, True), (6, 0, True)}
    nothing = table.limit(0)
    assert sentencepieces.encode_and_decode(nothing, path).collect() == sentencepieces.decode(sentencepieces.encode(nothing, path), path).collect() == []


def test_what_a_worker_keeps_is_bounded(path, monkeypatch):
    """More words, pairs and steps than a worker keeps, some of them again and again: the ids stay the library's."""
    monkeypatch.setattr(PrefixViterbi, "KEEP", 400)
    rng = random.Random(5)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), PrefixViterbi(path)
    own = sum(map(len, mine.steps))
    letters = "abcdefghijklmnopqrstuvwxyzéüßñабвгде中文日本"
    common = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(30)]
    for size in (5, 20, 1_500, 20, 5):
        words = common + ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(size)]
        texts = [" ".join(rng.sample(words, len(words))) for _ in range(3)]
        for text, data in zip(texts, mine.encode(texts)):
            assert np.frombuffer(data, "<u4").tolist() == library.encode(text), text[:80]
        assert len(mine.cache) + len(mine.older) <= 1.5 * mine.KEEP
        assert len(mine.fits) <= 2 * mine.KEEP
        assert sum(map(len, mine.steps)) - own < mine.KEEP // 2 + 64
    assert mine.fixed.items() <= mine.cache.items()


def test_parts_are_bounded_by_bytes(monkeypatch):
    """Long texts are encoded few at a time, short and null ones many; no row is lost or given twice."""
    monkeypatch.setattr(sentencepieces, "PART", 1_000)
    texts = [*["x" * 300] * 20, None, "", "é" * 4_000, None, *["short"] * 300, "x" * 999, "x" * 1_000, "x" * 1_001, "end"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"]) for t in (texts, [], [None] * 5, texts[3:])]
    found = list(sentencepieces.parts(batches))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches(batches))
    sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in found]
    assert all(s and sum(s) - s[0] <= 1_000 for s in sizes)
    assert len(found) < 40
