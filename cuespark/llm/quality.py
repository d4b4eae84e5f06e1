"""Operator 8: quality classifier from weak labels.

1. Heuristic labellers vote good (1), bad (-1) or nothing (0) on each whole text.
2. The votes of all documents are counted by pattern (at most 2 to the number of
   labellers), and expectation-maximisation over the counts estimates each labeller's
   accuracy and the share of good documents.
3. Each pattern's posterior labels a bounded sample of texts (``sample`` for each class, by
   text hash), on which a hashed linear scorer learns by logistic regression.
4. Every document gets the scorer's probability and the posterior of its votes.

A document is rejected if the scorer and the posterior both call it bad, so neither a
single heuristic nor the scorer alone drops a text.

Nulls: null, empty and blank texts get no votes on their content and are rejected (posterior and score 0).  Null ids are kept as such.
Whole texts are read; ties of posterior 0.5 count as good.  Without training rows of both
classes the score is the posterior.  Each row is scored by itself; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, make_room, pick

_MARK = re.compile(r"[^\w\s]")
_ASCII = re.compile(r"[\x00-\x7f]+")
#: ASCII letters, digits, underscores and white space, which aren't marks.
_PLAIN = bytes(b for b in range(128) if not _MARK.match(chr(b)))
_PUNCTUATION = frozenset(".,;:!?\"')]}")
#: Hash buckets of the scorer, as a power of two.
BITS = 16


def _marks(text: str) -> int:
    """How many characters are neither of a word nor white space."""
    more = 0 if text.isascii() else len(_MARK.findall(_ASCII.sub("", text)))
    return len(text.encode("ascii", "ignore").translate(None, _PLAIN)) + more


def measure(words: list[str], text: str) -> dict[str, float]:
    """What the labellers look at, of a text with words."""
    n, after = len(words), words[1:]
    lasts = Counter([w[-1] for w in words])
    ended = sum(k for c, k in lasts.items() if not c.isalnum() and c not in _PUNCTUATION)
    odd = [w for w in words if not w[-1].isalpha()]
    return {
        "words": n, "marks": _marks(text) / len(text), "ended": ended / n,
        "doubled": sum(len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum() for w in odd) / n,
        "upper": sum(map(str.isupper, words)) / n, "stuck": sum(map(operator.eq, words, after)) / n,
        "echo": 1 - len(set(zip(words, after))) / max(n - 1, 1) if n > 1 else 0.0,
        "stops": (lasts["."] + lasts["!"] + lasts["?"]) / n, "pipes": words.count("|") / n,
        "letters": (n - len(odd) + sum(w[0].isalpha() for w in odd)) / n,
    }


def _natural(m: dict[str, float]) -> bool:
    return m["ended"] < 0.05 and m["doubled"] < 0.05 and m["upper"] < 0.15 and m["stuck"] < 0.05 and m["pipes"] < 0.02 and m["letters"] > 0.8 and m["echo"] < 0.4


#: name: (vote, when); a labeller votes one way or abstains.
LABELLERS = {
    "symbol_ends": (-1, lambda m: m["ended"] >= 0.2),
    "doubled_marks": (-1, lambda m: m["doubled"] >= 0.2),
    "many_marks": (-1, lambda m: m["marks"] >= 0.12 and m["words"] >= 10),
    "capitals": (-1, lambda m: m["upper"] >= 0.4 and m["words"] >= 10),
    "pipes": (-1, lambda m: m["pipes"] >= 0.1),
    "cells": (-1, lambda m: m["letters"] < 0.65 and m["words"] >= 10),
    "stutter": (-1, lambda m: m["stuck"] >= 0.2 and m["words"] >= 10),
    "echo": (-1, lambda m: m["echo"] >= 0.6 and m["words"] >= 20),
    # the second implies the first; with one voter for good alone the estimation can't tell it from a wrong one
    "natural": (1, _natural),
    "sentences": (1, lambda m: _natural(m) and 0.01 <= m["stops"] <= 0.34),
}


def votes(words: list[str], text: str) -> str:
    """One of ``+``, ``-`` and ``0`` for each labeller; empty without a word."""
    if not words:
        return ""
    measures = measure(words, text)
    return "".join(("-+"[vote > 0] if when(measures) else "0") for vote, when in LABELLERS.values())


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of good by pattern, accuracies, share of good).

    A labeller that votes is right with its accuracy; abstaining says nothing.  Accuracies have the prior
    Beta(9, 3) and the share of good documents Beta(2, 2), as if 8 of 10 votes had been right and 1 of 2 documents good.
    """
    accuracy, prior = np.full(patterns.shape[1], 0.8), 0.5
    good = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = patterns @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior))
        new = np.where(odds > 0, 1 / (1 + np.exp(-np.abs(odds))), np.exp(-np.abs(odds)) / (1 + np.exp(-np.abs(odds))))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
        right = np.where(patterns > 0, good[:, None], np.where(patterns < 0, 1 - good[:, None], 0.0))
        voted = (patterns != 0) * counts[:, None]
        accuracy = ((right * counts[:, None]).sum(axis=0) + 8) / (voted.sum(axis=0) + 10)
        prior = float((good @ counts + 1) / (counts.sum() + 2))
    return good, accuracy, prior


class HashedLinear:
    """Logistic regression over hashed words and word shapes, weighted by presence share."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits = bits
        self.weights = np.zeros(1 << bits)
        self.bias = 0.0

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values (L2 norm 1) of a whole text: of its words, their shapes, and how often it says them again."""
        known: Hashes = held("quality", "words", Hashes)
        counted = Counter(words)
        n = len(counted)
        both = np.fromiter(map(known.__getitem__, counted), np.uint64, n)
        known.shrink()
        counts = np.fromiter(counted.values(), np.int64, n)
        again = Counter(min(k, 64).bit_length() for k in counts[counts > 1].tolist())
        hashes = np.concatenate([both >> np.uint64(32), both, np.array([_AGAIN[k] for k in again], np.uint64)])
        amounts = np.concatenate([counts, counts, np.fromiter(again.values(), np.int64, len(again))])
        cols, back = np.unique((hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64), return_inverse=True)
        values = np.sqrt(np.bincount(back, amounts, len(cols)))
        return cols, values / max(np.linalg.norm(values), 1e-12)

    def fit(self, texts: list[str], target: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-5) -> HashedLinear:
        rows = [self.features((t or "").split()) for t in texts]
        order = np.random.default_rng(7)
        grads = np.full(len(self.weights), 1e-8)
        for _ in range(rounds):
            for i in order.permutation(len(rows)):
                cols, values = rows[i]
                error = 1 / (1 + np.exp(-(self.weights[cols] @ values + self.bias))) - target[i]
                g = error * values + decay * self.weights[cols]
                grads[cols] += g * g
                self.weights[cols] -= rate * g / np.sqrt(grads[cols])
                self.bias -= 0.02 * error
        return self

    def score(self, words: list[str]) -> float:
        cols, values = self.features(words)
        return float(1 / (1 + np.exp(-(self.weights[cols] @ values + self.bias))))


class Kinds(dict):
    """The kind of a character: A, a, 0, or itself."""

    def __missing__(self, c: str) -> str:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if len(self) < 10_000:
            self[c] = kind
        return kind


class Hashes(dict):
    """Hashes of a word's shape (upper half: kinds of the first, middle and last two characters) and of the word in lower case."""

    KEEP, LONG = 200_000, 64

    def __init__(self) -> None:
        self.kinds = Kinds()
        self.long: list[str] = []

    def __missing__(self, w: str) -> int:
        k = self.kinds
        shape = xxhash.xxh32_intdigest(f"s={k[w[0]]}{k[w[len(w) // 2]]}{k[w[-2:][0]]}{k[w[-1]]}")
        self[w] = both = shape << 32 | xxhash.xxh32_intdigest("w=" + w.lower())
        if len(w) > self.LONG:
            self.long.append(w)
        return both

    def shrink(self) -> None:
        """Long words go, and beyond ``KEEP`` the newest, which are the rare ones."""
        for w in self.long:
            del self[w]
        self.long.clear()
        if len(self) > self.KEEP:
            kept = list(itertools.islice(self.items(), self.KEEP * 3 // 4))
            self.clear()
            self.update(kept)


_AGAIN = {k: xxhash.xxh32_intdigest(f"n={k}") for k in range(1, 8)}
_FEATURES = "doc_id {id}, votes string"


def label(rows: DataFrame) -> DataFrame:
    """doc_id, h, votes of each row (doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [votes((t or "").split(), t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["doc_id", "votes"])

    return rows.select("doc_id", "text").mapInArrow(run, _FEATURES.format(id=kind))


Model = tuple[dict[str, float], HashedLinear | None]


def train(rows: DataFrame, sample: int = 1000, bits: int = BITS) -> Model:
    """Posteriors by vote pattern, and the scorer, from all rows (doc_id, text)."""
    counted = label(rows).groupBy("votes").count().where("votes <> ''").collect()  # at most 2 ** labellers rows
    table: dict[str, float] = {}
    if counted:
        patterns = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in counted])
        good, _, _ = estimate(patterns, np.array([r["count"] for r in counted], float))
        table = {r["votes"]: float(g) for r, g in zip(counted, good)}
    return table, _train(rows, table, {r["votes"]: r["count"] for r in counted}, sample, bits)


def judge(model: Model, text: str | None) -> tuple[str, float, float, bool]:
    """(votes, posterior, score, keep) of a text."""
    words = (text or "").split()
    if not words:
        return "", 0.0, 0.0, False
    table, scorer = model
    pattern = votes(words, text)
    posterior = table.get(pattern, 0.5)
    score = posterior if scorer is None else scorer.score(words)
    return pattern, posterior, score, posterior >= 0.5 or score >= 0.5


def classify(docs: DataFrame, sample: int = 1000, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, posterior, score, keep of every document."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, sample, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            out = [judge(sent.value, t) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "votes", "posterior", "score", "keep"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, votes string, posterior double, score double, keep boolean")


def filter_quality(docs: DataFrame, sample: int = 1000, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) that are kept, decided in the pass that reads them."""
    sent = docs.sparkSession.sparkContext.broadcast(train(pick(docs, doc_id=id_col, text=text_col), sample, bits))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            yield batch.filter(pa.array([judge(sent.value, t)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _train(rows: DataFrame, table: dict[str, float], counts: dict[str, int], sample: int, bits: int) -> HashedLinear | None:
    """The scorer, from about ``sample`` texts of each posterior label."""
    have = [sum(n for v, n in counts.items() if (table[v] >= 0.5) == side) for side in (False, True)]
    if not all(have):
        return None
    span = 1 << 20
    limits = [min(span, int(1.5 * span * sample / n) + 1) for n in have]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("quality")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or not text.strip():
                    continue
                place = xxhash.xxh64_intdigest(text.encode()) % span
                if place >= max(limits):
                    continue
                posterior = table.get(votes(text.split(), text), 0.5)
                if place < limits[posterior >= 0.5]:
                    yield pa.RecordBatch.from_pydict({"place": [place], "good": [posterior], "text": [text]})

    got = rows.select("text").mapInArrow(run, "place long, good double, text string")
    distinct = got.groupBy("place", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.min("good").alias("good"))
    found = sorted((r["place"], r["h"], r["text"], r["good"]) for r in distinct.collect())
    chosen = [r for side in (False, True) for r in [x for x in found if (x[3] >= 0.5) == side][:sample]]
    if len({r[3] >= 0.5 for r in chosen}) < 2:
        return None
    return HashedLinear(bits).fit([r[2] for r in chosen], np.array([r[3] for r in chosen]))
