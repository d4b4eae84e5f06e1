"""Operator 3: language identification by string kernels.

Kernel: two texts share as many character n-grams, of 1 to ``order`` letters, as occur in both
(presence, not counts: the blended spectrum); divided by the root of both texts' own
numbers of n-grams.  The n-gram universe is that of the landmark texts.

Training takes a bounded sample of labelled texts (``sample_per_class``, by text hash; each
text once).  Some of it are landmarks; Nystroem features are K(x, landmarks) K_mm^(-1/2), and
one-versus-rest kernel ridge regression is a ridge solution over them.  A text's score is
the share of the best class among the clipped regression outputs.

Prediction reads whole texts in batches: a 0/1 matrix of documents by n-grams times the
landmark matrix gives the kernel, and two more products the outputs.  The model is
bounded (landmarks times n-grams) and is broadcast.

Nulls: null texts and texts without a letter are ``und`` with score 1.  Rows with null language, text or id take no part
in training; with no training rows at all every text is ``und`` with score 0.  Equal outputs go to the
alphabetically first language; each row is decided by itself.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room, pick

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: Size of the n-gram lookup table (a power of two) per n-gram kept.
_SPREAD = 8


def letters(text: str | None) -> str:
    """Lower-case letters; all else between them is one blank.  Empty without any letter."""
    clean = _OTHER.sub(" ", text or "").strip().lower()
    return f" {clean} " if any(map(str.isalpha, clean)) else ""


def grams(clean: str, order: int) -> np.ndarray:
    """Codes of all n-grams of 1 to ``order`` (at most 3) characters, one to one."""
    c = np.frombuffer(clean.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    parts = [c]
    for n in range(2, order + 1):
        if len(c) >= n:
            parts.append(parts[n - 2][:-1] | c[n - 1 :] << np.uint64(21 * (n - 1)))
    return np.concatenate(parts)


class Universe:
    """The n-grams of the landmarks, found by a hash table of their codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.sort(codes)
        self.bits = max(8, int(len(codes) * _SPREAD).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        # a slot takes its least code; the others of the slot are looked up by bisection
        self.table[self.slot(self.codes[::-1])] = np.arange(len(codes))[::-1]
        self.shared = np.zeros(1 << self.bits, bool)
        slots, n = np.unique(self.slot(self.codes), return_counts=True)
        self.shared[slots[n > 1]] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Columns of those codes that are in the universe."""
        slot = self.slot(codes)
        at = self.table[slot]
        good = (at >= 0) & (self.codes[at] == codes)
        odd = self.shared[slot] & ~good
        found = at[good]
        if odd.any():
            more = codes[odd]
            near = np.minimum(np.searchsorted(self.codes, more), len(self.codes) - 1)
            found = np.concatenate([found, near[self.codes[near] == more]])
        return found


@dataclass
class Model:
    """Landmark n-grams, their presence (landmarks x n-grams) and the classes' weights."""

    order: int
    classes: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def ready(self) -> tuple[Universe, np.ndarray, np.ndarray]:
        if self._ready is None:
            dense = self.landmarks.T.astype(np.float32)
            self._ready = Universe(self.codes), dense, np.sqrt(np.maximum(dense.sum(axis=0), 1))
        return self._ready

    def kernel(self, clean: list[str]) -> np.ndarray:
        universe, dense, norms = self.ready()
        x = np.zeros((len(clean), len(self.codes)), np.float32)
        for i, text in enumerate(clean):
            x[i, universe.find(grams(text, self.order))] = 1
        own = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ dense) / own[:, None] / norms

    def outputs(self, texts: list[str | None]) -> np.ndarray:
        """Each text's largest regression output: 1 is a class's own text, -1 another's; -inf without letters or classes."""
        out = np.full(len(texts), -np.inf)
        clean = {i: c for i, t in enumerate(texts) if (c := letters(t))}
        if clean and self.classes:
            out[list(clean)] = (self.kernel(list(clean.values())).astype(np.float64) @ self.weights).max(axis=1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [letters(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [1.0 if self.classes or not t else 0.0 for t in clean]
        known = [i for i, t in enumerate(clean) if t]
        if known and self.classes:
            raw = self.kernel([clean[i] for i in known]).astype(np.float64) @ self.weights
            share = np.clip((raw + 1) / 2, 0, 1)
            total = share.sum(axis=1)
            for i, row, s, t in zip(known, raw, share, total):
                k = int(np.argmax(row))
                langs[i], scores[i] = self.classes[k], float(s[k] / t) if t else 0.0
        return langs, scores


def fit(samples: list[tuple[str, str]], order: int = 3, landmarks_per_class: int = 64, ridge: float = 1e-3) -> Model:
    """Nystroem kernel ridge regression of (text, language) pairs."""
    rows = [(c, lang) for text, lang in samples if (c := letters(text))]
    classes = sorted({lang for _, lang in rows})
    if not classes:
        return Model(order, [], np.empty(0, np.uint64), np.empty((0, 0), np.uint8), np.empty((0, 0)))
    chosen: list[str] = []
    for c in classes:
        chosen += [t for t, lang in rows if lang == c][:landmarks_per_class]
    sets = [np.unique(grams(t, order)) for t in chosen]
    codes = np.unique(np.concatenate(sets))
    presence = np.zeros((len(chosen), len(codes)), np.uint8)
    for i, s in enumerate(sets):
        presence[i, np.searchsorted(codes, s)] = 1
    model = Model(order, classes, codes, presence, np.empty((0, 0)))
    kernel = np.concatenate([model.kernel([t for t, _ in rows[i : i + 64]]) for i in range(0, len(rows), 64)]).astype(np.float64)
    middle = model.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.array([[1.0 if lang == c else -1.0 for c in classes] for _, lang in rows])
    balance = 1 / np.array([np.mean([other == lang for _, other in rows]) for lang in classes])
    weight = np.array([balance[classes.index(lang)] for _, lang in rows])
    left = features.T @ (features * weight[:, None]) + ridge * len(rows) * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(left, features.T @ (target * weight[:, None]))
    return model


def training_sample(docs: DataFrame, learn: Column, sample_per_class: int) -> list[tuple[str, str]]:
    """Up to about ``sample_per_class`` distinct texts of each language, chosen by their hash."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 20
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(span, int(1.2 * span * sample_per_class / max(n, 1)) + 1)))])
    few = rows.where(F.pmod("h", F.lit(span)) < F.element_at(limit, F.col("lang")))
    got = few.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out = []
    for lang in sorted(counts):
        of = sorted((r["h"] % span, r["h"], r["text"]) for r in got if r["lang"] == lang)
        out += [(text, lang) for *_, text in of[:sample_per_class]]
    return out


def identify(
    docs: DataFrame,
    learn: Column | None = None,
    sample_per_class: int = 400,
    landmarks_per_class: int = 64,
    order: int = 3,
    ridge: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang_pred, score of every document; learns where ``learn`` (on doc_id) holds."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    samples = training_sample(rows, F.lit(True) if learn is None else learn, sample_per_class)
    model = docs.sparkSession.sparkContext.broadcast(fit(samples, order, landmarks_per_class, ridge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language")
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                langs, scores = model.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    learn = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return identify(docs, learn).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def filter_languages(docs: DataFrame, least_output: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **parameters) -> DataFrame:
    """The documents (all columns) whose best language has a regression output of at least ``least_output``.

    The score, a share among the classes, would be large for some class on any text, the more so the fewer they are.
    Learns from all labelled documents.  Rows are decided in the pass that reads them: no join.
    """
    defaults = {"sample_per_class": 400, "landmarks_per_class": 64, "order": 3, "ridge": 1e-3} | parameters
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    samples = training_sample(rows, F.col("doc_id").isNotNull(), defaults.pop("sample_per_class"))
    model = docs.sparkSession.sparkContext.broadcast(fit(samples, **defaults))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language")
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                yield batch.filter(pa.array(model.value.outputs(batch.column(at).to_pylist()) >= least_output, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
