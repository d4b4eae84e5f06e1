"""Operator 2: SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Texts are normalised by the library and cut into marked words (blank marks and what follows
them; no piece of the vocabulary crosses into the next word's mark, which is checked).  The distinct words of a
batch are sorted, which lays them out as a trie in depth-first order: each word starts from
the forward states of the prefix that it shares with the one before and adds the rest.

A forward state of a prefix is its best way in: the last piece and where it starts.  For
unigram models the score is the sum of the pieces' scores.  The scores of BPE models are merge
ranks, whose sum isn't what the library maximises, and additive Viterbi gives wrong ids.
There a way is valid if every two neighbouring pieces are what the merges make of the two together;
each prefix has exactly one valid way, so the state is that one, and the ids equal the library's.

Characters that no piece covers become byte pieces where the model has them, else the unknown id.
User-defined pieces are cut out first and stand by themselves.

Nulls: a null text is encoded as empty (no ids).  Texts of any length are encoded whole.  Each
row is encoded by itself, so repeated rows and empty tables need no rule.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import held, pick, shrink

MARK = "▁"
#: Bytes of text that are encoded at once, or one text: what a task holds besides caches is some tens of times this.
PART = 1 << 18
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in the protocol-buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram (the default), 2 BPE."""
    for number, value in _fields(proto):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), 1)
    return 1


def piece_kinds(proto: bytes) -> list[int]:
    """The type of each piece of a serialised model: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
    return [next((v for n, v in _fields(value) if n == 3), 1) for number, value in _fields(proto) if number == 1]


class PrefixViterbi:
    """Encodes sorted words, reusing forward states along common prefixes.

    An automaton over the pieces' letters tells which pieces end at a letter.  Its
    state depends on the prefix alone, as the forward state does, so both are kept on one stack.
    """

    #: Distinct words that a worker keeps (longer ones aren't), twice as many pairs of pieces, and half as many steps besides the pieces' own.
    KEEP, LONG = 100_000, 64

    def __init__(self, path: str | None = None, pieces: dict[str, tuple[int, float]] | None = None, additive: bool = True, unknown: int = 0) -> None:
        self.unknown, self.additive = unknown, additive
        self.bytes_of: list[int] | None = None
        self.processor = None
        self.fixed: dict[str, bytes] = {}
        if path is not None:
            import sentencepiece

            m = self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
            proto = m.serialized_model_proto()
            kinds = piece_kinds(proto)
            pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i, kind in enumerate(kinds) if kind == 1}
            self.fixed = {m.id_to_piece(i): np.array([i], "<u4").tobytes() for i, kind in enumerate(kinds) if kind == 4}
            self.additive = model_type(proto) == 1
            self.unknown = m.unk_id()
            if m.is_byte(m.piece_to_id("<0x00>")):
                self.bytes_of = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a word's mark")
        self.pieces = pieces
        self.apart = re.compile(f"({'|'.join(map(re.escape, sorted(self.fixed, key=len, reverse=True)))})") if self.fixed else None
        self.names = list(pieces)
        self.places = {p: k for k, p in enumerate(self.names)}
        self.ids = [pieces[p][0] for p in self.names]
        self.scores = [pieces[p][1] for p in self.names]
        self.penalty = min(self.scores, default=0.0) - 10.0
        self._automaton()
        if not self.additive:
            self._merges()
        self.fits: dict[int, bool] = {}
        #: words of late, and those before, of which the ones that come up again move over
        self.cache: dict[str, bytes] = dict(self.fixed)
        self.older: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """Nodes are the prefixes of pieces; ``fall`` leads to the longest proper suffix that is one."""
        steps: list[dict[str, int]] = [{}]
        own = [-1]
        order, depth = [0], [0]
        for name, k in self.places.items():
            node = 0
            for c in name:
                at = steps[node].get(c)
                if at is None:
                    at = steps[node][c] = len(steps)
                    steps.append({})
                    own.append(-1)
                    depth.append(depth[node] + 1)
                node = at
            own[node] = k
        fall = [0] * len(steps)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(steps)  # (length, place) of the pieces that end at a node, longest first; for merges shortest first
        for node in order:
            for c, at in steps[node].items():
                order.append(at)
                back = fall[node]
                while back and c not in steps[back]:
                    back = fall[back]
                if node:
                    fall[at] = steps[back].get(c, 0)
                mine = ((depth[at], own[at]),) if own[at] >= 0 else ()
                self.ending[at] = mine + self.ending[fall[at]] if self.additive else self.ending[fall[at]] + mine
        self.steps, self.fall, self.more = steps, fall, 0

    def _go(self, node: int, c: str) -> int:
        """Where letter c leads, remembered at the node while there is room; a letter of no piece leads to the root."""
        path = []
        at = self.steps[node].get(c)
        while at is None and node:
            path.append(node)
            node = self.fall[node]
            at = self.steps[node].get(c)
        at = at or 0
        if self.more < self.KEEP // 2 and c in self.steps[0]:
            self.more += len(path)
            for k in path:
                self.steps[k][c] = at
        return at

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.pieces.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got[1] > best):
                    best, at = got[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merges(self) -> None:
        """Rank of each piece's merge (-1: a single letter), and its two halves, found when asked for."""
        long = [k for k, p in enumerate(self.names) if len(p) > 1]
        order = {score: r for r, score in enumerate(sorted({self.scores[k] for k in long}, reverse=True))}
        self.rank = [-1] * len(self.names)
        for k in long:
            self.rank[k] = order[self.scores[k]]
        self.halves: list[tuple[int, int] | None | bool] = [None] * len(self.names)

    def _halves(self, k: int) -> tuple[int, int] | bool:
        """The two pieces that the last merge of piece k joins; False if merges never make it (True for a letter)."""
        if self.halves[k] is None:
            name = self.names[k]
            if len(name) == 1:
                self.halves[k] = True
            elif self.merged(name) != [name]:
                self.halves[k] = False
            else:  # of the ways to halve it into what merges make, the one whose halves stay apart before this merge
                parts = list(name)
                while len(parts) > 2:
                    found = [(-self.rank[j], -i) for i in range(len(parts) - 1) if (j := self.places.get(parts[i] + parts[i + 1])) is not None]
                    i = -max(found)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self.halves[k] = (self.places.get(parts[0], -1), self.places.get(parts[1], -1))
        return self.halves[k]

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges of left and right together give these two (or right alone, at a word's start: left -1).

        Merges inside of either run in order of rank; walking both trees along the border from the roots,
        a merge across it comes first if its rank is below the merges that use up the pieces beside it.
        """
        if not self._halves(right):
            return False
        if left < 0:
            return True
        names, rank, places = self.names, self.rank, self.places
        limit, a, b = len(names), left, right
        while True:
            across = places.get(names[a] + names[b])
            if across is not None and rank[across] < limit:
                return False
            if rank[a] > rank[b]:
                limit, half = rank[a], self._halves(a)
                a = half[1]
            elif rank[b] >= 0:
                limit, half = rank[b] + 1, self._halves(b)
                b = half[0]
            else:
                return True
            if half[0] < 0 or half[1] < 0 or max(rank[half[0]], rank[half[1]]) >= limit:  # not a vocabulary in order of merges
                return self.merged(names[left] + names[right]) == [names[left], names[right]]

    def words(self, ordered: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words."""
        steps, ending, go, fits, fit = self.steps, self.ending, self._go, self.fits, self.fit
        additive, scores, penalty, n = self.additive, self.scores, self.penalty, len(self.names)
        # of each prefix: node, start and place (-1: a letter that no piece covers) of the last piece, score
        nodes, starts, places, totals = [0], [0], [-1], [0.0]
        before = ""
        for word in ordered:
            same, size = 0, len(word)
            most = min(len(before), size)
            while same < most and before[same] == word[same]:
                same += 1
            if size >= len(nodes):
                for states in (nodes, starts, places, totals):
                    states += [0] * (2 * size)
            node = nodes[same]
            for end in range(same + 1, size + 1):
                c = word[end - 1]
                at = steps[node].get(c)
                node = nodes[end] = go(node, c) if at is None else at
                ends = ending[node]
                if additive:
                    best, start, place = None, end - 1, -1
                    for length, k in ends:
                        score = totals[end - length] + scores[k]
                        if best is None or score > best:
                            best, start, place = score, end - length, k
                    if not ends or ends[-1][0] > 1:
                        score = totals[end - 1] + penalty
                        if best is None or score > best:
                            best, start, place = score, end - 1, -1
                    starts[end], places[end], totals[end] = start, place, best
                    continue
                starts[end], places[end] = end - 1, -1
                for length, k in ends:
                    left = places[end - length]
                    key = (left + 1) * n + k
                    good = fits.get(key)
                    if good is None:
                        good = fits[key] = fit(left, k)
                    if good:
                        starts[end], places[end] = end - length, k
                        break
                else:
                    if ends and ends[0][0] == 1:
                        raise ValueError(f"no way to encode {word!r}")
            yield self._ids(word, starts, places)
            before = word
            if len(fits) > 2 * self.KEEP:
                shrink(fits, 2 * self.KEEP)

    def _ids(self, word: str, starts: list[int], places: list[int]) -> list[int]:
        ids, out, at = self.ids, [], len(word)
        while at:
            k = places[at]
            if k >= 0:
                out.append(ids[k])
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in reversed(word[at - 1].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # the library joins neighbouring unknown characters
            at = starts[at]
        out.reverse()
        return out

    def cut(self, text: str) -> list[str]:
        """Marked words of a normalised text; user-defined pieces stand by themselves."""
        if self.apart is None:
            return _MARKED.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.apart.split(text)):
            out += [part] if k % 2 else _MARKED.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        cache = self.cache
        split = [self.cut(self.processor.normalize(t)) if t else [] for t in texts]
        wanted = {w for ws in split for w in ws}.difference(cache)
        again = wanted & self.older.keys()
        cache.update((w, self.older[w]) for w in again)
        new = sorted(wanted - again)
        for word, ids in zip(new, self.words(new)):
            cache[word] = array("I", ids).tobytes()
        out = [b"".join(map(cache.__getitem__, ws)) for ws in split]
        for word in new:
            if len(word) > self.LONG:
                del cache[word]
        if len(cache) > self.KEEP // 2:
            shrink(cache, self.KEEP)
            self.cache, self.older = dict(self.fixed), cache
        return out


class Decoder:
    """Ids to text: marks become blanks, byte pieces their bytes, the leading blank goes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.parts: list[bytes] = []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.parts.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i):
                self.parts.append(b"")
            elif m.is_unknown(i):
                self.parts.append(" ⁇ ".encode())
            else:
                self.parts.append(piece.replace(MARK, " ").encode())
        self.dummy = m.normalize("a").startswith(MARK)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.parts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) in parts of about ``PART`` bytes of text, but whole rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        starts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(starts):
            if end > start:
                yield batch.slice(start, end - start)


def ready(kind: type, path: str):
    """One encoder and decoder for each Python worker."""
    return held("sentencepiece", f"{kind.__name__} {path}", lambda: kind(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [np.frombuffer(b, "<i4") for b in ready(PrefixViterbi, model_path).encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text of every row; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts = [None if not x.is_valid else ready(Decoder, model_path).decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = pick(encoded, doc_id=id_col, ids=ids_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text (decoded) of every document, in one pass of one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, back = [], []
            for data in ready(PrefixViterbi, model_path).encode([t or "" for t in batch.column(1).to_pylist()]):
                ids.append(np.frombuffer(data, "<i4"))
                back.append(ready(Decoder, model_path).decode(ids[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "text"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_crc32 (of the decoded text), restored, of every document.

    ``restored`` says whether decoding gave the text again (null counts as empty); a text
    with the mark character itself comes back with a blank in its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, data in zip(texts, ready(PrefixViterbi, model_path).encode(texts)):
                back = ready(Decoder, model_path).decode(np.frombuffer(data, "<u4"))
                rows.append((len(data) // 4, zlib.crc32(data), zlib.crc32(back.encode()), back == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "restored"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, text_crc32 long, restored boolean")
