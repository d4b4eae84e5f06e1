"""Operator 10: benchmark decontamination with a distributed positional inverted index.

The documents are dealt into index shards of some megabytes.  A shard's row holds, for
every term, its posting list: the sorted positions in the shard, with a gap between
documents.  The index is a Parquet table in the shared folder; nothing is shuffled.

Matching a window of test terms in a shard takes the posting lists in ascending order of
length: the rarest list, less the term's offset, gives the candidate starts, and each
further list, less its offset, is intersected with them.  A window with a term that
the shard lacks costs one lookup.

Test items of up to ``block_chars`` characters are matched as one block, and the index
keeps their vocabulary alone (both bounded by that size).  More items are matched block by block against an
index of all terms, and the blocks' hits are united.

Nulls: a null text has no words; items without words or with a null id match nothing.  Items of one id
count once.  An empty benchmark gives every document no hits; empty documents give no rows.
Repeated documents keep a row each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import identified, make_room, materialise, pick

#: ASCII bytes that end a word: all but digits, small letters and what isn't ASCII.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_BREAK = bytes(b if b in _KEEP else 0x20 for b in range(256))
GAP = 64
#: Texts that are sent to Python at once.
BATCH_ROWS = 512
#: Contaminated rows are broadcast up to this number, counted first; more are joined.
BROADCAST_ROWS = 100_000
INDEX = "doc_ids array<{id}>, n_words array<int>, terms binary, ends binary, positions binary"


def words(text: str | None) -> list[bytes]:
    """Lower-case words (UTF-8) of digits, letters and all beyond ASCII."""
    return (text or "").encode().lower().translate(_BREAK).split()


def term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Known(dict):
    """Terms by word; grows by what it is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = t = term(word)
        return t


def shard_row(doc_ids: list, texts: list[str | None], vocabulary: dict[bytes, int] | None) -> tuple:
    """The positional index of some documents."""
    lengths, parts, at, bases = [], [], 0, []
    known = Known() if vocabulary is None else vocabulary
    look = known.__getitem__ if vocabulary is None else known.get
    for text in texts:
        found = words(text)
        lengths.append(len(found))
        bases.append(at)
        at += len(found) + GAP
        if vocabulary is None:
            parts.append(np.fromiter(map(look, found), np.uint64, len(found)))
        else:
            parts.append(np.array([look(w, 0) for w in found], np.uint64))
    every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    place = np.arange(len(every)) + np.repeat(np.array(bases) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    if vocabulary is not None:
        keep = every != 0
        every, place = every[keep], place[keep]
    order = np.argsort(every, kind="stable")
    terms, starts = np.unique(every[order], return_index=True)
    ends = np.append(starts[1:], len(every)) if len(terms) else starts
    return doc_ids, lengths, terms.astype("<u8").tobytes(), ends.astype("<u4").tobytes(), place[order].astype("<u4").tobytes()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int] | None, shard_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard, with a stable name, written to the shared folder."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("decontamination")
        ids, texts, size = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    size += len(t or "")
                    if size >= shard_chars:
                        yield pack(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield pack(ids, texts)

    arrow = to_arrow_type(rows.schema["doc_id"].dataType)

    def pack(ids: list, texts: list) -> pa.RecordBatch:
        row = shard_row(ids, texts, vocabulary)
        kinds = [pa.list_(arrow), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        names = ["doc_ids", "n_words", "terms", "ends", "positions"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    index = rows.mapInArrow(run, INDEX.format(id=kind)).select(F.monotonically_increasing_id().alias("shard"), "*")
    return materialise(index, "positions", BATCH_ROWS)


class Shard:
    """Posting lists of an index row."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes) -> None:
        self.terms = np.frombuffer(terms, "<u8")
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends

    def rows_of(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this shard, -1 where it lacks it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, row: int) -> np.ndarray:
        return self.positions[self.starts[row] : self.ends[row]]

    def phrase(self, rows: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase, by offset-adjusted lists from the rarest on."""
        sizes = self.ends[rows] - self.starts[rows]
        order = np.argsort(sizes, kind="stable")
        starts = self.postings(rows[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            have = self.postings(rows[k])
            at = np.minimum(np.searchsorted(have, starts + k), len(have) - 1)
            starts = starts[have[at] == starts + k]
        return starts[starts >= 0]

    def near(self, rows: np.ndarray, span: int, bases: np.ndarray) -> list[tuple[int, int]]:
        """(first, last) positions of the least ranges of up to ``span`` words with all terms, in any order.

        ``bases`` are the documents' first positions; no range leaves its document, however long the span.
        """
        rows = np.unique(rows)
        rarest = self.postings(rows[np.argmin(self.ends[rows] - self.starts[rows])])
        lists = []
        for r in rows:  # nothing farther than the span from the rarest term can take part
            have = self.postings(r)
            low, high = np.searchsorted(rarest, have - span, "right"), np.searchsorted(rarest, have + span, "left")
            lists.append(have[low < high])
        place = np.concatenate(lists)
        what = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        order = np.argsort(place, kind="stable")
        owner = np.searchsorted(bases, place[order], "right")
        last: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        now = -1
        for p, t, o in zip(place[order].tolist(), what[order].tolist(), owner.tolist()):
            if o != now:
                last.clear()
                now = o
            last[t] = p
            if len(last) == len(rows) and p - (first := min(last.values())) < span:
                if found and found[-1][0] == first:
                    continue
                found.append((first, p))
        return found


def windows(items: list[tuple[str, str | None]], size: int) -> dict[int, list[tuple[str, np.ndarray]]]:
    """By length: (item id, terms) of every window; an item of fewer words is one window."""
    out: dict[int, list[tuple[str, np.ndarray]]] = {}
    known = Known()
    for item, text in items:
        terms = np.array([known[w] for w in words(text)], np.uint64)
        if len(terms):
            n = min(size, len(terms))
            out.setdefault(n, []).extend((item, terms[k : k + n]) for k in range(len(terms) - n + 1))
    return out


def match_block(index: DataFrame, items: list[tuple[str, str | None]], size: int = 10, slop: int | None = None) -> DataFrame:
    """shard, row, doc_id, n_words, hit (word positions), items of every document.

    With ``slop`` the windows match as sets of words within their length plus ``slop`` words, in any order.
    """
    by_length = {n: ([i for i, _ in w], np.array([t for _, t in w], np.uint64)) for n, w in windows(items, size).items()}
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("decontamination")
        for batch in batches:
            for row in batch.to_pylist():
                yield one(row)

    def one(row: dict) -> pa.RecordBatch:
        shard = Shard(row["terms"], row["ends"], row["positions"])
        lengths = np.array(row["n_words"], np.int64)
        bases = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]])
        mark = np.zeros(int((lengths + GAP).sum()), bool)
        items_of: dict[int, set[str]] = {}
        for n, (names, terms) in by_length.items():
            places = shard.rows_of(terms)
            for w in np.flatnonzero((places >= 0).all(axis=1)):
                if slop is None:
                    ranges = [(int(s), int(s) + n) for s in shard.phrase(places[w])]
                else:
                    ranges = [(a, b + 1) for a, b in shard.near(places[w], n + slop, bases)]
                for a, b in ranges:
                    mark[a:b] = True
                    items_of.setdefault(int(np.searchsorted(bases, a, "right")) - 1, set()).add(names[w])
        hits = [np.flatnonzero(mark[b : b + n]).astype(np.int32) if k in items_of else [] for k, (b, n) in enumerate(zip(bases, lengths))]
        n = len(lengths)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                pa.array(row["doc_ids"], batch_type), pa.array(row["n_words"], pa.int64()),
                pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(items_of.get(k, ())) for k in range(n)], pa.list_(pa.string())),
            ],
            ["shard", "row", "doc_id", "n_words", "hit", "items"],
        )

    batch_type = to_arrow_type(index.schema["doc_ids"].dataType.elementType)
    return index.mapInArrow(run, f"shard long, row int, doc_id {kind}, n_words long, hit array<int>, items array<string>")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    slop: int | None = None,
    block_chars: int = 16_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """shard, row, doc_id, n_words, hit, items of every document over the whole benchmark."""
    tests = pick(benchmark, item=item_col, text=item_text_col).where("item is not null and text is not null")
    tests = tests.select(F.col("item").cast("string").alias("item"), "text")
    chars = tests.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    if chars <= block_chars:
        items = [(r["item"], r["text"]) for r in tests.collect()]
        vocabulary = {w: term(w) for _, text in items for w in words(text)}
        return match_block(build_index(docs, vocabulary, id_col=id_col, text_col=text_col), items, size, slop)
    index = build_index(docs, None, id_col=id_col, text_col=text_col)
    blocks = -(-chars // (block_chars // 2))
    found = None
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        one = match_block(index, [(r["item"], r["text"]) for r in part.collect()], size, slop)
        found = one if found is None else found.unionAll(one)
    return found.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return find_contamination(docs, benchmark, size).select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def filter_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """The documents (all columns) that hold no window of the benchmark.

    Rows are told apart by their place, so of rows that share an id, or have none, each is kept or dropped by its own text.
    """
    named, place = identified(docs)
    rows = pick(named, file=place[0], place=place[1], text=text_col).select(F.struct("file", "place").alias("row"), "text")
    hit = find_contamination(rows, benchmark, size, id_col="row").where("size(hit) > 0")
    hit = materialise(hit.select(F.col("doc_id.file").alias(place[0]), F.col("doc_id.place").alias(place[1])), "contaminated")
    return named.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, place, "left_anti").drop(*place)
