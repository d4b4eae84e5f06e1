"""Operator 5: exact Jaccard self-join of word-shingle sets by universe partitioning.

Two sets with Jaccard similarity t or more, of sizes up to u, differ in at most
H = (1-t)/(1+t) * 2u elements.  For each band of sizes the universe of shingles is hashed
into segments; each segment has capacity 1 (its subset is indexed) or 2 (its subset and all its
one-deletion neighbours are).  With capacities of more than H together, similar sets
share an index key (pigeonhole).  A cost model picks the numbers of both kinds and spare capacity for each band.

A set of a band indexes only its last segments, of capacity D + 1 plus the spare one, where D is the
most by which it can differ from any set of the band that it links with.  Of two sets' ranges one
holds the other, and their difference is no more than either D, so the shorter range is enough.

Spare capacity lets a set leave out keys: its empty segments, the deletion in one-element
segments (which matches empty ones), and segments with keys that many sets have (boilerplate), while
their capacity together is no more than the spare one.  What is left of any range still has more than
its D, and a key that counts as frequent does so for either set, so no pair is lost.

1. Equal sets are one class; only one set of each class goes on.
2. Keys are counted in rounds, a range of keys each.  Keys of few sets give all their pairs.  Keys of many give each set's pairs with the
   key's hub, the member that shares most keys.  Pairs are verified exactly on the sets.
3. Components of these links; then, within the frequent keys, every member outside of
   the hub's component is held against all members of other components.  Pairs inside a
   component need no check: they can link nothing new.

Every join of pairs has the exact bounds of ``_may_link`` in its condition: sizes, and a parity sketch,
whose differing bits are never more than the elements in which two sets differ.  So a pair that the
bounds rule out is never emitted.  Of large sets, which fill that sketch, the pairs left are held against wider
ones before any set is sent anywhere; the others are verified.

The result is exact up to collisions of 64-bit hashes of shingles and 128-bit prints of sets: the components of all links.  Nothing is capped.

Nulls: null, empty and blank texts have no shingles (size 0) and are a component each.  Fewer words
than a shingle make one shingle.  Null ids are ignored in a component's least id (null if all are).
Repeated rows and ids keep a row each.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, identified, materialise, pick, remove, scratch
from .components import connected_components

#: Words whose hashes a task keeps; then it starts afresh.
KNOWN_WORDS = 100_000
#: Pairs of sets that a task holds at once.
PAIRS_AT_ONCE = 128
#: Keys of more sets than this count as frequent.
FREQUENT = 16
#: Tables of a few numbers a row (keys, ids, pairs) are broadcast up to this many rows, counted first; larger ones are joined.
BROADCAST_ROWS = 1_000_000
#: The same for rows that hold a file's name.
BROADCAST_NAMES = 100_000
#: What a set with more empty segments than its spare capacity costs, in keys a segment: it meets all others of that kind.
UNFIT = 300
#: What a segment of a single element costs, in keys: its key is shared by more sets that don't link.
SHORT = 5
#: Words of a set's parity sketch: of 512 bits each tells whether an odd number of elements fall on it.
SKETCH = [f"s{i}" for i in range(8)]
#: Larger sets than this get a sketch of their own size too, of a bit an element or two.
LARGE = 1_000
#: Ranges of keys that are indexed one after another, so that a part of the index lies in shuffle files at a time.  The index is written
#: with a column for each range, so every key is read once.
ROUNDS = 4
_ROUND_ENDS = np.array([k * (1 << 64) // ROUNDS for k in range(1, ROUNDS)], np.uint64)
#: The bits of a key that hold its segment's number.
_SEGMENT = np.uint64(0xFFFF)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * _P2
    x = (x ^ (x >> np.uint64(32))) * _P2
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        h, n = np.concatenate([h, np.full(width - len(h), len(h), np.uint64)]), 1
    out = h[:n]
    for k in range(1, width):
        out = mix(out) * _P1 + h[k : k + n]
    return np.unique(mix(out))


def difference(total: int, percent: int) -> int:
    """The largest symmetric difference of sets with ``total`` elements together that link."""
    return (100 - percent) * total // (100 + percent)


@functools.lru_cache(None)
def bands(most: int = 1 << 40) -> tuple[int, ...]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return tuple(out)


@functools.lru_cache(None)
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """(segments of capacity 2, segments in all, spare capacity) of a band; all 0 if only equal sets link."""
    low, high = bands()[band], bands()[band + 1] - 1
    h = difference(2 * high, percent)
    if h == 0:
        return 0, 0, 0
    least = max(1, low * percent // 100)
    best = None
    for part in (0.0, 0.25, 0.5, 1.0):  # of the capacity, by segments of capacity 2
        for spare in sorted({round(h * f) + k for f in (0, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5) for k in (0, 1, 2, 3, 5, 8)}):
            need = h + 1 + spare
            twos = math.ceil(need * part / 2)
            m = twos + max(0, need - 2 * twos)
            size = least / m
            left_out = math.exp(-size) * (m - twos + twos * (2 + size))
            unfit = 0.5 * math.erfc((spare + 0.5 - left_out) / math.sqrt(2 * left_out + 1e-9))
            written = (m - twos) + twos * (1 + low * 1.2 / m)
            short = m * math.exp(-1.5 * size) + twos * size * math.exp(-1.5 * max(0.0, size - 1))  # a neighbour has an element less
            # what short subsets cost in pairs that don't link, and sets whose empty segments must be written
            cost = written + SHORT * short + UNFIT * m * unfit
            if best is None or cost < best[0]:
                best = cost, twos, m, spare
    return best[1:]


def first_segment(n: int, band: int, percent: int) -> int:
    """Where the range of segments starts that a set of ``n`` elements indexes in a band."""
    twos, m, spare = allocation(band, percent)
    largest = min(bands()[band + 1] - 1, n * 100 // percent)
    need = difference(n + largest, percent) + 1 + spare
    ones = m - twos
    return m - need if need <= ones else max(0, twos - -(-(need - ones) // 2))


def keys_of(elements: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """Index keys of a set in a band, each with the last 16 bits of its segment's number at its end, and what spare capacity is left (-1: none).

    Equal keys are of equal segments anyway, so the number takes no place from the 48 bits of hash that tell a segment's subsets apart.
    """
    twos, m, spare = allocation(band, percent)
    if not m:
        return np.empty(0, np.uint64), 0
    start = first_segment(len(elements), band, percent)
    inner = mix(elements + np.uint64((band + 1) * int(_P1) & (1 << 64) - 1))
    segment = ((inner >> np.uint64(40)) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, inner)
    held = np.bincount(segment, minlength=m)
    left = spare - int((held[start:] == 0).sum() + (held[start:twos] < 2).sum())
    which = np.flatnonzero(held[start:]) + start if left >= 0 else np.arange(start, m)
    values = sums[which]
    if start < twos:
        in_two = (segment >= start) & (segment < twos)
        if left >= 0:
            in_two &= held[segment] > 1
        which = np.concatenate([which, segment[in_two]])
        values = np.concatenate([values, sums[segment[in_two]] - inner[in_two]])
    which = which.astype(np.uint64)
    names = mix(np.uint64(band << 32) + which)
    return (mix(values + names) & ~_SEGMENT) | (which & _SEGMENT), max(left, -1)


def signatures(elements: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(note, keys) of a set for its band and every further one whose sets may link with it.

    A note packs spare capacity left (9 bits) and band (6 bits); a note and the segment of a key are its tag.  With more segments
    than 16 bits tell apart nothing is left out, and more spare capacity than 9 bits hold isn't used; both keep the result.
    """
    n = len(elements)
    if not n:
        return []
    out = []
    for b in range(int(np.searchsorted(bands(), n, "right")) - 1, int(np.searchsorted(bands(), n * 100 // percent, "right"))):
        keys, left = keys_of(elements, b, percent)
        room = min(left + 1, 511) if allocation(b, percent)[1] <= 1 << 16 else 0
        out.append((b << 9 | room, np.sort(keys)))
    return out


def _by_round(found: list[list[tuple[int, np.ndarray]]]) -> list[pa.Array]:
    """The notes and keys of some sets, a column for each round's range of keys."""
    flat = [pair for pairs in found for pair in pairs]
    starts = np.cumsum([0, *map(len, found)]).astype(np.int32)
    cuts = [np.searchsorted(keys, _ROUND_ENDS).tolist() for _, keys in flat]
    notes = pa.array([note for note, _ in flat], pa.int32())
    columns = []
    for r in range(ROUNDS):
        parts = [keys[(cut[r - 1] if r else 0) : (cut[r] if r + 1 < ROUNDS else len(keys))] for (_, keys), cut in zip(flat, cuts)]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        keys = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))
        columns.append(pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([notes, keys], fields=list(_BAND))))
    return columns


def sketch(elements: np.ndarray) -> np.ndarray:
    """The parity of the number of elements on each of 512 bits, as 8 words."""
    odd = np.bincount((elements >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def wide_sketch(elements: np.ndarray) -> bytes | None:
    """The parity of the number of elements on each of as many bits as a large set has elements, or up to twice that."""
    if len(elements) <= LARGE:
        return None
    bits = (len(elements) - 1).bit_length()
    odd = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def too_far(x: pa.Buffer, y: pa.Buffer, total: int, percent: int) -> bool:
    """Whether wide sketches rule out that sets of ``total`` elements together link; the larger is folded to the smaller one's bits."""
    p, q = sorted((np.unpackbits(np.frombuffer(b, np.uint8)) for b in (x, y)), key=len)
    if len(q) > len(p):
        q = q.reshape(len(p), -1).sum(axis=1) & 1
    return int(np.count_nonzero(p != q)) * (100 + percent) > (100 - percent) * total


PLACE = ["row_file", "row_place"]
_BAND = pa.struct([("note", pa.int32()), ("keys", pa.list_(pa.int64()))])
_BASE = pa.schema(
    [
        ("doc_id", pa.int64()), *zip(PLACE, (pa.string(), pa.int64())), ("n", pa.int64()), ("print", pa.binary()),
        *[(f"bands{r}", pa.list_(_BAND)) for r in range(ROUNDS)], ("wide", pa.binary()), *[(s, pa.int64()) for s in SKETCH],
    ]
)


def _words() -> Words:
    """The worker's hashes by word, afresh when there are many."""
    known: Words = held("jaccard", "words", Words)
    if len(known) > KNOWN_WORDS:
        known.clear()
    return known


def _base(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, str]:
    """rid, doc_id, place, n, print (of the set, 128 bits), notes and keys by band, sketch words of every row (doc_id, place, text); and their folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                known = _words()
                ns, prints, keys, wide, sketches = [], [], [], [], []
                for text in batch.column(3).to_pylist():
                    elements = shingles(text, width, known)
                    ns.append(len(elements))
                    prints.append(xxhash.xxh128_digest(elements.tobytes()) if len(elements) else None)
                    keys.append(signatures(elements, percent))
                    wide.append(wide_sketch(elements))
                    sketches.append(sketch(elements))
                columns = (*batch.columns[:3], ns, prints, *_by_round(keys), wide, *np.array(sketches).reshape(-1, len(SKETCH)).T)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _BASE)], schema=_BASE)

    kinds = "doc_id long, row_file string, row_place long, n long, print binary, "
    kinds += "".join(f"bands{r} array<struct<note:int,keys:array<long>>>, " for r in range(ROUNDS)) + "wide binary, "
    found = rows.select("doc_id", *PLACE, "text").mapInArrow(run, kinds + ", ".join(f"{s} long" for s in SKETCH))
    path = scratch(rows.sparkSession, "shingle-keys")
    found = found.select(F.monotonically_increasing_id().alias("rid"), "*")
    found.write.parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path), path


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rid, elements of the wanted (rid, place), read from their texts once more."""
    texts = rows.join(_small(materialise(wanted, "wanted"), BROADCAST_NAMES), PLACE).select("rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                known = _words()
                out = [shingles(text, width, known).astype("<u8").tobytes() for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rid", "elements"])

    return materialise(texts.mapInArrow(run, "rid long, elements binary"), "shingle-sets", 256)


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast a table that was counted and is small enough."""
    return F.broadcast(df) if df.count() <= most else df


def _open_pairs(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the wide sketches of large sets don't rule out; these are a small part of the sets' own size."""
    wide = base.where("wide is not null")
    side = lambda c: wide.select(F.col("rid").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "a_n", "b_n", "a_wide", "b_wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                not (x.is_valid and y.is_valid and too_far(x.as_buffer(), y.as_buffer(), m.as_py() + n.as_py(), percent))
                for m, n, x, y in zip(*batch.columns[2:])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return materialise(joined.mapInArrow(run, "a long, b long"), "open-pairs", 512)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    one = _small(pairs).join(sets.select(F.col("rid").alias("a"), F.col("elements").alias("x")), "a")
    two = one.join(sets.select(F.col("rid").alias("b"), F.col("elements").alias("y")), "b")
    return materialise(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified", PAIRS_AT_ONCE)


def _sized(table: DataFrame, name: str, *more: str) -> DataFrame:
    """rid as ``name``, and n, the sketch and ``more`` with the name before theirs."""
    return table.select(F.col("rid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *SKETCH, *more)])


def _may_link(percent: int) -> Column:
    """Whether sizes and sketches of a and b leave it open that they link; a bound, which loses no link."""
    a, b = F.col("a_n"), F.col("b_n")
    apart = functools.reduce(operator.add, [F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH])
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (apart * (100 + percent) <= (100 - percent) * (a + b))


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs of the members (key, rid) of each key; for keys of few members."""
    of_key = members.groupBy("key").agg(F.array_sort(F.collect_set("rid")).alias("all")).where("size(all) > 1")
    firsts = of_key.select("all", F.posexplode("all").alias("at", "a"))
    return firsts.select("a", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("b"))


def _members(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that have one of these keys.

    Many keys are joined behind a filter, so that few of the other rows are shuffled: a bit for 26 bits of a key's
    hash, in a table of at most 2^20 words, which is broadcast whatever the number of keys.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), "key")
    word, bit = "shiftrightunsigned(xxhash64(key), 44)", "cast(shiftrightunsigned(xxhash64(key), 38) & 63 as int)"
    marks = materialise(keys.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("mask")), "key-marks")
    few = rows.withColumn("word", F.expr(word)).join(F.broadcast(marks), "word").where(f"shiftrightunsigned(mask, {bit}) & 1 = 1")
    return few.drop("word", "mask").join(keys, "key")


def _candidates(base: DataFrame, copies: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs to verify, members (key, rid, hub) of frequent keys that remain).

    Keys are counted first: nearly all are of one set, and a key and its count are the least that tells.  Sets' numbers are
    read with the keys that remain.
    """
    one_each = base.join(_small(copies), "rid", "left_anti")  # a set of each class
    parts = []
    for r in range(ROUNDS):
        rows = one_each.select("rid", F.explode(f"bands{r}").alias("band")).select("rid", F.col("band.note").alias("note"), F.explode("band.keys").alias("key"))
        rows = rows.select("key", F.shiftleft("note", 16).bitwiseOR(F.col("key").bitwiseAND(int(_SEGMENT)).cast("int")).alias("tag"), "rid")
        # one-deletion keys repeat within a set only by chance; counting them twice does no harm
        counts = materialise(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key-counts")
        parts.append(materialise(_members(rows, counts), "key-members"))
    members = functools.reduce(DataFrame.unionAll, parts)
    few = members.where(F.col("c") <= FREQUENT).select("key", "rid")
    many = members.where(F.col("c") > FREQUENT)
    if many.isEmpty():
        return _pairs(few).distinct(), None
    # a set leaves out its frequent segments while their capacity fits into what is left of the spare one
    band, left, segment = F.shiftright("tag", 25), F.shiftright("tag", 16).bitwiseAND(0x1FF) - 1, F.col("tag").bitwiseAND(0xFFFF)
    capacity = F.when(segment < _twos(percent, band), 2).otherwise(1)
    frequent = many.select("rid", band.alias("band"), left.alias("room"), segment.alias("segment"), capacity.alias("capacity")).distinct()
    stay = frequent.groupBy("rid", "band").agg(F.sum("capacity").alias("used"), F.max("room").alias("room")).where("used > room").select("rid", "band")
    many = many.withColumn("band", band).join(stay, ["rid", "band"], "left_semi").select("key", "rid")
    again = many.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    many = materialise(many.join(again, "key"), "frequent-members")
    few = few.unionAll(many.where(F.col("c") <= FREQUENT).select("key", "rid"))
    many = many.where(F.col("c") > FREQUENT)
    weight = many.groupBy("rid").agg(F.sum("c").alias("weight"))
    hubs = many.join(weight, "rid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rid")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("hub"))
    many = materialise(many.select("key", "rid").join(hubs, "key"), "hub-members")
    shared = many.where("rid <> hub").groupBy("rid", "hub").count()
    first = shared.groupBy("rid").agg(F.max(F.struct("count", "hub")).alias("top")).select(F.least("rid", "top.hub").alias("a"), F.greatest("rid", "top.hub").alias("b"))
    return _pairs(few).unionAll(first).distinct(), many


def _twos(percent: int, band):
    """The number of capacity-2 segments of a band, as a column."""
    out = F.lit(0)
    for b in range(len(bands()) - 1):
        if (n := allocation(b, percent)[0]) > 0:
            out = F.when(band == b, n).otherwise(out)
    return out


def _grouped(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, place, text): rid, doc_id, place, n, print of each; and print, root, least of each class of equal sets."""
    keyed, folder = _base(rows, width, percent)
    base = materialise(keyed.select("rid", "doc_id", *PLACE, "n", "print", "wide", *SKETCH), "prints")
    full = base.where("n > 0")
    classes = materialise(full.groupBy("print").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *SKETCH)]), "classes")
    copies = full.join(classes.select("print", F.col("rid").alias("first")), "print").where("rid <> first").select("rid")
    pairs, many = _candidates(keyed, materialise(copies, "copies"), percent)
    pairs = materialise(pairs.join(_sized(classes, "a"), "a").join(_sized(classes, "b"), "b").where(_may_link(percent)).select("a", "b"), "pairs")
    remove(rows.sparkSession, folder)  # the keys have done their work
    pairs = _open_pairs(pairs, base, percent)
    named = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
    if many is not None:
        named = named.unionAll(many.select("rid"))
    sets = _sets(rows, base.select("rid", *PLACE).join(named.distinct(), "rid", "left_semi"), width)
    links = _verify(pairs, sets, percent)
    roots = connected_components(links)
    if many is not None:
        more = _verify(_open_pairs(_crossing(many, roots, classes, percent).join(pairs, ["a", "b"], "left_anti"), base, percent), sets, percent)
        if not more.isEmpty():
            roots = connected_components(links.unionAll(more))
    labelled = classes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    return base, materialise(labelled.select("print", "root", "least"), "labelled")


def _crossing(many: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within frequent keys, of different components, that sizes and sketches leave open.

    What stands outside of the hub's component meets every other component of its keys.  Members meet
    by key and size step: sets that link are at most a step apart, so a key's members are dealt out by size.
    """
    roots = materialise(roots, "roots")
    of = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
    own = many.join(of("rid", "root"), "rid", "left").join(of("hub", "hub_root"), "hub", "left")
    own = own.select("key", "rid", F.coalesce("root", "rid").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
    own = own.join(classes.select("rid", "n", *SKETCH), "rid").withColumn("step", F.floor(F.log(F.col("n")) / -math.log(percent / 101)).cast("int"))
    own = materialise(own, "rooted")
    outside = own.where("root <> hub_root").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    outside = _sized(outside, "a", "key", "root", "step")
    other = _sized(own, "b", "key", "root", "hub_root", "step")
    cross = outside.join(other, F.expr("a_key = b_key and a_step = b_step and a_root <> b_root and (b_root = b_hub_root or a < b)") & _may_link(percent))
    return cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, place of documents."""
    rows, place = identified(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "text", *[F.col(c).alias(to) for c, to in zip(place, PLACE)])


def similar_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    base, labelled = _grouped(_rows(docs, id_col, text_col), width, percent)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(least, "root").select("print", "component_id")
    linked = base.where("n > 0").select("doc_id", "n", "print").join(by_print, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document (all its columns) of each component: that of the least id, nulls last; of equal ids any one, the same in every run.

    Rows count, not ids: of rows that share an id each stays or goes by its own text.  Texts without words stay.
    """
    named, place = identified(docs)
    rows = pick(named, doc_id=id_col, text=text_col, row_file=place[0], row_place=place[1]).withColumn("doc_id", F.col("doc_id").cast("long"))
    base, labelled = _grouped(rows, width, percent)
    full = base.where("n > 0")
    first = full.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    kept = first.join(labelled, "print").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    gone = materialise(full.join(kept, "rid", "left_anti").select(*[F.col(c).alias(to) for c, to in zip(PLACE, place)]), "duplicates")
    return named.join(_small(gone, BROADCAST_NAMES), place, "left_anti").drop(*place)
