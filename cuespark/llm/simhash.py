"""Operator 13: near duplicates by SimHash fingerprints, found by deletion-variant signatures.

A fingerprint has 64 bits: bit b is set if it is set in more than half of the hashes of the text's shingles.

Fingerprints that differ in two bits or fewer have at most one differing bit in one of their two halves (plain
pigeonholes would take three segments, and equal ones).  Each distinct fingerprint is indexed under the variants of its
halves in which one bit is a wildcard: halves that differ in one bit at most are equal in some variant.  Rows that
share a variant are joined by equality and verified on all 64 bits.  A pair counts in the first variant
that it shares only, so each link comes once.

Keys of two fingerprints give their pair from the index' counts (least and largest); keys of a few more are joined.  Fingerprints of frequent
keys are linked another way, without pairs of a group: each is laid under itself and its 64
neighbours of one differing bit.  Two share such a key if and only if they differ in two bits or fewer,
and a key has 65 members at most, whatever the data; each is linked with the least of them.

Rows are held by fingerprint first: a class of equal fingerprints, however large, is one row of the index.  Nothing is capped.

Nulls: null, empty and blank texts have no shingles and the fingerprint zero, which links like any other.  Null ids
are ignored in a component's least id (null if all are).  Repeated rows and ids keep a row each.  Texts of any length are read
whole, some shingles at a time.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_room, materialise, pick
from .components import connected_components
from .jaccard import _members as rows_of_keys

SEED = 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15
#: Keys of more fingerprints than this count as frequent.
FREQUENT = 16
#: The most differing bits of a link; halves and wildcards are made for this number.
DISTANCE = 2


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased; zero if it has no words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[width - 1 :] or [len(joined) + 1]
    votes, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(ends), AT_ONCE):
        hashes = np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE])), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("simhash")
        for batch in batches:
            found = pa.array([fingerprint(text.as_py(), width) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _half(fp: str, side: str) -> str:
    return f"(shiftrightunsigned({fp}, 32 * ({side})) & 4294967295L)"


def variants(fps: DataFrame) -> DataFrame:
    """key, fp of the 64 one-wildcard variants of each fingerprint: of half v / 32 without bit v % 32."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    rest = f"({_half('fp', 'v div 32')} & ~shiftleft(1L, v % 32))"
    return rows.select(F.expr(f"shiftleft(cast(v as long), 32) | {rest}").alias("key"), "fp")


def _links(key: str, a: str, b: str) -> Column:
    """Whether two fingerprints that share a key link, and share no earlier key."""
    low, high = (f"bit_count({_half(a, s)} ^ {_half(b, s)})" for s in ("0", "1"))
    v = f"shiftrightunsigned({key}, 32)"
    bit = f"shiftleft(1L, cast({v} % 32 as int))"
    here = f"({_half(a, f'cast({v} div 32 as int)')} ^ {_half(b, f'cast({v} div 32 as int)')})"
    first_variant = f"({here} = {bit} or ({here} = 0 and {v} % 32 = 0))"
    return F.expr(f"{a} < {b} and {low} + {high} <= {DISTANCE} and {first_variant} and ({v} < 32 or {low} > 1)")


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints (fp) that differ in two bits or fewer."""
    keyed = variants(fps)
    counts = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("c > 1")
    counts = materialise(counts, "variant-counts")
    twos = counts.where("c = 2").where(_links("key", "a", "b")).select("a", "b")
    shared = counts.where("c > 2").select("key", "c")
    if shared.isEmpty():
        return twos
    members = materialise(rows_of_keys(keyed, shared), "variant-members")
    few, many = members.where(F.col("c") <= FREQUENT), members.where(F.col("c") > FREQUENT)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where(_links("key", "a", "b")).select("a", "b")
    return twos.unionAll(pairs).unionAll(neighbour_links(many.select("fp").distinct()))


def neighbour_links(fps: DataFrame) -> DataFrame:
    """The same links' components by keys of whole fingerprints with one bit flipped or none: 65 members a key at most."""
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v")).select(F.expr("fp ^ if(v = 64, 0L, shiftleft(1L, v))").alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.collect_list("fp").alias("all")).where("a < b")
    return shared.select("a", F.explode("all").alias("b")).where("a < b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least id that links lead to) of every row."""
    rows = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints", 1_000)
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = connected_components(close_links(classes.select("fp")))
    labelled = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = materialise(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
