"""Operator 6: token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by id, encoded, and written as one file a partition, in
ascending order over all files.  A file is

    magic, blocks, footer, footer length (u64), magic

A block holds up to ``BLOCK`` ids as differences from the block's minimum, packed at the
width that the chosen percentile of them needs; wider ones keep their low bits there and
their value in an exception list (position, difference).  The footer holds the block
starts, the document ids and their token counts, so a reader seeks to any document.

Nulls: null text is encoded as empty, which leaves its end id alone; a null document id
sorts first.  Repeated ids keep a place each.  An empty table writes no file.
Texts of any length are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, held, materialise, pick, scratch

MAGIC = b"PFRI0001"
BLOCK = 4096
#: count, minimum, width, number of exceptions
HEAD = struct.Struct("<IIBI")


def pack_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """One block: header, packed low bits, exception positions, exception differences."""
    low = int(ids.min())
    diff = (ids - low).astype(np.uint32)
    place = math.ceil(percentile / 100 * (len(ids) - 1))
    edge = int(np.partition(diff, place)[place])
    width = edge.bit_length()
    odd = np.flatnonzero(diff >> width) if width < 32 else np.empty(0, np.int64)
    if width:
        bits = np.unpackbits(diff.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    return HEAD.pack(len(ids), low, width, len(odd)) + packed + odd.astype("<u2").tobytes() + diff[odd].astype("<u4").tobytes()


def unpack_block(data: bytes | memoryview, at: int = 0) -> np.ndarray:
    n, low, width, odd = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits
        diff = np.packbits(wide.ravel(), bitorder="little").view("<u4").astype(np.uint32)
    else:
        diff = np.zeros(n, np.uint32)
    at += size
    if odd:
        diff[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return diff + np.uint32(low)


class TokenFileWriter:
    """Streams documents into one file; at most a block of ids waits in memory."""

    def __init__(self, sink, percentile: float) -> None:
        self.sink, self.percentile = sink, percentile
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        self.at = sink.write(MAGIC)
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            block = pack_block(ids[i : min(i + BLOCK, end)], self.percentile)
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.wait, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> int:
        self.flush(True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        footer = zlib.compress(
            struct.pack("<QQ", len(self.docs), len(self.starts))
            + np.array(self.starts, "<u8").tobytes()
            + known.tobytes()
            + np.array([d or 0 for d in self.docs], "<i8").tobytes()
            + np.array(self.counts, "<u8").tobytes(),
            1,
        )
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return int(sum(self.counts))


class TokenFileReader:
    """Reads documents in order, or any of them by the block index."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<Q", tail[:8])
        self.end = size - 16 - length
        source.seek(self.end)
        raw = zlib.decompress(source.read(length))
        n, blocks = struct.unpack_from("<QQ", raw)
        at = 16
        self.starts = np.frombuffer(raw, "<u8", blocks, at)
        at += 8 * blocks
        known = np.frombuffer(raw, np.uint8, n, at)
        at += n
        self.docs = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n, at), known)]
        self.counts = np.frombuffer(raw, "<u8", n, at + 8 * n).astype(np.int64)

    def blocks(self, first: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
        for b in range(first, len(self.starts) if stop is None else stop):
            end = int(self.starts[b + 1]) if b + 1 < len(self.starts) else self.end
            self.source.seek(int(self.starts[b]))
            yield unpack_block(self.source.read(end - int(self.starts[b])))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the file, ids) of every document."""
        blocks, have, at = self.blocks(), np.empty(0, np.uint32), 0
        for doc, n in zip(self.docs, self.counts):
            parts = [have]
            size = len(have)
            while size < n:
                parts.append(next(blocks))
                size += len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc, at, have[:n]
            have, at = have[n:], at + int(n)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document; reads its blocks alone."""
        start = int(self.counts[:k].sum())
        stop = start + int(self.counts[k])
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = np.concatenate([np.empty(0, np.uint32), *self.blocks(first, last)])
        return ids[start - first * BLOCK : stop - first * BLOCK]


# Fixed values of byte-level BPE: the pattern of its pieces, and the bytes that stand for themselves.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Marks that are one piece, any number of them, between a letter and a word's end.
MARKS = string.punctuation


class Pieces(dict):
    """Ids by piece, from the BPE model."""

    def __init__(self, tokenize: Callable[[str], list]) -> None:
        self.tokenize = tokenize
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in PLAIN else next(rest)) for b in range(256)}

    def __missing__(self, text: str) -> bytes:
        self[text] = ids = self.encode(text)
        return ids

    def encode(self, text: str) -> bytes:
        letters = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()


class Words(dict):
    """Ids by word, each with a blank in front; none for what isn't a word: empty, or with white space at its end.

    Words with marks behind them, and two that a line's end joins, are put together from their parts and not kept.
    """

    def __init__(self, pieces: Pieces, special: list[str], whole: Callable[[str], bytes]) -> None:
        import regex

        self.pieces, self.whole = pieces, whole
        self.cut = regex.compile(PIECE).findall
        #: letters beyond Latin, and special tokens
        self.strange = re.compile("|".join(["[\u0250-\U0010ffff]", *map(re.escape, special)])).search
        #: no special token is within letters with marks behind them
        self.plain = not any(stem == "" or stem.isalpha() for stem in (t.rstrip(MARKS) for t in special))

    def __missing__(self, text: str) -> bytes:
        stem = text.rstrip(MARKS)
        if stem.isalpha() and self.plain and (text.isascii() or not self.strange(text)):
            if len(stem) < len(text):
                return self[stem] + self.pieces[text[len(stem) :]]
            ids = self.pieces.encode(" " + text)  # a blank and letters are one piece
        elif text == "" or text[-1].isspace():
            ids = b""
        elif self.strange(text):
            ids = self.whole(" " + text)
        else:
            before, line, after = text.partition("\n")
            if line and before and not before[-1].isspace() and not after[0].isspace():
                return self[before] + self.pieces[line] + self.start(after)
            ids = self.cut_up(" " + text)
        self[text] = ids
        return ids

    def start(self, text: str) -> bytes:
        """Ids of a word without a blank in front."""
        stem = text.rstrip(MARKS)
        if stem.isalpha():
            return self.pieces[stem] + self.pieces[text[len(stem) :]] if len(stem) < len(text) else self.pieces[text]
        return self.cut_up(text)

    def cut_up(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


class CachedEncoder:
    """The tokenizers library's ids, with each distinct word and piece looked up once for many texts.

    The byte-level pre-tokenizer ends a piece before every blank that no white space
    precedes, so the words between such blanks, each with its blank in front, are encoded
    on their own without any change of the ids.  Arrow finds the distinct words of some megabytes
    of text.  New words of Latin letters are cut into pieces, and the library's BPE model encodes
    new pieces.  Other words, texts with white space before
    a blank, and texts of other kinds of tokenizers go to the library whole.
    """

    #: Words that a worker keeps, and a quarter as many pieces; longer ones than LONG go after their texts.
    KEEP, LONG = 600_000, 64

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, special = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens") or []]
        #: without these there are no short cuts
        self.short = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and spec.get("normalizer") is None and not any(c.isspace() for t in special for c in t)
        )
        self.pieces = Pieces(self.tokenizer.model.tokenize)
        self.words = Words(self.pieces, special, lambda text: self.ids([text])[0])

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        """Little-endian u32 ids of each text; each distinct word of all texts is looked up once."""
        if not len(texts):
            return []
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.short:
            return [np.frombuffer(ids, "<u4") for ids in self.ids(texts.to_pylist())]
        lists = pc.split_pattern(texts, " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        begins = offsets[:-1] - offsets[0]
        # a text's first word, which has no blank in front, is an entry of its own behind those of the others
        firsts = words.take(pa.array(begins)).to_pylist()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        later = np.ones(len(codes), bool)
        later[begins] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[later]] = True
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)[used].tolist()
        codes = (np.cumsum(used) - 1)[codes]
        codes[begins] = len(distinct) + np.arange(len(begins))

        sizes = [len(self.words), len(self.pieces)]
        entries = [*map(self.words.__getitem__, distinct), *self.ids(firsts)]
        for kept, size, most in zip((self.words, self.pieces), sizes, (self.KEEP, self.KEEP // 4)):
            for text in [t for t in itertools.islice(reversed(kept), len(kept) - size) if len(t) > self.LONG]:
                del kept[text]
            if len(kept) > most:  # the oldest stay, which hold the frequent ones
                for _ in range(len(kept) - most * 3 // 4):
                    kept.popitem()

        lengths = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        whole = lengths == 0
        whole[len(distinct) :] = [word[-1:].isspace() for word in firsts]
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        flat = np.frombuffer(b"".join(entries), "<u4")[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1])]
        out = np.split(flat, ends[begins[1:] - 1])
        for i in np.flatnonzero(np.logical_or.reduceat(whole[codes], begins)):
            out[i] = np.frombuffer(self.ids([texts[i].as_py()])[0], "<u4")
        return out


def parts(texts: pa.StringArray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """First row and stop of runs of texts, none null, that have ``most`` bytes and a text more at most."""
    ended = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(ended)) + 1).tolist(), len(texts)]
    return zip(cuts, cuts[1:])


def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker, which later tasks use again."""
    return held("token file", path, lambda: CachedEncoder(path))


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = 0,
    percentile: float = 90.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files and return their list: part, file, n_docs, n_tokens.

    The list holds a file of each successful task alone; what a lost or repeated task left
    behind is not in it.  It is written to the shared folder, so nothing is encoded twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, files = None, None
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.pfr"
        end = np.array([] if end_id is None else [end_id], "<u4")
        encode = encoder(tokenizer_path).encode
        sink = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if out is None and ids:
                files, path = filesystem(folder)
                files.create_dir(path, recursive=True)
                sink = files.open_output_stream(f"{path}/{name}", compression=None)
                out = TokenFileWriter(sink, percentile)
            texts = texts.fill_null("")
            for i, stop in parts(texts):
                for doc, got in zip(ids[i:stop], encode(texts.slice(i, stop - i))):
                    out.add(doc, np.concatenate([got, end]))
        if out is not None:
            n = out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "n_docs": [len(out.docs)], "n_tokens": [n]}, schema=_FILES
            )

    # the texts' hashes break ties of repeated ids, so these are dealt out too, in the same order in every run
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return materialise(ordered.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "token-files")


_FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (u32, little-endian)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    based = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['file']}") as source:
                    rows: list[tuple] = []
                    size = 0
                    for doc, at, ids in TokenFileReader(source):
                        rows.append((doc, row["base"] + at, len(ids), ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    parts = max(1, files.count())
    return based.repartitionByRange(parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch(spark, "tokens")
    read = read_tokens(write_tokens(docs, folder, tokenizer_path), folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
