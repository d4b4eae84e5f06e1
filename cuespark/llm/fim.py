"""Operator 12: the fill-in-middle transformation, by overlapping chunks.

A text's units are tokens: white space and the word behind it, or white space at the end.  A unit ends where a word's
character stands before white space, so two neighbouring characters tell.  Texts are cut into chunks
of a fixed number of characters, each with its predecessor's last character in front, and the
chunks' boundaries are counted independently of each other.  Sums of the counts give the number of units, and the
chunk that owns each of the two cuts; only these two chunks are cut into units again.

All of it is column expressions over one row, so nothing is shuffled and each task holds a text at a time;
chunks bound what the matching of patterns holds.  The document is split at two places into prefix,
middle and suffix, which are written in one of three forms with markers; a column expression
restores the text from output and form.

Nulls: a null text is empty (no units, plain).  A null id is hashed as no digits.  Texts that hold a marker stay plain, so every
output can be restored.  Each row counts by itself, repeated ones too.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
#: Characters of a chunk.
CHUNK = 4096


def chunks(text: Column, size: int = CHUNK) -> Column:
    """The text in pieces of ``size`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def overlapping(pieces: Column, k: Column) -> Column:
    """Piece k after the last character of the one before."""
    return F.concat(F.when(k > 0, F.substring(F.get(pieces, k - 1), -1, 1)).otherwise(F.lit("")), F.get(pieces, k))


def _owner(counts: Column, rank: Column) -> Column:
    """(k, before): the chunk in which the boundary of a rank (from 1) lies, and how many boundaries are before that chunk."""

    def step(state: Column, count: Column) -> Column:
        passed = state["sum"] + count
        return F.struct(
            passed.alias("sum"),
            F.when(passed < rank, state["k"] + 1).otherwise(state["k"]).alias("k"),
            F.when(passed < rank, passed).otherwise(state["before"]).alias("before"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("before"))
    return F.aggregate(counts, zero, step)


def _place(piece: Column, k: Column, rank: Column, size: int) -> Column:
    """Where the boundary of a rank within an overlapping chunk lies in the text."""
    units = F.slice(F.regexp_extract_all(piece, F.lit(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"), F.lit(0)), 1, rank.cast("int"))
    inside = F.aggregate(F.transform(units, F.length), F.lit(0), lambda a, b: a + b)
    return F.when(k > 0, k * size - 1).otherwise(0) + inside


def _hashes(key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a text."""
    digits = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output of every row.

    Cuts, and whether and how a text is transformed, come from a hash of seed and id: of 100 texts ``rate`` are, and of
    these ``spm_rate`` of 100 with the suffix first.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("pieces", chunks(F.col("text"), chunk)).withColumn("h", F.array(*_hashes(key)))
    ends = lambda c, k: F.regexp_count(overlapping(F.col("pieces"), k), F.lit(f"[^{SPACE}][{SPACE}]")).cast("long")
    rows = rows.withColumn("counts", F.transform("pieces", ends))
    some = F.when(F.col("text") == "", 0).otherwise(1)
    rows = rows.withColumn("n", (F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b) + some).cast("long"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm"))
    u, v = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    rows = rows.withColumn("ranks", F.array(F.least(u, v), F.greatest(u, v)))
    for name, i in (("first", 0), ("second", 1)):
        rank = F.col("ranks")[i]
        rows = rows.withColumn(name, F.when((F.col("form") != "plain") & (rank > 0) & (rank < F.col("n")), _owner(F.col("counts"), rank)))
    for name, i in (("first", 0), ("second", 1)):
        rank, k = F.col("ranks")[i], F.col(f"{name}.k")
        found = _place(overlapping(F.col("pieces"), k), k, rank - F.col(f"{name}.before"), chunk)
        rows = rows.withColumn(f"{name}_at", F.when(rank == 0, 0).when(rank == F.col("n"), F.length("text")).otherwise(found))
    whole = F.col("form") == "plain"
    rows = rows.select(
        "doc_id", "text", "n", "form",
        F.when(~whole, F.substring("text", 1, F.col("first_at"))).alias("prefix"),
        F.when(~whole, F.substring("text", F.col("first_at") + 1, F.col("second_at") - F.col("first_at"))).alias("middle"),
        F.when(~whole, F.substring("text", F.col("second_at") + 1, F.length("text"))).alias("suffix"),
    )
    put = lambda *parts: F.concat(*[x for mark, name in parts for x in (F.lit(mark), F.col(name))])
    psm, spm = put((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")), put((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle"))
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from a transformed one; no marker can arise where a part meets a marker, as markers begin and end with signs of their own."""
    parts = F.split(output, "<[PSM]>", -1)
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(back)


def fim_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
