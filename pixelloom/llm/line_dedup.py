"""Line dedup by content-defined chunks of lines.

A polynomial rolling hash runs over the hashes of WINDOW lines; a chunk ends after a line
where it is 0 modulo SPACING, or where the text ends. Boundaries depend on the lines
around them alone, so inserted or deleted lines shift chunks without changing the others.
Of each chunk of two lines or more that occurs several times in all documents, the first
occurrence stays (by doc_id, then the MD5 of the text, then position; nulls first) and the
others are removed. Occurrences are found by hashes and compared byte by byte.

Defined cases. Null text has no lines and stays null. An empty text is one empty line, and
a text of any length is one row. A chunk of one line is never removed. Occurrences inside
one document count. Rows that agree in id and text are one document: they give equal
results, and what is first in one is first in the other. Null ids come first. An empty
table gives an empty result. Columns of the input that are named like the operator's own
(n_lines, n_kept, n_removed) are replaced; all others go through, whatever their names.

Scale. All on the JVM, no Python. First only hashes of chunks are shuffled, combined
before. Which hashes occur again is then marked in a bitmap of MARKS bits, broadcast in
rows of 4 kB, a fixed size; a bit set by chance only lets a chunk through that the byte
comparison drops. Where more than one bit in FILLED would be set, hashes are joined by
shuffle instead. So only chunks that are repeated are shuffled with their
bytes, and grouped by them, combined before, so a passage in a third of all documents is
one row a task. Chunks that occur very often meet their first occurrence by broadcast (no
more than HOT_KEYS, of HOT_BYTES each), the others by shuffle at every size, since what
is repeated grows with the corpus. Documents that lose chunks are marked the same
way: only they are shuffled, by id and hash; all others go from the scan to the result.
Positions gathered in a row are those of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, LEAST_HOT, saved, scratch

WINDOW, SPACING = 3, 4
#: The rolling hash's modulus, a prime, and its base.
PRIME, BASE = 2147483647, 1000003
#: Bits of a bitmap, in rows of ROW bits as Spark's bitmap functions make them.
MARKS, ROW = 1 << 26, 1 << 15
#: Of so many bits one may be set.
FILLED = 8
#: Bytes of a chunk that is broadcast.
HOT_BYTES = 32 << 10


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % PRIME


def boundaries(hashes: Column, window: int, spacing: int) -> Column:
    """The numbers, from 1, of the lines that end a chunk."""

    def rolled(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(window):
            at = F.when(i > back, F.get(hashes, (i - 1 - back).cast("int"))).otherwise(F.lit(0).cast("long"))
            total = (total + at * pow(BASE, back, PRIME)) % PRIME
        return total

    n = F.size(hashes)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (rolled(i) % spacing == 0) | (i == n))


def with_chunks(texts: DataFrame, window: int, spacing: int) -> DataFrame:
    """Rows that have a text with chunk_lines (the lines) and chunk_ends."""
    lines = texts.withColumn("chunk_lines", lines_of(F.col("text")))
    hashed = lines.withColumn("chunk_hashes", F.transform("chunk_lines", line_hash))
    return hashed.withColumn("chunk_ends", boundaries(F.col("chunk_hashes"), window, spacing)).drop("chunk_hashes")


def chunk_list(without: Column | None = None) -> Column:
    """(pos, lines, chunk) of each chunk of a row, but for those at the places ``without``."""
    ends, lines = F.col("chunk_ends"), F.col("chunk_lines")

    def chunk(k: Column) -> Column:
        begin, end = F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0)), F.get(ends, k)
        return F.struct(k.alias("pos"), (end - begin).alias("lines"), F.array_join(F.slice(lines, begin + 1, end - begin), "\n").alias("chunk"))

    places = F.sequence(F.lit(0), F.size(ends) - 1)
    return F.transform(places if without is None else F.array_except(places, without), chunk)


def marking(rows: DataFrame, hashes: DataFrame, h: str, name: str) -> DataFrame:
    """Rows with ``marked``: whether the hash in column ``h`` is among ``hashes`` (column h), or, by a chance that their number bounds, seems so.

    A bitmap says so where the rows are, while the hashes fill no more than one bit in
    FILLED of it; more of them are joined by shuffle.
    """
    hashes = saved(hashes.select("h"), name)
    if hashes.count() <= MARKS // FILLED:
        return with_mark(rows, saved(bitmap_of(hashes), f"{name}-bits"), h)
    told = hashes.distinct().select(F.col("h").alias("mark_h"), F.lit(True).alias("mark_told")).hint("merge")
    return rows.join(told, F.col(h) == F.col("mark_h"), "left").withColumn("marked", F.coalesce("mark_told", F.lit(False))).drop("mark_h", "mark_told")


def bitmap_of(hashes: DataFrame) -> DataFrame:
    """mark_row, mark_bits: the bits that the hashes (column h) set; MARKS / ROW rows at most."""
    bit = F.pmod(F.col("h"), F.lit(MARKS))
    return hashes.groupBy(F.floor(bit / ROW).alias("mark_row")).agg(F.bitmap_construct_agg((bit % ROW).cast("long")).alias("mark_bits"))


def with_mark(rows: DataFrame, marks: DataFrame, h: str) -> DataFrame:
    """Rows with ``marked``: whether the bit of the hash in column ``h`` is set."""
    bit = F.pmod(F.col(h), F.lit(MARKS))
    at = rows.withColumn("mark_row", F.floor(bit / ROW)).join(F.broadcast(marks), "mark_row", "left")
    byte = F.conv(F.hex(F.substring(F.col("mark_bits"), F.floor(bit % ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (bit % 8).cast("int")) == 1
    return at.withColumn("marked", F.coalesce(set_, F.lit(False))).drop("mark_row", "mark_bits")


def gone_chunks(rows: DataFrame, window: int, spacing: int) -> DataFrame:
    """id, key (the text's MD5), gone (places) of documents that lose chunks."""
    texts = rows.filter("text is not null").select("id", "text", F.md5("text").alias("key"))
    pieces = with_chunks(texts, window, spacing).select("id", "key", F.explode(chunk_list()).alias("c")).filter("c.lines > 1")
    pieces = pieces.select("id", "key", "c.pos", "c.chunk", F.xxhash64("c.chunk").alias("h"))
    again = pieces.groupBy("h").count().filter("count > 1")
    same = saved(marking(pieces, again, "h", "chunks-again").filter("marked").drop("marked"), "chunks-same")
    place = F.struct("id", "key", "pos")
    first = saved(same.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "chunks-first")
    many = max(LEAST_HOT, same.count() / HOT_KEYS)
    hot = F.broadcast(first.filter((F.col("n") > many) & (F.octet_length("chunk") <= HOT_BYTES)))
    rest = same.join(hot, ["h", "chunk"], "left_anti").join(first.hint("merge"), ["h", "chunk"])
    later = same.join(hot, ["h", "chunk"]).unionByName(rest).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "key").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """``docs`` with its text freed of repeated chunks, and n_lines, n_kept (lines), n_removed (chunks)."""
    own = ("n_lines", "n_kept", "n_removed")
    columns = [c for c in docs.columns if c not in own]
    # a row in one column, so that no name of the input meets one of ours
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.col("text"))
    with scratch():
        gone = saved(gone_chunks(rows, window, spacing), "chunks-gone", lasting=True)
    # documents that lose chunks are known by id and text; their marks let all others pass
    hashed = rows.withColumn("h", F.xxhash64("id", F.md5("text")))
    marked = marking(hashed, gone.select(F.xxhash64("id", "key").alias("h")), "h", "chunks-documents").drop("h")
    whole = marked.filter("not marked").select("row", F.col("text").alias("kept"), F.lit(None).cast("bigint").alias("kept_lines"), F.lit(0).cast("bigint").alias("n_removed"))
    cut = gone.withColumnsRenamed({"id": "gone_id", "key": "gone_key"}).hint("merge")
    found = marked.filter("marked").withColumn("key", F.md5("text")).join(cut, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    kept = with_chunks(found, window, spacing).withColumn("chunk_kept", chunk_list(F.coalesce("gone", F.array().cast("array<int>"))))
    touched = F.col("gone").isNotNull()
    freed = kept.select(
        "row",
        F.when(touched, F.array_join(F.transform("chunk_kept", lambda c: c["chunk"]), "\n")).otherwise(F.col("text")).alias("kept"),
        F.when(touched, F.aggregate("chunk_kept", F.lit(0).cast("long"), lambda n, c: n + c["lines"])).alias("kept_lines"),
        F.coalesce(F.when(touched, F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return whole.unionByName(freed).select(
        *[F.col("kept").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns],
        n_lines.alias("n_lines"),
        F.coalesce("kept_lines", n_lines).alias("n_kept"),
        F.col("n_removed"),
    )
