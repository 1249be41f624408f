"""Token-ID output: length-delimited binary records with an offset index.

File format, one file a range of document ids, little-endian throughout:

    record := length (8 bytes) | masked CRC of these 8 bytes (4) | payload | masked CRC of the payload (4) | newline (1)
    payload := width of an id in bytes (1: 2 or 4) | key length (4) | key | ids

A masked CRC is the CRC-32 turned right by 15 bits plus 0xA282EAD8, so that CRCs of data
that hold CRCs stay telling. The newline is the separator of Spark's text writer, through
which files are written: bytes go out unchanged, to any file system Spark knows, and a
task's file appears only when the task is committed, so lost executors leave no halves.
Records lie in ascending order of doc_id within and across files (nulls first, rows with
equal ids by the hash of their texts). The index, a Parquet table beside the files, has
(file, offset, length, doc_id, n_tokens) of each record, for shuffled reads.

Encoding: the ids are the tokenizers library's own. A text is cut before each white-space
character where its pattern cuts in any case (single spaces and newlines inside the text
and no other white space), its distinct pieces go to the library's model once, and are
looked up after that, once for all texts that are encoded together; all other texts go to
the library whole, and so do all texts where the file asks for anything else than plain
byte-level pieces (a normalizer, another pattern, a prefix space, truncation, padding,
dropout, marks of words).

Defined cases. Null and empty texts are the end id alone. Texts of any length are encoded
whole, one record each. Repeated rows are repeated records. A null id is an empty key, read
back as null. The special token's string in a text is what the library makes of it. Other
columns are left out, whatever their names. An empty table gives an empty index.

Scale. One shuffle, of whole rows by range of doc_id, before encoding, so ids are made
once, where they are written. Rows of one id are spread by the hash of their texts, and
rows that agree in both by their places in the input, so no id or copied row fills a task.
What comes before a document is its file's start plus a running sum as its file is read;
starts are sums over runs of files, so no task sees all files.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, kept, new_path, saved, utf8
from .token_counts import blocks

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 0
#: Pieces that a worker remembers from one turn to the next, and of the turn before.
CACHE = 300_000
#: Pieces that are looked up between two looks at how many there are.
TURN_BY = 4096
#: Bytes of text that are encoded together, about.
TOGETHER = 4 << 20
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20
#: Files whose sizes are added up by one task.
RUN = 4096
DELTA = 0xA282EAD8
#: The last of the characters whose kind is known here, and the letters among them.
TOP = "\u024f"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Pieces of such letters and of ASCII, and where the pattern cuts them.
PLAIN = re.compile(f"\n?[!-~{LETTERS}]+")
CUT = re.compile(f"\n|'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n0-9{LETTERS}]+")
#: White space but single spaces and newlines, as str.split has it.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record; a damaged one raises ValueError."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        if len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        n = struct.unpack("<Q", head)[0]
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or len(data) < at + n + 16 or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += n + 17


def opened(payload: memoryview) -> tuple[str | None, np.ndarray]:
    """The key and the ids of a record."""
    width, n = struct.unpack_from("<BI", payload)
    return bytes(payload[5 : 5 + n]).decode() if n else None, np.frombuffer(payload[5 + n :], f"<u{width}")


def lettered(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or max(piece) <= TOP)


class Pieces(dict):
    """The ids of pieces, made when they are first asked for. At a turn, those not asked for since the last one are forgotten.

    A word with a mark after it takes room only once the word alone has been seen.
    """

    def __init__(self, make: Callable[[str], bytes], marks: dict[str, bytes]):
        super().__init__()
        self.make, self.marks, self.older = make, marks, {}

    def __missing__(self, piece: str) -> bytes:
        mark = self.marks.get(piece[-1:])
        if mark and lettered(piece[:-1]):
            ids = self.get(piece[:-1])
            if ids is None:
                return self[piece[:-1]] + mark
            ids = self[piece] = ids + mark
            return ids
        ids = self[piece] = self.older.get(piece) or self.make(piece)
        return ids

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    """The library's ids of a text as bytes of ``width`` each."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer: Tokenizer = Tokenizer.from_file(tokenizer_file)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        # the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        codes = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}
        self.alphabet = "".join(chr(codes[b]) for b in range(256))
        self.space = self.alphabet[32]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = type(self.tokenizer.pre_tokenizer).__name__
        model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = kind == "ByteLevel" and type(model).__name__ == "BPE" and cut.use_regex and not cut.add_prefix_space
        whole = self.tokenizer.normalizer is None and self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.by_piece = plain and whole and not any(getattr(model, n, None) for n in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges"))
        self.ids = self.tokenizer.model.tokenize
        self.sign = lru_cache(10_000)(self.coded)
        self.known = Pieces(self.piece, {m: self.whole(m) for m in ".,!?;:"})

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def coded(self, part: str) -> bytes:
        """Of what the pattern doesn't cut."""
        return self.pack([t.id for t in self.ids(charmap_decode(part.encode(), "strict", self.alphabet)[0])])

    def part(self, part: str) -> bytes:
        if part[0] == " " and part[1:].isalpha():
            return self.known[part[1:]]
        return self.coded(part) if part.isalpha() else self.sign(part)

    def piece(self, piece: str) -> bytes:
        """A piece that has lost its space; one that begins with a newline never had one."""
        if piece.isalpha():
            if piece.isascii():  # the commonest: letters are their own alphabet
                return self.pack([t.id for t in self.ids(self.space + piece)])
            if max(piece) <= TOP:
                return self.coded(" " + piece)
        spaced = piece if piece[0] == "\n" else " " + piece
        return b"".join(map(self.part, CUT.findall(spaced))) if PLAIN.fullmatch(piece) else self.whole(spaced)

    def parted(self, text: str) -> tuple[str, str | None]:
        """What the library gets whole, and what follows in pieces with a space between, if anything."""
        flat = text.replace("\n", " ")
        # any white space but single spaces and newlines inside the text, and the library gets it whole
        if not self.by_piece or "  " in flat or flat[:1] == " " or flat[-1:] == " " or any(s in text for s in ODD_SPACES) or any(s in text for s in self.specials):
            return text, None
        first, space, rest = (text if "\n" not in text else text.replace("\n", " \n")).partition(" ")
        return first, rest if space else None

    def encode(self, text: str) -> bytes:
        """All ids of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """All ids of each text: its pieces are numbered and put together by Arrow, so each is looked up once however often these texts have it."""
        parts = list(map(self.parted, texts))
        cut = pc.split_pattern(pa.array([rest for _, rest in parts], pa.large_string()), " ")
        numbered = cut.flatten().dictionary_encode()
        pieces, ids = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for k in range(0, len(pieces), TURN_BY):
            if len(self.known) > CACHE:
                self.known.turn()
            ids += map(self.known.__getitem__, pieces[k : k + TURN_BY])
        found = pa.array(ids, pa.large_binary()).take(numbered.indices)
        places = np.append(0, np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64))
        ends = places[np.cumsum([0, *pc.list_value_length(cut).fill_null(0).to_pylist()])].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [b"".join((self.whole(first), data[a:b])) for (first, _), a, b in zip(parts, ends, ends[1:], strict=False)]


def encoder(tokenizer_file: str) -> Encoder:
    return kept(("records", tokenizer_file), lambda: Encoder(tokenizer_file))


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode ``docs``, an end id after each, into records under ``path``, in order of doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), utf8(F.col("text")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 32), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(files, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        end = own.pack([end_id])
        for keys, texts in blocks(batches, TOGETHER):
            out = []
            for key, ids in zip(keys.to_pylist(), own.encode_all([t.decode("utf-8", "replace") for t in texts]), strict=True):
                name = b"" if key is None else key.encode()
                out.append(framed(struct.pack("<BI", own.width, len(name)) + name + ids + end))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    made = rows.select(F.col("doc_id").cast("string"), "text").mapInArrow(frames, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_records(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Of each record: file, offset, length, doc_id, before (ids before it in its file), n_tokens, ids_crc32.

    Every checksum is verified. ids_crc32 is the CRC-32 of the ids as 32-bit numbers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, before, rows = memoryview(content.as_buffer()), 0, []
                for at, payload in unframed(data):
                    key, ids = opened(payload)
                    rows.append((name, at, len(payload) + 17, key, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    if len(rows) == 10_000:
                        yield pack(rows)
                        rows = []
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)

    schema = "file string, offset bigint, length bigint, doc_id string, before bigint, n_tokens bigint, ids_crc32 bigint"
    return files.mapInArrow(parse, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


NAMES = ["file", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"]


def token_records(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write records and index; return the index with start, the ids of all documents before each."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-records")
    write_records(docs, f"{path}/records", tokenizer_file)
    read_records(spark, f"{path}/records", docs.schema["doc_id"].dataType.simpleString()).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    return with_starts(index)


def with_starts(index: DataFrame, run: int = RUN) -> DataFrame:
    """The index with start: sums over runs of ``run`` files, over the files of a run, and over a file's records."""
    # files are named by the place of their range, so their names give the order
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    files = saved(index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.floor(number / run)), "token-files")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run")).alias("earlier"))
    inside = files.withColumn("first", before(Window.partitionBy("run").orderBy(number, "file")))
    starts = inside.join(runs, "run").select(F.col("file").alias("of"), (F.col("first") + F.col("earlier")).alias("first"))
    starts = F.broadcast(starts) if files.count() <= BROADCAST_ROWS else starts
    return index.join(starts, index["file"] == F.col("of")).withColumn("start", F.col("first") + F.col("before")).drop("of", "first")


def read_shuffled(spark: SparkSession, path: str, seed: int, kind: str = "bigint") -> DataFrame:
    """file, offset, doc_id and ids of each record in an order drawn from ``seed``.

    A file is cut where it is read, and checked; only records are shuffled.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for at, payload in unframed(memoryview(content.as_buffer())):
                    key, ids = opened(payload)
                    rows.append((name, at, key, ids.astype("<u4").tobytes()))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(r[3]) // 4 for r in rows)]), pa.array(np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), ids], ["file", "offset", "doc_id", "ids"])

    found = files.mapInArrow(cut, "file string, offset bigint, doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast(kind))
    return found.orderBy(F.xxhash64(F.lit(seed), "file", "offset"))
