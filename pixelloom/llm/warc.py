"""WARC archives: writing with segments and revisits, reading with reassembly.

Each page is one logical record, an HTTP message in chunked transfer framing. Of pages
with equal payloads of at least LEAST bytes, that with the largest page_id is a response
and the others are revisits of it. A record's block of more than SEGMENT bytes is cut: the
first part and its continuations carry WARC-Segment-Number from 1, the continuations carry
WARC-Segment-Origin-ID, and the last one WARC-Segment-Total-Length.

Reading goes by Content-Length alone. Segments are grouped by the record they come from,
ordered by number, held against the total length and joined; a missing, doubled or short
segment raises. Then the chunked framing is decoded and the payload is held against the
digest in the header; a mismatch raises.

Every record is a gzip member of its own, so one can be sought by its offset. Files are
written through Spark's text writer, to any file system Spark knows, and committed task by
task, so a lost executor leaves no half archive. The writer ends each value with a
separator: the last byte of a member, which is 0 for records under 16 MB, is left to it.

Revisits name their response by the standard fields (WARC-Refers-To, -Target-URI, -Date,
the payload digest) and, for this library's own use, by page. Ids of records are drawn
anew for each archive, so archives can be read together.

Defined cases. Null html is an empty payload. Null ids: such a page is a response if no
other page of its group has an id, else a revisit; it is read back as null. Rows with the
largest page_id of their group are all responses, and then no single record is referred
to; repeated rows are records of their own. Line ends in urls are percent-encoded; a null
url leaves its field out. Other columns are not stored. An empty table makes an archive
without records. Pages of any length are cut into segments. Archives of other writers are
read too: records that aren't pages are passed over with all their segments, wherever those
stand, fields that only this writer has are null, and a response without a digest is taken as it is.

Scale. Digests of payloads, not payloads, are shuffled to find equal ones, combined before
the shuffle; what is repeated is broadcast if it has been counted and is short. Beyond
that, pages of LEAST bytes or more are shuffled by digest; smaller ones never are. Pages
are written where they are read. A file holds at most PER_FILE records of at most SEGMENT
bytes. A file is inflated as it is read, so a reader's task holds its compressed bytes
(2 GB at most, the limit of Spark's reader of whole files) and one record. On reading, only
segments are shuffled; a group is one page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, new_path, saved, utf8
from .token_counts import blocks

LEAST = 1000
SEGMENT = 64 << 10
PER_FILE = 4096
CHUNK = 8192
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = b"\r\n\r\n"
#: Bytes that are inflated at once.
STEP = 64 << 10
#: Types of records that are pages.
PAGES = ("response", "revisit")
CHUNKED = re.compile(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions are passed over, trailers too."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        if n < 0:
            raise ValueError("a negative chunk length")
        at = end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk without its end")
        out.append(data[at : at + n])
        at += n + 2


def header(fields: dict[str, object]) -> bytes:
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None), b"\r\n"])


def quoted(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def named(space: uuid.UUID, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(space, name)}>"


def member(record: bytes) -> bytes:
    """A record and its separator as a gzip member, without the last byte, which is 0."""
    return gzip.compress(record + SEPARATOR, 6, mtime=0)[:-1]


def records(page_id: str | None, url: str | None, payload: bytes, original: dict | None, name: str, space: uuid.UUID, segment: int) -> Iterator[bytes]:
    """The records of one page, without the separator after each. original: of a revisit, what it refers to."""
    ident, revisit = named(space, name), original is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if not revisit:
        block += chunked(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": ident,
        "WARC-Date": DATE,
        "WARC-Target-URI": quoted(url),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": original and original["record"],
        "WARC-Refers-To-Target-URI": original and quoted(original["url"]),
        "WARC-Refers-To-Date": original and DATE,
        "WARC-Page-ID": page_id,
        "WARC-Refers-To-Page-ID": original and original["page"],
        "WARC-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(parts) == 1:
        yield header(fields | {"Content-Length": len(block)}) + block
        return
    yield header(fields | {"WARC-Segment-Number": 1, "Content-Length": len(parts[0])}) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        more = {"WARC-Type": "continuation", "WARC-Record-ID": named(space, f"{name}/{k}"), "WARC-Date": DATE, "WARC-Target-URI": quoted(url), "WARC-Segment-Origin-ID": ident, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total, "Content-Length": len(part)}
        yield header(more) + part


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, mark (the digest, if others have it too), original (page_id, url and number of rows of the page whose payload stands for this one's)."""
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    marked = rows.withColumn("mark", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    each = marked.filter("mark is not null").groupBy("mark", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    several = saved(each.groupBy("mark").agg(F.max(F.struct("page_id", "n", "url")).alias("original"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows"), "warc-equal")
    kind = several.schema["original"].dataType
    alone = marked.filter("mark is null").withColumn("original", F.lit(None).cast(kind))
    few = several.count() <= BROADCAST_ROWS
    return alone.unionByName(marked.filter("mark is not null").join(F.broadcast(several) if few else several, "mark", "left"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``."""
    if segment >= 8 << 20:
        raise ValueError("a segment must be under 8 MB")
    rows, space = with_originals(pages, least), uuid.uuid4()
    own = F.col("original").isNotNull() & F.col("page_id").eqNullSafe(F.col("original.page_id"))
    about = F.struct(F.col("page_id").cast("string").alias("page"), "url", F.col("mark"), F.col("original.page_id").cast("string").alias("of"), F.col("original.url").alias("of_url"), F.col("original.n").alias("n"), own.alias("own"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for keys, payloads in blocks(batches):
            out = []
            for row, payload in zip(keys.to_pylist(), payloads, strict=True):
                original, name = None, f"{task}/{number}"
                if row["n"] is not None:
                    # the one row that others refer to has a name that they can make
                    stands = f"original/{row['mark']}" if row["n"] == 1 else None
                    if not row["own"]:
                        original = {"page": row["of"], "url": row["of_url"], "record": stands and named(space, stands)}
                    else:
                        name = stands or name
                out += map(member, records(row["page"], row["url"], payload, original, name, space, segment))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.select(about.alias("about"), "payload").mapInArrow(write, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=per_file).text(path)


def inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of an archive, gzipped (all members) or plain, part by part."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[at : at + STEP]) for at in range(0, len(content), STEP))
        return
    engine, begun = zlib.decompressobj(31), False
    for at in range(0, len(content), STEP):
        part, more = bytes(content[at : at + STEP]), False
        while part or more:
            out = engine.decompress(part, 16 * STEP)
            yield out
            part, more, begun = engine.unconsumed_tail, len(out) == 16 * STEP, True
            if engine.eof:  # the next member, if any, after zeros that fill up
                part, more, begun, engine = engine.unused_data.lstrip(b"\0"), False, False, zlib.decompressobj(31)
    if begun:
        raise ValueError("the archive's last member is cut off")


def parsed(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, gzipped or plain; what is held is a record."""
    parts, held, at = inflated(content), bytearray(), 0
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            part = next(parts, None)
            if part is None:
                if held.strip():
                    raise ValueError(f"no record at byte {at}")
                return
            held += part
            held = held.lstrip(b"\r\n") if not held.startswith(b"WARC/") else held
        version, *lines = held[:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, n = end + 4, int(fields["content-length"])
        while len(held) < begin + n:
            part = next(parts, None)
            if part is None:
                raise ValueError(f"the record at byte {at} is cut off")
            held += part
        yield fields, bytes(held[begin : begin + n])
        at += begin + n
        held = held[begin + n :].lstrip(b"\r\n")


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if CHUNKED.search(head) and body else body


RECORD = "record_id string, origin_id string, number int, total bigint, type string, page_id string, url string, refers_to string, digest string, length bigint, block binary"
PAGE = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def digest_of(field: str | None) -> str | None:
    """The SHA-1 of a payload digest field, in hex; null for other kinds."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()


def finished(rows: Iterable[dict]) -> pa.RecordBatch:
    """Pages of whole records, as PAGE has them."""
    out = []
    for r in rows:
        digest, length = digest_of(r["digest"]), r["length"]
        payload = None if r["type"] == "revisit" else payload_of(r["block"])
        if payload is not None:
            found = hashlib.sha1(payload).hexdigest()
            if digest not in (None, found) or length not in (None, len(payload)):
                raise ValueError(f"the payload of {r['record_id']} isn't what its header says")
            digest, length = found, len(payload)
        out.append((r["page_id"], r["url"], r["type"], r["refers_to"], length, digest, payload))
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [f.split()[0] for f in PAGE.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path`` as they are stored; what isn't a page or a segment is passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())

    def whole(f: dict[str, str], key: str) -> int | None:
        return int(f[key]) if key in f else None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parsed(memoryview(content.as_buffer())):
                    kind, number = f["warc-type"], whole(f, "warc-segment-number")
                    if kind in PAGES or kind == "continuation" or number is not None:
                        # of a segmented record that isn't a page only its fields go on: they tell whose the continuations are
                        block = block if kind in PAGES or kind == "continuation" else b""
                        rows.append((f["warc-record-id"], f.get("warc-segment-origin-id"), number, whole(f, "warc-segment-total-length"), kind, f.get("warc-page-id"), f.get("warc-target-uri"), f.get("warc-refers-to-page-id"), f.get("warc-payload-digest"), whole(f, "warc-payload-length"), block))
                        size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.mapInArrow(read, RECORD)


def reassembled(stored: DataFrame) -> DataFrame:
    """Whole pages of segments: one row a segmented page, its block joined; segments of other records are passed over."""
    parts = stored.filter("number is not null")
    segment = F.struct("number", "type", "total", "page_id", "url", "refers_to", "digest", "length", "block")
    groups = parts.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(F.array_sort(F.collect_list(segment)).alias("s"))
    names = [f.split()[0] for f in RECORD.split(", ")]

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, listed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = listed.as_py()
                if s[0]["number"] == 1 and s[0]["type"] not in PAGES:
                    continue
                if [x["number"] for x in s] != [*range(1, len(s) + 1)] or s[-1]["total"] is None:
                    raise ValueError(f"segments of {ident} are missing or doubled: {[x['number'] for x in s]}")
                block = b"".join([x["block"] for x in s])
                if len(block) != s[-1]["total"]:
                    raise ValueError(f"the segments of {ident} have {len(block)} bytes of {s[-1]['total']}")
                a = s[0]
                row = (ident, None, None, None, a["type"], a["page_id"], a["url"], a["refers_to"], a["digest"], a["length"], block)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return groups.mapInArrow(join, RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a page: PAGE. The payload of a revisit is null; its digest and length are its response's."""
    stored = read_records(spark, path)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield finished(batch.slice(k, 256).to_pylist())

    return stored.filter("number is null").unionByName(reassembled(stored)).mapInArrow(finish, PAGE)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read them back, with page_id and refers_to of the type they had."""
    path = path or new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    kind = pages.schema["page_id"].dataType
    return read_warc(pages.sparkSession, path).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
