"""Interleaved document sequences: text and media of HTML documents in order.

HTML is parsed into parts, in order of appearance: text of blocks, and references to media
with their captions (the figcaption of the figure, else the alt text). Each part keeps its
position. References are resolved by a join on the payload's digest with a table of media;
what isn't there stays null, so positions and captions remain aligned.

The media stored here are 8-bit gray PNG images, WIDTH samples a row: a payload's bytes
are the samples, so the form is lossless. ``pixels_of`` reads them back and checks every
checksum.

Defined cases. Null html has no parts; an empty text is a payload of WIDTH padding bytes.
Texts of any length are taken whole, one payload each. Unclosed and stray tags are taken
as the parser takes them; scripts, styles and comments are no text. A reference without a
source is a part with a null digest. Equal payloads are one medium. Rows that agree in all
columns, or in their keys, keep their number; null keys are keys. An empty table gives an
empty result. Extra columns of a media table go through the join; those named like a
part's own get "media_" before their names. Columns of documents are left out.

Scale. ``media_of_texts`` is one pass that writes documents and media side by side, a
payload once a task; the two are read apart. Features are computed where media are stored
and only they are joined, never payloads; copies are combined before that. References, not
texts, go through the join: they carry the number of their row and their place in it, and
come back gathered by row. A digest that very many refer to (an empty text, say) is joined
apart (``even_join``), and references without a digest join nothing.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from html import escape
from html.parser import HTMLParser
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_join, saved, unused, utf8
from .token_counts import blocks

WIDTH = 192
PNG = b"\x89PNG\r\n\x1a\n"
#: Digests that a task remembers as stored, at most.
SEEN = 500_000
#: Elements that begin or end a block of text.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
#: What a part has; nth counts the media among them, from 0, as they are parsed.
PART = "pos int, kind string, text string, digest string, caption string, size bigint"
PARSED = f"{PART}, nth int"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with spaces up to a positive multiple of ``width``."""
    return data.ljust(max(1, -(-len(data) // width)) * width, b" ")


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """An 8-bit gray PNG whose samples are these bytes, a positive multiple of ``width``."""
    rows = np.zeros((len(samples) // width, width + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join((PNG, png_chunk(b"IHDR", head), png_chunk(b"IDAT", zlib.compress(rows, level)), png_chunk(b"IEND", b"")))


def pixels_of(png: bytes) -> np.ndarray:
    """The samples of such an image as an array of rows; anything else raises."""
    if png[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit gray without interlace")
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return rows[:, 1:]


class Parts(HTMLParser):
    """Collects the parts of one document."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.silent = self.captioning = 0
        self.figure: list[int] = []  # for each open figure, where its parts begin
        self.caption: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS and not self.captioning:
            self.flush()
        if tag in MEDIA:
            self.flush()
            a = dict(attrs)
            found = re.fullmatch(r"(?:media:|sha256:)+([0-9a-f]{64})", a.get("src") or "")
            size = a.get("data-bytes") or ""
            self.parts.append({"kind": "media", "digest": found[1] if found else None, "caption": a.get("alt"), "size": int(size) if size.isascii() and size.isdigit() else None})
        elif tag == "figure":
            self.figure.append(len(self.parts))
        elif tag == "figcaption" and self.figure:
            self.captioning += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.captioning:
            self.captioning -= 1
            caption, self.caption = " ".join("".join(self.caption).split()), []
            for part in self.parts[self.figure[-1] :] if self.figure else ():
                if part["kind"] == "media":
                    part["caption"] = caption
        elif tag == "figure" and self.figure:
            self.figure.pop()
            self.captioning = min(self.captioning, len(self.figure))
        if tag in BLOCKS and not self.captioning:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.caption if self.captioning else self.text).append(data)


def parts_of(html: str | None) -> list[dict]:
    parser = Parts()
    parser.feed(html or "")
    parser.close()
    parser.text += parser.caption  # a caption that never ended is text
    parser.flush()
    nth = count()
    return [{"pos": k, "kind": p["kind"], "text": p.get("text"), "digest": p.get("digest"), "caption": p.get("caption"), "size": p.get("size"), "nth": next(nth) if p["kind"] == "media" else None} for k, p in enumerate(parser.parts)]


ARROW_PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("size", pa.int64()), ("nth", pa.int32())])


def parse_html(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts) of rows of (key, html)."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches):
            parts = [parts_of(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array(parts, pa.list_(ARROW_PART))], [key, "parts"])

    kind = pages.schema[key].dataType.simpleString()
    fields = ",".join(f.replace(" ", ":") for f in PARSED.split(", "))
    return pages.select(key, utf8(F.col("html")).alias("html")).mapInArrow(parse, f"{key} {kind}, parts array<struct<{fields}>>")


def of_media(media: DataFrame) -> DataFrame:
    """A table of media, one row a digest, with names that no part has."""
    own = [f.split()[0] for f in PART.split(", ") if f.split()[0] != "digest"]
    return media.withColumnsRenamed({c: f"media_{c}" for c in media.columns if c in own})


def sequences(pages: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sequence) of rows of (key, html): all parts in order, media with what ``media`` has for them.

    ``media`` has one row a digest; what isn't in it is null.
    """
    parsed = parse_html(pages, key).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "parts")
    rows = saved(parsed, "sequences-parts")
    media = of_media(media)
    names = [c for c in media.columns if c != "digest"]
    references = rows.select("row", F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("p")).select("row", "p.pos", "p.digest")
    packed = media.select("digest", F.struct(F.lit(0).alias(unused("_", names)), *names).alias("found"))
    found = even_join(references, packed, "digest", "left", wide=True).select("row", F.struct("pos", "found").alias("m"))
    gathered = found.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("media"))
    whole = rows.join(gathered, "row", "left")
    # the n-th media part meets the n-th of the gathered ones: both are in order of their places
    fields = [f.split()[0] for f in PART.split(", ")]
    sequence = F.transform("parts", lambda p: F.struct(*[p[f].alias(f) for f in fields], *[F.when(p["nth"].isNotNull(), F.get("media", p["nth"])["found"][c]).alias(c) for c in names]))
    return whole.select(F.col("key").alias(key), sequence.alias("sequence"))


def media_of_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, html, digest, stored: a document with a reference to its text as a medium, and the medium, once a task."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for ids, texts in blocks(batches):
            pages, digests, stored = [], [], []
            for key, text in zip(ids.to_pylist(), texts, strict=True):
                payload = padded(text, width)
                digest = hashlib.sha256(payload).digest()
                name = escape("" if key is None else str(key))
                about = f"{len(text)} bytes in {len(payload) // width} rows"
                pages.append(f'<article><h1>Document {name}</h1><figure><img src="sha256:{digest.hex()}" alt="text" data-bytes="{len(text)}"><figcaption>{about}</figcaption></figure></article>')
                digests.append(digest.hex())
                stored.append(None if digest in seen else png_of(payload, width))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pages), pa.array(digests), pa.array(stored, pa.binary())], ["doc_id", "html", "digest", "stored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(store, f"doc_id {kind}, html string, digest string, stored binary")


FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: whether the mean of each of 8 x 8 cells is above the mean of all; cells cut the image evenly."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    y, x = (np.arange(9) * h) // 8, (np.arange(9) * w) // 8
    y0, y1 = np.minimum(y[:-1], h - 1), np.maximum(y[1:], np.minimum(y[:-1], h - 1) + 1)
    sums = total[y1][:, x[1:]] - total[y1][:, x[:-1]] - total[y0][:, x[1:]] + total[y0][:, x[:-1]]
    size = (y1 - y0)[:, None] * (x[1:] - x[:-1])[None, :]
    above = sums * (h * w) > total[h, w] * size
    return np.packbits(above).tobytes().hex()


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of each distinct digest of rows of (digest, stored), from the stored bytes alone; a payload that isn't its digest's raises."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for digests, media in blocks(batches):
            rows = []
            for digest, png in zip(digests.to_pylist(), media, strict=True):
                pixels = pixels_of(png)
                payload = pixels.tobytes()
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the medium {digest} has other samples")
                rows.append((digest, len(payload), found, zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), f"mean={int(pixels.sum(dtype=np.int64)) / pixels.size:.4f};ahash={average_hash(pixels)}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split()[0] for f in FEATURES.split(", ")])

    each = media.filter("stored is not null").select("digest", "stored").mapInArrow(read, FEATURES)
    names = [f.split()[0] for f in FEATURES.split(", ")][1:]
    return each.groupBy("digest").agg(F.max(F.struct(*names)).alias("f")).select("digest", "f.*")


def texts_as_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row a document: the media part of its sequence, with the features of the stored bytes."""
    both = saved(media_of_texts(docs, width), "media")
    media = saved(media_features(both.select("digest", "stored")), "media-features")
    found = sequences(both.select("doc_id", "html"), media)
    return found.select("doc_id", F.explode(F.filter("sequence", lambda p: p["kind"] == "media")).alias("p")).select("doc_id", "p.*")
