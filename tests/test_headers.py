"""Identification by headers: the same as by decoding, in few bytes of a file of any size."""

import bz2
import gzip
import struct

import numpy as np
import pytest
from pixelloom.image import true
from pixelloom.sources import files, headers
from pixelloom.sources.encode import ENCODERS
from pixelloom.sources.registry import BUILT_IN, Context, decoded, told_of

from .known_files import KNOWN_FILES
from .test_decoders import compressed

KNOWN = [(name, bytes.fromhex(content)) for name, content in KNOWN_FILES]
MORE = bytes(3 << 20)


def longer(data):
    """The file with 3 MB after it, unless it is wrapped: then what follows would belong to the wrapper."""
    return data if data[:2] in (b"\x1f\x8b", b"\x1f\x9d", b"BZ") or b"begin " in data[:100] else data + MORE


def head_of(name, data):
    return headers.Head(name, lambda at, n: data[at : at + n])


@pytest.mark.parametrize("name, data", KNOWN, ids=[n for n, _ in KNOWN])
def test_as_decoded(name, data):
    d = decoded(name, data)
    status, f, about, error = told_of(head_of(name, data))
    assert (status, f.name) == ("ok", d.format), error
    if d.format != "g3":
        assert (about.width, about.height, about.depth, about.colours) == (d.raster.width, d.raster.height, d.raster.depth, d.raster.used or None)


def test_every_format_has_a_header():
    assert {decoded(n, d).format for n, d in KNOWN} == {f.name for f in BUILT_IN if f.header}


@pytest.mark.parametrize("name, data", KNOWN, ids=[n for n, _ in KNOWN])
def test_reads_are_bounded(name, data):
    """However much follows, the parts that are read are the same; a wrapped file is undone a few times 4 kB."""
    head = head_of(name, longer(data))
    assert told_of(head)[0] == "ok"
    assert head.taken <= (96 << 10)


def test_parts_are_passed_over_unread():
    """Large parts before what a header needs: JPEG segments, PNG chunks, GIF comments."""
    segment = b"\xff\xe2" + struct.pack(">H", 65535) + bytes(65533)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 480, 640, 3) + bytes(9)
    head = head_of("x", b"\xff\xd8" + segment * 40 + frame)
    assert told_of(head)[2].told == " is a 640x480 JPEG image, color space YCbCr, 3 comps., Huffman coding"
    assert head.taken < 45 * 2 * headers.BLOCK
    r = true(np.zeros((3, 5, 3)), title="t" * (1 << 20))
    head = head_of("x", ENCODERS["png"](r))
    assert (told_of(head)[2].width, told_of(head)[2].colours) == (5, None) and head.taken <= 4 * headers.BLOCK
    comment = b"\x21\xfe" + (b"\xff" + bytes(255)) * 400 + b"\0"
    head = head_of("x", b"GIF89a" + struct.pack("<HHBBB", 9, 7, 0x81, 0, 0) + bytes(12) + comment + b"\x2c" + struct.pack("<4HB", 0, 0, 9, 7, 64))
    assert told_of(head)[2].told == " is a 9x7 interlaced GIF89a image with 4 colors"


@pytest.mark.parametrize(
    "data, told",
    [
        (b"P5\n# note\n3 4\n15\n", " is a 3x4 Raw PGM image with 16 levels"),
        (b"P1 3 4 ", " is a 3x4 PBM image"),
        (b"P4 3 4\n", " is a 3x4 RawBits PBM image"),
        (b"P6 3 4 255\n", " is a 3x4 Raw PPM image with 256 levels"),
        (b"\x2a\x17" + struct.pack(">HH", 8, 2), " is a 8x2 Compact PBM image"),
        (struct.pack(">8I", 0x59A66A95, 2, 3, 24, 0, 3, 0, 0), " is a RGB 2x3 24 plane color Sun rasterfile"),
        (struct.pack(">8I", 0x59A66A95, 2, 3, 8, 0, 0, 0, 0), " is an old-style 2x3 8 plane greyscale Sun rasterfile"),
        (struct.pack(">IIIH", 0xF10040BB, 9, 2, 1), " is a 9x2 1 plane CMU WM raster"),
        (b"FirstName: A\nPicData: 4 2 8\n\n00", " is a  4x2 8-bit grayscale Faces Project image"),
        (struct.pack("<HhhhhBBBBB", 0xCC52, 0, 0, 3, 2, 2, 3, 8, 0, 0), " is a 3x2 24 bit color RLE image with no map"),
        (struct.pack("<2sIIIIiiHHIIiiII", b"BM", 0, 0, 54, 40, 5, -2, 1, 8, 1, 0, 0, 0, 7, 0), " is a 5x2 8 bit deep, Run length compressed, Windows BMP image"),
        (struct.pack("<BBBHHBHHHHBB", 0, 1, 9, 0, 9, 24, 0, 0, 4, 2, 8, 64), " is a 4x2 Two way interleaved Targa Run length encoded pseudo color image with 9 colors"),
        (struct.pack(">8H", 1, 8, 1, 2, 85, 85, 13, 4), " is a 16x4 GEM Bit Image"),
        (b'/* XPM */\nstatic char * name[] = {\n"4 2 3 1",\n', " is a 4x2 X Pixmap image (Version 3) with 3 colors titled 'name'"),
        (b"#define t_format 1\n#define t_width 4\n#define t_height 2\n#define t_ncolors 3\n#define t_chars_per_pixel 1\n", " is a 4x2 X Pixmap image (Version 1) with 3 colors titled 't'"),
        (b"#define t_width 9\n#define t_height 2\nstatic short t_bits[] = {", " is a 9x2 X10 bitmap file titled 't'"),
        (struct.pack(">25I", 100, 7, 2, 8, 3, 2, 0, 1, 8, 1, 8, 8, 4, 3, *[0] * 11), " is a 3x2 XWD image in 8 bit ZPixmap MSB header,  MSB byte order"),
        (struct.pack(">64I", 0, 4, 20, 0, 0, 11, 12, 0, 2, 3, 1, 4, 5, *[0] * 32, 97001, 120000, *[0] * 17) + bytes(256), " is a McIDAS area, GOES-1 Visible 97001 120000 (11, 12) (4, 5)"),
    ],
)
def test_lines_are_the_formats_own(data, told):
    status, _, about, error = told_of(head_of("x", data))
    assert status == "ok" and about.told == told, error


def test_wrapped_files():
    body = b"P5 300 200 255\n" + np.random.default_rng(1).bytes(300 * 200)
    for pack in (gzip.compress, bz2.compress, lambda d: compressed(d[:2000])):
        data = pack(body)
        head = head_of("x", data)
        assert told_of(head)[2].told == " is a 300x200 Raw PGM image with 256 levels"
        assert pack is bz2.compress or head.taken <= 2 * headers.BLOCK
    for bad in (gzip.compress(body)[:9] + b"\xff" * 90, b"\x1f\x9d", b"BZh9" + bytes(30)):
        assert told_of(head_of("x", bad))[0] in ("error", "unknown")


def test_other_files_are_unknown_or_errors():
    for data in (b"", b"x", b"plain text\n" * 9, b"P7 1 1", b"P5 x", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xd9", b"GIF89a" + bytes(20), b"\xff\xd8\xff\xc9" + struct.pack(">HBHHB", 8, 8, 1, 1, 1)):
        status, _, about, error = told_of(head_of("x", data))
        assert status in ("unknown", "error") and about is None and error


def test_photo_cd_by_its_target():
    data = bytearray(b"\xff" * 32 + bytes(0x2000))
    data[0x800:0x807] = b"PCD_IPI"
    for turn, target, told in ((0, (800, 600), "768x512 Photograph on CD Image"), (1, (600, 800), "512x768 Photograph on CD Image (On right side)"), (3, (0, 0), "128x192 Photograph on CD Image (On left side)"), (0, (9999, 9999), "3072x2048 Photograph on CD Image")):
        data[0xE02] = turn
        assert told_of(head_of("x", bytes(data)), Context(width=target[0], height=target[1]))[2].told == f" is a {told}"


def test_tasks_read_parts_of_files(spark, tmp_path):
    """Files of 3 MB each, listed by Spark: the reads are counted in the tasks that make them."""
    for name, data in KNOWN:
        (tmp_path / name).write_bytes(longer(data))
    (tmp_path / "text.txt").write_bytes(b"no image\n" * 100_000)
    found = files.identify_at(spark, f"file://{tmp_path}")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert len(rows) == len(KNOWN) + 1 and rows["text.txt"].status == "unknown"
    assert max(r.bytes_read for r in rows.values()) <= 128 << 10
    whole = {r.path: r for r in files.identify(spark.createDataFrame([(n, bytearray(d)) for n, d in KNOWN], "path string, content binary")).collect()}
    for name, _ in KNOWN:
        a, b = rows[name], whole[name]
        assert (a.format, a.status, a.width, a.height, a.depth, a.colors) == (b.format, b.status, b.width, b.height, b.depth, b.colors)
        assert a.told.split(" is a", 1)[1] == b.told.split(" is a", 1)[1]


def test_files_that_go_are_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"P5 1 1 255\n1")

    def gone(path):
        raise OSError("gone")

    row = files.identify_at(spark, f"file://{tmp_path}", opened=gone).first()
    assert row.status == "error" and "gone" in row.error
    row = files.identify_at(spark, f"file://{tmp_path}", opened=lambda path: files.arrow_reader("nosuch://x/y")).first()
    assert row.status == "error" and row.width is None
