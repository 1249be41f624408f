"""Files of every format, their bytes put together by column expressions from the rows of a table.

No encoder of this library has a part in them: each format's header is a constant, and what
a file shows is the number of its image, one format after another.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .corpora import SIDE, quantised, read

#: In the order of an image's number modulo their number.
FORMATS = ("fbm", "cmu", "faces", "gif", "jpeg", "rle", "pcd", "xwd", "mcidas", "g3", "pcx", "img", "mac", "xpm", "xbm")
LINES = range(SIDE)


def head(data: bytes) -> Column:
    return F.lit(data.hex())


def byte(v: Column) -> Column:
    """A number below 256 as two digits."""
    return F.lower(F.lpad(F.hex(v), 2, "0"))


def bytes_of(values: Column) -> Column:
    return F.array_join(F.transform(values, byte), "")


def text(c: Column | str) -> Column:
    """The digits of a text's bytes."""
    return F.lower(F.hex((F.lit(c) if isinstance(c, str) else c).cast("binary")))


def row_of(level: Column, y: int) -> Column:
    return F.slice(level, y * SIDE + 1, SIDE)


def bits_of(level: Column, y: int, dark: bool = False, last_first: bool = False) -> Column:
    """A row as a byte: a bit is set where a level is 128 or more, or, if dark, where it is below."""
    row = F.reverse(row_of(level, y)) if last_first else row_of(level, y)
    return F.aggregate(row, F.lit(0), lambda n, v: n * 2 + ((v < 128) if dark else (v >= 128)).cast("int"))


def fbm(r: Column, g: Column, b: Column) -> Column:
    words = b"".join(str(v).encode().ljust(8, b"\0") for v in (8, 8, 3, 8, 8)) + b"".join(str(v).encode().ljust(12, b"\0") for v in (8, 64, 0, 1))
    return F.concat(head(b"%bitmap\0" + words + bytes(160)), *map(bytes_of, (r, g, b)))


def cmu(r: Column, g: Column, b: Column) -> Column:
    return F.concat(head(struct.pack(">IIIH", 0xF10040BB, 8, 8, 1)), *[byte(bits_of(r, y)) for y in LINES])


def faces(r: Column, g: Column, b: Column) -> Column:
    rows = F.concat(*[F.concat(bytes_of(row_of(r, y)), F.lit("\n")) for y in reversed(LINES)])
    return text(F.concat(F.lit("FirstName: A\nPicData: 8 8 8\n\n"), rows))


def gif(r: Column, g: Column, b: Column) -> Column:
    """Codes of 8 bits: the first clears, and 64 more don't fill a table that needs 9."""
    table = bytes(v for k in range(128) for v in (2 * k, 255 - k, k))
    image = struct.pack("<BHHHHBBB", 0x2C, 0, 0, 8, 8, 0, 7, 66)
    codes = F.transform(r, lambda v: F.shiftright(v, 1))
    return F.concat(head(b"GIF87a" + struct.pack("<HHBBB", 8, 8, 0xF6, 0, 0) + table + image + b"\x80"), bytes_of(codes), head(b"\x81\0\x3b"))


def jpeg(r: Column, g: Column, b: Column) -> Column:
    """One block of one level: its difference from 128 in a code of four bits for its size and as many more, and the end."""
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8, 8, 1) + bytes([1, 0x11, 0])
    sizes = b"\xff\xc4" + struct.pack(">HB", 27, 0) + bytes([0, 0, 0, 8, *[0] * 12]) + bytes(range(8))
    ends = b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1, *[0] * 15]) + bytes([0])
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
    d = F.greatest(F.get(r, F.lit(0)), F.lit(1)) - 128
    size = F.length(F.bin(F.abs(d))) * (d != 0).cast("int")
    value = F.when(d > 0, F.bin(d)).when(d < 0, F.lpad(F.bin(d + F.pow(F.lit(2), size).cast("int") - 1), size, "0")).otherwise("")
    bits = F.rpad(F.concat(F.lpad(F.bin(size), 4, "0"), value, F.lit("0")), 16, "1")
    both = [byte(F.conv(F.substring(bits, k, 8), 2, 10).cast("int")) for k in (1, 9)]
    stuffed = [F.when(c == "ff", "ff00").otherwise(c) for c in both]
    return F.concat(head(b"\xff\xd8" + quant + frame + sizes + ends + scan), *stuffed, head(b"\xff\xd9"))


def rle(r: Column, g: Column, b: Column) -> Column:
    rows = [F.concat(head(bytes([2, k])), *[F.concat(head(bytes([5, 7])), bytes_of(row_of(c, y)), head(bytes([1, 1]))) for y in reversed(LINES)]) for k, c in enumerate((r, g, b))]
    first = struct.pack("<HhhhhBBBBB", 0xCC52, 0, 0, 8, 8, 2, 3, 8, 0, 0) + b"\0"
    up = head(bytes([0x41, 0]) + struct.pack("<h", -8))  # to the first row again, before the next channel
    return F.concat(head(first), rows[0], up, rows[1], up, rows[2], head(bytes([7, 0])))


def pcd(r: Column, g: Column, b: Column) -> Column:
    """The smallest size, of one luminance and no colour."""
    lead = bytearray(0x2000)
    lead[:32], lead[0x800:0x807] = b"\xff" * 32, b"PCD_IPI"
    pair = F.concat(F.repeat(byte(luma(r)), 2 * 192), head(bytes([156]) * 96 + bytes([137]) * 96))
    return F.concat(head(bytes(lead)), F.repeat(pair, 64))


def luma(r: Column) -> Column:
    """Below what highlights are bent from."""
    return F.floor(F.get(r, F.lit(0)) * 5 / 8).cast("int")


def xwd(r: Column, g: Column, b: Column) -> Column:
    fields = [100, 7, 2, 8, 8, 8, 0, 1, 8, 1, 8, 8, 8, 3, 0, 0, 0, 8, 256, 256, 8, 8, 0, 0, 0]
    table = b"".join(struct.pack(">IHHHBB", k, k * 257, (255 - k) * 257, k, 7, 0) for k in range(256))
    return F.concat(head(struct.pack(">25I", *fields) + table), bytes_of(r))


def mcidas(r: Column, g: Column, b: Column) -> Column:
    words = [0, 4, 20, *[0] * 5, 8, 8, 1, *[0] * 53]
    return F.concat(head(struct.pack("<64I", *words) + bytes(512)), bytes_of(r))


#: A pixel's two runs: one white and no black, or no white and one black.
WHITE_PIXEL, BLACK_PIXEL, LINE_END = "000111" + "0000110111", "00110101" + "010", "000000000001"


def g3(r: Column, g: Column, b: Column) -> Column:
    pixels = [F.array_join(F.transform(row_of(r, y), lambda v: F.when(v < 128, BLACK_PIXEL).otherwise(WHITE_PIXEL)), "") for y in LINES]
    bits = F.concat(*[F.concat(F.lit(LINE_END), p) for p in pixels], F.lit(LINE_END * 6 + "0000000"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(bits) / 8).cast("int") - 1), lambda k: byte(F.conv(F.substring(bits, k * 8 + 1, F.lit(8)), 2, 10).cast("int"))), "")


def pcx(r: Column, g: Column, b: Column) -> Column:
    first = bytearray(128)
    first[:4], first[65] = bytes([10, 5, 1, 8]), 1
    struct.pack_into("<4H", first, 4, 0, 0, 7, 7)
    struct.pack_into("<H", first, 66, 8)
    table = bytes(v for k in range(256) for v in (k, 255 - k, 7))
    return F.concat(head(bytes(first)), F.array_join(F.transform(r, lambda v: F.concat(F.lit("c1"), byte(v))), ""), head(b"\x0c" + table))


def img(r: Column, g: Column, b: Column) -> Column:
    return F.concat(head(struct.pack(">8H", 1, 8, 1, 2, 85, 85, 8, 8)), *[F.concat(head(b"\x80\1"), byte(bits_of(r, y, dark=True))) for y in LINES])


def mac(r: Column, g: Column, b: Column) -> Column:
    """576 by 720: the rows of the image over and over, each as one run of its byte."""
    return F.concat(head(bytes(512)), F.repeat(F.concat(*[F.concat(head(bytes([257 - 72])), byte(bits_of(r, y, dark=True))) for y in LINES]), 90))


def xpm(r: Column, g: Column, b: Column) -> Column:
    rows = [F.concat(F.lit('"'), F.array_join(F.transform(row_of(r, y), lambda v: F.get(F.array(*map(F.lit, "a.#~")), F.shiftright(v, 6))), ""), F.lit('",\n')) for y in LINES]
    first = '/* XPM */\nstatic char * image[] = {\n"8 8 4 1",\n"a c #102030",\n". c red m white",\n"# g gray50 c #0f0",\n"~ c None",\n'
    return text(F.concat(F.lit(first), *rows, F.lit("};\n")))


def xbm(r: Column, g: Column, b: Column) -> Column:
    values = [F.concat(F.lit("0x"), byte(bits_of(r, y, dark=True, last_first=True))) for y in LINES]
    return text(F.concat(F.lit("#define image_width 8\n#define image_height 8\nstatic char image_bits[] = {\n"), F.concat_ws(", ", *values), F.lit("};\n")))


MADE = dict(zip(FORMATS, (fbm, cmu, faces, gif, jpeg, rle, pcd, xwd, mcidas, g3, pcx, img, mac, xpm, xbm), strict=True))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, path, content: each 64-number embedding as a file, of all formats in turn."""
    v = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").filter(F.size(v) == SIDE * SIDE)

    def plane(shift: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: quantised(F.get(v, (i + shift) % (SIDE * SIDE))))

    planes = {c: plane(shift) for c, shift in corpora.SHIFTS.items()}
    levels = rows.select(F.col("vec_id").alias("image_id"), *[p.alias(c) for c, p in planes.items()])
    kind = F.pmod("image_id", F.lit(len(FORMATS))).cast("int")
    name = F.get(F.array(*map(F.lit, FORMATS)), kind)
    digits = F.coalesce(*[F.when(kind == k, made(*map(F.col, "rgb"))) for k, made in enumerate(MADE.values())])
    return levels.select("image_id", F.concat("image_id", F.lit("."), name).alias("path"), F.unhex(digits).alias("content"))
