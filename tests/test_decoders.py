"""Files encoded by hand, one format after another."""

import bz2
import gzip
import resource
import struct
import time
import zlib

import numpy as np
import pytest

from pixelloom.functions.colour import colour_names, read_names
from pixelloom.image import BITMAP, RGB, TRUE, true
from pixelloom.sources import coded, simple
from pixelloom.sources.encode import ENCODERS
from pixelloom.sources.headers import Head
from pixelloom.sources.registry import BUILT_IN, Context, decoded, told_of
from pixelloom.sources.stream import Broken, lzw_bits, trailing_options, unwrapped, with_trailing, without_trailing

GRAY = bytes([0, 51, 102, 153, 204, 255])


def ok(data, name="x", context=Context(), kind=None, status="ok"):
    d = decoded(name, data, context)
    assert d.status == status, d.error
    assert kind is None or d.format == kind, d.format
    if status == "ok":
        same_by_header(name, data, context, d)
    return d.raster


def same_by_header(name, data, context, d):
    """A header alone tells the format, the size and the colours of what was decoded."""
    said, f, about, error = told_of(Head(name, lambda at, n: data[at : at + n]), context)
    assert (said, f.name) == ("ok", d.format), error
    r = d.raster
    if f.name != "g3":  # its header has no size
        assert (about.width, about.height, about.depth, about.colours) == (r.width, r.height, r.depth, r.used or None), about.told


def levels(r):
    return (r.colours16() >> 8)[..., 0].tolist()


def fbm_file(w, h, planes, bits, body, colours=b""):
    num = lambda v, n: str(v).encode().ljust(n, b"\0")
    row = w + 2
    head = b"%bitmap\0" + num(w, 8) + num(h, 8) + num(planes, 8) + num(bits, 8) + num(8, 8) + num(row, 12) + num(row * h, 12) + num(len(colours), 12) + num(1.0, 12) + b"title".ljust(80, b"\0") + bytes(80)
    rows = b"".join(p[k * w : k * w + w] + b"\0\0" for p in body for k in range(h))
    return head + colours + rows


def test_fbm():
    assert ok(fbm_file(3, 2, 1, 1, [bytes([1, 0, 1, 0, 0, 1])]), kind="fbm").pixels.tolist() == [[0, 1, 0], [1, 1, 0]]
    r = ok(fbm_file(3, 2, 1, 8, [bytes([0, 1, 2, 2, 1, 0])], bytes([10, 20, 30] * 1 + [40, 50, 60] + [70, 80, 90])))
    assert (r.palette >> 8).tolist() == [[10, 40, 70], [20, 50, 80], [30, 60, 90]] and r.title == "title"
    assert ok(fbm_file(3, 2, 3, 8, [GRAY, GRAY[::-1], bytes(6)])).pixels[0, 0].tolist() == [0, 255, 0]


def test_sun():
    head = lambda w, h, d, kind, m=0, n=0: struct.pack(">8I", 0x59A66A95, w, h, d, 0, kind, m, n)
    assert ok(head(3, 1, 1, 1) + bytes([0b10100000, 0]), kind="sun").pixels.tolist() == [[1, 0, 1]]
    assert levels(ok(head(3, 2, 8, 1) + bytes([0, 51, 102, 9, 153, 204, 255, 9]))) == [[0, 51, 102], [153, 204, 255]]
    assert ok(head(2, 1, 8, 1, 1, 6) + bytes([1, 2, 3, 4, 5, 6]) + bytes([1, 0])).palette.tolist() == [[256, 768, 1280], [512, 1024, 1536]]
    assert ok(head(4, 1, 8, 2) + bytes([128, 2, 7, 128, 0])).pixels.tolist() == [[7, 7, 7, 128]]
    assert ok(head(1, 1, 24, 1) + bytes([3, 2, 1, 0])).pixels.tolist() == [[[1, 2, 3]]]
    assert ok(head(1, 1, 24, 3) + bytes([1, 2, 3, 0])).pixels.tolist() == [[[1, 2, 3]]]
    assert ok(head(1, 1, 32, 1) + bytes([9, 3, 2, 1])).pixels.tolist() == [[[1, 2, 3]]]


def test_cmu():
    assert ok(struct.pack(">IIIH", 0xF10040BB, 9, 1, 1) + bytes([0b01010101, 0x7F]), kind="cmu").pixels.tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1]]


def test_pnm():
    assert ok(b"P1 # note\n3 2\n1 0 1\n010", kind="pnm").pixels.tolist() == [[1, 0, 1], [0, 1, 0]]
    assert ok(b"P4\n9 1\n\xaa\x80").pixels.tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1]]
    assert ok(struct.pack(">HHH", 0x2A17, 3, 1) + b"\xa0").pixels.tolist() == [[1, 0, 1]]
    assert levels(ok(b"P2\n3 1 15\n0 7 15")) == [[0, 119, 255]]
    r = ok(b"P5 2 2 255\n" + bytes([0, 1, 2, 3]))
    assert levels(r) == [[0, 1], [2, 3]] and r.gamma == 1.0
    assert levels(ok(b"P5 2 1 65535\n" + struct.pack(">2H", 65535, 32768))) == [[255, 127]]
    assert ok(b"P3 1 1 15 15 0 7").pixels.tolist() == [[[255, 0, 119]]]
    assert ok(b"P6\n1 1\n255\n\x01\x02\x03").pixels.tolist() == [[[1, 2, 3]]]


def test_faces():
    r = ok(b"FirstName: Ada\nLastName: B\nPicData: 2 2 8\nImage: 2 2 8\n\n0102\n03ff\n", kind="faces")
    assert levels(r) == [[3, 255], [1, 2]] and r.title == "Ada B"
    assert ok(b"PicData: 4 1 4\n\n0f 5A\n").pixels.tolist() == [[0, 15, 5, 10]]


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_file(w, h, depth, colour, raw, *more, interlace=0):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png():
    assert ok(png_file(3, 1, 1, 0, b"\0\xa0"), kind="png").pixels.tolist() == [[0, 1, 0]]
    assert levels(ok(png_file(4, 1, 2, 0, b"\0\x1b"))) == [[0, 85, 170, 255]]
    assert levels(ok(png_file(2, 1, 16, 0, b"\0\x12\x34\xff\0"))) == [[0x12, 0xFF]]
    r = ok(png_file(2, 1, 8, 3, b"\0\1\0", chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])), chunk(b"gAMA", struct.pack(">I", 45455)), chunk(b"tEXt", b"Title\0Name")))
    assert (r.palette >> 8).tolist() == [[1, 2, 3], [4, 5, 6]] and abs(r.gamma - 2.2) < 1e-4 and r.title == "Name"
    # the four filters, on two rows of two true colour pixels
    rows = np.array([[10, 20, 30, 40, 50, 60], [70, 80, 90, 15, 25, 35], [1, 2, 3, 4, 5, 6], [200, 100, 50, 25, 12, 6]], np.uint8)
    raw = b"\1" + bytes(rows[0, :3]) + bytes(rows[0, 3:] - rows[0, :3]) + b"\2" + bytes(rows[1] - rows[0])
    left = np.concatenate(([0, 0, 0], rows[2, :3])).astype(int)
    raw += b"\3" + bytes((rows[2] - (left + rows[1]) // 2).astype(np.uint8))
    paeth = []
    for x in range(6):
        a, b, d = (int(rows[3, x - 3]), int(rows[2, x]), int(rows[2, x - 3])) if x > 2 else (0, int(rows[2, x]), 0)
        paeth.append(min((abs(v - (a + b - d)), k, v) for k, v in enumerate((a, b, d)))[2])
    raw += b"\4" + bytes((rows[3].astype(int) - paeth).astype(np.uint8))
    assert ok(png_file(2, 4, 8, 2, raw)).pixels.reshape(4, 6).tolist() == rows.tolist()
    # alpha over a given background, and over the file's own
    half = png_file(1, 1, 8, 6, b"\0" + bytes([200, 100, 0, 128]))
    assert ok(half, context=Context(background=(65535,) * 3)).pixels.tolist() == [[[227, 177, 127]]]
    assert ok(png_file(1, 1, 8, 4, b"\0\x64\0", chunk(b"bKGD", struct.pack(">H", 50)))).pixels[0, 0, 0] in (49, 50)
    clear = png_file(2, 1, 8, 0, b"\0\5\6", chunk(b"tRNS", struct.pack(">H", 5)))
    assert ok(clear).pixels[..., 0].tolist() == [[0, 6]]


def test_png_interlaced():
    values = np.arange(45, dtype=np.uint8).reshape(5, 9)
    raw = b"".join(b"\0" + values[y, x0::dx].tobytes() for x0, y0, dx, dy in coded.ADAM7 for y in range(y0, 5, dy) if len(values[y, x0::dx]))
    assert levels(ok(png_file(9, 5, 8, 0, raw, interlace=1))) == values.tolist()


def lzw(values, least):
    """Codes of a growing table, packed low bits first."""
    table = {bytes([k]): k for k in range(1 << least)}
    bits, width, count = [], least + 1, (1 << least) + 2
    emit = lambda code: bits.extend(code >> k & 1 for k in range(width))
    emit(1 << least)
    have = b""
    for v in values:
        more = have + bytes([v])
        if more in table:
            have = more
            continue
        emit(table[have])
        table[more] = count
        count += 1
        if count > 1 << width and width < 12:
            width += 1
        have = bytes([v])
    emit(table[have])
    emit((1 << least) + 1)
    return np.packbits(np.pad(bits, (0, -len(bits) % 8)), bitorder="little").tobytes()


def gif_file(w, h, values, interlaced=False, aspect=0):
    data = lzw(values, 2)
    blocks = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, aspect) + table + b"\x21\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<4HB", 0, 0, w, h, 64 * interlaced) + b"\2" + blocks + b"\0;"


def test_gif():
    values = np.random.default_rng(1).integers(0, 4, 20 * 11)
    assert ok(gif_file(20, 11, values.tolist()), kind="gif").pixels.ravel().tolist() == values.tolist()
    rows = values.reshape(11, 20)
    order = [0, 8, 4, 2, 6, 10, 1, 3, 5, 7, 9]
    assert ok(gif_file(20, 11, rows[order].ravel().tolist(), True)).pixels.tolist() == rows.tolist()
    whole = gif_file(20, 11, values.tolist())
    part = ok(whole[:60], status="partial")
    assert part.pixels.shape == (11, 20)
    assert decoded("x", gif_file(4, 4, [1] * 16, aspect=113)).zoom == (200, 100)


def jpeg_file(plane, colours=1, restart=0):
    """DC and first AC coefficients alone, quantised by 1, in blocks of one value or a slope."""
    out = b"\xff\xd8\xff\xdb\0\x43\0" + b"\x08" * 64
    h, w = plane.shape
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * colours, 8, h, w, colours) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(colours))
    dc = bytes([0, 0, 0, 12] + [0] * 12)  # twelve codes of four bits: sizes 0 to 11
    out += b"\xff\xc4" + struct.pack(">H", 19 + 12) + b"\0" + dc + bytes(range(12))
    out += b"\xff\xc4" + struct.pack(">H", 19 + 1) + b"\x10" + bytes([1] + [0] * 15) + b"\0"  # one code: end of block
    if restart:
        out += b"\xff\xdd\0\4" + struct.pack(">H", restart)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * colours, colours) + b"".join(bytes([k + 1, 0]) for k in range(colours)) + b"\0\x3f\0"
    bits, last, count, parts = "", [0] * colours, 0, []
    for by in range(0, h, 8):
        for bx in range(0, w, 8):
            if restart and count and count % restart == 0:
                parts.append(bits)
                bits, last = "", [0] * colours
            count += 1
            for k in range(colours):
                value = int(plane[by, bx]) - 128 if k == 0 else 0
                d, last[k] = value - last[k], value
                size = abs(d).bit_length()
                bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    parts.append(bits)
    segments = [int(b + "1" * (-len(b) % 8), 2).to_bytes(-(-len(b) // 8)).replace(b"\xff", b"\xff\0") for b in parts]
    return out + b"".join(s + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(segments) else b"") for k, s in enumerate(segments)) + b"\xff\xd9"


def test_jpeg():
    plane = np.repeat(np.repeat(np.array([[0, 200, 55], [255, 128, 1]]), 8, axis=0), 8, axis=1)
    r = ok(jpeg_file(plane), kind="jpeg")
    assert r.type == RGB and r.gamma == 2.2 and levels(r) == plane.tolist()
    colour = ok(jpeg_file(plane, 3, restart=2))
    assert colour.type == TRUE and colour.pixels[..., 1].tolist() == plane.tolist()
    small = ok(jpeg_file(plane), context=Context(iscale=3))
    assert levels(small) == [[0, 200, 55], [255, 128, 1]]
    assert decoded("x", b"\xff\xd8\xff\xc9\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0").status == "error"  # arithmetic coding
    assert decoded("x", b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0").status == "error"  # no scan


class JpegBits:
    """Writes symbols by one plain table: 128 codes of 8 bits, 128 of 9."""

    TABLE = bytes([0] * 7 + [128, 128] + [0] * 7) + bytes(range(256))

    def __init__(self):
        self.bits = ""

    def symbol(self, v):
        self.bits += f"{v:08b}" if v < 128 else f"{128 + v:09b}"

    def number(self, v, n):
        self.bits += f"{v:0{n}b}" if n else ""

    def signed(self, v):
        n = abs(v).bit_length()
        self.number(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        padded = self.bits + "1" * (-len(self.bits) % 8)
        return (int(padded, 2).to_bytes(len(padded) // 8) if padded else b"").replace(b"\xff", b"\xff\0")


def jpeg_coded(size, parts, scans, progressive):
    """parts: (sampling across, down, blocks: rows x columns x 64 along the diagonals); scans: (numbers of parts, first, last, before, bit)."""
    w, h = size
    out = b"\xff\xd8\xff\xdb\0\x43\0" + b"\1" * 64 + bytes([0xFF, 0xC2 if progressive else 0xC0]) + struct.pack(">HBHHB", 8 + 3 * len(parts), 8, h, w, len(parts))
    out += b"".join(bytes([k + 1, p[0] << 4 | p[1], 0]) for k, p in enumerate(parts))
    for kind in (0, 16):
        out += b"\xff\xc4" + struct.pack(">H", 19 + 256) + bytes([kind]) + JpegBits.TABLE
    top_x, top_y = max(p[0] for p in parts), max(p[1] for p in parts)
    for which, first, last, before, bit in scans:
        out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(which), len(which)) + b"".join(bytes([k + 1, 0]) for k in which) + bytes([first, last, before << 4 | bit])
        code, dc, run, held = JpegBits(), {k: 0 for k in which}, [0], [""]

        def flush(code=code, run=run, held=held):
            if run[0]:
                n = run[0].bit_length() - 1
                code.symbol(n << 4)
                code.number(run[0] - (1 << n), n)
                code.bits += held[0]
                run[0], held[0] = 0, ""

        if len(which) == 1:
            sx, sy, blocks = parts[which[0]]
            rows, columns = -(-(-(-h * sy // top_y)) // 8), -(-(-(-w * sx // top_x)) // 8)
            units = [(which[0], blocks[y, x]) for y in range(rows) for x in range(columns)]
        else:
            rows, columns = -(-h // (8 * top_y)), -(-w // (8 * top_x))
            units = [(k, parts[k][2][y * parts[k][1] + b // parts[k][0], x * parts[k][0] + b % parts[k][0]]) for y in range(rows) for x in range(columns) for k in which for b in range(parts[k][0] * parts[k][1])]
        for k, block in units:
            c = [int(v) for v in block]
            if first == 0:
                if before:
                    code.number(c[0] >> bit & 1, 1)
                else:
                    value = c[0] >> bit
                    code.symbol(abs(value - dc[k]).bit_length())
                    code.signed(value - dc[k])
                    dc[k] = value
                if progressive:
                    continue
            zeros, corrections = 0, ""
            small = [abs(v) >> bit for v in c]
            new = [i for i in range(64) if small[i] == 1]
            for i in range(max(first, 1), last + 1):
                if not small[i]:
                    zeros += 1
                    continue
                while zeros > 15 and (not before or new and i <= new[-1]):
                    flush()
                    code.symbol(0xF0)
                    code.bits += corrections
                    zeros, corrections = zeros - 16, ""
                if before and small[i] > 1:
                    corrections += str(small[i] & 1)
                    continue
                flush()
                code.symbol(zeros << 4 | small[i].bit_length())
                if before:
                    code.number(int(c[i] > 0), 1)
                    code.bits += corrections
                else:
                    code.signed(small[i] if c[i] > 0 else -small[i])
                zeros, corrections = 0, ""
            if zeros or corrections:
                if not progressive:
                    code.symbol(0)
                else:
                    run[0], held[0] = run[0] + 1, held[0] + corrections
                    if run[0] == 5:
                        flush()
        flush()
        out += code.data()
    return out + b"\xff\xd9"


def test_jpeg_scans_of_every_kind():
    """The same coefficients in one scan, in a scan a component, and in progressive scans with runs and refinement."""
    rng = np.random.default_rng(8)
    for size, sampling in (((21, 18), [(2, 2), (1, 1), (1, 1)]), ((30, 9), [(2, 1), (1, 1), (1, 1)]), ((17, 20), [(1, 1)])):
        top_x, top_y = max(s[0] for s in sampling), max(s[1] for s in sampling)
        across, down = -(-size[0] // (8 * top_x)), -(-size[1] // (8 * top_y))
        parts = []
        for k, (sx, sy) in enumerate(sampling):
            blocks = np.where(rng.random((down * sy, across * sx, 64)) < 0.12, rng.integers(-40, 41, (down * sy, across * sx, 64)), 0)
            blocks[0, 0, 1:] = 0
            blocks[..., 0] = rng.integers(-300, 300, blocks.shape[:2])
            # what no scan of one component has isn't part of the picture
            blocks[-(-(-(-size[1] * sy // top_y)) // 8) :] = 0
            blocks[:, -(-(-(-size[0] * sx // top_x)) // 8) :] = 0
            parts.append((sx, sy, blocks))
        all_ = tuple(range(len(parts)))
        plain = ok(jpeg_coded(size, parts, [(all_, 0, 63, 0, 0)], False), kind="jpeg")
        # by hand: inverse transform of the first component
        basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
        zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
        if len(parts) == 1:
            first = np.zeros((8, 8))
            for (u, v), value in zip(zigzag, parts[0][2][0, 1], strict=True):
                first += value * np.outer(basis[u], basis[v])
            assert levels(plain)[0][8:16] == np.clip(np.round(first + 128), 0, 255).astype(int)[0].tolist()
        alone = [((k,), 0, 63, 0, 0) for k in all_]
        steps = [(all_, 0, 0, 0, 1)] + [((k,), 1, 5, 0, 2) for k in all_] + [((k,), 6, 63, 0, 2) for k in all_] + [((k,), 1, 63, 2, 1) for k in all_] + [(all_, 0, 0, 1, 0)] + [((k,), 1, 63, 1, 0) for k in reversed(all_)]
        for scans, progressive in ((alone, False), (steps, True)):
            again = ok(jpeg_coded(size, parts, scans, progressive))
            assert (again.colours16() == plain.colours16()).all()
        part = ok(jpeg_coded(size, parts, steps, True)[:-60], status="partial")
        assert part.pixels.shape == plain.pixels.shape


def rle_file(w, h, channels, maps, ops, comment=b"", table=b"", back=None):
    flags = (8 if comment else 0) | (0 if back is not None else 2)
    head = struct.pack("<HhhhhBBBBB", 0xCC52, 0, 0, w, h, flags, channels, 8, maps, 8 if maps else 0)
    head += (back + bytes(1 - channels % 2)) if back is not None else b"\0"
    note = struct.pack("<H", len(comment)) + comment + bytes(len(comment) % 2) if comment else b""
    return head + table + note + ops + b"\x07\0"


def test_utah():
    row = lambda k, data: bytes([2, k]) + bytes([5, len(data) - 1]) + data + bytes(len(data) % 2)
    ops = row(0, b"\1\2\3") + b"\1\1" + row(0, b"\4\5\6")
    r = ok(rle_file(3, 2, 1, 0, ops, b"image_gamma=0.5\0"), kind="rle")
    assert levels(r) == [[4, 5, 6], [1, 2, 3]] and r.gamma == 2.0
    three = row(0, b"\1") + row(1, b"\2") + bytes([2, 2, 6, 0, 9, 0])
    assert ok(rle_file(1, 1, 3, 0, three)).pixels.tolist() == [[[1, 2, 9]]]
    table = struct.pack("<768H", *(v << 8 for k in range(3) for v in [(x + k) % 256 for x in range(256)]))
    assert ok(rle_file(1, 1, 1, 3, row(0, b"\7"), table=table)).colours16()[0, 0].tolist() == [7 << 8, 8 << 8, 9 << 8]
    assert ok(rle_file(1, 1, 3, 3, three, table=table)).pixels.tolist() == [[[1, 3, 11]]]
    assert levels(ok(rle_file(4, 1, 1, 0, bytes([2, 0, 3, 2, 6, 0, 5, 0]), back=b"\x11"))) == [[17, 17, 5, 17]]
    assert levels(ok(rle_file(2, 1, 1, 0, bytes([2, 0, 0x46, 0]) + struct.pack("<h", 1) + b"\3\0"))) == [[3, 3]]


def bmp_head(size, w, h, depth, packing=0, colours=b"", body=b"", used=0):
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, packing, 0, 0, 0, used, 0)
    return struct.pack("<2sIII", b"BM", 0, 0, 54 + len(colours)) + info + colours + body


def test_bmp():
    two = bytes([0, 0, 255, 0, 255, 0, 0, 0])
    r = ok(bmp_head(40, 3, 2, 1, colours=two, body=b"\xa0\0\0\0\x40\0\0\0"), kind="bmp")
    assert r.pixels.tolist() == [[0, 1, 0], [1, 0, 1]] and (r.palette >> 8).tolist() == [[255, 0, 0], [0, 0, 255]]
    table = bytes(v for k in range(16) for v in (k, k, k, 0))
    assert levels(ok(bmp_head(40, 3, 1, 4, colours=table, body=b"\x1f\x20\0\0"))) == [[1, 15, 2]]
    assert levels(ok(bmp_head(40, 5, 2, 4, 2, table, bytes([5, 0x12, 0, 0, 0, 3, 0xAB, 0xC0, 0, 1])))) == [[10, 11, 12, 0, 0], [1, 2, 1, 2, 1]]
    wide = bytes(v for k in range(256) for v in (k, k, k, 0))
    assert levels(ok(bmp_head(40, 4, 2, 8, 1, wide, bytes([2, 9, 0, 2, 1, 1, 1, 7, 0, 1])))) == [[0, 0, 0, 7], [9, 9, 0, 0]]
    assert ok(bmp_head(40, 1, 1, 24, body=b"\3\2\1\0")).pixels.tolist() == [[[1, 2, 3]]]
    old = struct.pack("<2sIII", b"BM", 0, 0, 26 + 6) + struct.pack("<IHHHH", 12, 1, 1, 1, 1) + bytes([1, 2, 3, 4, 5, 6]) + b"\x80\0\0\0"
    assert (ok(old).palette >> 8).tolist() == [[3, 2, 1], [6, 5, 4]]


def test_targa():
    head = lambda kind, w, h, d, flags=32, m=(0, 0, 0, 0): struct.pack("<BBBHHBHHHHBB", 0, m[0], kind, m[1], m[2], m[3], 0, 0, w, h, d, flags)
    assert ok(head(2, 2, 1, 24) + bytes([3, 2, 1, 6, 5, 4]), kind="tga").pixels.tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert levels(ok(head(3, 1, 2, 8, 0) + bytes([5, 9]))) == [[9], [5]]
    assert levels(ok(head(11, 5, 1, 8) + bytes([0x82, 7, 1, 8, 9]))) == [[7, 7, 7, 8, 9]]
    r = ok(head(1, 2, 1, 8, 32, (1, 1, 2, 24)) + bytes([3, 2, 1, 6, 5, 4]) + bytes([1, 2]))
    assert (r.colours16() >> 8).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert ok(head(2, 1, 1, 16) + struct.pack("<H", 31 << 10 | 5 << 5 | 2)).pixels.tolist() == [[[31, 5, 2]]]
    assert levels(ok(head(3, 1, 5, 8, 32 | 64) + bytes([0, 2, 4, 1, 3]))) == [[0], [1], [2], [3], [4]]
    assert ok(head(10, 2, 1, 32) + bytes([0x81, 3, 2, 1, 9])).pixels.tolist() == [[[1, 2, 3], [1, 2, 3]]]


def test_mcidas():
    for order in "><":
        words = [0, 4, 20, *[0] * 5, 2, 3, 1, *[0] * 53]
        r = ok(struct.pack(f"{order}64I", *words) + bytes(512) + bytes([0, 1, 2, 3, 4, 254]), kind="mcidas")
        assert levels(r) == [[0, 1, 2], [3, 4, 254]]


def fax_bits(row, first=0):
    out, colour = "", 0
    for run in row:
        codes = {v: k for k, v in coded.RUNS[colour].items()}
        if run > 63:
            out += codes[run // 64 * 64]
        out += codes[run % 64]
        colour = 1 - colour
    return out


@pytest.mark.parametrize("flip", [False, True])
def test_fax(flip):
    rows = [[100, 20, 8], [0, 128], [64, 64], [1] * 128]
    mark = "0" * 11 + "1"
    stream = mark + mark.join(map(fax_bits, rows)) + mark * 6
    data = np.packbits(np.pad([int(b) for b in stream], (0, -len(stream) % 8)), bitorder="little" if flip else "big").tobytes()
    r = ok(data, kind="g3")
    assert r.type == BITMAP and r.pixels.shape == (4, 128)
    assert r.pixels[0].tolist() == [0] * 100 + [1] * 20 + [0] * 8 and r.pixels[1].all() and r.pixels[3].tolist() == [0, 1] * 64


def test_fax_in_odd_places():
    """Rows that begin after other bits, damaged rows, fill between marks, data that ends inside a code."""
    rows = [[100, 28], [0, 128], [64, 64], [2000, 48], [1] * 128]
    mark = "0" * 11 + "1"

    def packed(stream):
        return np.packbits(np.pad([int(b) for b in stream], (0, -len(stream) % 8))).tobytes()

    three = [fax_bits([100, 28])] * 5
    lead = "1" * 5 + mark.join(["1", *three])
    r = decoded("x", packed(lead + mark + mark.join(map(fax_bits, rows)) + mark * 6)).raster
    assert r.height == 2 + len(rows) and r.width == 2048 and r.pixels[0, 100:128].all() and not r.pixels[0, :100].any()
    filled = "".join("0" * (k * 37) + mark + b for k, b in enumerate(three + [fax_bits([0, 128])]))
    r = decoded("x", packed(mark + three[0] + filled + mark * 6)).raster
    assert r.height == 7 and r.pixels[6].all() and r.pixels[5, 100:].all()
    damaged = mark + mark.join([*three, three[0][:9] + "0" * 9 + "1" + three[0], fax_bits([0, 128])]) + mark * 6
    d = decoded("x", packed(damaged))
    assert d.status == "partial" and d.raster.height == 6
    for cut in range(1, 30):
        d = decoded("x", packed((mark + mark.join(three))[:-cut]))
        assert d.format == "g3" and d.raster.height >= 4


@pytest.mark.parametrize("rows", ["d0d2c038e9429fe2", "94ecc60cdeed84a8", "eca99833c9f59a92", "d7d2e63e344d043b"])
def test_gem_files_are_no_faxes(rows):
    """The zeros of a GEM header look like ends of lines, and after them these rows like three rows of a fax."""
    data = struct.pack(">8H", 1, 8, 1, 2, 85, 85, 8, 8) + b"".join(b"\x80\1" + bytes([b]) for b in bytes.fromhex(rows))
    r = ok(data, kind="img")
    assert np.packbits(r.pixels).tobytes() == bytes.fromhex(rows)
    assert told_of(Head("x", lambda at, n: data[at : at + n]))[1].name == "img"


def test_fax_begins_with_whole_rows():
    """No three whole rows of one width at the beginning, right after their marks: no fax."""
    row, mark = fax_bits([3, 5, 8]), "0" * 11 + "1"

    def packed(stream):
        return np.packbits(np.pad([int(b) for b in stream], (0, -len(stream) % 8))).tobytes()

    whole = mark + mark.join([row] * 5) + mark * 6
    assert decoded("x", packed(whole)).format == "g3"
    bad = row + "0" * 9 + "1"
    for stream in (mark + whole, mark + mark.join([row, bad, *[row] * 4]) + mark * 6):
        assert decoded("x", packed(stream)).format != "g3"


def test_large_fax_in_seconds():
    """3300 rows of single pixels, 4 MB and more: no bit is a character."""
    row = fax_bits([1] * 2550)
    stream = ("0" * 11 + "1" + row) * 16
    data = np.packbits(np.frombuffer(stream.encode(), np.uint8) & 1).tobytes() * (3300 // 16)
    data += bytes((8 << 20) + 1 - len(data))
    begun, before = time.monotonic(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    r = decoded("x", data).raster
    assert time.monotonic() - begun < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    assert r.pixels.shape == (3296, 2550) and r.pixels[77].tolist() == [0, 1] * 1275


def test_pcx():
    head = bytearray(128)
    head[:4] = bytes([10, 5, 1, 1])
    struct.pack_into("<4H", head, 4, 0, 0, 8, 1)
    head[65] = 1
    struct.pack_into("<H", head, 66, 2)
    assert ok(bytes(head) + bytes([0xC1, 0xFF, 0x00, 0xC2, 0x00]), kind="pcx").pixels.tolist() == [[0] * 8 + [1], [1] * 9]
    head[3] = 8
    struct.pack_into("<4H", head, 4, 0, 0, 2, 0)
    struct.pack_into("<H", head, 66, 4)
    r = ok(bytes(head) + bytes([0xC2, 7, 9, 0, 12]) + bytes(v for k in range(256) for v in (k, 0, 255 - k)))
    assert (r.colours16() >> 8).tolist() == [[[7, 0, 248], [7, 0, 248], [9, 0, 246]]]


def test_gem():
    head = struct.pack(">8H", 1, 8, 1, 2, 85, 85, 13, 4)
    body = bytes([0, 0, 255, 2, 128, 2, 0xAA, 0xF0]) + bytes([0, 1, 0x11, 0x22]) + bytes([0x81, 0x01])
    r = ok(head + body, kind="img")
    assert r.width == 16 and np.packbits(r.pixels, axis=1).tolist() == [[0xAA, 0xF0], [0xAA, 0xF0], [0x11, 0x22], [0xFF, 0x00]]


def test_macpaint():
    packed = bytes([257 - 72, 0xF0])
    data = bytes(512) + packed * 719 + bytes([71]) + bytes(range(72))
    for extra in (b"", None):
        whole = data if extra == b"" else b"\0\4name".ljust(128, b"\0") + data
        r = ok(whole, kind="mac")
        assert r.pixels.shape == (720, 576) and np.packbits(r.pixels[0]).tolist() == [0xF0] * 72 and np.packbits(r.pixels[719]).tolist() == list(range(72))


def test_xpm():
    three = b'/* XPM */\nstatic char *x[] = {\n"2 2 3 1",\n"a c red m white",\n"b c #00f",\n"c c None g4 gray50",\n"ab",\n"ca"};\n'
    r = ok(three, kind="xpm")
    assert (r.colours16() >> 8).tolist() == [[[255, 0, 0], [0, 0, 255]], [[0, 0, 0], [255, 0, 0]]]
    assert (ok(three, context=Context(xpm="m")).colours16()[0, 0] >> 8).tolist() == [255] * 3
    assert (ok(three, context=Context(background=(65535, 0, 65535))).colours16()[1, 0] >> 8).tolist() == [255, 0, 255]
    one = b'#define x_format 1\n#define x_width 2\n#define x_height 1\n#define x_ncolors 2\n#define x_chars_per_pixel 1\nstatic char *x_colors[] = {\n"a", "#ff0000",\n"b", "blue" };\nstatic char *x_pixels[] = {\n"ba" };\n'
    assert (ok(one).colours16() >> 8).tolist() == [[[0, 0, 255], [255, 0, 0]]]
    assert ok(b"! XPM2\n1 1 1 1\na c #010203\na\n").colours16().tolist() == [[[257, 514, 771]]]


def test_xbm():
    assert ok(b"#define x_width 9\n#define x_height 2\nstatic char x_bits[] = {\n 0x05, 0x01, 0x00, 0x00};\n", kind="xbm").pixels.tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 1], [0] * 9]
    assert ok(b"#define x_width 3\n#define x_height 1\nstatic short x_bits[] = { 0x0006 };\n").pixels.tolist() == [[0, 1, 1]]


@pytest.mark.parametrize("order", "><")
def test_xwd(order):
    big = order == ">"
    head = lambda kind, depth, w, h, bpp, line, n=0, unit=8: struct.pack(f"{order}25I", 100, 7, kind, depth, w, h, 0, int(big), unit, int(big), 8, bpp, line, 3, 0, 0, 0, 8, n, n, 0, 0, 0, 0, 0)
    colours = b"".join(struct.pack(f"{order}IHHHBB", k, k * 1000, 0, 0, 7, 0) for k in range(4))
    assert ok(head(0, 1, 9, 1, 1, 2) + (bytes([0xA0, 0x80]) if big else bytes([5, 1])), kind="xwd").pixels.tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 1]]
    r = ok(head(2, 8, 3, 1, 8, 4, 4) + colours + bytes([3, 1, 2, 0]))
    assert r.colours16()[..., 0].tolist() == [[3000, 1000, 2000]]
    planes = (bytes([0b11000000]), bytes([0b10100000])) if big else (bytes([0b011]), bytes([0b101]))
    assert ok(head(1, 2, 3, 1, 1, 1, 4) + colours + planes[0] + planes[1]).pixels.tolist() == [[3, 2, 1]]
    assert ok(head(2, 16, 1, 1, 16, 2) + struct.pack(f"{order}H", 300)).pixels.tolist() == [[300]]
    four = bytes([0x12, 0x30]) if big else bytes([0x21, 0x03])
    assert ok(head(2, 4, 3, 1, 4, 2) + four).pixels.tolist() == [[1, 2, 3]]


def test_photo_cd():
    data = bytearray(0x2000)
    data[:32] = b"\xff" * 32
    data[0x800:0x807] = b"PCD_IPI"
    pair = bytes([100] * 192) + bytes([182] * 192) + bytes([156] * 96) + bytes([137] * 96)
    r = ok(bytes(data) + pair * 64, kind="pcd")
    assert r.pixels.shape == (128, 192, 3) and r.gamma == 2.05
    # 182 is 255 in the scene, and highlights are bent down: 255 shows as 246
    assert r.pixels[0, 0].tolist() == [140] * 3 and r.pixels[1, 0].tolist() == [246] * 3
    for light, shown in ((168, 235), (169, 237), (170, 237), (171, 239), (182, 246), (185, 248), (199, 251), (214, 253), (235, 254), (236, 255), (255, 255)):
        line = bytes([light] * 384) + bytes([156] * 96) + bytes([137] * 96)
        assert ok(bytes(data) + line * 64).pixels[0, 0].tolist() == [shown] * 3, light
    data[0xE02] = 1
    assert ok(bytes(data) + pair * 64).pixels.shape == (192, 128, 3)


def photo_cd_rows(codes, rows, high):
    """Rows of differences: a mark, plane and row, then codes; the mark of a row past the last ends them."""
    head = lambda plane, y: f"{0xFFFFFE:024b}{ {0: 0, 1: 2, 2: 3}[plane]:02b}{y:013b}0"
    bits = "".join(head(plane, y) + "".join(codes[v] for v in values) for plane, y, values in rows) + head(0, high)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8)


def test_photo_cd_larger_sizes():
    block = 0x800
    codes = {0: "0", 5: "10", -3: "110", 100: "1110"}
    table = bytes([len(codes) - 1]) + b"".join(bytes([len(c) - 1]) + int(c.ljust(16, "0"), 2).to_bytes(2) + (v % 256).to_bytes() for v, c in codes.items())
    data = bytearray(384 * block)
    data[:32] = b"\xff" * 32
    data[0x800:0x807] = b"PCD_IPI"
    pair = bytes([100] * 1536) + bytes([156] * 384) + bytes([137] * 384)
    data[0x30000 : 0x30000 + 256 * len(pair)] = pair * 256
    base = [100] * 1536
    larger = table.rjust(4 * block + len(table), b"\0").ljust(5 * block, b"\0") + bytes(6) + photo_cd_rows(codes, [(0, 3, [5, -3, 0, 100] + [0] * 1532), (0, 1000, [5] * 1536)], 1024)
    whole = bytes(data) + larger.ljust(-(-len(larger) // block) * block, b"\0")
    shown = lambda v: np.floor(v * 255 / 182 + 0.5).astype(int)
    r = ok(whole, context=Context(width=1600, height=1200))
    assert r.pixels.shape == (1024, 1536, 3)
    want = np.array([105, 97, 100, 200] + base[4:])
    assert r.pixels[3, :3, 0].tolist() == shown(want)[:3].tolist() and r.pixels[3, 3, 0] == 251 and (r.pixels[1000] == shown(105)).all() and (r.pixels[4] == shown(100)).all()
    assert ok(whole, context=Context(width=800, height=600)).pixels.shape == (512, 768, 3)
    # the largest: differences of that size twice as large, and of colours
    rows = [(0, 2047, [-3] * 3072), (1, 10, [100] * 1536), (2, 10, [0, 5] + [0] * 1534)]
    more = (table * 3).rjust(12 * block + 3 * len(table), b"\0").ljust(14 * block, b"\0") + photo_cd_rows(codes, rows, 2048)
    r = ok(whole + more, context=Context(width=4000, height=3000))
    assert r.pixels.shape == (2048, 3072, 3)
    assert (r.pixels[2047] == shown(97)).all() and r.pixels[2000:2002, 0, 0].tolist() == [147, 144]  # 105, and between it and 100
    assert r.pixels[20, 8].tolist() == [140, 113, 251] and r.pixels[20, 2].tolist() == [147, 110, 251]
    # cut off: the size is there, its differences in part
    assert ok(whole[: 389 * block + 200], context=Context(width=1600, height=1200), status="partial").pixels.shape == (1024, 1536, 3)
    assert ok(bytes(data), context=Context(width=1600, height=1200), status="partial").pixels.shape == (1024, 1536, 3)


@pytest.mark.parametrize("form", sorted(ENCODERS))
def test_written_files_come_back(form):
    r = true(np.random.default_rng(2).integers(0, 256, (5, 7, 3)))
    assert (ok(ENCODERS[form](r)).pixels == r.pixels).all()


def test_bad_files_are_rows_with_a_status():
    r = true(np.random.default_rng(2).integers(0, 256, (5, 7, 3)))
    assert decoded("x", b"").status == "unknown"
    assert decoded("x", b"no image at all, only words").status == "unknown"
    for form, encode in ENCODERS.items():
        d = decoded("x", encode(r)[:-20])
        assert d.status == "partial" and d.raster.pixels.shape == (5, 7, 3), form
    assert decoded("x", b"P6 0 5 255\n").status == "error"
    assert decoded("x", b"P6 99999 99999 255\n").status == "error"
    rng = np.random.default_rng(4)
    starts = [b"P5 ", b"GIF89a", b"\xff\xd8\xff", b"BM", b"\x89PNG\r\n\x1a\n", b"%bitmap\0", b"\x0a\x05\x01\x08", struct.pack("<H", 0xCC52), struct.pack(">I", 0x59A66A95), b"/* XPM */\n", b"\0\1\0\x08"]
    for s in starts:
        for n in (0, 10, 200, 3000):
            assert decoded("x", s + rng.bytes(n)).status in ("ok", "partial", "error", "unknown")


def test_wrappers():
    pgm = b"P5 2 2 255\n" + bytes([0, 1, 2, 3])
    lines = b"begin 644 x.pgm\n" + b"".join(__import__("binascii").b2a_uu(pgm[k : k + 45]) for k in range(0, len(pgm), 45)) + b"`\nend\n"
    for name, data in (("a.pgm", pgm), ("a.pgm.gz", gzip.compress(pgm)), ("a.pgm.bz2", bz2.compress(pgm)), ("mail.uu", b"Subject: x\n\n" + lines), ("a.uu.gz", gzip.compress(lines))):
        assert levels(ok(data, name)) == [[0, 1], [2, 3]], name
    assert unwrapped("x", pgm) == pgm
    # members one after the other are one file; what isn't a member is left out, a lost end is partial
    for pack in (gzip.compress, bz2.compress):
        assert unwrapped("x", pack(pgm[:7]) + pack(pgm[7:]) + pack(b"")) == pgm
        assert unwrapped("x", pack(pgm) + b"junk") == pgm
        assert unwrapped("x", pack(pgm[:11]) + pack(pgm[11:])[:6]) == pgm[:11]
        with pytest.raises(Broken):
            unwrapped("x", pack(bytes(1000)) + pack(bytes(1000)), most=1999)
        assert len(unwrapped("x", pack(bytes(1000)) + pack(bytes(1000)), most=2000)) == 2000
    assert decoded("x.gz", gzip.compress(pgm[:11]) + gzip.compress(pgm[11:])[:6]).status == "partial"


def compressed(data, most=12, blocks=128):
    """Codes as .Z files have them: 9 bits and more, padded to eight codes where the width grows."""
    table, bits, width, count, have, start = {bytes([k]): k for k in range(256)}, [], 9, 257 if blocks else 256, b"", 0

    def emit(code):
        bits.extend(code >> k & 1 for k in range(width))

    for v in data:
        more = have + bytes([v])
        if more in table:
            have = more
            continue
        emit(table[have])
        if count < 1 << most:
            table[more] = count
            count += 1
            if count > 1 << width and width < most:
                bits.extend([0] * (-(len(bits) - start) % (8 * width)))
                width, start = width + 1, len(bits)
        have = bytes([v])
    emit(table[have])
    return b"\x1f\x9d" + bytes([most | blocks]) + np.packbits(np.pad(bits, (0, -len(bits) % 8)), bitorder="little").tobytes()


def test_old_compression():
    rng = np.random.default_rng(1)
    for data in (b"a", b"abababababababab" * 9, rng.integers(0, 5, 5000).astype(np.uint8).tobytes(), rng.bytes(3000)):
        assert lzw_bits(compressed(data)) == data


def test_old_compression_has_a_bound():
    packed = compressed(b"a" * 5000)
    assert len(lzw_bits(packed, 5000)) == 5000
    with pytest.raises(Broken):
        lzw_bits(packed, 4999)


def test_trailing_options():
    body = b"P5 1 1 255\n\x07"
    whole = with_trailing(body, "-rotate 90 -gray", "viewer")
    d = decoded("x", whole)
    assert d.status == "ok" and d.options == "-rotate 90 -gray"
    assert without_trailing(whole) == body and with_trailing(whole, "-zoom 50") == with_trailing(body, "-zoom 50")
    assert decoded("x", body + b"junk" * 10).options is None
    assert trailing_options(whole.replace(b"0016", b"0015")[len(body) :]) is None
    assert trailing_options(bytes(2000) + whole) is None
    r = ENCODERS["bmp"](true(np.zeros((1, 1, 3))))
    assert decoded("x", with_trailing(r, "-gray")).options is None  # this format carries none


def test_order_and_registration():
    assert [f.name for f in BUILT_IN] == "fbm sun cmu pnm faces png gif jpeg rle bmp pcd xwd tga mcidas g3 pcx img mac xpm xbm".split()
    assert simple.colour_of("#abc") == (0xAAAA, 0xBBBB, 0xCCCC) and simple.colour_of("#808080") == (0x8080,) * 3 and simple.colour_of("#fff") == (65535,) * 3
    assert simple.colour_of("no such") is None and simple.colour_of("LightGrey") == (0xD3D3,) * 3 and simple.colour_of("gray50") == (127 * 257,) * 3
    assert [colour_names()[f"gray{p}"][0] for p in (0, 10, 30, 70, 90, 100)] == [0, 26, 77, 179, 229, 255]
    assert read_names("! comment\n255 250 250\t\tsnow1\n 1 2 3 my colour\nbad line\n") == {"snow1": (255, 250, 250), "my colour": (1, 2, 3)}
