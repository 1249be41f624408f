"""What a file is, from its header alone: size, depth, colours, and a line in its format's own words.

``Head`` reads parts of a file, wherever it lies, and counts what it has read; each format
looks at its fields, walks from part to part where sizes say how far, and never reads
pixels. What isn't in a header (the rows of a fax) is null.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.colour import SENSORS
from ..image import colours_to_depth
from . import coded, simple
from .simple import sized
from .stream import Broken, Cursor, NotMine, unwrapped

Read = Callable[[int, int], bytes]
#: Bytes that are read at once, and those in which a text header must begin.
BLOCK, TEXT = 4096, 8192


@dataclass(frozen=True)
class About:
    width: int | None
    height: int | None
    depth: int
    colours: int | None  # null for true colour
    told: str  # what follows the path


def bitmap(w: int, h: int, told: str) -> About:
    return About(w, h, 1, 2, told)


def mapped(w: int, h: int, colours: int, told: str, depth: int | None = None) -> About:
    return About(w, h, depth or max(1, colours_to_depth(colours)), colours, told)


def true(w: int, h: int, told: str) -> About:
    return About(w, h, 24, None, told)


class Head:
    """Parts of a file by their places. read: (place, number of bytes) -> bytes, fewer at the end.

    A compressed or uuencoded file is undone from its beginning, as far as it is asked for.
    """

    def __init__(self, name: str, read: Read):
        self._read, self._name, self.taken, self._parts = read, name, 0, {}
        first = self._block(0)
        magic = first[:2] in (b"\x1f\x8b", b"\x1f\x9d") or first[:3] == b"BZh" or name.endswith(".bz2") or re.search(rb"(?:^|\n)begin [0-7]{3,4} [^\n]*\n", first)
        self._raw = bytearray(first) if magic else None
        self._plain, self._whole = b"", False

    def _block(self, k: int) -> bytes:
        if k not in self._parts:
            self._parts[k] = self._read(k * BLOCK, BLOCK)
            self.taken += len(self._parts[k])
        return self._parts[k]

    def _unwrapped(self, n: int) -> bytes:
        """At least ``n`` bytes of what a wrapped file holds, if it has them."""
        while len(self._plain) < n and not self._whole:
            if self._plain or len(self._raw) > BLOCK:  # twice as much each time
                more = self._read(len(self._raw), len(self._raw))
                self.taken += len(more)
                self._raw += more
                self._whole = not more
            try:
                self._plain = unwrapped(self._name, bytes(self._raw))
            except (Broken, OSError, EOFError, zlib.error, ValueError, IndexError) as e:
                if self._whole:
                    raise Broken(f"{type(e).__name__}: {e}") from None
            if self._plain == bytes(self._raw) and not self._whole:  # nothing is undone yet
                self._plain = b""
            if len(self._raw) <= BLOCK and len(self._plain) < n:
                more = self._read(len(self._raw), BLOCK)
                self.taken += len(more)
                self._raw += more
                self._whole = not more
        return self._plain

    def at(self, place: int, n: int) -> bytes:
        """The bytes from a place on, fewer where the file ends."""
        if self._raw is not None:
            return self._unwrapped(place + n)[place : place + n]
        blocks = range(place // BLOCK, -(-(place + n) // BLOCK))
        return b"".join(map(self._block, blocks))[place % BLOCK :][:n] if n > 0 else b""

    def fields(self, form: str, place: int = 0) -> tuple:
        """A part in struct's terms; a file that ends before is of another format."""
        n = struct.calcsize(form)
        data = self.at(place, n)
        if len(data) < n:
            raise NotMine
        return struct.unpack(form, data)

    def lines(self, n: int = 8) -> bytes:
        return b"".join(self.at(0, TEXT).splitlines(keepends=True)[:n])

    def found(self, pattern: bytes, place: int = 0, most: int | None = None) -> re.Match | None:
        """The first match after a place, in a text that is read as far as that."""
        compiled, n = re.compile(pattern, re.S), BLOCK
        while True:
            text = self.at(place, n)
            if (match := compiled.search(text)) or len(text) < n or most and n >= most:
                return match
            n *= 2


def fbm(head: Head) -> About:
    if head.at(0, 7) != b"%bitmap" or len(head.at(0, 256)) < 256:
        raise NotMine
    try:
        w, h, planes, depth, _ = (int(head.at(8 + 8 * k, 8).rstrip(b"\0 ") or 0) for k in range(5))
        row, _, colours = (int(head.at(48 + 12 * k, 12).rstrip(b"\0 ") or 0) for k in range(3))
    except ValueError:
        raise NotMine from None
    sized(w, h, planes)
    if planes not in (1, 3) or row < w or max(w, h) > 32767:
        raise Broken("fields that don't fit")
    n = colours // 3 if colours >= 3 else 1 << min(depth, 8)
    told = f" is a {w}x{h} FBM image, depth {depth * planes} with {colours // 3} colors"
    return true(w, h, told) if planes == 3 else bitmap(w, h, told) if depth == 1 else mapped(w, h, n, told)


#: Words for the types of Sun rasters, by number.
SUN_KINDS = ("n old-style", " standard", " run-length encoded", " RGB")


def sun(head: Head) -> About:
    magic, w, h, depth, _, kind, map_kind, map_size = head.fields(">8I")
    if magic != 0x59A66A95:
        raise NotMine
    sized(w, h, 4)
    if depth not in (1, 8, 24, 32) or kind > 3:
        raise Broken(f"depth {depth} of type {kind}")
    own = map_kind == 1 and map_size >= 3
    what = {1: "monochrome", 8: f"8 plane {'color' if map_size else 'greyscale'}", 24: "24 plane color", 32: "32 plane color"}[depth]
    told = f" is a{SUN_KINDS[kind]} {w}x{h} {what} Sun rasterfile"
    return bitmap(w, h, told) if depth == 1 else mapped(w, h, map_size // 3 if own else 256, told) if depth == 8 else true(w, h, told)


def cmu(head: Head) -> About:
    magic, w, h, depth = head.fields(">IIIH")
    if magic != 0xF10040BB:
        raise NotMine
    sized(w, h)
    if depth != 1:
        raise Broken(f"depth {depth}")
    return bitmap(w, h, f" is a {w}x{h} {depth} plane CMU WM raster")


def pnm(head: Head) -> About:
    if head.at(0, 2) == b"\x2a\x17":
        _, w, h = head.fields(">HHH")
        sized(w, h)
        return bitmap(w, h, f" is a {w}x{h} Compact PBM image")
    if not re.match(rb"P[1-6][\s#]", head.at(0, 3)):
        raise NotMine
    form = head.at(1, 1)[0] - 48
    gap, n = rb"(?:\s|#[^\n]*\n)*", 2 if form in (1, 4) else 3
    numbers = head.found(gap + gap.join([rb"(\d+)"] * n) + rb"(?=\s|#|$)", 2)
    if not numbers or numbers.start():
        raise Broken("a number is missing")
    w, h, most = (*map(int, numbers.groups()), 1)[:3]
    sized(w, h, 3)
    if not 1 <= most <= 65535:
        raise Broken(f"a largest value of {most}")
    raw = "Raw" if form > 3 else ""
    if form in (1, 4):
        return bitmap(w, h, f" is a {w}x{h} {raw and 'RawBits '}PBM image")
    told = f" is a {w}x{h} {raw and 'Raw '}{'PGM' if form in (2, 5) else 'PPM'} image with {most + 1} levels"
    return mapped(w, h, 256, told) if form in (2, 5) else true(w, h, told)


def faces(head: Head) -> About:
    if not re.match(rb"(?:FirstName|LastName|Image|PicData|[A-Za-z-]+):", head.at(0, 64)):
        raise NotMine
    found = re.search(rb"(?:^|\n)PicData:\s*(\d+)\s+(\d+)\s+(\d+)", re.split(rb"\n\s*\n", head.at(0, TEXT))[0])
    if not found or not all(map(int, found.groups())):
        raise NotMine
    w, h, depth = map(int, found.groups())
    sized(w, h)
    if depth not in (1, 2, 4, 8):
        raise Broken(f"depth {depth}")
    return mapped(w, h, 1 << depth, f" is a  {w}x{h} {depth}-bit grayscale Faces Project image")


#: Words for the colour types of PNG, by number.
PNG_KINDS = {0: "grayscale", 2: "RGB", 3: "paletted", 4: "grayscale", 6: "RGB"}


def png(head: Head) -> About:
    if head.at(0, 8) != b"\x89PNG\r\n\x1a\n":
        raise NotMine
    found: dict[bytes, bytes] = {}
    sizes, place = {}, 8
    while len(part := head.at(place, 8)) == 8:
        n, kind = struct.unpack(">I4s", part)
        if kind in (b"IDAT", b"IEND"):
            break
        sizes.setdefault(kind, n)
        if kind in (b"IHDR", b"PLTE", b"gAMA", b"bKGD"):
            body = head.at(place + 8, min(n, BLOCK))
            if kind in (b"IHDR", b"PLTE") and head.at(place + 8 + n, 4) != struct.pack(">I", zlib.crc32(kind + body)):
                raise Broken(f"a damaged {kind.decode()}")
            found.setdefault(kind, body)
        place += 12 + n
    if len(found.get(b"IHDR", b"")) < 13:
        raise Broken("no header")
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", found[b"IHDR"][:13])
    sized(w, h, 4)
    if colour not in PNG_KINDS or depth not in (1, 2, 4, 8, 16) or interlace > 1:
        raise Broken(f"colour type {colour}, depth {depth}")
    clear = b"tRNS" in sizes
    told = f" is a{'n interlaced' if interlace else ''} {w}x{h} {depth} bit deep {PNG_KINDS[colour]} PNG image"
    told += (" with an alpha channel" if colour in (4, 6) else "") + (" with transparency" if clear else "")
    if own := found.get(b"bKGD"):
        digits, values = (depth + 3) // 4, [int.from_bytes(own[k : k + 2]) for k in range(0, len(own) - 1, 2)]
        table = found.get(b"PLTE", b"")
        told += ", background = " + (f"index {own[0]}: #{table[3 * own[0] : 3 * own[0] + 3].hex()}" if colour == 3 else "#" + "".join(f"{v:0{digits}x}" for v in values))
    if len(found.get(b"gAMA", b"")) >= 4 and (g := struct.unpack(">I", found[b"gAMA"][:4])[0]):
        told += f", gamma = {g / 100000:g}"
    if colour == 3 and not sizes.get(b"PLTE", 0) // 3:
        raise Broken("no colours")
    if colour in (2, 4, 6) or clear:
        return true(w, h, told)
    if colour == 3:
        return mapped(w, h, sizes[b"PLTE"] // 3, told)
    return bitmap(w, h, told) if depth == 1 else mapped(w, h, min(256, 1 << depth), told)


def gif(head: Head) -> About:
    if head.at(0, 6) not in (b"GIF87a", b"GIF89a"):
        raise NotMine
    (flags,) = head.fields("B", 10)
    place, colours = 13, 0
    if flags & 128:
        colours = 2 << (flags & 7)
        place += 3 * colours
    while mark := head.at(place, 1):
        if mark == b"\x2c":
            break
        if mark != b"\x21":
            raise Broken("no image")
        place += 2
        while (n := head.at(place, 1)) and n[0]:
            place += n[0] + 1
        place += 1
    else:
        raise Broken("no image")
    w, h, local = head.fields("<HHB", place + 5)
    sized(w, h)
    if local & 128:
        colours = 2 << (local & 7)
    if not colours:
        raise Broken("no colours")
    return mapped(w, h, colours, f" is a {w}x{h} {'interlaced ' if local & 64 else ''}{head.at(0, 6).decode()} image with {colours} colors")


#: Words for the colour spaces of JPEG by number of components.
JPEG_SPACES = {1: "Grayscale", 3: "YCbCr"}


def jpeg(head: Head, scale: int = 0) -> About:
    if head.at(0, 2) != b"\xff\xd8":
        raise NotMine
    place = 2
    while len(mark := head.at(place, 2)) == 2:
        if mark[0] != 255 or mark[1] in (0, 1, 255) or 0xD0 <= mark[1] <= 0xD8:
            place += 1
            continue
        if mark[1] in (0xD9, 0xDA):
            break
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            depth, h, w, parts = head.fields(">BHHB", place + 4)
            if mark[1] > 0xC2:
                raise Broken("lossless, hierarchical or arithmetic coding")
            if depth != 8 or parts not in (1, 3):
                raise Broken(f"{depth} bits, {parts} components")
            sized(w, h, 3)
            told = f" is a {w}x{h} JPEG image, color space {JPEG_SPACES[parts]}, {parts} comps., Huffman coding"
            n = 8 >> min(max(scale, 0), 3)
            w, h = -(-w * n // 8), -(-h * n // 8)
            return mapped(w, h, 256, told) if parts == 1 else true(w, h, told)
        place += 2 + head.fields(">H", place + 2)[0]
    raise Broken("no scan")


def utah(head: Head) -> About:
    magic, _, _, w, h, _, channels, depth, maps, _ = head.fields("<HhhhhBBBBB")
    if magic != 0xCC52:
        raise NotMine
    sized(w, h, 4)
    what = {(1, 0): "8 bit grey scale RLE image with no map", (1, 1): "8 bit grey scale RLE image with map", (1, 3): "8 bit color RLE image with color map", (3, 0): "24 bit color RLE image with no map", (3, 3): "24 bit color RLE image with color map"}.get((channels, maps))
    if depth != 8 or what is None:
        raise Broken(f"{channels} channels with {maps} maps")
    told = f" is a {w}x{h} {what}"
    return true(w, h, told) if channels == 3 else mapped(w, h, 256, told)


def bmp(head: Head) -> About:
    magic, _, _, _, info = head.fields("<2sIIII")
    if magic != b"BM" or info not in (12, 40):
        raise NotMine
    packing = used = 0
    if info == 12:
        w, h, planes, depth = head.fields("<HHHH", 18)
    else:
        w, h, planes, depth, packing, _, _, _, used, _ = head.fields("<iiHHIIiiII", 18)
    h = abs(h)
    sized(w, h, 3)
    if planes != 1 or depth not in (1, 4, 8, 24) or packing not in (0, {4: 2, 8: 1}.get(depth, 0)):
        raise Broken(f"depth {depth}, packing {packing}")
    told = f" is a {w}x{h} {depth} bit deep, {'Run length compressed, ' if packing else ''}{'OS/2' if info == 12 else 'Windows'} BMP image"
    n = min(used or 1 << depth, 1 << depth) if depth < 24 else 0
    return true(w, h, told) if depth == 24 else bitmap(w, h, told) if depth == 1 and n == 2 else mapped(w, h, n, told)


def photo_cd(head: Head, width: int = 0, height: int = 0) -> About:
    if head.at(0, 32) != b"\xff" * 32 or head.at(0x800, 7) != b"PCD_IPI":
        raise NotMine
    turn = (head.at(0xE02, 1) or b"\0")[0] & 3
    wide, high = (height, width) if turn in (1, 3) else (width, height)
    sizes = [s[1:3] for s in coded.PCD_SIZES] + [s[:2] for s in coded.PCD_LARGER]
    w, h = next((s for s in reversed(sizes) if s[0] <= wide and s[1] <= high), sizes[0])
    if turn in (1, 3):
        w, h = h, w
    return true(w, h, f" is a {w}x{h} Photograph on CD Image{ {1: ' (On right side)', 3: ' (On left side)'}.get(turn, '')}")


def xwd(head: Head) -> About:
    form, f = "MSB", head.fields(">25I")
    if f[1] != 7:
        form, f = "LSB", head.fields("<25I")
    if f[1] != 7 or f[0] < 100 or f[2] > 2 or f[13] > 5:
        raise NotMine
    kind, depth, w, h, _, byte_order, unit, bit_order, _, bpp, _, visual = f[2:14]
    sized(w, h)
    if visual > 3 and kind or depth > 16:
        raise Broken("direct colours")
    told = f" is a {w}x{h} XWD image in {('XYBitmap', f'{depth} bit XYPixmap', f'{depth} bit ZPixmap')[kind]} {form} header, "
    told += f" {'MSB' if bit_order else 'LSB'} bit, {unit} units," if kind < 2 or depth == 1 else ""
    told += f" {'MSB' if byte_order else 'LSB'} byte order"
    if kind == 0 or kind == 1 and depth == 1 or kind == 2 and bpp == 1:
        return bitmap(w, h, told)
    if kind == 2 and bpp not in (4, 8, 16):
        raise Broken(f"{bpp} bits a pixel")
    return mapped(w, h, max(f[19], 1 << depth), told, depth)


#: Words for the row orders of Targa images and for their types, by number.
TGA_ORDERS = ("", "Two way interleaved ", "Four way interleaved ")
TGA_KINDS = {1: "Pseudo color", 2: "True color", 3: "Gray scale", 9: "Run length encoded pseudo color", 10: "Run length encoded true color", 11: "Run length encoded gray scale"}


def tga(head: Head) -> About:
    ident, has_map, kind, first, count, map_bits, x0, y0, w, h, depth, flags = head.fields("<BBBHHBHHHHBB")
    base, leave = kind & 7, flags >> 6
    fits = has_map in (0, 1) and kind in (1, 2, 3, 9, 10, 11) and map_bits in (0, 15, 16, 24, 32) and depth in (8, 16, 24, 32) and leave in (0, 1, 2)
    fits = fits and ((has_map == 1 and map_bits > 0) if base == 1 else (has_map == 0 and map_bits == 0)) and not (has_map and depth > 16)
    if not fits or max(first + count, x0 + w, y0 + h) > 65535:
        raise NotMine
    sized(w, h, 3)
    told = f" is a {w}x{h} {TGA_ORDERS[leave]}Targa {TGA_KINDS[kind]} image{f' with {count} colors' if has_map else ''}"
    return mapped(w, h, 1 << depth, told, depth) if has_map else mapped(w, h, 256, told) if depth == 8 else true(w, h, told)


def mcidas(head: Head) -> About:
    words = head.fields(">64I")
    if words[1] != 4:
        words = head.fields("<64I")
    if words[1] != 4 or words[45] > 99999 or words[46] > 999999 or len(head.at(0, 512)) < 512:
        raise NotMine
    h, w = words[8], words[9]
    sized(w, h)
    sensor = SENSORS.get(words[2], "Unknown McIDAS format")
    return About(w, h, 8, 255, f" is a McIDAS area, {sensor} {words[45]} {words[46]} ({words[5]}, {words[6]}) ({words[11]}, {words[12]})")


def fax(head: Head) -> About:
    coded.fax_lead(head.at(0, 65536))
    return About(None, None, 1, 2, " is a G3 FAX image.")


def pcx(head: Head) -> About:
    data = head.at(0, 128)
    if len(data) < 128 or data[0] != 10 or data[1] > 5:
        raise NotMine
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    w, h, depth, (line,) = x1 - x0 + 1, y1 - y0 + 1, data[3], struct.unpack_from("<H", data, 66)
    sized(w, h)
    if data[65] > 1 or depth not in (1, 8) or line < (w * depth + 7) // 8:
        raise Broken("planes or depth that isn't handled")
    told = f" is a {w}x{h} PC Paintbrush image"
    return bitmap(w, h, told) if depth == 1 else mapped(w, h, 256, told)


def gem(head: Head) -> About:
    version, size, colours, pattern, pixel_w, pixel_h, w, h = head.fields(">8H")
    if version != 1 or size < 8 or colours > 256 or not pixel_w or not pixel_h or not w or not 1 <= h <= 8192 or pattern > 255:
        raise NotMine
    if colours != 1:
        raise Broken("colours")
    w = (w + 7) // 8 * 8
    return bitmap(w, h, f" is a {w}x{h} GEM Bit Image")


def mac(head: Head) -> About:
    data = head.at(0, 640)
    if len(data) < 640 or data[0] or data[1] == 0 and data[2:4] not in (b"\0\0", b"\0\2", b"\0\1", b"\0\3"):
        raise NotMine
    return bitmap(576, 720, " is a 576x720 MacPaint image")


def xpm(head: Head) -> About:
    first = head.lines()
    if not re.search(rb"#define\s+\w*_format|/\*\s*XPM\s*\*/|!\s*XPM2", first):
        raise NotMine
    named = re.search(rb"#define\s+(\w*)_format", first)
    if named:
        version, title = 1, named[1]
        numbers = [head.found(rb"#define\s+\w*_%b\s+(\d+)\D" % k) for k in (b"width", b"height", b"ncolors")]
        if not all(numbers):
            raise Broken("no size")
        w, h, n = (int(m[1]) for m in numbers)
    else:
        version = 2 if first.lstrip().startswith(b"!") else 3
        declared = re.search(rb"char\s*\*\s*(?:const\s+)?(\w+)\s*\[", head.at(0, TEXT))
        title = declared[1] if declared else b""
        body = rb"\n\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)" if version == 2 else rb'(?:^|[^\\])"\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)'
        numbers = head.found(body)
        if not numbers:
            raise Broken("no strings")
        w, h, n = map(int, numbers.groups()[:3])
    sized(w, h)
    return mapped(w, h, max(1, n), f" is a {w}x{h} X Pixmap image (Version {version}) with {n} colors titled '{title.decode('latin-1')}'")


def xbm(head: Head) -> About:
    first = head.lines()
    w, h = (re.search(rb"#define\s+(?:(\w*)_)?%b\s+(\d+)" % k, first) for k in (b"width", b"height"))
    if not w or not h:
        raise NotMine
    found = head.found(rb"(short|char)\s+\w*\[\s*\w*\s*\]\s*=\s*\{", 0, 1 << 16)
    if not found:
        raise NotMine
    title, w, h = (w[1] or b"").decode("latin-1"), int(w[2]), int(h[2])
    sized(w, h)
    return bitmap(w, h, f" is a {w}x{h} X{'10' if found[1] == b'short' else '11'} bitmap file titled '{title}'")


def whole(decode: Callable[[Cursor], object], head: Head) -> About:
    """By a full decode, for formats that say nothing of their headers."""
    n = BLOCK
    while len(data := head.at(0, n)) == n:
        n *= 2
    r = decode(Cursor(data))
    return About(r.width, r.height, r.depth, r.used or None, f" is a {r.width}x{r.height} image")
