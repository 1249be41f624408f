"""Decoders of formats with little structure: bitmaps, maps of bytes, run lengths, text."""

from __future__ import annotations

import re
import struct

import numpy as np

from ..functions.colour import colour_names
from ..image import Raster, bitmap, gray_ramp, indexed, true
from .stream import Broken, Cursor, NotMine

LIMIT = 1 << 31


def sized(w: int, h: int, depth: int = 1) -> None:
    if w < 1 or h < 1:
        raise Broken(f"a size of {w} x {h}")
    if w * h * depth >= LIMIT:
        raise Broken(f"{w} x {h} is too large")


def bits(data: bytes, w: int, h: int, stride: int | None = None) -> np.ndarray:
    """Rows of bits, first bit first."""
    stride = stride or (w + 7) // 8
    rows = np.frombuffer(data, np.uint8, h * stride).reshape(h, stride)
    return np.unpackbits(rows, axis=1)[:, :w]


def rows_of(data: bytes, w: int, h: int, stride: int | None = None) -> np.ndarray:
    stride = stride or w
    return np.frombuffer(data, np.uint8, h * stride).reshape(h, stride)[:, :w]


def fbm(c: Cursor) -> Raster:
    if c.left < 256 or c.data[:7] != b"%bitmap":
        raise NotMine
    c.take(8)
    try:
        w, h, planes, depth, _ = (int(c.take(8).rstrip(b"\0 ") or 0) for _ in range(5))
        row, plane, colours = (int(c.take(12).rstrip(b"\0 ") or 0) for _ in range(3))
    except ValueError:
        raise NotMine from None
    c.take(12)
    title = c.take(80).split(b"\0")[0].decode("latin-1").strip()
    c.take(80)
    sized(w, h, planes)
    if planes not in (1, 3) or row < w or max(w, h) > 32767:
        raise Broken("fields that don't fit")
    table = rows_of(c.take(colours // 3 * 3), colours // 3, 3).T.astype(np.int64) << 8 if colours >= 3 else gray_ramp(1 << depth) if depth < 8 else np.repeat(np.arange(256)[:, None] << 8, 3, axis=1)
    size = max(plane, row * h)
    levels = [rows_of(c.take(size), w, h, row) for _ in range(planes)]
    if planes == 3:
        return true(np.stack(levels, axis=2), title=title)
    return bitmap(levels[0] == 0, title=title) if depth == 1 else indexed(levels[0], table, title=title)


def sun_rle(c: Cursor, n: int) -> bytes:
    """128 0 is one 128; 128 n v is v n + 1 times."""
    out = bytearray()
    while len(out) < n and c.left:
        b = c.byte()
        if b == 128 and (k := c.byte()):
            out += bytes([c.byte()]) * (k + 1)
        else:
            out.append(b)
    c.short |= len(out) < n
    return bytes(out[:n].ljust(n, b"\0"))


def sun(c: Cursor) -> Raster:
    magic, w, h, depth, _, kind, map_kind, map_size = c.head(">8I")
    if magic != 0x59A66A95:
        raise NotMine
    sized(w, h, 4)
    if depth not in (1, 8, 24, 32) or kind > 3:
        raise Broken(f"depth {depth} of type {kind}")
    table = c.take(map_size)
    line = (w * depth + 7) // 8
    line += line % 2
    data = sun_rle(c, line * h) if kind == 2 else c.take(line * h)
    if depth == 1:
        r = bitmap(bits(data, w, h, line))
        if map_kind == 1 and map_size >= 6:
            r = r.but(palette=rows_of(table, map_size // 3, 3).T[:2].astype(np.int64) << 8)
        return r
    if depth == 8:
        colours = rows_of(table, map_size // 3, 3).T.astype(np.int64) << 8 if map_kind == 1 and map_size >= 3 else np.repeat(np.arange(256)[:, None] << 8, 3, axis=1)
        return indexed(rows_of(data, w, h, line), colours)
    n = depth // 8
    pixels = np.frombuffer(data, np.uint8).reshape(h, line)[:, : w * n].reshape(h, w, n)[..., n - 3 :]
    return true(pixels if kind == 3 else pixels[..., ::-1])


def cmu(c: Cursor) -> Raster:
    magic, w, h, depth = c.head(">IIIH")
    if magic != 0xF10040BB:
        raise NotMine
    sized(w, h)
    if depth != 1:
        raise Broken(f"depth {depth}")
    return bitmap(1 - bits(c.take((w + 7) // 8 * h), w, h))


def pnm_number(c: Cursor) -> int:
    """A number after white space and comments."""
    found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(c.data, c.at)
    if not found:
        raise Broken("a number is missing")
    c.at = found.end()
    return int(found[1])


def pnm(c: Cursor) -> Raster:
    kind = c.data[:2]
    if kind == b"\x2a\x17":
        _, w, h = c.head(">HHH")
        sized(w, h)
        return bitmap(bits(c.take((w + 7) // 8 * h), w, h))
    if not re.match(rb"P[1-6][\s#]", c.data[:3]):
        raise NotMine
    c.at = 2
    form = kind[1] - 48
    w, h = pnm_number(c), pnm_number(c)
    most = 1 if form in (1, 4) else pnm_number(c)
    sized(w, h, 3)
    if not 1 <= most <= 65535:
        raise Broken(f"a largest value of {most}")
    if form == 4:
        c.take(1)
        return bitmap(bits(c.take((w + 7) // 8 * h), w, h))
    n = w * h * (3 if form in (3, 6) else 1)
    if form == 1:  # digits may stand without space between them
        digits = re.sub(rb"#[^\n]*\n|\s", b"", c.data[c.at :])[:n]
        c.at, c.short = len(c.data), len(digits) < n
        return bitmap(np.frombuffer(digits.ljust(n, b"0"), np.uint8).reshape(h, w) == 49)
    if form in (2, 3):
        words = re.sub(rb"#[^\n]*\n", b" ", c.data[c.at :]).split()[:n]
        c.at, c.short = len(c.data), len(words) < n
        values = np.array([int(x) for x in words if x.isdigit()], np.int64)
        values = np.pad(values, (0, max(0, n - len(values))))[:n]
    else:
        c.take(1)
        values = np.frombuffer(c.take(n * (2 if most > 255 else 1)), ">u2" if most > 255 else np.uint8).astype(np.int64)
    values = np.minimum(values, most) * 255 // most if most != 255 else values
    if form in (3, 6):
        return true(values.reshape(h, w, 3))
    return indexed(values.reshape(h, w), np.repeat(np.arange(256)[:, None] * 257, 3, axis=1), gamma=1.0)


def faces(c: Cursor) -> Raster:
    if not re.match(rb"(?:FirstName|LastName|Image|PicData|[A-Za-z-]+):", c.data[:64]):
        raise NotMine
    size, first, last = None, b"", b""
    while line := c.line():
        if line.strip() == b"":
            break
        name, _, value = line.partition(b":")
        if name == b"FirstName":
            first = value.strip()
        elif name == b"LastName":
            last = value.strip()
        elif name == b"PicData":
            size = [int(v) for v in value.split()[:3]]
    if not size or len(size) < 3 or not all(size):
        raise NotMine
    w, h, depth = size
    sized(w, h)
    if depth not in (1, 2, 4, 8):
        raise Broken(f"depth {depth}")
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", c.data[c.at :])
    n = (w * depth // 8) * h
    c.at, c.short = len(c.data), len(digits) < 2 * n
    data = np.frombuffer(bytes.fromhex(digits[: 2 * n].ljust(2 * n, b"0").decode()), np.uint8)
    per = 8 // depth
    values = (data[:, None] >> (8 - depth * (np.arange(per) + 1)) & (1 << depth) - 1).reshape(h, -1)
    ramp = np.repeat((np.arange(1 << depth) * (65536 // (1 << depth)))[:, None], 3, axis=1)
    return indexed(np.pad(values, ((0, 0), (0, w - values.shape[1])))[::-1], ramp, title=b" ".join(x for x in (first, last) if x).decode("latin-1"))


def bmp_rle(c: Cursor, w: int, h: int, nibbles: bool) -> np.ndarray:
    out, x, y = np.zeros((h, w), np.uint8), 0, 0

    def put(values: list[int]) -> None:
        nonlocal x
        for v in values:
            if x < w and y < h:
                out[y, x] = v
            x += 1

    while c.left and y < h:
        n, v = c.byte(), c.byte()
        if n:
            put([(v >> 4, v & 15)[k & 1] if nibbles else v for k in range(n)])
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            return out
        elif v == 2:
            x, y = x + c.byte(), y + c.byte()
        else:
            size = (v + 1) // 2 if nibbles else v
            data = c.take(size + size % 2)
            put([(data[k // 2] >> 4, data[k // 2] & 15)[k & 1] if nibbles else data[k] for k in range(v)])
    c.short |= y < h
    return out


def bmp(c: Cursor) -> Raster:
    magic, _, _, start, info = c.head("<2sIIII")
    if magic != b"BM" or info not in (12, 40):
        raise NotMine
    if info == 12:
        w, h, planes, depth = c.head("<HHHH")
        packing = used = 0
    else:
        w, h, planes, depth, packing, _, _, _, used, _ = c.head("<iiHHIIiiII")
    up, h = h < 0, abs(h)
    sized(w, h, 3)
    if planes != 1 or depth not in (1, 4, 8, 24) or packing not in (0, {4: 2, 8: 1}.get(depth, 0)):
        raise Broken(f"depth {depth}, packing {packing}")
    if depth < 24:
        n = min(used or 1 << depth, 1 << depth)
        step = 3 if info == 12 else 4
        colours = np.frombuffer(c.take(n * step), np.uint8).reshape(n, step)[:, 2::-1].astype(np.int64) << 8
    c.at = max(c.at, start)
    if packing:
        pixels = bmp_rle(c, w, h, depth == 4)
    else:
        line = (w * depth + 31) // 32 * 4
        data = c.take(line * h)
        if depth == 24:
            pixels = np.frombuffer(data, np.uint8).reshape(h, line)[:, : 3 * w].reshape(h, w, 3)[..., ::-1]
        elif depth == 8:
            pixels = rows_of(data, w, h, line)
        else:
            b = bits(data, line * 8, h, line)
            pixels = b[:, :w] if depth == 1 else (b.reshape(h, -1, 4) * [8, 4, 2, 1]).sum(2)[:, :w]
    pixels = pixels if up else pixels[::-1]
    if depth == 24:
        return true(pixels)
    return indexed(pixels, colours) if depth > 1 or len(colours) != 2 else bitmap(pixels).but(palette=colours)


def tga(c: Cursor) -> Raster:
    ident, mapped, kind, first, count, map_bits, x0, y0, w, h, depth, flags = c.head("<BBBHHBHHHHBB")
    rle, base, leave = kind > 8, kind & 7, flags >> 6
    fits = mapped in (0, 1) and kind in (1, 2, 3, 9, 10, 11) and map_bits in (0, 15, 16, 24, 32) and depth in (8, 16, 24, 32) and leave in (0, 1, 2)
    fits = fits and ((mapped == 1 and map_bits > 0) if base == 1 else (mapped == 0 and map_bits == 0)) and not (mapped and depth > 16)
    if not fits or max(first + count, x0 + w, y0 + h) > 65535:
        raise NotMine
    sized(w, h, 3)
    c.take(ident)
    n = (depth + 7) // 8
    if mapped:
        colours = np.zeros((1 << depth, 3), np.int64)
        size = (map_bits + 7) // 8
        entries = np.frombuffer(c.take(count * size), np.uint8).reshape(count, size).astype(np.int64)
        if size == 2:  # 5 bits a channel, kept as they are
            v = entries[:, 0] | entries[:, 1] << 8
            entries = np.stack([v & 31, v >> 5 & 31, v >> 10 & 31], axis=1)
        reach = max(0, min(count, len(colours) - first))
        colours[first : first + reach] = entries[:reach, 2::-1] << 8
    total = w * h
    if rle:
        out, left = [], total
        while left > 0 and c.left:
            b = c.byte()
            k = min(left, (b & 127) + 1)
            out.append(c.take(n) * k if b & 128 else c.take(n * k))
            left -= k
        data = b"".join(out).ljust(total * n, b"\0")
        c.short |= left > 0
    else:
        data = c.take(total * n)
    values = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
    step = (1, 2, 4)[leave]
    order = np.argsort([k for s in range(step) for k in range(s, h, step)], kind="stable")
    values = values[order]
    if not flags & 32:
        values = values[::-1]
    if mapped:
        return indexed(values[..., 0] if n == 1 else values[..., 0] | values[..., 1] << 8, colours, depth=depth)
    if n == 1:
        return indexed(values[..., 0], np.repeat(np.arange(256)[:, None] << 8, 3, axis=1))
    if n == 2:
        v = values[..., 0] | values[..., 1] << 8
        return true(np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=2))
    return true(values[..., 2::-1])


def mcidas(c: Cursor) -> Raster:
    words = c.head(">64I")
    if words[1] != 4:
        words = struct.unpack("<64I", c.data[:256])
    if words[1] != 4 or words[45] > 99999 or words[46] > 999999:
        raise NotMine
    h, w = words[8], words[9]
    sized(w, h)
    if c.left < 512:
        raise NotMine
    c.take(4 * 128)  # navigation
    ramp = np.repeat(np.arange(255)[:, None] * 257, 3, axis=1)
    return indexed(np.minimum(rows_of(c.take(w * h), w, h), 254), ramp, depth=8)


def pcx(c: Cursor) -> Raster:
    head = c.data[:128]
    if len(head) < 128 or head[0] != 10 or head[1] > 5:
        raise NotMine
    x0, y0, x1, y1 = struct.unpack_from("<4H", head, 4)
    w, h, depth, (line,) = x1 - x0 + 1, y1 - y0 + 1, head[3], struct.unpack_from("<H", head, 66)
    sized(w, h)
    if head[65] > 1 or depth not in (1, 8) or line < (w * depth + 7) // 8:
        raise Broken("planes or depth that isn't handled")
    c.at = 128
    out = bytearray()
    while len(out) < line * h and c.left:
        b = c.byte()
        out += bytes([c.byte()]) * (b & 63) if b >= 192 else bytes([b])
    c.short |= len(out) < line * h
    data = bytes(out[: line * h].ljust(line * h, b"\0"))
    if depth == 1:
        return bitmap(1 - bits(data, w, h, line))
    ramp = np.repeat(np.arange(256)[:, None] * 257, 3, axis=1)
    if not c.left or c.byte() != 12:
        c.short = True
    else:
        ramp = np.frombuffer(c.take(768), np.uint8).reshape(256, 3).astype(np.int64) << 8
    return indexed(rows_of(data, w, h, line), ramp)


def gem(c: Cursor) -> Raster:
    version, size, colours, pattern, pixel_w, pixel_h, w, h = c.head(">8H")
    if version != 1 or size < 8 or colours > 256 or not pixel_w or not pixel_h or not w or not 1 <= h <= 8192 or pattern > 255:
        raise NotMine
    if colours != 1:
        raise Broken("colours")
    w = (w + 7) // 8 * 8
    c.take(2 * (size - 8))
    line, rows, row, repeat = w // 8, [], bytearray(), 1
    while len(rows) < h and c.left:
        b = c.byte()
        if b == 0:
            n = c.byte()
            if n == 0:
                if row or c.byte() != 255:
                    break
                repeat = c.byte()
                continue
            row += c.take(pattern) * n
        elif b == 128:
            row += c.take(c.byte())
        else:
            row += (b"\xff" if b & 128 else b"\0") * (b & 127)
        while len(row) >= line:
            rows += [bytes(row[:line])] * max(1, repeat)
            del row[:line]
            repeat = 1
    c.short |= len(rows) < h
    return bitmap(bits(b"".join(rows[:h]).ljust(line * h, b"\0"), w, h))


def packbits(c: Cursor, n: int) -> bytes:
    out = bytearray()
    while len(out) < n and c.left:
        b = c.byte()
        out += c.take(b + 1) if b < 128 else bytes([c.byte()]) * (257 - b)
    c.short |= len(out) < n
    return bytes(out[:n].ljust(n, b"\0"))


def mac(c: Cursor) -> Raster:
    if c.left < 640 or c.data[0] != 0:
        raise NotMine
    if c.data[1] == 0 and (c.data[2:4] not in (b"\0\0", b"\0\2", b"\0\1", b"\0\3")):
        raise NotMine
    c.take(640 if c.data[1] else 512)
    return bitmap(bits(packbits(c, 72 * 720), 576, 720))


def xbm(c: Cursor) -> Raster:
    head = b"".join(c.data.splitlines(keepends=True)[:8])
    w, h = (re.search(rb"#define\s+(?:\w*_)?%b\s+(\d+)" % k, head) for k in (b"width", b"height"))
    found = re.search(rb"(short|char)\s+\w*\[\s*\w*\s*\]\s*=\s*\{", c.data)
    if not w or not h or not found:
        raise NotMine
    w, h = int(w[1]), int(h[1])
    sized(w, h)
    size = 2 if found[1] == b"short" else 1
    line = (w + 8 * size - 1) // (8 * size)
    end = c.data.find(b"}", found.end())
    values = [int(v, 16) for v in re.findall(rb"0[xX]([0-9a-fA-F]+)", c.data[found.end() : end if end >= 0 else None])]
    c.at = len(c.data) if end < 0 else end + 1
    c.short = len(values) < line * h
    values = np.array((values + [0] * (line * h))[: line * h], np.uint32)
    b = (values[:, None] >> np.arange(8 * size, dtype=np.uint32) & 1).reshape(h, -1)
    return bitmap(b[:, :w])


def colour_of(spec: str) -> tuple[int, int, int] | None:
    """16-bit channels of a colour by digits or name."""
    s = spec.strip().lower()
    if found := re.fullmatch(r"#((?:[0-9a-f]{3}){1,4})", s):
        n = len(found[1]) // 3
        v = [int(found[1][k * n : k * n + n], 16) for k in range(3)]
        return tuple(x * 65535 // ((1 << 4 * n) - 1) for x in v)
    rgb = colour_names().get(s)
    return rgb and tuple(v * 257 for v in rgb)


def xpm(c: Cursor, context: str = "c", background: tuple[int, int, int] = (0, 0, 0)) -> Raster:
    head = b"".join(c.data.splitlines(keepends=True)[:8])
    if not re.search(rb"#define\s+\w*_format|/\*\s*XPM\s*\*/|!\s*XPM2", head):
        raise NotMine
    plain = re.sub(rb"/\*.*?\*/", b"", c.data, flags=re.S)
    if head.lstrip().startswith(b"!"):
        strings = [x.decode("latin-1") for x in c.data.splitlines()[1:] if x.strip()]
    else:
        strings = [x.decode("latin-1") for x in re.findall(rb'"((?:[^"\\]|\\.)*)"', plain)]
    fields = {k: re.search(rb"#define\s+\w*_%b\s+(\d+)" % k, plain) for k in (b"width", b"height", b"ncolors", b"chars_per_pixel")}
    if all(fields.values()):
        w, h, n, chars = (int(f[1]) for f in fields.values())
        pairs = strings[: 2 * n]
        entries = [(pairs[k], f"c {pairs[k + 1]}") for k in range(0, len(pairs) - 1, 2)]
        rows = strings[2 * n :]
    else:
        if not strings:
            raise Broken("no strings")
        w, h, n, chars = (int(v) for v in strings[0].split()[:4])
        entries = [(s[:chars], s[chars:]) for s in strings[1 : n + 1]]
        rows = strings[n + 1 :]
    sized(w, h)
    order = ("m", "g4", "g", "c")
    start = order.index(context)
    palette, place = [], {}
    for k, (symbol, text) in enumerate(entries):
        found = dict(re.findall(r"(?:^|\s)(m|s|g4|g|c)\s+(.+?)(?=\s+(?:m|s|g4|g|c)\s|$)", text))
        # the context asked for, then richer ones, then poorer ones
        spec = next((found[o] for o in (*order[start:], *order[:start][::-1]) if o in found), "black")
        palette.append(background if spec.strip().lower() == "none" else colour_of(spec) or (0, 0, 0))
        place[symbol] = k
    pixels = np.zeros((h, w), np.int64)
    c.short = len(rows) < h
    for y, row in enumerate(rows[:h]):
        for x in range(min(w, len(row) // chars)):
            pixels[y, x] = place.get(row[x * chars : x * chars + chars], 0)
    c.at = len(c.data) if b"}" not in c.data else c.data.rfind(b"}") + 1
    return indexed(pixels, np.array(palette or [(0, 0, 0)]))


def xwd(c: Cursor) -> Raster:
    form, h = ">", c.head(">25I")
    if h[1] != 7:
        form, h = "<", struct.unpack("<25I", c.data[:100])
    if h[1] != 7 or h[0] < 100 or h[2] > 2 or h[13] > 5:
        raise NotMine
    kind, depth, w, height, offset, byte_order, unit, bit_order, _, bpp, line, visual = h[2:14]
    sized(w, height)
    if visual > 3 and kind != 0 or depth > 16:
        raise Broken("direct colours")
    c.at = h[0]
    n = h[19]
    colours = np.zeros((max(n, 1 << depth), 3), np.int64)
    for _ in range(n):
        pixel, r, g, b, _, _ = struct.unpack(form + "IHHHBB", c.take(12))
        if pixel < len(colours):
            colours[pixel] = r, g, b
    unit = unit // 8 if unit > 7 else unit or 1

    def planes(rows: bytes, line: int) -> np.ndarray:
        raw = np.frombuffer(rows, np.uint8).reshape(height, line)
        if (byte_order == 0) != (bit_order == 0) and unit > 1:  # bytes of a unit stand the other way round
            whole = line // unit * unit
            raw = np.hstack([raw[:, :whole].reshape(height, -1, unit)[..., ::-1].reshape(height, whole), raw[:, whole:]])
        return np.unpackbits(raw, axis=1, bitorder="little" if bit_order == 0 else "big")[:, offset : offset + w]

    line = line or (w * max(bpp, 1) + 7) // 8
    if kind == 0 or kind == 1 and depth == 1 or kind == 2 and bpp == 1:
        r = bitmap(planes(c.take(line * height), line))
        return r.but(palette=colours[:2]) if n >= 2 else r
    if kind == 1:
        pixels = np.zeros((height, w), np.int64)
        for plane in range(depth - 1, -1, -1):
            pixels |= planes(c.take(line * height), line).astype(np.int64) << plane
    else:
        raw = np.frombuffer(c.take(line * height), np.uint8).reshape(height, line)
        if bpp == 4:
            pair = (raw & 15, raw >> 4) if byte_order == 0 else (raw >> 4, raw & 15)
            pixels = np.stack(pair, axis=2).reshape(height, -1)[:, :w]
        elif bpp == 8:
            pixels = raw[:, :w]
        elif bpp == 16:
            pixels = raw[:, : 2 * w].copy().view("<u2" if byte_order == 0 else ">u2")
        else:
            raise Broken(f"{bpp} bits a pixel")
    return indexed(pixels.astype(np.int64), colours, depth=depth)
