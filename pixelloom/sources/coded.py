"""Decoders of formats with entropy coding: GIF, PNG, JPEG, Utah RLE, fax, Photo CD."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np

from ..image import Raster, bitmap, indexed, true
from ..operators.raster import upsample
from .simple import bits, sized
from .stream import Broken, Cursor, NotMine


def gif_lzw(data: bytes, least: int, n: int) -> tuple[bytes, bool]:
    """At most n indices, and whether they are all there."""
    clear = 1 << least
    table: list[bytes] = []
    out, have, width, held, count, previous = [], 0, least + 1, 0, 0, b""
    for byte in data:
        held |= byte << count
        count += 8
        while count >= width:
            code = held & (1 << width) - 1
            held >>= width
            count -= width
            if code == clear:
                table = [bytes([k]) for k in range(clear)] + [b"", b""]
                width, previous = least + 1, b""
                continue
            if code == clear + 1:
                return b"".join(out)[:n], have >= n
            if not table:  # a stream without its first clear code
                table = [bytes([k]) for k in range(clear)] + [b"", b""]
            if code < len(table):
                entry = table[code]
            elif previous and code == len(table):
                entry = previous + previous[:1]
            else:
                return b"".join(out)[:n], have >= n
            out.append(entry)
            have += len(entry)
            if previous and len(table) < 4096:
                table.append(previous + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            previous = entry
    return b"".join(out)[:n], have >= n


def gif(c: Cursor) -> Raster:
    if c.data[:6] not in (b"GIF87a", b"GIF89a"):
        raise NotMine
    _, _, _, flags, _, aspect = c.head("<6sHHBBB")

    def table(flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        return np.frombuffer(c.take(3 * n), np.uint8).reshape(n, 3).astype(np.int64) << 8

    def blocks() -> bytes:
        parts = []
        while c.left and (n := c.byte()):
            parts.append(c.take(n))
        return b"".join(parts)

    colours = table(flags) if flags & 128 else None
    while c.left:
        mark = c.byte()
        if mark == 0x21:
            c.byte()
            blocks()
        elif mark == 0x2C:
            break
        else:
            raise Broken("no image")
    else:
        raise Broken("no image")
    _, _, w, h, local = struct.unpack("<4HB", c.take(9))
    sized(w, h)
    if local & 128:
        colours = table(local)
    if colours is None:
        raise Broken("no colours")
    least = c.byte()
    if not 1 <= least <= 11:
        raise Broken(f"a code size of {least}")
    data, whole = gif_lzw(blocks(), least, w * h)
    c.short |= not whole
    rows = np.frombuffer(data.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
    if local & 64:
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
        rows = rows[np.argsort(order)]
    r = indexed(np.minimum(rows, len(colours) - 1), colours)
    r.aspect = (aspect + 15) / 64 if aspect and c.data[4:5] == b"9" else 1.0
    return r


ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfiltered(raw: bytes, line: int, h: int, step: int) -> tuple[np.ndarray, int]:
    """Rows with their PNG filters undone, and how many there were bytes for."""
    out, above = np.zeros((h, line), np.uint8), bytes(line)
    for y in range(h):
        row = raw[y * (line + 1) : (y + 1) * (line + 1)]
        if len(row) < line + 1:
            return out, y
        kind, row = row[0], bytearray(row[1:])
        if kind == 1:
            for x in range(step, line):
                row[x] = row[x] + row[x - step] & 255
        elif kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind == 3:
            for x in range(line):
                row[x] = row[x] + ((row[x - step] if x >= step else 0) + above[x] >> 1) & 255
        elif kind == 4:
            for x in range(line):
                a, b, d = (row[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
                p = a + b - d
                pa, pb, pd = abs(p - a), abs(p - b), abs(p - d)
                row[x] = row[x] + (a if pa <= pb and pa <= pd else b if pb <= pd else d) & 255
        elif kind:
            raise Broken(f"row filter {kind}")
        out[y] = np.frombuffer(row, np.uint8)
        above = bytes(row)
    return out, h


def png(c: Cursor, background: tuple[int, int, int] | None = None) -> Raster:
    """background: 16-bit channels that transparency is laid over, before the file's own."""
    if c.take(8) != b"\x89PNG\r\n\x1a\n":
        raise NotMine
    found: dict[bytes, bytes] = {}
    data, title = [], ""
    while c.left >= 8:
        n, kind = struct.unpack(">I4s", c.take(8))
        body = c.take(n)
        if c.short:
            if kind == b"IDAT":
                data.append(body)
            break
        if struct.unpack(">I", c.take(4))[0] != zlib.crc32(kind + body) and kind in (b"IHDR", b"PLTE"):
            raise Broken(f"a damaged {kind.decode('latin-1')}")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"Title\0"):
            title = body[6:].decode("latin-1")
        elif kind == b"IEND":
            break
        found.setdefault(kind, body)
    if len(found.get(b"IHDR", b"")) < 13:
        raise Broken("no header")
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", found[b"IHDR"][:13])
    sized(w, h, 4)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or depth not in (1, 2, 4, 8, 16) or interlace > 1:
        raise Broken(f"colour type {colour}, depth {depth}")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(data))
    except zlib.error:
        raw, c.short = b"", True

    def samples(rows: np.ndarray, w: int) -> np.ndarray:
        h = len(rows)
        if depth == 16:
            return rows.reshape(h, -1, 2).astype(np.int64) @ [256, 1]
        b = rows if depth == 8 else (np.unpackbits(rows, axis=1).reshape(h, -1, depth) * (1 << np.arange(depth)[::-1])).sum(2)
        return b[:, : w * channels].astype(np.int64)

    step = max(1, channels * depth // 8)
    values = np.zeros((h, w, channels), np.int64)
    at = 0
    for x0, y0, dx, dy in ADAM7 if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        line = (pw * channels * depth + 7) // 8
        rows, got = unfiltered(raw[at : at + (line + 1) * ph], line, ph, step)
        c.short |= got < ph
        at += (line + 1) * ph
        values[y0::dy, x0::dx] = samples(rows, pw).reshape(ph, pw, channels)
    most = (1 << depth) - 1
    gamma = None
    if b"gAMA" in found and (g := struct.unpack(">I", found[b"gAMA"][:4])[0]):
        gamma = 100000 / g
    hidden = found.get(b"tRNS")
    if colour == 3:
        table = np.frombuffer(found.get(b"PLTE", b""), np.uint8)
        table = table[: len(table) // 3 * 3].reshape(-1, 3).astype(np.int64)
        if not len(table):
            raise Broken("no colours")
        values = np.minimum(values[..., 0], len(table) - 1)
        if hidden is None:
            return indexed(values, table << 8, gamma=gamma, title=title)
        alpha = np.full(len(table), 255)
        alpha[: len(hidden)] = np.frombuffer(hidden, np.uint8)[: len(table)]
        rgb, alpha = table[values], alpha[values]
    else:
        level = values[..., : channels - (colour in (4, 6))]
        eight = level >> 8 if depth == 16 else level * 255 // most
        alpha = None
        if colour in (4, 6):
            alpha = values[..., -1] >> 8 if depth == 16 else values[..., -1]
        elif hidden is not None:
            clear = np.frombuffer(hidden, ">u2")[: level.shape[2]]
            alpha = np.where((level == clear).all(axis=2), 0, 255)
        if alpha is None and colour == 0:
            if depth == 1:
                return bitmap(1 - values[..., 0], title=title)
            n = min(256, 1 << depth)
            ramp = np.repeat((np.arange(n) * 255 // (n - 1) << 8)[:, None], 3, axis=1)
            return indexed(eight[..., 0] if depth in (8, 16) else values[..., 0], ramp, gamma=gamma, title=title)
        rgb = np.repeat(eight, 3, axis=2) if eight.shape[2] == 1 else eight
    if alpha is not None:
        behind = background
        if behind is None and b"bKGD" in found:
            own = found[b"bKGD"]
            if colour == 3:
                behind = tuple(int(v) << 8 for v in table[min(own[0], len(table) - 1)])
            else:
                v = [x if depth == 16 else x * 65535 // most for x in struct.unpack(f">{len(own) // 2}H", own)]
                behind = tuple(v * 3)[:3] if len(v) == 1 else tuple(v)
        back = np.array(behind or (0, 0, 0)) >> 8
        rgb = (rgb * alpha[..., None] + back * (255 - alpha[..., None]) + 127) // 255
    return true(rgb, gamma=gamma, title=title)


#: A Huffman code's length and value, by the next 16 bits; length 0 where there is none.
Codes = list[tuple[int, int]]


def looked_up(counts: bytes, values: bytes) -> Codes:
    """The table of a JPEG file: how many codes there are of each length, and what they stand for."""
    found, code, k = [(0, 0)] * (1 << 16), 0, 0
    for length, many in enumerate(counts, 1):
        left = 16 - length
        for _ in range(many):
            found[code << left : code + 1 << left] = [(length, values[k])] * (1 << left)
            code, k = code + 1, k + 1
        code <<= 1
    return found


class Bits:
    """Bits of JPEG scans, marker by marker; what is taken beyond their end is zeros, and noted."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end, self.short = data, 0, 8 * len(data), False
        self.window, self.top = 0, 0  # the bits before ``top`` are in the window

    def _next(self, n: int) -> int:
        """The next n bits, at most 16, which aren't taken yet."""
        if self.top - self.at < n:
            byte = self.at >> 3
            self.window, self.top = int.from_bytes(self.data[byte : byte + 8].ljust(8, b"\0")), 8 * byte + 64
        return self.window >> self.top - self.at - n & (1 << n) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self._next(n)
        self.at += n
        self.short |= self.at > self.end
        return value

    def symbol(self, codes: Codes) -> int:
        length, value = codes[self._next(16)]
        if not length:
            raise Broken("a code that no table has")
        self.at += length
        self.short |= self.at > self.end
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def zigzag() -> list[int]:
    """Places of coefficients along the diagonals."""
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 else p[0]))
    return [y * 8 + x if (x + y) % 2 == 0 else y * 8 + x for x, y in cells]


def cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


class Component:
    """A colour component: its sampling, its quantisation table, and its coefficients along the diagonals."""

    def __init__(self, ident: int, sx: int, sy: int, quant: int):
        self.ident, self.sx, self.sy, self.quant, self.last = ident, sx, sy, quant, 0

    def sized(self, w: int, h: int, top_x: int, top_y: int) -> None:
        across, down = -(-w // (8 * top_x)), -(-h // (8 * top_y))
        self.blocks = np.zeros((down * self.sy, across * self.sx, 64), np.int64)
        # blocks that a scan of this component alone has
        self.rows, self.columns = -(-(-(-h * self.sy // top_y)) // 8), -(-(-(-w * self.sx // top_x)) // 8)


class Scan:
    """One scan: which components, which coefficients (first to last), and which of their bits."""

    def __init__(self, parts: list[Component], tables: list[tuple[Codes, Codes]], first: int, last: int, before: int, bit: int, progressive: bool):
        self.parts, self.tables, self.first, self.last, self.bit, self.run = parts, tables, first, last, bit, 0
        self.block = self.whole if not progressive else (self.dc if not before else self.dc_again) if not first else (self.ac if not before else self.ac_again)

    def units(self) -> Iterator[list[tuple[int, Component, int, int]]]:
        """The blocks of each step: all of an interleaved unit, or one of a component by itself."""
        if len(self.parts) == 1:
            p = self.parts[0]
            for y in range(p.rows):
                for x in range(p.columns):
                    yield [(0, p, y, x)]
            return
        down, across = self.parts[0].blocks.shape[0] // self.parts[0].sy, self.parts[0].blocks.shape[1] // self.parts[0].sx
        for y in range(down):
            for x in range(across):
                yield [(k, p, y * p.sy + b // p.sx, x * p.sx + b % p.sx) for k, p in enumerate(self.parts) for b in range(p.sx * p.sy)]

    def read(self, segments: list[bytes], restart: int) -> bool:
        """Decode all steps; whether every bit was there."""
        runs = iter([Bits(s.replace(b"\xff\0", b"\xff")) for s in segments])
        source = None
        for n, unit in enumerate(self.units()):
            if source is None or restart and n % restart == 0:
                source, self.run = next(runs, None), 0
                if source is None:
                    return False
                for p in self.parts:
                    p.last = 0
            for k, p, y, x in unit:
                self.block(source, p, *self.tables[k], p.blocks[y, x])
            if source.short:
                return False
        return True

    def dc(self, source: Bits, p: Component, dc: Codes, ac: Codes, block: np.ndarray) -> None:
        p.last += source.signed(source.symbol(dc))
        block[0] = p.last << self.bit

    def dc_again(self, source: Bits, p: Component, dc: Codes, ac: Codes, block: np.ndarray) -> None:
        block[0] |= source.take(1) << self.bit

    def whole(self, source: Bits, p: Component, dc: Codes, ac: Codes, block: np.ndarray) -> None:
        self.dc(source, p, dc, ac, block)
        k = 1
        while k < 64:
            run, size = divmod(source.symbol(ac), 16)
            if not size and run < 15:
                return
            k += run
            if size and k < 64:
                block[k] = source.signed(size)
            k += 1

    def ac(self, source: Bits, p: Component, dc: Codes, ac: Codes, block: np.ndarray) -> None:
        """New coefficients; a run of blocks without any is counted down."""
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            run, size = divmod(source.symbol(ac), 16)
            if not size and run < 15:
                self.run = (1 << run) + source.take(run) - 1
                return
            k += run
            if size and k < 64:
                block[k] = source.signed(size) << self.bit
            k += 1

    def ac_again(self, source: Bits, p: Component, dc: Codes, ac: Codes, block: np.ndarray) -> None:
        """One more bit of what isn't 0 so far, with new coefficients of one bit between."""
        k, one = self.first, 1 << self.bit

        def refined(k: int) -> None:
            if source.take(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        if not self.run:
            while k <= self.last:
                zeros, size = divmod(source.symbol(ac), 16)
                if not size and zeros < 15:
                    self.run = (1 << zeros) + source.take(zeros)
                    break
                new = (one if source.take(1) else -one) if size else 0
                while k <= self.last:
                    if block[k]:
                        refined(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        break
                    k += 1
                if new and k <= self.last:
                    block[k] = new
                k += 1
        if self.run:
            for k in range(k, self.last + 1):
                if block[k]:
                    refined(k)
            self.run -= 1


def jpeg(c: Cursor, scale: int = 0) -> Raster:
    """JPEG in Huffman coding: sequential or progressive, components in one scan or in many.

    scale 1, 2 or 3 makes a half, a quarter or an eighth from the low frequencies alone.
    """
    if c.data[:2] != b"\xff\xd8":
        raise NotMine
    data, at = c.data, 2
    quant, tables, frame, restart, progressive, scans, ended = {}, {}, [], 0, False, 0, False
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 2 > len(data):
            break
        mark = data[at + 1]
        if mark == 0xD9:
            at, ended = at + 2, True
            break
        if mark in (0, 1, 255) or 0xD0 <= mark <= 0xD8:
            at += 1
            continue
        if at + 4 > len(data):
            break
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.float64)
                body = body[1 + size :]
        elif mark == 0xC4:
            while len(body) > 17:
                counts = body[1:17]
                tables[body[0]] = looked_up(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, h, w, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts not in (1, 3):
                raise Broken(f"{depth} bits, {parts} components")
            sized(w, h, 3)
            progressive = mark == 0xC2
            frame = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
            if parts == 1:  # one component has no units to share
                frame[0].sx = frame[0].sy = 1
            top_x, top_y = max(p.sx for p in frame), max(p.sy for p in frame)
            if not min(min(p.sx, p.sy) for p in frame) or any(top_x % p.sx or top_y % p.sy for p in frame):
                raise Broken("sampling that isn't whole")
            for p in frame:
                p.sized(w, h, top_x, top_y)
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise Broken("lossless, hierarchical or arithmetic coding")
        elif mark == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif mark == 0xDA:
            if not frame:
                raise Broken("a scan before its frame")
            end = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]").search(data, at)
            segments = re.split(rb"\xff[\xd0-\xd7]", data[at : end.start() if end else None])
            at, scans = end.start() if end else len(data), scans + 1
            try:
                chosen = [(next(p for p in frame if p.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
                first, last, bits_ = body[1 + 2 * body[0] : 4 + 2 * body[0]] if progressive else (0, 63, 0)
                known = [(tables.get(t >> 4, []), tables.get(16 | t & 15, [])) for _, t in chosen]
                whole = Scan([p for p, _ in chosen], known, first, min(last, 63), bits_ >> 4, bits_ & 15, progressive).read(segments, restart)
            except (Broken, StopIteration, ValueError, IndexError):
                whole = False
            if not whole:
                c.short = True
                break
    if not scans:
        raise Broken("no scan")
    if progressive and not ended:  # later scans may be missing
        c.short = True
    c.at = at if ended else len(data)
    n = 8 >> min(max(scale, 0), 3)
    basis, order = cosines(n), zigzag()
    planes = []
    for p in frame:
        values = np.zeros(p.blocks.shape)
        values[..., order] = p.blocks * quant[p.quant]
        rows, cols, _ = values.shape
        low = values.reshape(rows, cols, 8, 8)[..., :n, :n]
        cells = np.einsum("ku,rckl,lv->rcuv", basis, low, basis) * (n / 8) + 128
        plane = cells.transpose(0, 2, 1, 3).reshape(rows * n, cols * n)
        plane = np.repeat(np.repeat(plane, top_y // p.sy, axis=0), top_x // p.sx, axis=1)
        planes.append(plane[: -(-h * n // 8), : -(-w * n // 8)])
    if len(planes) == 1:
        level = np.clip(np.round(planes[0]), 0, 255).astype(np.int64)
        return indexed(level, np.repeat(np.arange(256)[:, None] * 257, 3, axis=1), gamma=2.2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return true(np.clip(np.round(rgb), 0, 255).astype(np.uint8), gamma=2.2)


def utah(c: Cursor) -> Raster:
    magic, x0, y0, w, h, flags, channels, depth, maps, log = c.head("<HhhhhBBBBB")
    if magic != 0xCC52:
        raise NotMine
    sized(w, h, 4)
    if depth != 8 or channels not in (1, 3) or (channels, maps) not in ((1, 0), (1, 1), (1, 3), (3, 0), (3, 3)):
        raise Broken(f"{channels} channels with {maps} maps")
    back = c.take(channels) if not flags & 2 else b""
    if flags & 2 or not channels % 2:
        c.take(1)
    table = np.frombuffer(c.take(2 * maps << log), "<u2").astype(np.int64).reshape(maps, -1) if maps else None
    gamma = None
    if flags & 8:
        (n,) = struct.unpack("<H", c.take(2))
        notes = dict(x.split("=", 1) for x in c.take(n + n % 2).decode("latin-1").split("\0") if "=" in x)
        for name, turn in (("image_gamma", True), ("display_gamma", False)):
            if name in notes and gamma is None:
                try:
                    v = float(notes[name])
                except ValueError:
                    v = 0.0
                gamma = 1.0 if not v else 1 / v if turn else v
    planes = np.zeros((channels, h, w), np.uint8)
    if back:
        planes[:] = np.frombuffer(back, np.uint8)[:, None, None]
    x, y, k = 0, 0, 0
    while c.left > 1:
        op, value = c.byte(), c.byte()
        if op & 64:
            (value,) = struct.unpack("<h", c.take(2))
        op &= 63
        if op == 1:
            y, x = y + value, 0
        elif op == 2:
            k, x = value, 0
        elif op == 3:
            x += value
        elif op in (5, 6):
            n = value + 1
            run = c.take(n + n % 2)[:n] if op == 5 else c.take(2)[:1] * n
            if k < channels and 0 <= y < h and x < w:
                planes[k, y, x : x + n] = np.frombuffer(run, np.uint8)[: w - x]
            x += n
        elif op == 7:
            break
    else:
        c.short = True
    planes = planes[:, ::-1]  # from the bottom up
    if channels == 3:
        if table is not None:
            planes = np.stack([table[i][np.minimum(planes[i], table.shape[1] - 1)] >> 8 for i in range(3)])
        return true(planes.transpose(1, 2, 0), gamma=gamma)
    if maps == 3:
        colours = np.zeros((256, 3), np.int64)
        colours[: table.shape[1]] = table.T[:256]
        return indexed(planes[0], colours, gamma=gamma)
    ramp = np.repeat(np.arange(256)[:, None] << 8, 3, axis=1)
    level = planes[0].astype(np.int64) if table is None else table[0][np.minimum(planes[0], table.shape[1] - 1)] >> 8
    return indexed(level, ramp, gamma=gamma)


#: The standard's codes for runs of white and of black, 0 to 63 and then 64 to 1728 in steps of 64.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011
0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100
00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001
011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100
00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011
000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101
000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101
0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100
0000001100101"""
#: Runs from 1792 to 2560 of either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
FAX_COLUMNS, FAX_ROWS = 2550, 3300


def fax_codes(text: str) -> dict[str, int]:
    codes = text.split()
    runs = [*range(64), *range(64, 1729, 64)]
    return dict(zip(codes, runs, strict=True)) | {c: 1792 + 64 * k for k, c in enumerate(LONG.split())}


RUNS = (fax_codes(WHITE), fax_codes(BLACK))
#: Bits that a step of the fax decoder looks at: the longest code.
FAX_STEP = 13
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


@cache
def fax_steps() -> tuple[list, list]:
    """Of white and of black, by the next FAX_STEP bits: all codes that are whole there, and the first of them alone.

    Each is (bits taken, run lengths that end, what is begun of one more, the colour after
    them), or None where no code stands.
    """
    first = [[None] * (1 << FAX_STEP) for _ in range(2)]
    for colour, codes in enumerate(RUNS):
        for code, run in codes.items():
            left = FAX_STEP - len(code)
            begin = int(code, 2) << left
            first[colour][begin : begin + (1 << left)] = [(len(code), run)] * (1 << left)

    def followed(window: int, colour: int, most: int) -> tuple | None:
        taken, ended, total, n = 0, [], 0, 0
        while taken < FAX_STEP and n < most:
            code = first[colour][window << taken & (1 << FAX_STEP) - 1]
            if code is None or taken + code[0] > FAX_STEP:
                break
            taken, total, n = taken + code[0], total + code[1], n + 1
            if code[1] < 64:
                ended.append(total)
                total, colour = 0, 1 - colour
        return (taken, tuple(ended), total, colour) if taken else None

    return tuple([[followed(w, colour, most) for w in range(1 << FAX_STEP)] for colour in range(2)] for most in (FAX_STEP, 1))


def zeros_at(data: bytes, pos: int) -> int:
    """The number of zero bits from a bit on."""
    byte, left = pos >> 3, 8 - (pos & 7)
    if byte >= len(data):
        return 0
    if head := data[byte] & (1 << left) - 1:
        return left - head.bit_length()
    rest = re.compile(rb"\0*").match(data, byte + 1).end()
    more = 8 - data[rest].bit_length() if rest < len(data) else 0
    return left + 8 * (rest - byte - 1) + more


def mark_at(data: bytes, pos: int) -> int | None:
    """Where an end of line that begins at a bit ends: 11 zeros or more and a one."""
    n = zeros_at(data, pos)
    return pos + n + 1 if n >= 11 and pos + n < 8 * len(data) else None


def mark_after(data: bytes, pos: int) -> int | None:
    """Where the next end of line begins."""
    while pos < 8 * len(data):
        n = zeros_at(data, pos)
        if n >= 11:
            return pos if pos + n < 8 * len(data) else None
        pos += n + 1
    return None


def fax_rows(data: bytes, at: int, most: int) -> tuple[list[list[int]], bool]:
    """Runs of each row from a bit on, white first, up to ``most`` rows; whether no row is damaged."""
    rows: list[list[int]] = []
    (steps, singles), whole, end, mask = fax_steps(), True, 8 * len(data), (1 << FAX_STEP) - 1
    while len(rows) < most:
        ends = 0
        while (after := mark_at(data, at)) is not None:  # several marks in a row end the page
            at, ends = after, ends + 1
        if ends > 1 and rows or at >= end:
            break
        row, total, colour = [], 0, 0
        window, top = 0, at  # the bits up to ``top`` are in the window
        while True:
            if top - at < FAX_STEP:
                byte = at >> 3
                window = int.from_bytes(data[byte : byte + 16].ljust(16, b"\0"))
                top = 8 * byte + 128
            step = steps[colour][window >> top - at - FAX_STEP & mask]
            if step is not None and at + step[0] > end:
                step = singles[colour][window >> top - at - FAX_STEP & mask]
            if step is None or at + step[0] > end:
                break
            at += step[0]
            if step[1]:
                row.append(total + step[1][0])
                row += step[1][1:]
                total = step[2]
            else:
                total += step[2]
            colour = step[3]
        if mark_at(data, at) is None:
            following = mark_after(data, at)
            if following is None:
                at = end
            else:
                whole, at = False, following
        if row:
            rows.append(row)
    return rows, whole


def fax_lead(sample: bytes) -> tuple[bool, int]:
    """Of a file's first bytes: whether bits stand the other way round in them, and the bit at which rows begin."""
    for turned in (False, True):
        data = sample.translate(REVERSED) if turned else sample
        begin = 0
        if not 11 <= zeros_at(data, 0) <= 15:
            marks, at = [], 0
            while len(marks) < 5 and (at := mark_after(data, at)) is not None:
                marks.append(at)
                at = mark_at(data, at)
            if len(marks) < 5:
                continue
            begin = marks[3]
        # a row follows the mark at once, and none of the three is damaged: headers full of zeros have marks, too
        start = mark_at(data, begin)
        if mark_at(data, start) is not None:
            continue
        first, whole = fax_rows(data, start, 3)
        widths = {sum(r) for r in first}
        if whole and len(first) == 3 and len(widths) == 1 and 0 < widths.pop() <= FAX_COLUMNS:
            return turned, begin
    raise NotMine


def fax(c: Cursor) -> Raster:
    if c.left < 8:
        raise NotMine
    turned, begin = fax_lead(c.data[:65536])
    rows, whole = fax_rows(c.data.translate(REVERSED) if turned else c.data, begin, FAX_ROWS)
    c.at, c.short = len(c.data), not whole
    w = min(FAX_COLUMNS, max(map(sum, rows)))
    out = np.zeros((len(rows), w), np.uint8)
    for y, row in enumerate(rows):
        shown = np.repeat(np.arange(len(row), dtype=np.uint8) & 1, row)[:w]
        out[y, : len(shown)] = shown
    return bitmap(out)


#: Where the plain sizes begin, and how large they are.
PCD_SIZES = ((0x2000, 192, 128), (0xB800, 384, 256), (0x30000, 768, 512))
#: Highlights are bent down from 238 on. The inputs at which 238, 239, ... 255 begin.
PCD_HIGHLIGHTS = (239, 240, 241, 243, 245, 246, 248, 251, 253, 256, 259, 263, 268, 273, 281, 291, 307, 331)


#: The larger sizes, their tables and data in blocks after the part before, and how many planes they add to.
PCD_BLOCK, PCD_BEYOND = 0x800, 384 * 0x800
PCD_LARGER = ((1536, 1024, 4, 5, 1), (3072, 2048, 12, 14, 3))
#: A mark before each row of differences, and the planes by their numbers in it.
PCD_MARK, PCD_PLANES = 0xFFFFFE, {0: 0, 2: 1, 3: 2}


def pcd_tables(data: bytes, at: int, count: int) -> list[tuple[list[int], list[int]]]:
    """Code lengths and values by the next 16 bits, for each of the tables that follow one another."""
    out = []
    for _ in range(count):
        lengths, values = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        entries = np.frombuffer(data[at + 1 : at + 1 + 4 * (data[at] + 1)], ">u1,>u2,i1")
        for length, code, value in entries.tolist():
            if length > 15:
                raise Broken("a code of more than 16 bits")
            lengths[code : code + (1 << 15 - length)], values[code : code + (1 << 15 - length)] = length + 1, value
        out.append((lengths.tolist(), values.tolist()))
        at += 1 + 4 * (data[at] + 1)
    return out


def pcd_differences(c: Cursor, tables: list[tuple[list[int], list[int]]], planes: list[np.ndarray], at: int) -> int:
    """Add the differences that begin at a byte to rows of the planes; where they end. What is missing is noted."""
    data, high = c.data, len(planes[0])
    while data[at : at + 3] != b"\xff\xff\xfe":
        at += 3
        if at >= len(data):
            c.short = True
            return at
    pos, end, row, x = 8 * at, 8 * len(data), None, 0
    while pos + 24 <= end:
        byte = pos >> 3
        bits = int.from_bytes(data[byte : byte + 6].ljust(6, b"\0")) << (pos & 7) & (1 << 48) - 1
        if bits >> 24 == PCD_MARK:
            head = bits >> 8 & 0xFFFF
            plane, y = PCD_PLANES.get(head >> 14, 3), head >> 1 & 0x1FFF
            pos += 40
            if y * (2 if plane else 1) >= high:
                return -(-pos // 8)
            if plane >= len(tables):
                break
            (lengths, values), row, x = tables[plane], planes[plane][y], 0
            continue
        code = bits >> 32
        if row is None or x >= len(row) or not lengths[code]:
            break
        row[x] += values[code]
        x, pos = x + 1, pos + lengths[code]
    c.short = True
    return -(-pos // 8)


def photo_cd(c: Cursor, width: int = 0, height: int = 0) -> Raster:
    """The largest size that fits (width, height), or the smallest. Beyond the base size, each is twice the one before and differences from that."""
    if c.data[:32] != b"\xff" * 32 or c.data[0x800:0x807] != b"PCD_IPI":
        raise NotMine
    turn = c.data[0xE02] & 3 if len(c.data) > 0xE02 else 0
    wide, high = (height, width) if turn in (1, 3) else (width, height)
    fits = [s for s in PCD_SIZES if s[1] <= wide and s[2] <= high]
    start, w, h = fits[-1] if fits else PCD_SIZES[0]
    c.at = start
    raw = np.frombuffer(c.take(w * h * 3 // 2), np.uint8).reshape(h // 2, 3 * w)
    planes = [raw[:, : 2 * w].reshape(h, w).astype(np.int64), raw[:, 2 * w : 2 * w + w // 2].astype(np.int64), raw[:, 2 * w + w // 2 :].astype(np.int64)]
    part = PCD_BEYOND
    for w, h, table, differences, count in PCD_LARGER if (w, h) == PCD_SIZES[-1][1:] else ():
        if w > wide or h > high or c.short:
            break
        planes = [upsample(p) for p in planes]
        try:
            tables = pcd_tables(c.data, part + table * PCD_BLOCK, count)
            part = -(-pcd_differences(c, tables, planes, part + differences * PCD_BLOCK) // PCD_BLOCK) * PCD_BLOCK
        except (IndexError, ValueError):  # the tables aren't there
            c.short = True
        planes = [p.clip(0, 255) for p in planes]
        c.at = min(part, len(c.data))
    luma, blue, red = planes[0], upsample(planes[1]), upsample(planes[2])
    # in 16 bits behind the point, rounded once
    part = lambda share: int(255 / 182 * share * 65536 + 0.5)
    c1, c2, light = blue - 156, red - 137, part(1) * luma + 32768
    rgb = np.stack([light + part(1) * c2, light - part(0.194) * c1 - part(0.509) * c2, light + part(1) * c1], axis=2) >> 16
    pixels = np.where(rgb < 238, np.maximum(rgb, 0), 237 + np.searchsorted(PCD_HIGHLIGHTS, rgb, "right")).astype(np.uint8)
    return true(np.rot90(pixels, {1: 1, 3: -1}.get(turn, 0)).copy(), gamma=2.05)
