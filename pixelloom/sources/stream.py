"""Bytes of image files: wrappers undone, and a cursor that shows where data ended early."""

from __future__ import annotations

import binascii
import bz2
import re
import struct
import zlib
from collections.abc import Callable


#: Bytes that are inflated at most.
MOST = 1 << 31


class NotMine(Exception):
    """The data is of another format."""


class Broken(Exception):
    """The data is of this format and can't be used."""


class Cursor:
    """Reads forward; what is missing reads as zeros and is noted."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.short = data, at, False

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        self.at = min(len(self.data), self.at + n)
        if len(part) < n:
            self.short = True
            part += bytes(n - len(part))
        return part

    def byte(self) -> int:
        return self.take(1)[0]

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def head(self, form: str) -> tuple:
        """A header; a short one means the file is of another format."""
        n = struct.calcsize(form)
        if self.left < n:
            raise NotMine
        return struct.unpack(form, self.take(n))

    def line(self) -> bytes:
        end = self.data.find(b"\n", self.at)
        end = len(self.data) if end < 0 else end + 1
        part, self.at = self.data[self.at : end], end
        return part


def lzw_bits(data: bytes, limit: int = MOST) -> bytes:
    """Undo the variable-width LZW of .Z files. More than ``limit`` bytes raise."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise Broken("not a .Z file")
    most, blocks = data[2] & 31, data[2] & 128
    table = [bytes([k]) for k in range(256)] + [b""] * bool(blocks)
    out, size, width, start, bit = [], 0, 9, 24, 24
    previous = b""
    while bit + width <= 8 * len(data):
        at = bit >> 3
        code = int.from_bytes(data[at : at + 4], "little") >> (bit & 7) & (1 << width) - 1
        bit += width
        if blocks and code == 256:
            del table[257:]
            bit += -(bit - start) % (8 * width)  # codes come in groups of eight
            width, start, previous = 9, bit, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise Broken("a damaged .Z file")
        out.append(entry)
        size += len(entry)
        if size > limit:
            raise Broken(f"more than {limit} bytes when inflated")
        if previous and len(table) < 1 << most:
            table.append(previous + entry[:1])
        previous = entry
        if len(table) >= 1 << width and width < most:
            bit += -(bit - start) % (8 * width)
            width, start = width + 1, bit
    return b"".join(out)


def uudecoded(data: bytes) -> bytes | None:
    """The body of uuencoded data that begins within the first lines, else None."""
    found = re.search(rb"(?:^|\n)begin [0-7]{3,4} [^\n]*\n", data[:12800])
    if not found:
        return None
    out = []
    for line in data[found.end() :].splitlines():
        if line.strip() == b"end":
            break
        if line:
            try:
                out.append(binascii.a2b_uu(line))
            except binascii.Error:  # some encoders write padding that is too long
                out.append(binascii.a2b_uu(line[: ((line[0] - 32 & 63) * 4 + 5) // 3]))
    return b"".join(out)


def members(data: bytes, engine: Callable, magic: bytes, most: int) -> bytes:
    """All members of compressed data, one after the other; what follows them and isn't one is left, as is what is cut off."""
    out, size = [], 0
    while data.startswith(magic):
        one = engine()
        try:
            out.append(one.decompress(data, most - size + 1))
        except (zlib.error, OSError, EOFError):
            if not out:
                raise
            break
        size += len(out[-1])
        if size > most:
            raise Broken(f"more than {most} bytes when inflated")
        data = one.unused_data if one.eof else b""
    return b"".join(out)


def unwrapped(name: str, data: bytes, most: int = MOST) -> bytes:
    """Undo compression, by name or by first bytes, and uuencoding. More than ``most`` bytes raise."""
    if data[:2] == b"\x1f\x8b":
        data = members(data, lambda: zlib.decompressobj(31), b"\x1f\x8b", most)
    elif data[:2] == b"\x1f\x9d":
        data = lzw_bits(data, most)
    elif name.endswith(".bz2") or data[:3] == b"BZh":
        try:
            data = members(data, bz2.BZ2Decompressor, b"BZh", most) or data
        except OSError:
            pass
    plain = uudecoded(data)
    return data if plain is None else plain


#: What stands before and after trailing options; the second word is a program's name.
KEY = rb"XXX \w+ trailing options XXX"


def trailing_options(tail: bytes, reach: int = 1024) -> str | None:
    """The text between two keys, if both lengths agree with it."""
    for first in re.finditer(KEY + rb'(\d{4})"', tail[:reach]):
        n, at = int(first[1]), first.end()
        if re.match(rb'"%04d' % n + KEY, tail[at + n : at + n + 100]):
            return tail[at : at + n].decode("latin-1")
    return None


def last_options(data: bytes) -> str | None:
    """The last trailing options of a file, searched from its end to its beginning."""
    end = len(data)
    while (at := data.rfind(b"XXX ", 0, end)) >= 0:
        if re.match(KEY + rb'\d{4}"', data[at : at + 200]):
            found = trailing_options(data[at : at + 12_000], 200)
            if found is not None:
                return found
        end = at + 3
    return None


def with_trailing(data: bytes, text: str, program: str = "image") -> bytes:
    """``data`` followed by options: old ones are replaced, new ones stand after 20 bytes of padding."""
    key = f"XXX {program} trailing options XXX".encode()
    body = text.encode("latin-1")
    return without_trailing(data) + bytes(20) + key + b'%04d"' % len(body) + body + b'"%04d' % len(body) + key


def without_trailing(data: bytes) -> bytes:
    """``data`` without trailing options."""
    for first in re.finditer(KEY + rb'\d{4}"', data):
        if trailing_options(data[first.start() :]) is not None:
            at = first.start()
            return data[: at - 20] if data[max(0, at - 20) : at] == bytes(20) else data[:at]
    return data
