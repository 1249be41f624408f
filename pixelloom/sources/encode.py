"""Encoders of the formats that images are written in."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..image import BITMAP, TRUE, Raster


def rgb8(r: Raster) -> np.ndarray:
    return (r.colours16() >> 8).astype(np.uint8)


def ppm(r: Raster) -> bytes:
    if r.type == BITMAP and not r.palette[1].any():
        return b"P4\n%d %d\n" % (r.width, r.height) + np.packbits(r.pixels.astype(np.uint8), axis=1).tobytes()
    return b"P6\n%d %d\n255\n" % (r.width, r.height) + rgb8(r).tobytes()


def png(r: Raster) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    few = r.type != TRUE and r.used <= 256
    data = r.pixels.astype(np.uint8) if few else rgb8(r).reshape(r.height, -1)
    rows = np.zeros((r.height, data.shape[1] + 1), np.uint8)
    rows[:, 1:] = data
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", r.width, r.height, 8, 3 if few else 2, 0, 0, 0))]
    if r.gamma:
        parts.append(chunk(b"gAMA", struct.pack(">I", round(100000 / r.gamma))))
    if few:
        parts.append(chunk(b"PLTE", (r.palette >> 8).astype(np.uint8).tobytes()))
    if r.title:
        parts.append(chunk(b"tEXt", b"Title\0" + r.title.encode("latin-1", "replace")))
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def sun(r: Raster) -> bytes:
    line = 3 * r.width + (3 * r.width) % 2
    rows = np.zeros((r.height, line), np.uint8)
    rows[:, : 3 * r.width] = rgb8(r)[..., ::-1].reshape(r.height, -1)
    return struct.pack(">8I", 0x59A66A95, r.width, r.height, 24, line * r.height, 1, 0, 0) + rows.tobytes()


def tga(r: Raster) -> bytes:
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, r.width, r.height, 24, 32) + rgb8(r)[..., ::-1].tobytes()


def bmp(r: Raster) -> bytes:
    line = (3 * r.width + 3) // 4 * 4
    rows = np.zeros((r.height, line), np.uint8)
    rows[:, : 3 * r.width] = rgb8(r)[::-1, :, ::-1].reshape(r.height, -1)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, r.width, r.height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


ENCODERS = {"ppm": ppm, "png": png, "sun": sun, "tga": tga, "bmp": bmp}
