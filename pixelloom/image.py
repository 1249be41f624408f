"""One image in memory, and its packed form as a DataFrame row.

A raster is a bitmap (indices 0 and 1), a palette image (indices into 16-bit colours) or a
true colour image (8 bits a channel). Bitmaps begin with white for 0 and black for 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

BITMAP, RGB, TRUE = "BITMAP", "RGB", "TRUE"
WHITE_BLACK = ((65535, 65535, 65535), (0, 0, 0))

COLOUR = T.StructType([T.StructField(c, T.IntegerType()) for c in ("red", "green", "blue")])
#: The packed form. data: indices of one byte, or of two (big-endian) beyond 256 colours; true colour: r, g, b bytes.
PACKED = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("gamma", T.FloatType()),
        T.StructField("palette", T.ArrayType(COLOUR)),
        T.StructField("data", T.BinaryType()),
    ]
)


def colours_to_depth(n: int) -> int:
    """The smallest depth with 2^depth >= n."""
    return max(0, n - 1).bit_length()


def depth_to_colours(depth: int) -> int:
    return 1 << min(depth, 32)


@dataclass
class Raster:
    type: str
    pixels: np.ndarray  # (h, w) indices, or (h, w, 3) bytes
    palette: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    gamma: float | None = None
    title: str = ""
    depth: int = 0
    compressed: bool = False

    def __post_init__(self):
        if self.type == TRUE:
            self.depth, self.palette = 24, np.zeros((0, 3), np.int64)
        elif self.type == BITMAP:
            self.depth = 1
            self.compressed = True
        else:
            self.depth = max(1, self.depth or colours_to_depth(len(self.palette)))

    @property
    def width(self) -> int:
        return self.pixels.shape[1]

    @property
    def height(self) -> int:
        return self.pixels.shape[0]

    @property
    def used(self) -> int:
        return len(self.palette)

    def but(self, **changes) -> Raster:
        return replace(self, **changes)

    def colours16(self) -> np.ndarray:
        """(h, w, 3): every pixel's colour, 16 bits a channel."""
        return self.pixels.astype(np.int64) << 8 if self.type == TRUE else self.palette[np.minimum(self.pixels, max(0, self.used - 1))]


def bitmap(bits: np.ndarray, **more) -> Raster:
    return Raster(BITMAP, np.asarray(bits, np.uint8), np.array(WHITE_BLACK, np.int64), **more)


def indexed(pixels: np.ndarray, palette: np.ndarray, **more) -> Raster:
    return Raster(RGB, np.asarray(pixels, np.int64), np.asarray(palette, np.int64).reshape(-1, 3), **more)


def true(pixels: np.ndarray, **more) -> Raster:
    return Raster(TRUE, np.asarray(pixels, np.uint8), **more)


def gray_ramp(n: int) -> np.ndarray:
    """n grays from black to white, in whole steps of 16-bit intensity."""
    return np.repeat((np.arange(n) * 65535 // max(1, n - 1))[:, None], 3, axis=1)


def pack(image_id: int | None, r: Raster) -> tuple:
    """A row of PACKED."""
    wide = r.type == RGB and r.used > 256
    data = r.pixels.astype(">u2" if wide else np.uint8).tobytes()
    colours = [dict(zip(COLOUR.names, c, strict=True)) for c in r.palette.tolist()] if r.type != TRUE else None
    return image_id, r.title, r.type, r.width, r.height, r.depth, r.gamma, colours, data


def unpack(row) -> Raster:
    """A raster of a row of PACKED (by name)."""
    palette = [(c["red"], c["green"], c["blue"]) for c in (row["palette"] if row["palette"] is not None else ())]
    wide = row["type"] == RGB and len(palette) > 256
    shape = (row["height"], row["width"], 3) if row["type"] == TRUE else (row["height"], row["width"])
    pixels = np.frombuffer(row["data"], ">u2" if wide else np.uint8).reshape(shape)
    gamma = row["gamma"]
    gamma = None if gamma is None or math.isnan(gamma) else round(float(gamma), 6)
    return Raster(row["type"], pixels.astype(np.int64) if row["type"] != TRUE else pixels, np.array(palette, np.int64).reshape(-1, 3), gamma, row["title"] or "", row["depth"])
