"""Operators on exploded images that no task could hold, and on palettes of any length.

Tiles: each pixel goes to its tile, and to the neighbouring tiles that are near enough to
look at it, in one shuffle. Strips: rows of pixels come sorted and are diffused one after
the other, with one row of errors carried. Palettes and reductions are tables with one
entry a colour cell, joined to the pixels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import five_bit_cell, gamma8
from . import raster as R
from .pixels import COLOURS, PLACE, histogram

PIXEL = "image_id bigint, x int, y int, r int, g int, b int"
#: Sides of tiles, in pixels.
SIDE = 256
#: A table is broadcast only if it has been counted and has this many rows at most.
BROADCAST_ROWS = 20_000


def in_order(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The key and the values (rows, columns) of each group of sorted rows, whatever batches they come in; one group is held."""
    held: list[np.ndarray] = []
    at: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in keys]
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns], axis=1)
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(int(k[a]) for k in key)
            if at is not None and now != at:
                yield at, np.concatenate(held)
                held = []
            at = now
            held.append(values[a:b])
    if at is not None:
        yield at, np.concatenate(held)


def together(parts: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# tiles


def in_tiles(pixels: DataFrame, side: int, halo: int) -> DataFrame:
    """Pixels with tile_x and tile_y: once for their own tile, and once for each other that they are within ``halo`` of."""

    def near(at: Column) -> Column:
        first = F.greatest(F.floor((at - halo) / side), F.lit(0))
        return F.sequence(first.cast("int"), F.floor((at + halo) / side).cast("int"))

    wide = pixels.select(*PLACE, *COLOURS, F.explode(near(F.col("x"))).alias("tile_x"))
    return wide.withColumn("tile_y", F.explode(near(F.col("y"))))


def smooth_tiled(pixels: DataFrame, passes: int = 1, side: int = SIDE) -> DataFrame:
    """``pixels.smooth`` with no image in one task: one shuffle for all passes, a tile and its edges held at a time.

    After each pass one more ring of what came from other tiles is wrong; there are as many
    rings as passes. Where a tile has no neighbour its edge is the image's, and repeats. An
    image's pixels fill a rectangle that begins at (0, 0).
    """
    if side < passes:
        raise ValueError("a tile must be as wide as what is looked at beside it")

    keys = ("image_id", "tile_x", "tile_y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (image, tile_x, tile_y), values in in_order(batches, keys, ("x", "y", *COLOURS)):
            x, y = values[:, 0], values[:, 1]
            x0, y0 = x.min(), y.min()
            block = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1, 3), np.int64)
            block[y - y0, x - x0] = values[:, 2:]
            for _ in range(passes):
                wide = np.pad(block, ((1, 1), (1, 1), (0, 0)), mode="edge")
                rows = wide[:-2] + wide[1:-1] + wide[2:]
                block = (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:] + 8) // 9
            own = (x // side == tile_x) & (y // side == tile_y)
            x, y = x[own], y[own]
            out = np.column_stack([x, y, block[y - y0, x - x0]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), image, np.int64)), *[pa.array(np.ascontiguousarray(v)) for v in out.T]], ["image_id", *"xyrgb"])

    return in_tiles(pixels, side, passes).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: together(run(batches)), PIXEL)


# strips


def sorted_rows(pixels: DataFrame) -> DataFrame:
    return pixels.repartition("image_id").sortWithinPartitions("image_id", "y", "x")


def row_batch(image: int, y: int, index: np.ndarray) -> pa.RecordBatch:
    n = len(index)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, image, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, y, np.int32)), pa.array(index.astype(np.int32))], ["image_id", "x", "y", "idx"])


INDEX = "image_id bigint, x int, y int, idx int"


def dither(pixels: DataFrame) -> DataFrame:
    """Linear pixels as bitmaps (1 is black) by error diffusion: rows stream past, and one row of errors is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for (image, y), rgb in in_order(batches, ("image_id", "y"), COLOURS):
            if image != last:
                last, carried = image, None
            black, carried = R.dither_row(R.intensity(rgb << 8).tolist(), carried, y % 2 == 0)
            yield row_batch(image, y, np.array(black))

    return sorted_rows(pixels).mapInArrow(lambda batches: together(run(batches)), INDEX)


# palettes by colour cells


#: Bits of a channel that a cell of the palette index has.
CELL_BITS = 3


def cell_of() -> Column:
    cell = F.lit(0)
    for c in COLOURS:
        cell = F.shiftleft(cell, CELL_BITS) + F.shiftright(c, 8 - CELL_BITS)
    return cell


def palette_cells(used: DataFrame, palettes: DataFrame) -> DataFrame:
    """image_id, cell, entries (idx, r, g, b): which entries of an image's palette can be the nearest in each cell that it uses.

    A cell keeps the entries that are nearer to some point of it than the entry whose
    farthest point is nearest; no other can win anywhere in it. used: image_id, cell.
    palettes: image_id, idx, red, green, blue (16 bits), as many entries as there are.
    """
    width = 256 >> CELL_BITS
    names = ("idx", *COLOURS)

    def cells(there: pa.Table, group: pa.Table) -> pa.Table:
        image, numbers = there.column("image_id"), np.sort(there.column("cell").to_numpy())
        idx, *rgb = (group.column(c).to_numpy() for c in ("idx", "red", "green", "blue"))
        colour = np.stack([idx, *(v >> 8 for v in rgb)]).astype(np.int32)
        low = np.arange(0, 256, width)[:, None]
        # of each channel's bands: how near and how far an entry can be
        near = [np.maximum(0, np.maximum(low - v, v - (low + width - 1))) ** 2 for v in colour[1:]]
        far = [np.maximum(np.abs(v - low), np.abs(v - (low + width - 1))) ** 2 for v in colour[1:]]
        kept = []
        for cell in numbers.tolist() if len(idx) else ():
            at = (cell >> 2 * CELL_BITS, cell >> CELL_BITS & len(low) - 1, cell & len(low) - 1)
            least, most = (sum(d[c][at[c]] for c in range(3)) for d in (near, far))
            kept.append(np.flatnonzero(least <= most.min()))
        ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
        flat = colour[:, np.concatenate(kept)] if kept else colour[:, :0]
        entries = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in flat], list(names)))
        return pa.Table.from_arrays([image.combine_chunks()[: len(kept)], pa.array(numbers[: len(kept)].astype(np.int32)), entries], ["image_id", "cell", "entries"])

    schema = "image_id bigint, cell int, entries array<struct<idx:int,r:int,g:int,b:int>>"
    entries = palettes.select("image_id", "idx", "red", "green", "blue")
    return used.groupBy("image_id").cogroup(entries.groupBy("image_id")).applyInArrow(cells, schema)


def joined(pixels: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """By broadcast if ``small`` is counted and short, else by shuffle; hot keys of a shuffle are split by Spark as it runs."""
    small = small.persist()
    return pixels.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge"), keys)


def nearest_entry(pixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """The index of the closest entry of each image's own palette; of equal ones the last.

    A pixel looks at the few entries that its cell has, however long the palette is.
    """
    marked = pixels.withColumn("cell", cell_of())
    found = joined(marked, palette_cells(marked.select("image_id", "cell").distinct(), palettes), ["image_id", "cell"])

    def distance(p: Column) -> Column:
        return F.struct(sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in COLOURS), F.lit(0)).alias("d"), (-p["idx"]).alias("i"))

    return found.select(*PLACE, (-F.array_min(F.transform("entries", distance))["i"]).alias("idx"))


# reduction over relations


def whole_images(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], images: int = 512, rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first of them, some images at a time, none in two parts; images of ``rows`` rows or so are held."""

    def dealt(held: list[list[np.ndarray]], last: bool) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """Groups of images that are whole, and what may go on."""
        parts = [np.concatenate(v) for v in zip(*held, strict=True)]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(parts[0])) + 1, [len(parts[0])]))
        ends = starts if last else starts[:-1]
        marks = [*ends[:-1:images].tolist(), int(ends[-1])]
        return [[v[a:b] for v in parts] for a, b in zip(marks[:-1], marks[1:], strict=True)], [[v[ends[-1] :] for v in parts]]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy() for c in columns])
        if sum(len(v[0]) for v in held) >= rows:
            groups, held = dealt(held, False)
            yield from groups
    if held:
        yield from dealt(held, True)[0]


def reduction(pixels: DataFrame, colours: int) -> DataFrame:
    """image_id, cell, idx, red, green, blue: the box of each 5-bit cell that an image uses, and the box's colour (16 bits).

    Pixels are counted by cell where they are, so an image is at most 32,768 rows when its
    boxes are cut. pixels: as a display of gamma 2.2 shows them.
    """

    names = ["image_id", "cell", "idx", "red", "green", "blue"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, cell, n in whole_images(batches, ("image_id", "cell", "n")):
            number = np.concatenate(([0], np.cumsum(np.diff(image) != 0)))
            box, begins, means = R.boxed(number, cell, n, int(number[-1]) + 1, min(colours, R.MAX_COLOURS))
            colour = (means[box] + np.float32(0.5)).astype(np.int32) << 11
            rows = [cell.astype(np.int32), (box - begins[number]).astype(np.int32), *map(np.ascontiguousarray, colour.T)]
            yield pa.RecordBatch.from_arrays([pa.array(image), *map(pa.array, rows)], names)

    counts = histogram(pixels.filter("image_id is not null")).repartition("image_id").sortWithinPartitions("image_id")
    return counts.mapInArrow(run, "image_id bigint, cell int, idx int, red int, green int, blue int")


def reduce(pixels: DataFrame, colours: int, gamma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Indices (image_id, x, y, idx) and palettes (image_id, idx, red, green, blue) of at most ``colours`` colours an image.

    The cells are a dimension table, joined back to the pixels; no image is ever packed.
    gamma: of the pixels; they are made ready for a display first.
    """
    shown = pixels if R.same_gamma(gamma, R.REDUCE_GAMMA) else pixels.withColumns({c: gamma8(F.col(c), gamma, R.REDUCE_GAMMA) for c in COLOURS})
    table = reduction(shown, colours).persist()
    marked = shown.withColumn("cell", five_bit_cell(*map(F.col, COLOURS)))
    return joined(marked, table, ["image_id", "cell"]).select(*PLACE, "idx"), table.select("image_id", "idx", "red", "green", "blue").distinct()


def reduce_dithered(pixels: DataFrame, colours: int, gamma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The same with error diffusion: an image's cells come before its rows, which then stream past."""
    shown = pixels if R.same_gamma(gamma, R.REDUCE_GAMMA) else pixels.withColumns({c: gamma8(F.col(c), gamma, R.REDUCE_GAMMA) for c in COLOURS})
    table = reduction(shown, colours).persist()
    lead = table.select("image_id", F.col("cell").alias("x"), F.lit(-1).alias("y"), F.col("idx").alias("k"), F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"))
    both = shown.select(*PLACE, F.lit(0).alias("k"), *COLOURS).unionByName(lead.select(*PLACE, "k", *COLOURS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        diffusion = None
        for (image, y), values in in_order(batches, ("image_id", "y"), ("x", "k", *COLOURS)):
            if y < 0:
                palette = np.zeros((values[:, 1].max() + 1, 3), np.int64)
                palette[values[:, 1]] = values[:, 2:]
                diffusion = R.Diffusion(R.place_of(values[:, 0], values[:, 1]), palette)
                continue
            yield row_batch(image, y, np.array(diffusion.row(values[:, 2:])))

    return sorted_rows(both).mapInArrow(lambda batches: together(run(batches)), INDEX), table.select("image_id", "idx", "red", "green", "blue").distinct()
