"""Operators on exploded images: one row a pixel, all in Catalyst.

pixels: image_id, x, y, r, g, b (8 bits). ipixels: image_id, x, y, idx. palettes: image_id,
idx, red, green, blue (16 bits). Sizes are columns or numbers.

Most operators are projections: they move or change a pixel where it is, fan it out, or
drop it, with no shuffle. Those that need an image's other pixels shuffle by image_id and
place, once; an image is the largest group there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import brighter, five_bit_cell, gray8, intensity8
from .raster import CELLS

PLACE = ("image_id", "x", "y")
COLOURS = ("r", "g", "b")
Size = int | Column


def lit(v: Size) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative numbers."""
    return F.floor(a / b).cast("int")


# projections: colour


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PLACE, gray8(*map(F.col, COLOURS)).alias("level"))


def mapped(pixels: DataFrame, change, columns=COLOURS) -> DataFrame:
    """Every channel changed by an expression."""
    return pixels.withColumns({c: change(F.col(c)) for c in columns})


def brighten(pixels: DataFrame, percent: int) -> DataFrame:
    return mapped(pixels, lambda v: brighter(v, percent, 255))


def threshold(pixels: DataFrame, level: int = 128) -> DataFrame:
    """A bitmap: 1 is black."""
    return pixels.select(*PLACE, (gray8(*map(F.col, COLOURS)) < level).cast("int").alias("idx"))


def expand_bitmap(ipixels: DataFrame) -> DataFrame:
    """True colour of a bitmap: 0 is white, 1 is black."""
    value = F.when(F.col("idx") == 0, 255).otherwise(0)
    return ipixels.select(*PLACE, *[value.alias(c) for c in COLOURS])


def recolour(ipixels: DataFrame, foreground: tuple[int, int, int], background: tuple[int, int, int]) -> DataFrame:
    """True colour of a bitmap in other inks (16 bits, meant for a display): 0 is the background."""
    inks = {c: (int(0.5 + 65535 * (b / 65535) ** 2.2) >> 8, int(0.5 + 65535 * (f / 65535) ** 2.2) >> 8) for c, b, f in zip(COLOURS, background, foreground, strict=True)}
    return ipixels.select(*PLACE, *[F.when(F.col("idx") == 0, b).otherwise(f).alias(c) for c, (b, f) in inks.items()])


def first_of_name(names: DataFrame) -> DataFrame:
    """name, position: where each name stands first in a list of (name, position)."""
    return names.groupBy("name").agg(F.min("position").alias("position"))


def palette_lookup(ipixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """The 16-bit colours of indices. One palette an image: gathered into one row a palette, then joined by image."""
    entry = F.struct("idx", "red", "green", "blue")
    gathered = palettes.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx"), entry))).alias("palette"))
    found = ipixels.join(gathered, "image_id").withColumn("entry", F.try_element_at("palette", F.col("idx")))
    return found.select(*PLACE, "entry.red", "entry.green", "entry.blue").filter("red is not null")


def expand_true(ipixels: DataFrame, palettes: DataFrame) -> DataFrame:
    found = palette_lookup(ipixels, palettes)
    return found.select(*PLACE, *[F.shiftright(c, 8).alias(o) for c, o in zip(("red", "green", "blue"), COLOURS, strict=True)])


def normalize(pixels: DataFrame) -> DataFrame:
    """Each image stretched from its smallest to its largest value; an image of one value stays as it is.

    The extremes are added up before they are shuffled, one row an image and task, and
    joined; no image's pixels are held together.
    """
    marked = pixels.join(extremes(pixels), "image_id")
    span = F.col("high") - F.col("low")

    def stretched(v: Column) -> Column:
        return F.when(span == 0, v).otherwise(F.least(F.lit(255), div((v - F.col("low")) * 256, F.greatest(span, F.lit(1)))))

    return mapped(marked, stretched).drop("low", "high")


def nearest_colour(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """The index of the closest colour of a short palette; of equal ones the last. Long palettes and tables of them: ``large.nearest_entry``.

    Distance and index are one number, so the least of plain numbers says both.
    """
    n = len(palette)
    keys = []
    for i, colour in enumerate(palette):
        parts = [(F.col(c) - v) * (F.col(c) - v) for c, v in zip(COLOURS, colour, strict=True)]
        keys.append((parts[0] + parts[1] + parts[2]).cast("long") * n + (n - 1 - i))
    least = F.least(*keys) if n > 1 else keys[0]
    return pixels.select(*PLACE, (n - 1 - least % n).cast("int").alias("idx"))


# projections: place


def rotate(pixels: DataFrame, width: Size, height: Size, degrees: int) -> DataFrame:
    """Clockwise, in quarter turns."""
    w, h, x, y = lit(width), lit(height), F.col("x"), F.col("y")
    turns = -(-degrees // 90) % 4
    to = ((x, y), (h - 1 - y, x), (w - 1 - x, h - 1 - y), (y, w - 1 - x))[turns]
    return pixels.withColumns({"x": to[0].cast("int"), "y": to[1].cast("int")})


def zoomed_size(size: Size, percent: Size) -> Column:
    return div(lit(size) * F.when(lit(percent) == 0, 100).otherwise(lit(percent)), F.lit(100))


def targets(at: Column, size: Column, out: Column) -> Column:
    """All a below ``out`` with floor(a (size - 1) / (out - 1)) = at, as an array; none is an empty one."""
    step = F.greatest(out - 1, F.lit(1))
    span = F.greatest(size - 1, F.lit(1))
    first = F.when(at == 0, 0).otherwise(div(at * step + span - 1, span))
    last = F.when(size <= 1, out - 1).when(at == size - 1, F.when(out <= 1, -1).otherwise(out - 1)).otherwise(div((at + 1) * step - 1, span))
    last = F.when((out <= 1) & (at == 0), out - 1).otherwise(F.least(last, out - 1))
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))


def zoom(pixels: DataFrame, width: Size, height: Size, x_percent: Size, y_percent: Size) -> DataFrame:
    """Nearest neighbour: each pixel goes to the places that take it, so nothing is joined."""
    rest = [c for c in pixels.columns if c not in ("x", "y")]
    across = targets(F.col("x"), lit(width), zoomed_size(width, x_percent))
    down = targets(F.col("y"), lit(height), zoomed_size(height, y_percent))
    wide = pixels.withColumn("down", down).withColumn("x", F.explode(across))
    return wide.withColumn("y", F.explode("down")).select(*PLACE, *[c for c in rest if c != "image_id"])


def clip(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part inside a rectangle, moved to its corner."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.filter(inside).withColumns({"x": (F.col("x") - x).cast("int"), "y": (F.col("y") - y).cast("int")})


def clip_border(pixels: DataFrame, images: DataFrame, x: int, y: int, w: int, h: int, border: int = 255) -> DataFrame:
    """Exactly w by h pixels: what an image (image_id, width, height) doesn't cover shows the border. No join."""
    part = clip(pixels, x, y, w, h).select(*PLACE, *COLOURS)
    grid = images.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    covered = (F.col("x") + x).between(0, F.col("width") - 1) & (F.col("y") + y).between(0, F.col("height") - 1)
    return part.unionByName(grid.filter(~covered).select(*PLACE, *[F.lit(border).alias(c) for c in COLOURS]))


def fill(pixels: DataFrame, x: int, y: int, w: int, h: int, colour: tuple[int, int, int]) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.withColumns({c: F.when(inside, v).otherwise(F.col(c)) for c, v in zip(COLOURS, colour, strict=True)})


def tile(pixels: DataFrame, width: Size, height: Size, out_width: int, out_height: int) -> DataFrame:
    """Repeated over a larger area."""
    w, h = lit(width), lit(height)

    def every(at: Column, size: Column, out: int) -> Column:
        return F.when(at < out, F.sequence(at, F.lit(out - 1), size))

    wide = pixels.withColumn("down", every(F.col("y"), h, out_height)).withColumn("x", F.explode(every(F.col("x"), w, out_width)))
    return wide.withColumn("y", F.explode("down")).select(*pixels.columns)


def halftone(pixels: DataFrame) -> DataFrame:
    """4 x 4 bits a pixel; 1 is black."""
    step = F.least(F.lit(16), div(intensity8(*map(F.col, COLOURS)), F.lit(3855)))
    cell = F.element_at(F.array(*[F.lit(c) for c in CELLS]), (step + 1).cast("int"))
    wide = pixels.select(*PLACE, cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    x, y = F.col("x") * 4 + F.col("k") % 4, F.col("y") * 4 + F.shiftright("k", 2)
    bit = F.expr("(shiftright(cell, 15 - k) & 1)")
    return wide.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), bit.cast("int").alias("idx"))


# compositions


def layers(parts: list[tuple[DataFrame, Size, Size]]) -> DataFrame:
    """Images laid over one another: the first is the canvas, later ones cover earlier ones where they overlap it.

    One shuffle for all layers; places that the canvas doesn't have are left out.
    """
    stacked = None
    for k, (pixels, at_x, at_y) in enumerate(parts):
        moved = pixels.select("image_id", (F.col("x") + lit(at_x)).cast("int").alias("x"), (F.col("y") + lit(at_y)).cast("int").alias("y"), F.struct(F.lit(k).alias("layer"), *COLOURS).alias("top"))
        stacked = moved if stacked is None else stacked.unionByName(moved)
    top = stacked.groupBy(*PLACE).agg(F.max("top").alias("top"), F.min("top.layer").alias("ground"))
    return top.filter("ground = 0").select(*PLACE, *[F.col(f"top.{c}").alias(c) for c in COLOURS])


def merge(dst: DataFrame, src: DataFrame, at_x: Size, at_y: Size) -> DataFrame:
    return layers([(dst, 0, 0), (src, at_x, at_y)])


def smooth(pixels: DataFrame, passes: int = 1) -> DataFrame:
    """3 x 3 means rounded up, edges repeated; each pass adds up columns and then rows.

    One shuffle for all passes: images are dealt out whole, and columns and rows are
    sorted where they are. Only neighbours are held.
    """
    pixels = pixels.repartition("image_id")
    for _ in range(passes):
        for axis, other in (("y", "x"), ("x", "y")):
            line = Window.partitionBy("image_id", other).orderBy(axis)
            pixels = pixels.withColumns({c: F.col(c) + F.coalesce(F.lag(c).over(line), F.col(c)) + F.coalesce(F.lead(c).over(line), F.col(c)) for c in COLOURS})
        pixels = mapped(pixels, lambda v: div(v + 8, F.lit(9)))
    return pixels


# aggregations


def histogram(pixels: DataFrame) -> DataFrame:
    """Pixels in each 5-bit cell, by image."""
    return pixels.groupBy("image_id", five_bit_cell(*map(F.col, COLOURS)).alias("cell")).agg(F.count("*").alias("n"))


def marginals(pixels: DataFrame) -> DataFrame:
    """Pixels at each 5-bit value of each channel, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.shiftright(c, 3).alias("value")) for c in COLOURS]))
    return pixels.select("image_id", each.alias("m")).groupBy("image_id", "m.channel", "m.value").agg(F.count("*").alias("n"))


def box_stats(pixels: DataFrame) -> DataFrame:
    """Weight, sums and sums of squares of 5-bit values by channel: what means and variances are made of."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.shiftright(c, 3).alias("value")) for c in COLOURS]))
    v = F.col("value").cast("long")
    return pixels.select("image_id", each.alias("m")).select("image_id", "m.*").groupBy("image_id", "channel").agg(F.count("*").alias("weight"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def extremes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.min(F.least(*COLOURS)).alias("low"), F.max(F.greatest(*COLOURS)).alias("high"))


def used_colours(ipixels: DataFrame, size: int) -> DataFrame:
    """By image: distinct indices, and pixels beyond a palette of ``size``."""
    return ipixels.groupBy("image_id").agg(F.count_distinct("idx").alias("used"), F.count_if(F.col("idx") >= size).alias("out_of_range"))


def compress(ipixels: DataFrame, palettes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Indices and palettes without unused entries, in the order they had; what is out of range becomes 0.

    New numbers are made from one row an image (the set of its indices), not from pixels.
    """
    cleaned = ipixels.withColumn("idx", F.when(F.col("idx") < size, F.col("idx")).otherwise(0))
    kept = cleaned.groupBy("image_id").agg(F.array_sort(F.collect_set("idx")).alias("kept"))
    place = (F.array_position("kept", F.col("idx")) - 1).cast("int")
    pixels = cleaned.join(kept, "image_id").withColumn("idx", place).drop("kept")
    colours = palettes.join(kept, "image_id").withColumn("idx", place).filter("idx >= 0").drop("kept")
    return pixels, colours
