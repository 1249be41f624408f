"""Exploded images that carry what each image is: its type, its gamma and its title.

A collection is two tables. images: image_id, title, type (BITMAP or TRUE), width, height,
gamma, palette (of bitmaps: two colours of 16 bits). pixels: image_id, x, y, and idx for
bitmaps or r, g, b for true colour. What an operator does to a pixel may depend on the
image it is of, so operators join the few columns that they need, by image, and return both
tables anew. Spark broadcasts the images where their size is small, and shuffles by image
where it isn't.

Operators that work on linear values (gray, brighten, normalize, smooth) first convert each
image from its own gamma, in whole 8-bit steps, as on one raster.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import gray8
from ..image import PACKED
from . import pixels as P
from .pixels import COLOURS, PLACE
from .raster import DISPLAY_GAMMA

VALUES = ("idx", *COLOURS)
ABOUT = ("image_id", "title", "type", "width", "height", "gamma", "palette")


class Carried(NamedTuple):
    images: DataFrame
    pixels: DataFrame


def is_bitmap(kind: Column | None = None) -> Column:
    return (F.col("type") if kind is None else kind) == "BITMAP"


def same_gamma(a: Column, b: Column) -> Column:
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= 1e-5


def converted(v: Column, source: Column, target: Column) -> Column:
    """An 8-bit value of one gamma in another; gammas and their ratio are single precision."""
    exponent = F.lit(1.0) / (target.cast("float").cast("double") / source.cast("float").cast("double")).cast("float").cast("double")
    return F.floor(0.5 + 255 * F.pow(v / F.lit(255.0), exponent)).cast("int")


def with_of(c: Carried, *columns: str) -> DataFrame:
    """Pixels with columns of their images, named ``of_`` and the column."""
    return c.pixels.join(c.images.select("image_id", *[F.col(n).alias(f"of_{n}") for n in columns]), "image_id")


def default_gamma(c: Carried) -> Carried:
    """Images without a gamma get that of their type."""
    return c._replace(images=c.images.withColumn("gamma", F.coalesce("gamma", F.when(is_bitmap(), DISPLAY_GAMMA).otherwise(1.0))))


def with_gamma(c: Carried, target: Column) -> Carried:
    """Every image in another gamma (a column of ``images``); bitmaps and images without one are relabelled only."""
    named = c._replace(images=c.images.withColumn("target", target))
    changes = ~same_gamma(F.col("of_gamma"), F.col("of_target")) & F.col("of_gamma").isNotNull() & ~is_bitmap(F.col("of_type"))
    pixels = with_of(named, "type", "gamma", "target")
    pixels = pixels.withColumns({v: F.when(changes, converted(F.col(v), F.col("of_gamma"), F.col("of_target"))).otherwise(F.col(v)) for v in COLOURS})
    images = named.images.withColumn("gamma", F.when(same_gamma(F.col("gamma"), F.col("target")), F.col("gamma")).otherwise(F.col("target"))).drop("target")
    return Carried(images, pixels.select(*PLACE, *VALUES))


def linear(c: Carried) -> Carried:
    return with_gamma(c, F.lit(1.0))


def expand(c: Carried) -> Carried:
    """True colour; a bitmap is taken to be linear."""
    pixels = with_of(c, "type", "palette")
    entry = F.get("of_palette", F.col("idx"))
    pixels = pixels.withColumns({v: F.when(is_bitmap(F.col("of_type")), F.shiftright(entry[n], 8)).otherwise(F.col(v)) for v, n in zip(COLOURS, ("red", "green", "blue"), strict=True)})
    images = c.images.withColumns({"gamma": F.when(is_bitmap(), F.lit(1.0)).otherwise(F.col("gamma")), "palette": F.lit(None).cast(c.images.schema["palette"].dataType), "type": F.lit("TRUE")})
    return Carried(images, pixels.select(*PLACE, F.lit(None).cast("int").alias("idx"), *COLOURS))


def on_colours(c: Carried, change) -> Carried:
    """``change`` of the linear colours (rows of image_id, x, y, r, g, b) of images that aren't bitmaps, which stay."""
    images = c.images
    lined = linear(c)
    images = images.withColumn("gamma", F.when(is_bitmap(), F.col("gamma")).otherwise(F.lit(1.0)))
    true = lined.pixels.filter("idx is null").select(*PLACE, *COLOURS)
    rest = c.pixels.filter("idx is not null").select(*PLACE, *VALUES)
    return Carried(images, rest.unionByName(change(true).select(*PLACE, F.lit(None).cast("int").alias("idx"), *COLOURS)))


def gray(c: Carried) -> Carried:
    level = gray8(*map(F.col, COLOURS))
    return on_colours(c, lambda p: p.select(*PLACE, *[level.alias(v) for v in COLOURS]))


def brighten(c: Carried, percent: int) -> Carried:
    return on_colours(c, lambda p: P.brighten(p, percent))


def normalize(c: Carried) -> Carried:
    return on_colours(c, P.normalize)


def titled(images: DataFrame, more: str) -> DataFrame:
    return images.withColumn("title", F.concat("title", F.lit(more)))


def smooth(c: Carried, passes: int = 1) -> Carried:
    """Bitmaps become true colour, and all images linear."""
    c = expand(linear(c))
    return Carried(titled(c.images, " (smoothed)" * passes), P.smooth(c.pixels.select(*PLACE, *COLOURS), passes).select(*PLACE, F.lit(None).cast("int").alias("idx"), *COLOURS))


def merge(dst: Carried, src: Carried, at_x: int, at_y: int, display: float = DISPLAY_GAMMA) -> Carried:
    """Each image of ``src`` laid over that of ``dst`` with its id; dst keeps its size and title.

    Two bitmaps stay one, and indices are turned where their palettes are opposed. Else
    both are true colour, and the one whose gamma is farther from the display's is
    converted. Where nothing of src falls on dst, or there is no src, dst stays as it is.
    """
    own = [F.col(n).alias(f"src_{n}") for n in ("type", "width", "height", "gamma", "palette")]
    both = dst.images.join(src.images.select("image_id", *own), "image_id", "left")
    meets = F.lit(at_x) < F.col("width")
    for test in (F.lit(at_y) < F.col("height"), F.col("src_width") + at_x > 0, F.col("src_height") + at_y > 0):
        meets = meets & test
    bits = is_bitmap() & is_bitmap(F.col("src_type"))
    first = lambda palette, k: F.get(palette, F.lit(k))
    base = F.when(is_bitmap(), F.lit(1.0)).otherwise(F.col("gamma"))  # of dst in true colour
    away = lambda g: F.abs(F.coalesce(g, F.lit(0.0)) - display)
    src_moves = away(F.col("src_gamma")) > away(base)
    differ = ~same_gamma(F.col("src_gamma"), base)
    plan = both.withColumns(
        {
            "meets": F.coalesce(meets, F.lit(False)),
            "bits": bits,
            "turned": first(F.col("palette"), 0) == first(F.col("src_palette"), 1),
            "base": base,
            "dst_to": F.when(~bits & differ & ~src_moves, F.col("src_gamma")),
            "src_to": F.when(~bits & differ & src_moves, base),
        }
    )
    table = plan.select("image_id", "meets", "bits", "turned", "base", "dst_to", "src_to", "src_gamma", F.col("type").alias("dst_type"), F.col("palette").alias("dst_palette"), "src_type", "src_palette")

    def shown(v: str, n: str, side: str, source: Column, target: Column) -> Column:
        """A channel of a pixel in true colour, in the gamma that both have then."""
        entry = F.shiftright(F.get(f"{side}_palette", F.col("idx"))[n], 8)
        value = F.when(is_bitmap(F.col(f"{side}_type")), entry).otherwise(F.col(v))
        moves = target.isNotNull() & source.isNotNull() & (~is_bitmap(F.col("src_type")) if side == "src" else F.lit(True))
        return F.when(moves, converted(value, source, target)).otherwise(value)

    def in_colour(side: str, source: Column, target: Column) -> dict[str, Column]:
        return {v: F.when(F.col("meets") & ~F.col("bits"), shown(v, n, side, source, target)).otherwise(F.col(v)) for v, n in zip(COLOURS, ("red", "green", "blue"), strict=True)}

    kept = F.when(F.col("meets") & ~F.col("bits"), F.lit(None).cast("int"))
    under = dst.pixels.join(table, "image_id").withColumns({**in_colour("dst", F.col("base"), F.col("dst_to")), "idx": kept.otherwise(F.col("idx"))})
    over = src.pixels.join(table.filter("meets"), "image_id")
    over = over.withColumns({**in_colour("src", F.col("src_gamma"), F.col("src_to")), "idx": kept.otherwise(F.when(F.col("turned"), 1 - F.col("idx")).otherwise(F.col("idx")))})
    layers = None
    for k, (pixels, dx, dy) in enumerate(((under, 0, 0), (over, at_x, at_y))):
        moved = pixels.select("image_id", (F.col("x") + dx).cast("int").alias("x"), (F.col("y") + dy).cast("int").alias("y"), F.struct(F.lit(k).alias("layer"), *VALUES).alias("top"))
        layers = moved if layers is None else layers.unionByName(moved)
    top = layers.groupBy(*PLACE).agg(F.max("top").alias("top"), F.min("top.layer").alias("ground")).filter("ground = 0")
    true = F.col("meets") & ~F.col("bits")
    images = plan.select(
        "image_id",
        "title",
        F.when(true, "TRUE").otherwise(F.col("type")).alias("type"),
        "width",
        "height",
        F.when(true, F.coalesce("dst_to", "base")).otherwise(F.col("gamma")).alias("gamma"),
        F.when(true, F.lit(None).cast(dst.images.schema["palette"].dataType)).otherwise(F.col("palette")).alias("palette"),
    )
    return Carried(images, top.select(*PLACE, *[F.col(f"top.{v}").alias(v) for v in VALUES]))


def of_packed(images: DataFrame) -> Carried:
    """Bitmaps and true colour images of packed rows, exploded."""
    from ..sources.files import explode_indices

    about = images.select("image_id", "title", "type", "width", "height", F.col("gamma").cast("double").alias("gamma"), F.when(is_bitmap(), F.col("palette")).alias("palette"))
    return Carried(about, explode_indices(images.select(*PACKED.names)))
