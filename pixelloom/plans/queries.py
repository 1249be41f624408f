"""The registered queries: every operator over corpora made of the given tables."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import colour as C
from ..image import PACKED, unpack
from ..operators import carried, large
from ..operators import pixels as P
from ..operators import raster as R
from ..sources import encode, files, stream
from . import corpora, formats, options, paths
from .corpora import SIDE, read

Query = Callable[[SparkSession, str], DataFrame]

#: Sixteen colours for the nearest-colour query.
SIXTEEN = [((k >> 3 & 1) * 255, (k >> 1 & 3) * 85, (k & 1) * 255) for k in range(16)]
PATHS, EXTENSIONS = ["img", "pics"], [".gif", ".ppm"]


def on_pixels(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: operator(corpora.pixels(spark, d))


def one_channel(change: Callable) -> Query:
    """r, and r changed."""
    return lambda spark, d: corpora.pixels(spark, d).select(*P.PLACE, F.col("r").alias("v"), change(F.col("r")).alias("out"))


def palette_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.palette_lookup(corpora.indexed_pixels(spark, d), corpora.palettes(spark, d))


def expand_true(spark: SparkSession, d: str) -> DataFrame:
    return P.expand_true(corpora.indexed_pixels(spark, d), corpora.palettes(spark, d))


def gray_palette(spark: SparkSession, d: str) -> DataFrame:
    level = C.intensity16(F.col("red"), F.col("green"), F.col("blue"))
    return corpora.palettes(spark, d).select("image_id", "idx", level.alias("level"))


def brighten_palette(spark: SparkSession, d: str) -> DataFrame:
    return P.mapped(corpora.palettes(spark, d), lambda v: C.brighter(v, 130, 65535), ("red", "green", "blue"))


def clip_border(spark: SparkSession, d: str) -> DataFrame:
    return P.clip_border(corpora.pixels(spark, d), corpora.images(spark, d), -2, -1, 10, 10)


def partner(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the image whose number differs in the last bit, under this image's number."""
    return corpora.pixels(spark, d).withColumn("image_id", F.col("image_id").bitwiseXOR(F.lit(1).cast("long")))


def merge_at(spark: SparkSession, d: str) -> DataFrame:
    return P.merge(corpora.pixels(spark, d), partner(spark, d), 3, -2)


def merge_center(spark: SparkSession, d: str) -> DataFrame:
    small = P.zoom(partner(spark, d), SIDE, SIDE, 50, 50)
    at = C.half_difference(F.lit(SIDE), F.lit(SIDE // 2))
    return P.merge(corpora.pixels(spark, d), small, at, at)


def merge_offcanvas(spark: SparkSession, d: str) -> DataFrame:
    return P.merge(corpora.pixels(spark, d), partner(spark, d), 100, 100)


def collage(spark: SparkSession, d: str) -> DataFrame:
    small = P.zoom(partner(spark, d), SIDE, SIDE, 50, 50)
    return P.layers([(corpora.pixels(spark, d), 0, 0), (small, 1, 1), (P.rotate(small, SIDE // 2, SIDE // 2, 90), 3, 5)])


def used_colors(spark: SparkSession, d: str) -> DataFrame:
    return P.used_colours(corpora.indexed_pixels(spark, d), 24)


def compress_cmap(spark: SparkSession, d: str) -> DataFrame:
    return P.compress(corpora.indexed_pixels(spark, d), corpora.palettes(spark, d), 24)[0]


def compress_palette(spark: SparkSession, d: str) -> DataFrame:
    return P.compress(corpora.indexed_pixels(spark, d), corpora.palettes(spark, d), 24)[1]


def bitmap_expand(spark: SparkSession, d: str) -> DataFrame:
    return P.expand_bitmap(P.threshold(corpora.pixels(spark, d)))


def zoom_auto(spark: SparkSession, d: str) -> DataFrame:
    percent = C.auto_zoom(F.lit(SIDE), F.lit(SIDE), 6, 7)
    return P.zoom(corpora.pixels(spark, d), SIDE, SIDE, percent, percent)


def specs(spark: SparkSession, d: str) -> DataFrame:
    """Colour specifications of every kind, made of part numbers."""
    k = F.col("p_partkey")
    h = F.lower(F.lpad(F.hex((k * 7919) % 16777216), 6, "0"))
    spec = F.when(k % 6 == 0, F.concat(F.lit("#"), h)).when(k % 6 == 1, F.concat(F.lit("#"), F.substring(h, 4, 3))).when(k % 6 == 2, F.concat(F.lit("#"), h, F.substring(h, 1, 3))).when(k % 6 == 3, F.concat(F.lit("#"), F.upper(h), h)).when(k % 6 == 4, F.concat(F.lit("#"), F.substring(h, 1, 4))).otherwise(F.concat(F.lit("#"), F.substring(h, 1, 5), F.lit("x")))
    return read(spark, d, "part").select("p_partkey", spec.alias("spec"))


def color_parse(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_colours(specs(spark, d))


def color_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """First words of part names as colours."""
    words = read(spark, d, "part").select("p_partkey", F.upper(F.substring_index("p_name", " ", 1)).alias("spec"))
    return C.parse_colours(words)


#: Names of every kind, and some that there aren't.
SHADES = "red,blue,antiquewhite1,antiquewhite4,khaki3,hotpink4,slate grey,dodgerblue2,tan4,medium purple,purple2,azure3,peru,goldenrod3,chocolate4,gray37,grey99,gray5,lightgoldenrodyellow,cornsilk3,thistle2,gray101,azure5,no such colour".split(",")


def color_shades(spark: SparkSession, d: str) -> DataFrame:
    spec = F.get(F.array(*map(F.lit, SHADES)), (F.col("p_partkey") % len(SHADES)).cast("int"))
    return C.parse_colours(read(spark, d, "part").select("p_partkey", spec.alias("spec")))


def option_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of flags, one a part."""
    names = F.array(*[F.lit(n) for n in options.FLAGS])
    name = F.get(names, (F.col("p_partkey") % len(options.FLAGS)).cast("int"))
    word = F.concat(F.when(F.col("p_partkey") % 11 == 0, "").otherwise("-"), F.substring(name, F.lit(1), (F.col("p_size") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 13 == 0, "q").otherwise(""))
    return options.resolve_words(read(spark, d, "part").select("p_partkey", word.alias("word")))


def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part")
    names = parts.select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("name"))
    stem = F.concat(F.lit("i"), F.col("p_partkey").cast("string"))
    there = F.when(F.col("p_size") % 5 == 0, F.array(stem, F.concat(F.lit("img/"), stem))).when(F.col("p_size") % 5 == 1, F.array(F.concat(F.lit("pics/"), stem, F.lit(".ppm")), F.concat(F.lit("img/"), stem, F.lit(".gif.Z")))).when(F.col("p_size") % 5 == 2, F.array(F.concat(stem, F.lit(".gif")), F.concat(F.lit("pics/"), stem, F.lit(".Z")))).when(F.col("p_size") % 5 == 3, F.array(F.concat(stem, F.lit(".jpg")))).otherwise(F.array(F.concat(stem, F.lit(".Z")), F.concat(stem, F.lit(".ppm.Z"))))
    return paths.resolve_names(names, parts.select(F.explode(there).alias("path")), PATHS, EXTENSIONS)


def icon_name(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("page_id") % 9 == 0, F.lit(None)).otherwise(F.concat("url", F.lit(" (50% zoom)")))
    return read(spark, d, "pages").select("page_id", C.icon_name(title).alias("icon"))


def tail(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", C.tail(F.col("url")).alias("tail"))


def depth_of_colors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") + 1
    return read(spark, d, "part").select("p_partkey", C.depth_of_colours(n).alias("depth"), C.colours_of_depth(F.col("p_size")).alias("colors"))


def pm_scale(spark: SparkSession, d: str) -> DataFrame:
    most = F.col("p_size") + 1
    return read(spark, d, "part").select("p_partkey", C.scaled(F.col("p_partkey") % most, most, F.lit(255)).alias("scaled"))


def default_gamma(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("BITMAP"), F.lit("RGB"), F.lit("TRUE")), (k % 3 + 1).cast("int"))
    option = F.when(k % 5 == 0, F.lit(1.7))
    file = F.when(k % 7 == 0, F.lit(1.0))
    display = C.display_gamma(F.when(k % 2 == 0, F.lit("1.8")).when(k % 3 == 0, F.lit("99")).otherwise(F.lit("x")))
    return read(spark, d, "part").select("p_partkey", C.gamma_default(option, file, kind, display).alias("gamma"))


def sensor_name(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("p_partkey") % 100).cast("int")
    return read(spark, d, "part").select("p_partkey", C.sensor_name(code).alias("sensor"))


def scalars(spark: SparkSession, d: str) -> DataFrame:
    """Small arithmetic: centring, fitting, scale steps, linear colours, true pixels."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select(
        "p_partkey",
        C.half_difference(s, (k % 50).cast("int")).alias("centre"),
        C.fit_zoom(s + 1, (k % 40 + 1).cast("int"), 64, 48).alias("fit"),
        C.fit_zoom(s + 1, (k % 40 + 1).cast("int"), 64, 48, True).alias("cover"),
        C.scale_zoom((k % 7 - 3).cast("int")).alias("scale"),
        C.linear16((k * 31 % 65536).cast("int")).alias("linear"),
        C.true_of((k * 31 % 65536).cast("int"), (k * 17 % 65536).cast("int"), (k * 13 % 65536).cast("int")).alias("true"),
    )


def best_depth(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", C.best_depth(F.col("p_size"), [1, 4, 8, 16, 24]).alias("depth"))


#: What a display of each kind has.
SHOWS = {"TrueColor": [("PseudoColor", 8), ("TrueColor", 24), ("DirectColor", 24), ("StaticGray", 1)], "DirectColor": [("StaticColor", 8), ("DirectColor", 16), ("GrayScale", 8)]}


def best_visual(spark: SparkSession, d: str) -> DataFrame:
    """The visual for images of all types and depths on two kinds of display, and of a class that is asked for."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("BITMAP"), F.lit("RGB"), F.lit("TRUE")), (k % 3 + 1).cast("int"))
    found = {f"on_{own}".lower(): C.best_visual(kind, F.col("p_size"), there, own) for own, there in SHOWS.items()}
    found["gray"] = C.best_visual(kind, F.col("p_size"), SHOWS["DirectColor"], wanted="GrayScale")
    rows = read(spark, d, "part").select("p_partkey", *[v.alias(n) for n, v in found.items()])
    return rows.select("p_partkey", *[F.col(f"{n}.visual_{f}").alias(f"{n}_{f}") for n in found for f in ("class", "depth")])


def found_at(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", C.found_at(F.col("p_name"), F.substring("p_type", 2, 2)).alias("position"))


def command_words(spark: SparkSession, d: str) -> DataFrame:
    return files.command_words(encoded(spark, d).select("path", "content"))


def goto_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.first_of_name(read(spark, d, "part").selectExpr("p_name as name", "p_partkey as position"))


def bit_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", C.flipped((k % 256).cast("int")).alias("flipped"), C.swapped32((k * 7919) % 4294967296).alias("swapped"))


def recolor_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return P.recolour(P.threshold(corpora.pixels(spark, d)), (0x8080, 0x4040, 0), (0, 0, 0x8080))


def text_comment(spark: SparkSession, d: str) -> DataFrame:
    notes = F.array(F.concat(F.lit("maker="), "p_brand"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("image_gamma="), (F.col("p_size") / 10).cast("string"))).otherwise("image_gammas"), F.lit("image_gamma=9"))
    return read(spark, d, "part").select("p_partkey", C.comment_value(notes, "image_gamma").alias("gamma"), C.comment_value(notes, "absent").alias("absent_note"))


def pipeline_full(spark: SparkSession, d: str) -> DataFrame:
    """Clip, rotate, zoom, smooth, gray, normalize, brighten: a whole job in its fixed order."""
    p = P.clip(corpora.pixels(spark, d), 1, 1, 6, 5)
    p = P.zoom(P.rotate(p, 6, 5, 90), 5, 6, 150, 200)
    g = P.gray(P.smooth(p))
    p = P.normalize(g.select(*P.PLACE, *[F.col("level").alias(c) for c in P.COLOURS]))
    return P.brighten(p, 120)


def packed(spark: SparkSession, d: str) -> DataFrame:
    return files.pack_pixels(corpora.pixels(spark, d))


def exploded(change: Callable) -> Query:
    """Packed images through an operator in arrays, exploded."""
    return lambda spark, d: files.explode_pixels(files.mapped(packed(spark, d), change))


def encoded(spark: SparkSession, d: str) -> DataFrame:
    """Each image as a file of one of five formats."""
    forms = sorted(encode.ENCODERS)
    schema = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def one(row: dict) -> tuple:
        form = forms[row["image_id"] % len(forms)]
        content = encode.ENCODERS[form](unpack(row).but(gamma=None))
        content = gzip.compress(content, mtime=0) if row["image_id"] % 7 == 0 else content
        return row["image_id"], f"{row['image_id']}.{form}", stream.with_trailing(content, f"-rotate 90 -bright {row['image_id'] % 50 + 50}") if row["image_id"] % 7 == 1 else content

    return files.each(packed(spark, d), one, schema)


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Images encoded in five formats, some compressed, decoded and exploded again."""
    return files.explode_pixels(files.decode(encoded(spark, d)))


def decode_formats(spark: SparkSession, d: str) -> DataFrame:
    """Files of the other fifteen formats, decoded: what each is, its indices or colours as a digest, and its palette as a sum."""
    found = files.decode(formats.files_of(spark, d))
    part = F.transform("palette", lambda c, k: (c["red"] + 3 * c["green"] + 7 * c["blue"]).cast("long") * (k + 1))
    total = F.coalesce(F.aggregate(part, F.lit(0).cast("long"), lambda n, v: n + v), F.lit(0).cast("long"))
    return found.select("image_id", "path", "format", "status", "type", "width", "height", "depth", F.md5(F.lower(F.hex("data"))).alias("data_md5"), total.alias("palette_sum"))


def identify_formats(spark: SparkSession, d: str) -> DataFrame:
    """The same files by their headers."""
    found = files.identify(formats.files_of(spark, d).select("path", "content"))
    return found.select("path", "format", "status", "depth", "told", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height", "colors")])


def identify(spark: SparkSession, d: str) -> DataFrame:
    found = files.identify(encoded(spark, d).select("path", "content"))
    return found.select("path", "format", "status", "width", "height", "depth", F.coalesce("colors", F.lit(0)).alias("colors"), "description")


def trailing_options(spark: SparkSession, d: str) -> DataFrame:
    return files.options_of(encoded(spark, d).select("path", "content"))


def job_packed(spark: SparkSession, d: str) -> DataFrame:
    """The job of ``pipeline_full`` on packed images."""
    job = options.parse("-clip 1,1,6,5 -rotate 90 -xzoom 150 -yzoom 200 -smooth -gray -normalize -brighten 120 -gamma 1.0 x".split()).jobs[0]
    return files.explode_pixels(files.process(packed(spark, d), job))


def reduced(spark: SparkSession, d: str) -> DataFrame:
    """Reduced to 16 colours by a table of cells: indices looked up in their palettes."""
    return P.expand_true(*large.reduce(corpora.pixels(spark, d), 16))


def reduced_in_strips(spark: SparkSession, d: str) -> DataFrame:
    return P.expand_true(*large.reduce_dithered(corpora.pixels(spark, d), 16))


def nearest_of_table(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of each image's own 32 colours."""
    return large.nearest_entry(corpora.pixels(spark, d), corpora.palettes(spark, d))


def with_gammas(spark: SparkSession, d: str) -> carried.Carried:
    """The images with gammas of their own: 1, 2.2 or 1.7 by number."""
    gamma = F.get(F.array(F.lit(1.0), F.lit(2.2), F.lit(1.7)), (F.col("image_id") % 3).cast("int"))
    about = corpora.images(spark, d).select("image_id", F.lit("").alias("title"), F.lit("TRUE").alias("type"), "width", "height", gamma.alias("gamma"), F.lit(None).cast(PACKED["palette"].dataType).alias("palette"))
    return carried.Carried(about, corpora.pixels(spark, d).select(*P.PLACE, F.lit(None).cast("int").alias("idx"), *P.COLOURS))


def gray_carried(spark: SparkSession, d: str) -> DataFrame:
    """Grays of images of several gammas, each made linear first, with the gamma that they have then."""
    found = carried.gray(with_gammas(spark, d))
    return found.pixels.join(found.images, "image_id").select(*P.PLACE, F.col("r").alias("level"), "gamma")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "pixels": corpora.pixels,
        "palette_lookup": palette_lookup,
        "expand_true": expand_true,
        "bitmap_expand": bitmap_expand,
        "gray": on_pixels(P.gray),
        "gray_palette": gray_palette,
        "gamma_to_linear": one_channel(lambda v: C.gamma8(v, 2.2, 1.0)),
        "gamma_to_display": one_channel(lambda v: C.gamma8(v, 1.0, 2.2)),
        "brighten": on_pixels(lambda p: P.brighten(p, 130)),
        "brighten_palette": brighten_palette,
        "normalize": on_pixels(P.normalize),
        "rotate_90": on_pixels(lambda p: P.rotate(p, SIDE, SIDE, 90)),
        "rotate_180": on_pixels(lambda p: P.rotate(p, SIDE, SIDE, 180)),
        "rotate_270": on_pixels(lambda p: P.rotate(p, SIDE, SIDE, 270)),
        "zoom_150": on_pixels(lambda p: P.zoom(p, SIDE, SIDE, 150, 150)),
        "zoom_50": on_pixels(lambda p: P.zoom(p, SIDE, SIDE, 50, 50)),
        "zoom_x": on_pixels(lambda p: P.zoom(p, SIDE, SIDE, 230, 0)),
        "zoom_auto": zoom_auto,
        "clip_inner": on_pixels(lambda p: P.clip(p, 2, 2, 4, 4)),
        "clip_border": clip_border,
        "fill_rect": on_pixels(lambda p: P.fill(p, 1, 2, 3, 4, (9, 99, 199))),
        "tile": on_pixels(lambda p: P.tile(p, SIDE, SIDE, 19, 11)),
        "merge_at": merge_at,
        "merge_center": merge_center,
        "merge_offcanvas": merge_offcanvas,
        "collage": collage,
        "histogram_5bit": on_pixels(P.histogram),
        "histogram_marginals": on_pixels(P.marginals),
        "box_stats": on_pixels(P.box_stats),
        "minmax": on_pixels(P.extremes),
        "used_colors": used_colors,
        "compress_cmap": compress_cmap,
        "compress_palette": compress_palette,
        "smooth_1": on_pixels(P.smooth),
        "smooth_2": on_pixels(lambda p: P.smooth(p, 2)),
        "halftone": on_pixels(P.halftone),
        "threshold_bitmap": on_pixels(P.threshold),
        "nearest_color": on_pixels(lambda p: P.nearest_colour(p, SIXTEEN)),
        "text_raster_histogram": corpora.text_levels,
        "color_parse": color_parse,
        "color_name_lookup": color_name_lookup,
        "color_shades": color_shades,
        "option_resolve": option_resolve,
        "path_resolve": path_resolve,
        "icon_name": icon_name,
        "tail": tail,
        "depth_of_colors": depth_of_colors,
        "pm_scale": pm_scale,
        "default_gamma": default_gamma,
        "sensor_name": sensor_name,
        "scalar_arithmetic": scalars,
        "best_depth": best_depth,
        "best_visual": best_visual,
        "found_at": found_at,
        "command_words": command_words,
        "goto_lookup": goto_lookup,
        "bit_order": bit_order,
        "recolor_bitmap": recolor_bitmap,
        "comment_value": text_comment,
        "pipeline_full": pipeline_full,
        "pipeline_packed": job_packed,
        "decode_roundtrip": decode_roundtrip,
        "decode_formats": decode_formats,
        "identify_formats": identify_formats,
        "identify": identify,
        "trailing_options": trailing_options,
        "gray_carried": gray_carried,
        "smooth_tiled": on_pixels(lambda p: large.smooth_tiled(p, 2, 3)),
        "dither_strips": on_pixels(lambda p: P.expand_bitmap(large.dither(p))),
        "nearest_palette": nearest_of_table,
        "reduce_relations": reduced,
        "reduce_strips": reduced_in_strips,
        "smooth_packed": exploded(R.smooth),
        "halftone_packed": exploded(R.halftone),
        "zoom_packed": exploded(lambda r: R.zoom(r, 150, 150)),
        "clip_packed": exploded(lambda r: R.clip(r, -2, -1, 10, 10)),
        "reduce_n": exploded(lambda r: R.reduce(r, 16)),
        "reduce_dither": exploded(lambda r: R.reduce(r, 16, True)),
        "dither_fs": exploded(R.dither),
    }
    return found
