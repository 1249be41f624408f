"""Colours and names as column expressions; all run inside generated code."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Value = Column | str

#: Common colour names of window systems.
NAMES = {
    "snow": "fffafa", "ghost white": "f8f8ff", "white smoke": "f5f5f5", "gainsboro": "dcdcdc", "floral white": "fffaf0", "old lace": "fdf5e6", "linen": "faf0e6", "antique white": "faebd7",
    "papaya whip": "ffefd5", "blanched almond": "ffebcd", "bisque": "ffe4c4", "peach puff": "ffdab9", "navajo white": "ffdead", "moccasin": "ffe4b5", "cornsilk": "fff8dc", "ivory": "fffff0",
    "lemon chiffon": "fffacd", "seashell": "fff5ee", "honeydew": "f0fff0", "mint cream": "f5fffa", "azure": "f0ffff", "alice blue": "f0f8ff", "lavender": "e6e6fa", "lavender blush": "fff0f5",
    "misty rose": "ffe4e1", "white": "ffffff", "black": "000000", "dark slate gray": "2f4f4f", "dim gray": "696969", "slate gray": "708090", "light slate gray": "778899", "gray": "bebebe",
    "light gray": "d3d3d3", "midnight blue": "191970", "navy": "000080", "navy blue": "000080", "cornflower blue": "6495ed", "dark slate blue": "483d8b", "slate blue": "6a5acd", "medium slate blue": "7b68ee",
    "light slate blue": "8470ff", "medium blue": "0000cd", "royal blue": "4169e1", "blue": "0000ff", "dodger blue": "1e90ff", "deep sky blue": "00bfff", "sky blue": "87ceeb", "light sky blue": "87cefa",
    "steel blue": "4682b4", "light steel blue": "b0c4de", "light blue": "add8e6", "powder blue": "b0e0e6", "pale turquoise": "afeeee", "dark turquoise": "00ced1", "medium turquoise": "48d1cc", "turquoise": "40e0d0",
    "cyan": "00ffff", "light cyan": "e0ffff", "cadet blue": "5f9ea0", "medium aquamarine": "66cdaa", "aquamarine": "7fffd4", "dark green": "006400", "dark olive green": "556b2f", "dark sea green": "8fbc8f",
    "sea green": "2e8b57", "medium sea green": "3cb371", "light sea green": "20b2aa", "pale green": "98fb98", "spring green": "00ff7f", "lawn green": "7cfc00", "green": "00ff00", "chartreuse": "7fff00",
    "medium spring green": "00fa9a", "green yellow": "adff2f", "lime green": "32cd32", "yellow green": "9acd32", "forest green": "228b22", "olive drab": "6b8e23", "dark khaki": "bdb76b", "khaki": "f0e68c",
    "pale goldenrod": "eee8aa", "light goldenrod yellow": "fafad2", "light yellow": "ffffe0", "yellow": "ffff00", "gold": "ffd700", "light goldenrod": "eedd82", "goldenrod": "daa520", "dark goldenrod": "b8860b",
    "rosy brown": "bc8f8f", "indian red": "cd5c5c", "saddle brown": "8b4513", "sienna": "a0522d", "peru": "cd853f", "burlywood": "deb887", "beige": "f5f5dc", "wheat": "f5deb3",
    "sandy brown": "f4a460", "tan": "d2b48c", "chocolate": "d2691e", "firebrick": "b22222", "brown": "a52a2a", "dark salmon": "e9967a", "salmon": "fa8072", "light salmon": "ffa07a",
    "orange": "ffa500", "dark orange": "ff8c00", "coral": "ff7f50", "light coral": "f08080", "tomato": "ff6347", "orange red": "ff4500", "red": "ff0000", "hot pink": "ff69b4",
    "deep pink": "ff1493", "pink": "ffc0cb", "light pink": "ffb6c1", "pale violet red": "db7093", "maroon": "b03060", "medium violet red": "c71585", "violet red": "d02090", "magenta": "ff00ff",
    "violet": "ee82ee", "plum": "dda0dd", "orchid": "da70d6", "medium orchid": "ba55d3", "dark orchid": "9932cc", "dark violet": "9400d3", "blue violet": "8a2be2", "purple": "a020f0",
    "medium purple": "9370db", "thistle": "d8bfd8",
}


#: The numbered shades of a colour, 1 to 4.
SHADES = """
snow fffafa eee9e9 cdc9c9 8b8989
seashell fff5ee eee5de cdc5bf 8b8682
antiquewhite ffefdb eedfcc cdc0b0 8b8378
bisque ffe4c4 eed5b7 cdb79e 8b7d6b
peachpuff ffdab9 eecbad cdaf95 8b7765
navajowhite ffdead eecfa1 cdb38b 8b795e
lemonchiffon fffacd eee9bf cdc9a5 8b8970
cornsilk fff8dc eee8cd cdc8b1 8b8878
ivory fffff0 eeeee0 cdcdc1 8b8b83
honeydew f0fff0 e0eee0 c1cdc1 838b83
lavenderblush fff0f5 eee0e5 cdc1c5 8b8386
mistyrose ffe4e1 eed5d2 cdb7b5 8b7d7b
azure f0ffff e0eeee c1cdcd 838b8b
slateblue 836fff 7a67ee 6959cd 473c8b
royalblue 4876ff 436eee 3a5fcd 27408b
blue 0000ff 0000ee 0000cd 00008b
dodgerblue 1e90ff 1c86ee 1874cd 104e8b
steelblue 63b8ff 5cacee 4f94cd 36648b
deepskyblue 00bfff 00b2ee 009acd 00688b
skyblue 87ceff 7ec0ee 6ca6cd 4a708b
lightskyblue b0e2ff a4d3ee 8db6cd 607b8b
slategray c6e2ff b9d3ee 9fb6cd 6c7b8b
lightsteelblue cae1ff bcd2ee a2b5cd 6e7b8b
lightblue bfefff b2dfee 9ac0cd 68838b
lightcyan e0ffff d1eeee b4cdcd 7a8b8b
paleturquoise bbffff aeeeee 96cdcd 668b8b
cadetblue 98f5ff 8ee5ee 7ac5cd 53868b
turquoise 00f5ff 00e5ee 00c5cd 00868b
cyan 00ffff 00eeee 00cdcd 008b8b
darkslategray 97ffff 8deeee 79cdcd 528b8b
aquamarine 7fffd4 76eec6 66cdaa 458b74
darkseagreen c1ffc1 b4eeb4 9bcd9b 698b69
seagreen 54ff9f 4eee94 43cd80 2e8b57
palegreen 9aff9a 90ee90 7ccd7c 548b54
springgreen 00ff7f 00ee76 00cd66 008b45
green 00ff00 00ee00 00cd00 008b00
chartreuse 7fff00 76ee00 66cd00 458b00
olivedrab c0ff3e b3ee3a 9acd32 698b22
darkolivegreen caff70 bcee68 a2cd5a 6e8b3d
khaki fff68f eee685 cdc673 8b864e
lightgoldenrod ffec8b eedc82 cdbe70 8b814c
lightyellow ffffe0 eeeed1 cdcdb4 8b8b7a
yellow ffff00 eeee00 cdcd00 8b8b00
gold ffd700 eec900 cdad00 8b7500
goldenrod ffc125 eeb422 cd9b1d 8b6914
darkgoldenrod ffb90f eead0e cd950c 8b6508
rosybrown ffc1c1 eeb4b4 cd9b9b 8b6969
indianred ff6a6a ee6363 cd5555 8b3a3a
sienna ff8247 ee7942 cd6839 8b4726
burlywood ffd39b eec591 cdaa7d 8b7355
wheat ffe7ba eed8ae cdba96 8b7e66
tan ffa54f ee9a49 cd853f 8b5a2b
chocolate ff7f24 ee7621 cd661d 8b4513
firebrick ff3030 ee2c2c cd2626 8b1a1a
brown ff4040 ee3b3b cd3333 8b2323
salmon ff8c69 ee8262 cd7054 8b4c39
lightsalmon ffa07a ee9572 cd8162 8b5742
orange ffa500 ee9a00 cd8500 8b5a00
darkorange ff7f00 ee7600 cd6600 8b4500
coral ff7256 ee6a50 cd5b45 8b3e2f
tomato ff6347 ee5c42 cd4f39 8b3626
orangered ff4500 ee4000 cd3700 8b2500
red ff0000 ee0000 cd0000 8b0000
deeppink ff1493 ee1289 cd1076 8b0a50
hotpink ff6eb4 ee6aa7 cd6090 8b3a62
pink ffb5c5 eea9b8 cd919e 8b636c
lightpink ffaeb9 eea2ad cd8c95 8b5f65
palevioletred ff82ab ee799f cd6889 8b475d
maroon ff34b3 ee30a7 cd2990 8b1c62
violetred ff3e96 ee3a8c cd3278 8b2252
magenta ff00ff ee00ee cd00cd 8b008b
orchid ff83fa ee7ae9 cd69c9 8b4789
plum ffbbff eeaeee cd96cd 8b668b
mediumorchid e066ff d15fee b452cd 7a378b
darkorchid bf3eff b23aee 9a32cd 68228b
purple 9b30ff 912cee 7d26cd 551a8b
mediumpurple ab82ff 9f79ee 8968cd 5d478b
thistle ffe1ff eed2ee cdb5cd 8b7b8b
"""


def read_names(text: str) -> dict[str, tuple[int, int, int]]:
    """Names of a list in the usual form, "red green blue name" a line; ! begins a comment. Goes to ``parse_colours`` as ``more``."""
    lines = (re.fullmatch(r"\s*(\d+)\s+(\d+)\s+(\d+)\s+(.*?)\s*", x) for x in text.splitlines())
    return {m[4].lower(): (int(m[1]), int(m[2]), int(m[3])) for m in lines if m}


@cache
def own_names() -> dict[str, tuple[int, int, int]]:
    """The list, without spaces and with the other spelling of gray, the numbered shades, gray0 to gray100."""
    found = {}
    for name, code in NAMES.items():
        for spelling in {name, name.replace("gray", "grey")}:
            rgb = tuple(bytes.fromhex(code))
            found[spelling] = found[spelling.replace(" ", "")] = rgb
    for percent in range(101):
        level = int(percent * 2.55 + 0.5)
        found[f"gray{percent}"] = found[f"grey{percent}"] = (level,) * 3
    for name, *shades in map(str.split, SHADES.strip().splitlines()):
        found |= {f"{name}{k}": tuple(bytes.fromhex(code)) for k, code in enumerate(shades, 1)}
    return found


def colour_names(more: dict[str, tuple[int, int, int]] | None = None) -> dict[str, tuple[int, int, int]]:
    """All names, with those of a system's own list."""
    return own_names() | (more or {})


def names_table(spark: SparkSession, more: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """name, red, green, blue (16 bits a channel)."""
    rows = [(n, *(v * 0x101 for v in rgb)) for n, rgb in sorted(colour_names(more).items())]
    return spark.createDataFrame(rows, "name string, red int, green int, blue int")


def intensity16(red: Column, green: Column, blue: Column) -> Column:
    """0 to 65280 of 16-bit channels: 30, 59 and 11 percent of the upper bytes, each rounded."""
    parts = ((red, 7680), (green, 15104), (blue, 2816))
    return sum(((F.floor((F.shiftright(c, 8) * w + 50) / 100)) for c, w in parts), F.lit(0)).cast("int")


def intensity8(r: Column, g: Column, b: Column) -> Column:
    """The same of 8-bit channels."""
    return sum((F.floor((c * w + 50) / 100) for c, w in ((r, 7680), (g, 15104), (b, 2816))), F.lit(0)).cast("int")


def gray8(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(intensity8(r, g, b), 8)


def gamma8(v: Column, source: float, target: float) -> Column:
    """An 8-bit value of one gamma in another."""
    exponent = 1.0 / float(np.float32(target) / np.float32(source))
    return F.floor(0.5 + 255 * F.pow(v / F.lit(255.0), F.lit(exponent))).cast("int")


def linear16(v: Column, gamma: float = 2.2) -> Column:
    """A 16-bit colour meant for a display, made linear."""
    return F.floor(0.5 + 65535.0 * F.pow(v / F.lit(65535.0), F.lit(gamma))).cast("int")


def brighter(v: Column, percent: int, most: int) -> Column:
    """In single precision, cut, at most ``most``."""
    factor = float(np.float32(percent) / np.float32(100))
    return F.least(F.floor(v.cast("float") * F.lit(factor).cast("float")), F.lit(most)).cast("int")


def five_bit_cell(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 10) + F.shiftleft(F.shiftright(g, 3), 5) + F.shiftright(b, 3)


def true_of(red: Column, green: Column, blue: Column) -> Column:
    """A 24-bit pixel of 16-bit channels."""
    return F.shiftleft(F.shiftright(red, 8), 16) + F.shiftleft(F.shiftright(green, 8), 8) + F.shiftright(blue, 8)


def scaled(a: Column, most: Column, to: Column) -> Column:
    """a of ``most`` as a share of ``to``, cut."""
    return F.floor(a * to / most).cast("int")


def depth_of_colours(n: Column) -> Column:
    """The smallest depth with 2^depth >= n, 32 at most."""
    return F.least(F.length(F.bin(F.greatest(n - 1, F.lit(0)))) - F.when(n <= 1, 1).otherwise(0), F.lit(32)).cast("int")


def colours_of_depth(depth: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(depth, F.lit(32))).cast("long")


def display_gamma(value: Column) -> Column:
    """A display's gamma; what is out of reason or no number is 2.2."""
    v = value.try_cast("double")
    return F.when(v.between(0.05, 20.0), v).otherwise(F.lit(2.2))


def gamma_default(option: Column, file: Column, kind: Column, display: Column) -> Column:
    """As told, as the file says, or by type: bitmaps the display's, palettes 2.2, true colour 1."""
    return F.coalesce(option, file, F.when(kind == "BITMAP", display).when(kind == "RGB", F.lit(2.2)).otherwise(F.lit(1.0)))


def hex_colour(spec: Column) -> Column:
    """red, green, blue (16 bits) of #rgb, #rrggbb, #rrrgggbbb, #rrrrggggbbbb; null for anything else."""
    s = F.lower(spec)
    digits = F.length(s) - 1

    def channel(k: int) -> Column:
        width = (digits / 3).cast("int")
        v = F.conv(F.substring(s, 2 + k * width, width), 16, 10).cast("long")
        return F.when(digits == 3, v * 0x1111).when(digits == 6, v * 0x101).when(digits == 9, F.floor(v * 65535 / 4095)).otherwise(v).cast("int")

    fits = s.rlike("^#([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{9}|[0-9a-f]{12})$")
    return F.when(fits, F.struct(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue")))


def parse_colours(specs: DataFrame, spec: str = "spec", more: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """``specs`` with red, green, blue and known; an unknown colour is black. The names are a bounded table. more: names of a system's own list."""
    names = names_table(specs.sparkSession, more).selectExpr("name as colour_name", "red as n_red", "green as n_green", "blue as n_blue")
    joined = specs.drop("red", "green", "blue", "known").withColumn("colour_hex", hex_colour(F.col(spec))).join(F.broadcast(names), F.lower(F.col(spec)) == F.col("colour_name"), "left")
    out = {c: F.coalesce(F.col(f"colour_hex.{c}"), F.col(f"n_{c}"), F.lit(0)) for c in ("red", "green", "blue")}
    known = F.col("colour_hex").isNotNull() | F.col("colour_name").isNotNull()
    return joined.withColumns(out | {"known": known}).drop("colour_hex", "colour_name", "n_red", "n_green", "n_blue")


def tail(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def icon_name(title: Column) -> Column:
    """The first word, without folders and without extensions; null is Unnamed."""
    return F.when(title.isNull(), F.lit("Unnamed")).otherwise(F.substring_index(tail(F.substring_index(title, " ", 1)), ".", 1))


def half_difference(a: Column, b: Column) -> Column:
    """(a - b) / 2, cut towards 0."""
    d = a - b
    return (F.signum(d) * F.floor(F.abs(d) / 2)).cast("int")


def fit_zoom(width: Column, height: Column, display_width: int, display_height: int, whole: bool = False) -> Column:
    """The percentage that fits an image to a display, or that covers it all."""
    x, y = F.lit(float(display_width)) / width, F.lit(float(display_height)) / height
    return F.floor((F.greatest(x, y) if whole else F.least(x, y)) * 100 + 0.5).cast("int")


def auto_zoom(width: Column, height: Column, display_width: int, display_height: int) -> Column:
    """100, or what brings both sides to 90 percent of the display."""
    def one(size: Column, display: int) -> Column:
        return F.when(size > display * 0.9, F.floor(F.lit(display * 90) / size)).otherwise(100).cast("int")

    return F.least(one(width, display_width), one(height, display_height))


def scale_zoom(n: Column) -> Column:
    """Percent of a scale step: each step halves, each negative step doubles."""
    return F.when(n < 0, (F.lit(100) * F.pow(F.lit(2.0), -n)).cast("int")).otherwise(F.floor(F.lit(100) / F.pow(F.lit(2.0), n)).cast("int"))


def best_depth(image: Column, depths: list[int]) -> Column:
    """The smallest depth that holds an image, else the largest there is."""
    there = F.array(*[F.lit(d) for d in depths])
    return F.coalesce(F.array_min(F.filter(there, lambda d: d >= image)), F.array_max(there))


#: The classes to try for each type of image, best first. "default" is TrueColor or DirectColor, as the display's own class is, and then the other.
CLASS_ORDER = {
    "TRUE": ("default", "other", "PseudoColor", "StaticColor", "GrayScale", "StaticGray"),
    "RGB": ("PseudoColor", "DirectColor", "TrueColor", "StaticColor", "GrayScale", "StaticGray"),
    "BITMAP": ("PseudoColor", "StaticColor", "GrayScale", "StaticGray", "DirectColor", "TrueColor"),
}


def best_visual(kind: Column, depth: Column, visuals: list[tuple[str, int]], own: str = "TrueColor", wanted: str | None = None) -> Column:
    """visual_class and visual_depth for images of a type and a depth, of those a target has; own: the class it has by itself.

    The depth comes first, then the class by type; true colour goes to PseudoColor when
    the depth is 8 or less. With a class that is wanted, only its depths count. Null if
    nothing fits.
    """
    pair = lambda name, d: F.struct(F.lit(name).alias("visual_class"), d.alias("visual_depth"))
    if wanted is not None:
        depths = [d for c, d in visuals if c == wanted]
        return pair(wanted, best_depth(depth, depths)) if depths else F.lit(None).cast("struct<visual_class:string,visual_depth:int>")
    at = best_depth(depth, [d for _, d in visuals])
    first, second = ("TrueColor", "DirectColor") if own == "TrueColor" else ("DirectColor", "TrueColor")
    there = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in visuals])
    has = lambda name: F.exists(there, lambda v: (v["c"] == name) & (v["d"] == at))
    choice = None
    for type_, order in CLASS_ORDER.items():
        names = [{"default": first, "other": second}.get(n, n) for n in order]
        best = F.coalesce(*[F.when(has(n), F.lit(n)) for n in names])
        if type_ == "TRUE":
            best = F.when((at <= 8) & has("PseudoColor"), F.lit("PseudoColor")).otherwise(best)
        choice = F.when(kind == type_, best) if choice is None else choice.when(kind == type_, best)
    return F.when(choice.isNotNull(), F.struct(choice.alias("visual_class"), at.alias("visual_depth")))


def found_at(text: Column, part: Column) -> Column:
    """Where ``part`` first begins in ``text``, from 0; null if it doesn't occur."""
    at = F.position(part, text)
    return F.when(at > 0, at - 1)


def flipped(byte: Column) -> Column:
    """The bits of a byte in reverse."""
    return sum((F.when(byte.bitwiseAND(F.lit(1 << k)) != 0, 128 >> k).otherwise(0) for k in range(8)), F.lit(0)).cast("int")


def swapped32(v: Column) -> Column:
    """The bytes of a 32-bit number in reverse."""
    return sum((F.shiftleft(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255).cast("long")), 24 - 8 * k) for k in range(4)), F.lit(0).cast("long"))


def comment_value(comments: Column, name: str) -> Column:
    """The value of name=value in an array of comments."""
    found = F.filter(comments, lambda c: F.substring_index(c, "=", 1) == name)
    return F.when(F.size(found) > 0, F.regexp_replace(F.get(found, F.lit(0)), "^[^=]*=?", ""))


#: Satellite sensor names by code.
SENSORS = {
    0: "Non-Image Derived Data", 1: "Test patterns", 2: "Graphics", 3: "Miscellaneous", 4: "PDUS Meteosat Visible", 5: "PDUS Meteosat Infrared", 6: "PDUS Meteosat Water Vapor", 7: "Radar",
    8: "Miscellaneous Aircraft Data (MAMS)", 12: "GMS Visible", 13: "GMS Infrared", 14: "ATS 6 Visible", 15: "ATS 6 Infrared", 16: "SMS-1 Visible", 17: "SMS-1 Infrared", 18: "SMS-2 Visible",
    19: "SMS-2 Infrared", 20: "GOES-1 Visible", 21: "GOES-1 Infrared", 22: "GOES-2 Visible", 23: "GOES-2 Infrared", 24: "GOES-3 Visible", 25: "GOES-3 Infrared", 26: "GOES-4 Visible (VAS)",
    27: "GOES-4 Infrared and Water Vapor (VAS)", 28: "GOES-5 Visible (VAS)", 29: "GOES-5 Infrared and Water Vapor (VAS)", 30: "GOES-6 Visible", 31: "GOES-6 Infrared", 32: "GOES-Visible, Block 1 Auxiliary Data",
    33: "GOES-7 Infrared", 34: "NOAA Series Satellites", 36: "NOAA Series Satellites", 37: "NOAA Series Satellites", 38: "NOAA Series Satellites", 39: "NOAA Series Satellites", 40: "NOAA Series Satellites", 41: "TIROS-N",
    42: "NOAA-6", 43: "NOAA-7", 44: "NOAA-8", 45: "NOAA-9", 46: "Venus", 47: "Voyager 1", 48: "Voyager 2", 50: "Hubble St.", 60: "NOAA-10", 61: "NOAA-11", 70: "GOES-I (IMAGER)", 71: "GOES-I (SOUNDER)",
    72: "GOES-J (IMAGER)", 73: "GOES-J (SOUNDER)", 74: "GOES-K (IMAGER)", 75: "GOES-K (SOUNDER)", 76: "GOES-L (IMAGER)", 77: "GOES-L (SOUNDER)", 78: "GOES-M (IMAGER)", 79: "GOES-M (SOUNDER)", 80: "ERBE", 90: "RAW METEOSAT",
}


def sensor_name(code: Column) -> Column:
    """The sensor of a code, by a constant map."""
    table = F.create_map(*[F.lit(v) for pair in SENSORS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown McIDAS format"))
