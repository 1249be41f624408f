"""Image corpora made of other tables: small images for trying operators at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
#: Where each channel begins in an embedding.
SHIFTS = {"r": 0, "g": 21, "b": 42}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(v: Column) -> Column:
    """A number around 0 as 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 255))).cast("int")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-number embedding as an 8 x 8 true colour image."""
    v = F.col("embedding")
    whole = read(spark, sf_dir, "embeddings").filter(F.size(v) == SIDE * SIDE).select(F.col("vec_id").alias("image_id"), v, F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    channel = {c: quantised(F.get(v, ((F.col("i") + shift) % (SIDE * SIDE)).cast("int"))) for c, shift in SHIFTS.items()}
    return whole.select("image_id", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), *[c.alias(n) for n, c in channel.items()])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height of the same images, without their pixels."""
    return read(spark, sf_dir, "embeddings").filter(F.size("embedding") == SIDE * SIDE).select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


def indexed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images with 5-bit reds as indices."""
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.shiftright("r", 3).alias("idx"))


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 colours an image: red rises, green falls, blue rises by the square, turned by the image's number."""
    i = F.col("idx")
    rows = images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("idx"))
    return rows.select("image_id", "idx", (i * 2114).alias("red"), ((31 - i) * 2114).alias("green"), ((i * i * 68 + F.pmod(F.col("image_id"), F.lit(7)) * 256) % 65536).cast("int").alias("blue"))


#: A letter for each 5-bit level, and the characters whose code points have it.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"
LATIN = "".join(map(chr, range(256)))


def text_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's bytes as a gray image, counted: image_id, value (5 bits), n.

    Counted inside the text, where it is: bytes become letters by their upper five bits,
    and a letter's count is what the text loses without it. A text makes 32 rows at most,
    of a long one only numbers go on.
    """
    data = F.col("text").cast("binary")
    lettered = F.translate(F.decode(data, "ISO-8859-1"), LATIN, "".join(c * 8 for c in LETTERS))
    rows = read(spark, sf_dir, "documents").filter(F.length(data) > 0).select(F.col("doc_id").alias("image_id"), lettered.alias("s"))
    size = F.octet_length("s")
    counts = F.array(*[F.struct(F.lit(k).alias("value"), (size - F.octet_length(F.replace(F.col("s"), F.lit(c), F.lit("")))).cast("long").alias("n")) for k, c in enumerate(LETTERS)])
    each = rows.select("image_id", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).select("image_id", "c.*")
    return each.groupBy("image_id", "value").agg(F.sum("n").alias("n"))
