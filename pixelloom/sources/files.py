"""Image files as DataFrames: scan, decode, identify, process, write.

A file is one task's row; it is read whole, decoded in the worker, and goes on as a packed
row, so no stage before a shuffle holds more than one file. Bad files never fail a job:
they are rows with a status.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..image import PACKED, pack, unpack
from ..operators import raster as R
from ..plans import jobs as J
from ..plans.options import Job, RenderTarget, trailing
from . import encode
from .headers import Head, Read
from .registry import Context, Registry, decoded, registry, told_of
from .stream import last_options, with_trailing, without_trailing

ABOUT = [T.StructField(n, T.StringType()) for n in ("path", "format", "status", "error", "options")]
DECODED = T.StructType(ABOUT + PACKED.fields)


def scan(spark: SparkSession, path: str, stream: bool = False, pattern: str | None = None) -> DataFrame:
    """path, content of the files under ``path``; as a stream if asked for."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    return reader.load(path).select("path", "content")


def each(df: DataFrame, change: Callable[[dict], tuple | None], schema: T.StructType) -> DataFrame:
    """A row at a time within Arrow batches; rows that become None are left out."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # few at a time: a row may be a large image
                rows = [r for r in map(change, batch.slice(k, 16).to_pylist()) if r is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.types)], schema=kinds)

    return df.mapInArrow(run, schema)


def decode(files: DataFrame, context: Context = Context(), formats: Registry | None = None) -> DataFrame:
    """Packed images of rows of (path, content); image_id is the hash of the path.

    The formats known here and now, those registered by the user too, go with the task.
    """
    formats = formats or registry()

    def one(row: dict) -> tuple:
        d = decoded(row["path"], row["content"], context, formats)
        head = (row["path"], d.format, d.status, d.error, d.options)
        if d.raster is None:
            return (*head, row["image_id"], *[None] * (len(PACKED.fields) - 1))
        r = d.raster if d.zoom == (100, 100) else R.zoom(d.raster, *d.zoom)
        return (*head, *pack(row["image_id"], r))

    ident = F.col("image_id") if "image_id" in files.columns else F.xxhash64("path")
    return each(files.select("path", "content", ident.alias("image_id")), one, DECODED)


#: told: the file in its format's own words; bytes_read: of the file, as it lies.
IDENTIFIED = T.StructType(ABOUT[:4] + [T.StructField(n, T.IntegerType()) for n in ("width", "height", "depth", "colors")] + [T.StructField(n, T.StringType()) for n in ("description", "told")] + [T.StructField("bytes_read", T.LongType())])


def header_row(path: str, read: Read, context: Context, formats: Registry) -> tuple:
    """A row of IDENTIFIED."""
    try:
        head = Head(path, read)
    except OSError as e:
        return (path, None, "error", f"{type(e).__name__}: {e}", *[None] * 4, f"{path}: unknown or unsupported image type", None, 0)
    status, f, about, error = told_of(head, context, formats)
    first = (path, f and f.name, status, error)
    if about is None:
        return (*first, *[None] * 4, f"{path}: unknown or unsupported image type", None, head.taken)
    size = "" if about.width is None else f"{about.width}x{about.height} "
    line = f"{path} is a {size}{f.description} image with depth {about.depth}"
    return (*first, about.width, about.height, about.depth, about.colours, line, path + about.told, head.taken)


def identify(files: DataFrame, context: Context = Context(), formats: Registry | None = None) -> DataFrame:
    """What each of (path, content) is by its header, as columns and as a line; pixels aren't decoded, so data that ends early isn't noticed."""
    formats = formats or registry()
    return each(files, lambda row: header_row(row["path"], lambda at, n: row["content"][at : at + n], context, formats), IDENTIFIED)


def arrow_reader(path: str) -> Read:
    """Parts of a file on any file system Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, name = fs.FileSystem.from_uri(path)
    source = store.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        size = source.size()
        return source.read_at(min(n, size - at), at) if at < size else b""

    return read


def identify_at(spark: SparkSession, path: str, context: Context = Context(), pattern: str | None = None, opened: Callable[[str], Read] = arrow_reader, formats: Registry | None = None) -> DataFrame:
    """The same for the files under ``path``: they are listed by Spark, and tasks read no more of each than its header.

    opened: how a task reads parts of a file, (place, number of bytes) -> bytes; for file
    systems that Arrow doesn't know.
    """
    formats = formats or registry()
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def one(row: dict) -> tuple:
        try:
            return header_row(row["path"], opened(row["path"]), context, formats)
        except (OSError, ValueError) as e:  # it has gone, or Arrow doesn't know the file system
            return (row["path"], None, "error", f"{type(e).__name__}: {e}", *[None] * 4, f"{row['path']}: unknown or unsupported image type", None, 0)

    return each(reader.load(path).select("path"), one, IDENTIFIED)


def supported(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f.name, f.description, f.trailing) for k, f in enumerate(registry())], "priority int, format string, description string, trailing boolean")


def process(images: DataFrame, job: Job | None = None, target: RenderTarget = RenderTarget()) -> DataFrame:
    """Packed images through a job; options that a file carries come on top of it."""
    keep = [c for c in ("path", "format", "status", "error", "options") if c in images.columns]
    schema = T.StructType([f for f in images.schema.fields if f.name in keep] + PACKED.fields)
    base = job or Job()

    def one(row: dict) -> tuple | None:
        head = tuple(row[c] for c in keep)
        if row["data"] is None:
            return (*head, row["image_id"], *[None] * (len(PACKED.fields) - 1))
        own = trailing(base, row["options"]) if row.get("options") else base
        return (*head, *pack(row["image_id"], J.process(unpack(row), own, target, scaled=row.get("format") == "jpeg" and 1 <= own.iscale <= 3)))

    return each(images, one, schema)


def mapped(images: DataFrame, change: Callable) -> DataFrame:
    """Packed images with an operator of ``operators.raster`` applied to each."""
    return each(images.select(*PACKED.names), lambda row: pack(row["image_id"], change(unpack(row))), PACKED)


def render(images: DataFrame, target: RenderTarget = RenderTarget(), form: str = "png") -> DataFrame:
    """image_id, title, content: each image fitted to a target and encoded."""
    schema = T.StructType([PACKED["image_id"], PACKED["title"], T.StructField("content", T.BinaryType())])

    def one(row: dict) -> tuple | None:
        if row["data"] is None:
            return None
        r = J.fit_to_target(unpack(row), target)
        return row["image_id"], r.title, encode.ENCODERS[form](r)

    return each(images, one, schema)


def write_files(rendered: DataFrame, folder: str, suffix: str = ".png") -> DataFrame:
    """Write (image_id, content) as a file each, on any file system Arrow knows; returns path, length.

    A file is written under a name of its own attempt and then renamed, so a lost task
    leaves no half file under a final name.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])

    def one(row: dict) -> tuple:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, part = f"{base}/{row['image_id']}{suffix}", f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(row["content"])
        store.move(part, name)
        return name, len(row["content"])

    return each(rendered.select("image_id", "content"), one, schema)


def explode_pixels(images: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b of packed images."""
    names = ("image_id", "x", "y", "r", "g", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["data"] is None:
                    continue
                r = unpack(row)
                rgb = (r.colours16() >> 8).reshape(-1, 3).astype(np.int32)
                for k in range(0, len(rgb), 1 << 16):
                    part = rgb[k : k + (1 << 16)]
                    at = np.arange(k, k + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row["image_id"], np.int64)), *map(pa.array, (at % np.int32(r.width), at // np.int32(r.width), *np.ascontiguousarray(part.T)))], names)

    return images.select(*PACKED.names).mapInArrow(run, "image_id bigint, x int, y int, r int, g int, b int")


def explode_indices(images: DataFrame) -> DataFrame:
    """image_id, x, y, and idx of bitmaps and palette images or r, g, b of true colour ones."""
    names = ("image_id", "x", "y", "idx", "r", "g", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["data"] is None:
                    continue
                r = unpack(row)
                n, none = r.width * r.height, pa.nulls(r.width * r.height, pa.int32())
                at = np.arange(n, dtype=np.int32)
                values = [none, *map(pa.array, np.ascontiguousarray(r.pixels.reshape(-1, 3).astype(np.int32).T))] if r.type == "TRUE" else [pa.array(r.pixels.ravel().astype(np.int32)), none, none, none]
                whole = pa.RecordBatch.from_arrays([pa.array(np.full(n, row["image_id"], np.int64)), pa.array(at % r.width), pa.array(at // r.width), *values], names)
                for k in range(0, n, 1 << 16):
                    yield whole.slice(k, 1 << 16)

    return images.mapInArrow(run, "image_id bigint, x int, y int, idx int, r int, g int, b int")


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """Packed true colour images of exploded ones: one shuffle by image; an image is a group."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*[F.unhex(F.lpad(F.hex(c), 2, "0")) for c in ("r", "g", "b")]).alias("p"))))
    grouped = pixels.groupBy("image_id").agg(ordered.alias("s"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    data = F.unhex(F.array_join(F.transform("s", lambda p: F.hex(p["p"])), ""))
    return grouped.select("image_id", F.lit("").alias("title"), F.lit("TRUE").alias("type"), "width", "height", F.lit(24).alias("depth"), F.lit(1.0).cast("float").alias("gamma"), F.lit(None).cast(PACKED["palette"].dataType).alias("palette"), data.alias("data"))


def options_of(files: DataFrame) -> DataFrame:
    """path, options: the trailing options of files, the last of them wherever they stand."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("options", T.StringType())])
    return each(files, lambda row: (row["path"], last_options(row["content"])), schema)


def command_words(files: DataFrame, named: bool = False) -> DataFrame:
    """path, words: each file as a command line has it, its own options before its name; named: with -name."""
    name = F.concat(F.lit("-name "), F.col("path")) if named else F.col("path")
    return options_of(files).select("path", F.concat_ws(" ", "options", name).alias("words"))


def edit_options(files: DataFrame, text: str | None) -> DataFrame:
    """path, content with new trailing options, or without any: new bytes, never changed in place."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
    return each(files, lambda row: (row["path"], without_trailing(row["content"]) if text is None else with_trailing(row["content"], text)), schema)


def job_row(job: Job) -> dict:
    return asdict(job)
