"""A whole command as a DataFrame: what its mode asks for, over the images that it names."""

from __future__ import annotations

from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..image import PACKED, pack, unpack
from ..operators import raster as R
from ..sources import files
from ..sources.registry import Context, decoded, registry
from ..sources.simple import colour_of
from . import jobs, options, paths

VERSION = "2.0"
SHOWN = T.StructType([T.StructField("position", T.IntegerType()), *PACKED.fields])


def named_files(spark: SparkSession, parsed: options.Parsed, folders: list[str], extensions: list[str]) -> DataFrame:
    """position, path, content of each image of a command that is found, in its order; names come from a command line, so they are few."""
    there = paths.file_exists(spark)
    found = [(k, paths.find_image(j.name, folders, extensions, there)) for k, j in enumerate(parsed.jobs)]
    rows = [(k, p) for k, p in found if p is not None]
    if not rows:
        return spark.createDataFrame([], "position int, path string, content binary")
    read = spark.read.format("binaryFile").load(sorted({p for _, p in rows})).select("path", "content")
    # the reader gives full addresses, so the asked ones are made full too
    asked = spark.createDataFrame([(k, paths.full_address(spark, p)) for k, p in rows], "position int, path string")
    return read.join(F.broadcast(asked), "path").select("position", "path", "content")


#: A processed image, with where it goes if it is laid over the one before.
PLACED = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("merge", T.BooleanType()), T.StructField("center", T.BooleanType()), T.StructField("at_x", T.IntegerType()), T.StructField("at_y", T.IntegerType()), *PACKED.fields])


def processed(named: DataFrame, parsed: options.Parsed) -> DataFrame:
    """Rows of PLACED: each image decoded and put through its job where its file is read; what can't be decoded is left out."""
    formats, told, target = registry(), [asdict(j) for j in parsed.jobs], parsed.target

    def one(row: dict) -> tuple | None:
        job = options.Job(**told[row["position"]])
        background = colour_of(job.background) if job.background else None
        context = Context(width=target.width, height=target.height, background=background, xpm=job.xpm or "c", iscale=job.iscale, gamma=target.gamma)
        d = decoded(row["path"], row["content"], context, formats)
        if d.raster is None:
            return None
        job = options.trailing(job, d.options) if d.options else job
        r = d.raster if d.zoom == (100, 100) else R.zoom(d.raster, *d.zoom)
        x, y = job.at or (0, 0)
        return (row["position"], job.merge, job.center, x, y, *pack(row["position"], jobs.process(r, job, target)))

    return files.each(named, one, PLACED)


def chains(images: DataFrame) -> DataFrame:
    """position, chain: images that are laid over one another have one number, counted from 0.

    A chain begins with each image that isn't merged, so its number is a running count of
    those. Only positions are counted: as many rows as the command line has names.
    """
    begins = F.when(F.col("merge"), 0).otherwise(1)
    first = F.when(F.row_number().over(Window.orderBy("position")) == 1, 1).otherwise(begins)
    marked = images.select("position", first.alias("begins"))
    return marked.select("position", (F.sum("begins").over(Window.orderBy("position")) - 1).alias("chain"))


def shown(spark: SparkSession, parsed: options.Parsed, folders: list[str], extensions: list[str]) -> DataFrame:
    """position and a packed image for each that is shown: processed by its job, merged where the job says so, fitted to the target.

    Images are decoded and processed in tasks of their own; only those of one chain of
    merges meet. The first is fitted to the whole target if that is asked for, the others
    too with ``forall``.
    """
    target = parsed.target
    plain = replace(target, fullscreen=False, fillscreen=False)

    def compose(key: tuple, group: pa.Table) -> pa.Table:
        whole = None
        for row in sorted(group.to_pylist(), key=lambda r: r["position"]):
            r = unpack(row)
            if whole is None:
                whole = r
                continue
            at = (int((whole.width - r.width) / 2), int((whole.height - r.height) / 2)) if row["center"] else (row["at_x"], row["at_y"])
            whole = R.merge(whole, r, *at, target.gamma)
        chain = key[0].as_py()
        row = (chain, *pack(chain, jobs.fit_to_target(whole, target if target.forall or not chain else plain)))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.types, strict=True)], schema=kinds)

    kinds = files.to_arrow_schema(SHOWN)
    images = processed(named_files(spark, parsed, folders, extensions), parsed).persist()
    numbered = images.join(F.broadcast(chains(images)), "position")
    return numbered.groupBy("chain").applyInArrow(compose, SHOWN)


def run(spark: SparkSession, words: list[str], folders: list[str] = (), extensions: list[str] = ()) -> DataFrame:
    """The result of a command: a description of images, a list, a table of what there is, or the images shown.

    Modes: identify, list, path, supported, version, help, default (the empty root window,
    tiled over the target), and view.
    """
    parsed = options.parse(words)
    mode = parsed.target.mode
    if mode == "identify":
        return files.identify(named_files(spark, parsed, list(folders), list(extensions)).select("path", "content"))
    if mode == "list":
        return paths.list_images(spark, list(folders))
    if mode == "path":
        return paths.show_path(spark, list(folders), list(extensions))
    if mode == "supported":
        return files.supported(spark)
    if mode == "version":
        return spark.createDataFrame([(VERSION,)], "version string")
    if mode == "help":
        return options.catalogue(spark)
    if mode == "default":
        r = R.tile(R.root_weave(), parsed.target.width, parsed.target.height)
        return spark.createDataFrame([(0, *pack(0, r))], SHOWN)
    return shown(spark, parsed, list(folders), list(extensions))

