"""Finding image files by name along paths and with default extensions."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "~/.pixelloomrc"


def read_config(text: str) -> tuple[list[str], list[str]]:
    """Paths and extensions of a configuration: path= and extension= with words, # comments, \\ before any sign."""
    found: dict[str, list[str]] = {"path": [], "extension": []}
    key = None
    for line in text.splitlines():
        body = re.sub(r"(?<!\\)#.*", "", line)
        head = re.match(r"\s*(\w+)\s*=", body)
        if head:
            key, body = head[1].lower(), body[head.end() :]
        if key in found:
            words = re.findall(r"(?:\\.|[^\s\\])+", body)
            found[key] += [re.sub(r"\\(.)", r"\1", w) for w in words]
    return [expand_path(p) for p in found["path"]], found["extension"]


def expand_path(path: str) -> str:
    return os.path.expandvars(os.path.expanduser(path))


def candidates(name: str, paths: list[str], extensions: list[str]) -> list[str]:
    """Where an image may be, best first: as named, along the paths, then with extensions; each also compressed."""
    if name == "stdin":
        return [name]
    out = [name, f"{name}.Z"]
    for p in paths:
        for base in (f"{p}/{name}", *(f"{p}/{name}{e}" for e in extensions)):
            out += [base, f"{base}.Z"]
    for e in extensions:
        out += [f"{name}{e}", f"{name}{e}.Z"]
    return out


def find_image(name: str, paths: list[str], extensions: list[str], exists: Callable[[str], bool] = os.path.isfile) -> str | None:
    return next((c for c in candidates(name, paths, extensions) if c == "stdin" or exists(c)), None)


def resolve_names(names: DataFrame, existing: DataFrame, paths: list[str], extensions: list[str]) -> DataFrame:
    """name, found (null if nothing is there) for rows of (name) and of (path).

    Candidates of a name are its rows, with their rank; one join finds those that exist and
    one aggregation takes the best.
    """
    c = F.col("name")
    parts: list = [c, F.concat(c, F.lit(".Z"))]
    for p in paths:
        for e in ("", *extensions):
            base = F.concat(F.lit(f"{p}/"), c, F.lit(e))
            parts += [base, F.concat(base, F.lit(".Z"))]
    for e in extensions:
        parts += [F.concat(c, F.lit(e)), F.concat(c, F.lit(f"{e}.Z"))]
    ranked = names.select("name", F.posexplode(F.array(*parts)).alias("rank", "path"))
    there = ranked.join(existing.select("path").distinct(), "path").groupBy("name").agg(F.min_by("path", "rank").alias("found"))
    return names.join(there, "name", "left")


def file_exists(spark: SparkSession) -> Callable[[str], bool]:
    """Whether a path is a file, on any file system Spark knows: for ``find_image``."""
    context = spark.sparkContext

    def exists(path: str) -> bool:
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        store = there.getFileSystem(context._jsc.hadoopConfiguration())
        return store.exists(there) and store.getFileStatus(there).isFile()

    return exists


def full_address(spark: SparkSession, path: str) -> str:
    """A path as the file readers name it."""
    context = spark.sparkContext
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(there).getPath().toString()


def list_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """directory, position, name, length of the files in each directory of a path. Contents aren't read."""
    listed = None
    for k, p in enumerate(paths):
        there = spark.read.format("binaryFile").load(p.rstrip("/") + "/*")
        one = there.select(F.lit(p).alias("directory"), F.lit(k).alias("position"), F.substring_index("path", "/", -1).alias("name"), "length")
        listed = one if listed is None else listed.unionByName(one)
    return listed if listed is not None else spark.createDataFrame([], "directory string, position int, name string, length bigint")


def show_path(spark: SparkSession, paths: list[str], extensions: list[str]) -> DataFrame:
    """kind (path or extension), position, value: a configuration as rows."""
    rows = [("path", k, p) for k, p in enumerate(paths)] + [("extension", k, e) for k, e in enumerate(extensions)]
    return spark.createDataFrame(rows, "kind string, position int, value string")
