"""What the operators share: the folder all executors see, saved steps, joins that stay even.

``shared_dir`` names that folder. ``saved`` writes a step there as Parquet and reads it
back, which cuts the lineage with files that outlive any executor.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in the sense of the size contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only if it has been counted and has this many rows at most.
BROADCAST_ROWS = 20_000
#: Keys with more than this share of a table's rows, and more rows than LEAST_HOT, are joined apart; there can't be more than HOT_KEYS of them.
HOT_KEYS, LEAST_HOT = 1000, 200
#: Bytes of rows that may be wide and are broadcast all the same; more of them are sent to SALTS places each.
HOT_BYTES, SALTS = 64 << 20, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark is local, one of our own."""
    conf = spark.sparkContext.getConf()
    place = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not place:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), f"pixelloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Steps saved in each scope that is open.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Steps that are saved inside go when the block ends, but for lasting ones: what is still to be read must be one of them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for step in _SCOPES.pop():
            discard(step)


def saved(df: DataFrame, name: str, compression: str = "zstd", lasting: bool = False) -> DataFrame:
    """Write a step to the shared folder and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    if _SCOPES and not lasting:
        _SCOPES[-1].append(back)
    return back


def discard(step: DataFrame) -> None:
    """Remove a saved step that nothing reads any more."""
    context = step.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(step.saved_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with marks after it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """The same join with each row of ``small`` in SALTS places and the rows of ``big`` dealt to these."""
    salt = unused("salt", [*big.columns, *small.columns])
    left = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right.hint("merge"), [key, salt], how).drop(salt)


def even_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int | None = None, wide: bool = False) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, with no key's rows in one task.

    Keys that hold more than one in HOT_KEYS of the rows of ``big`` meet their HOT_KEYS rows
    or fewer of ``small`` by broadcast, the others by shuffle; in a left join, rows with a
    null key go to neither. ``big`` is read several times, so it should be a saved step.
    rows: how many ``big`` has, if that is known. wide: rows of ``small`` may be of any size,
    so those that are to be broadcast are added up first.
    """
    there = big.filter(F.col(key).isNotNull())
    rows = there.count() if rows is None else rows
    hot = None
    if rows > LEAST_HOT:
        hot = saved(there.groupBy(key).count().filter(F.col("count") > max(LEAST_HOT, rows / HOT_KEYS)).select(key), "hot-keys")
        hot = None if hot.isEmpty() else F.broadcast(hot)
    if hot is None:
        found = there.join(small.hint("merge"), key, how)
    else:
        many, few = there.join(hot, key, "left_semi"), small.join(hot, key, "left_semi")
        size = few.agg(F.sum(F.octet_length(F.to_json(F.struct(*few.columns))))).first()[0] if wide else 0
        apart = many.join(F.broadcast(few), key, how) if (size or 0) <= HOT_BYTES else salted_join(many, few, key, how)
        found = there.join(hot, key, "left_anti").join(small.hint("merge"), key, how).unionByName(apart)
    return found.unionByName(big.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else found


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(c: Column) -> Column:
    """The text's bytes; null is empty."""
    return F.coalesce(c.cast("binary"), F.lit("").cast("binary"))


#: What a Python worker keeps from one task to the next, for one operator at a time.
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A worker's state for ``key``; that of another operator goes, and its memory with it."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # else freed memory stays with the process
                trim(0)
        _KEPT[key] = make()
    return _KEPT[key]
