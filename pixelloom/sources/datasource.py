"""Image files as a data source of Spark: ``spark.read.format("images").load(path)``.

Reading. Files are dealt to tasks by their sizes. Which columns are asked for, by
``.schema(...)``, says how much of a file is read: where only those of a header are (path,
length, format, status, error, width, height, depth, colors, told), no pixel is. A filter
on the path or the length is applied to the listing, before anything is opened.

Writing. Rows of (image_id, title, and a packed image) are encoded in ``form`` (png, ppm,
sun, tga, bmp). A task writes into a folder of its own attempt; the job's commit moves the
files of the attempts that were committed to their names and removes the rest, and an abort
removes all of them, so a failed task leaves nothing.

Streaming. Offsets are times of last change: a batch has the files that were changed after
one offset and up to the next. The newest SETTLED seconds are left to a later batch, since
files of one time may still arrive.

Folders and files are reached through Arrow's file systems (local, HDFS, S3, GCS); listing
is the driver's, a row a file. The formats known when ``register`` is called go with the
source.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..image import PACKED, pack, unpack
from ..operators import raster as R
from . import encode
from .files import IDENTIFIED, arrow_reader, header_row
from .registry import Context, Registry, decoded, registry

#: Bytes of files in a task, and seconds that a stream leaves to the next batch.
PART_BYTES, SETTLED = 128 << 20, 1.0
HEADER = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), *[f for f in IDENTIFIED.fields if f.name not in ("path", "description", "bytes_read")]])
#: All columns: what a header says, and the packed image under names that don't meet them.
SCHEMA = T.StructType([*HEADER.fields, T.StructField("options", T.StringType()), *[f for f in PACKED.fields if f.name not in HEADER.names]])


@dataclass(frozen=True)
class File:
    path: str
    length: int
    changed: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


def store_of(path: str) -> tuple:
    """Arrow's file system, the path in it, and what stands before it in full addresses."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, name, path[: len(path) - len(name)] if "://" in path else "file://"


def listed(path: str, suffix: str) -> list[File]:
    """The files in a folder and below it, or the one file; hidden ones and those of writes that aren't committed are left out."""
    from pyarrow import fs

    store, name, before = store_of(path)
    about = store.get_file_info(name)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    plain = [i for i in found if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path[len(name) :].split("/") if p)]
    return sorted((File(before + i.path, i.size, i.mtime_ns or 0) for i in plain if i.path.endswith(suffix)), key=lambda f: f.path)


def parted(files: list[File], most: int) -> list[Files]:
    """In their order, at most ``most`` bytes a task, or one file."""
    parts: list[list[File]] = []
    size = most
    for f in files:
        if size + f.length > most and (not parts or parts[-1]):
            parts.append([])
            size = 0
        parts[-1].append(f)
        size += f.length
    return [Files(tuple(p)) for p in parts]


class Rows:
    """Rows of files, in the columns that are asked for."""

    def __init__(self, schema: T.StructType, options: dict, formats: Registry):
        self.path, self.suffix, self.formats = options["path"], options.get("suffix", ""), formats
        self.most, self.names = int(options.get("partbytes", PART_BYTES)), schema.names
        self.context = Context(width=int(options.get("width", 0)), height=int(options.get("height", 0)), iscale=int(options.get("iscale", 0)))
        self.pixels = bool(set(schema.names) - set(HEADER.names))
        self.kinds = to_arrow_schema(schema)

    def row(self, file: File) -> dict:
        about = {"path": file.path, "length": file.length}
        if set(self.names) <= set(about):
            return about
        read = arrow_reader(file.path)
        if not self.pixels:
            return about | dict(zip(IDENTIFIED.names, header_row(file.path, read, self.context, self.formats), strict=True))
        content = read(0, file.length)
        d = decoded(file.path, content, self.context, self.formats)
        about |= {"format": d.format, "status": d.status, "error": d.error, "options": d.options, "told": None}
        if "told" in self.names:
            about["told"] = header_row(file.path, lambda at, n: content[at : at + n], self.context, self.formats)[IDENTIFIED.names.index("told")]
        if d.raster is not None:
            r = d.raster if d.zoom == (100, 100) else R.zoom(d.raster, *d.zoom)
            about |= dict(zip(PACKED.names, pack(int.from_bytes(uuid.uuid5(uuid.NAMESPACE_URL, file.path).bytes[:8], signed=True), r), strict=True)) | {"colors": r.used or None}
        return about

    def batches(self, files: tuple[File, ...]) -> Iterator[pa.RecordBatch]:
        """A batch a file where pixels are read, else many files a batch."""
        step = 1 if self.pixels else 1024
        for k in range(0, len(files), step):
            rows = []
            for f in files[k : k + step]:
                try:
                    rows.append(self.row(f))
                except OSError as e:
                    rows.append({"path": f.path, "length": f.length, "status": "error", "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(self.names, self.kinds.types, strict=True)], schema=self.kinds)


class Reader(DataSourceReader):
    def __init__(self, rows: Rows):
        self.rows, self.tests = rows, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that the listing can answer stay here; the others go back to Spark."""
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: str.startswith, StringEndsWith: str.endswith}
        for f in filters:
            if type(f) in tests and f.attribute in (("path",), ("length",)):
                self.tests.append((f.attribute[0], tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = [f for f in listed(self.rows.path, self.rows.suffix) if all(test(getattr(f, name), value) for name, test, value in self.tests)]
        return parted(found, self.rows.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows.batches(partition.files)


class StreamReader(DataSourceStreamReader):
    def __init__(self, rows: Rows):
        self.rows = rows

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(SETTLED * 1e9)
        return {"changed": max((f.changed for f in listed(self.rows.path, self.rows.suffix) if f.changed <= settled), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return parted([f for f in listed(self.rows.path, self.rows.suffix) if start["changed"] < f.changed <= end["changed"]], self.rows.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows.batches(partition.files)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.form, self.overwrite = options["path"], options.get("form", "png"), overwrite
        if self.form not in encode.ENCODERS:
            raise ValueError(f"{self.form} isn't one of {', '.join(encode.ENCODERS)}")
        missing = set(PACKED.names) - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Written:
        store, base, _ = store_of(self.path)
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(f"{base}/{folder}", recursive=True)
        for row in iterator:
            if row["data"] is None:
                continue
            name = f"{row['image_id']}.{self.form}"
            with store.open_output_stream(f"{base}/{folder}/{name}") as out:
                out.write(encode.ENCODERS[self.form](unpack(row.asDict(True))))
            names.append(name)
        return Written(folder, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, base, _ = store_of(self.path)
        if self.overwrite:
            for f in listed(self.path, ""):
                store.delete_file(store_of(f.path)[1])
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{base}/{m.folder}/{name}", f"{base}/{name}")
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        store, base, _ = store_of(self.path)
        self._clear(store, base)

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


def register(spark: SparkSession, formats: Registry | None = None) -> None:
    """Make the format ``images`` known to a session, with the decoders known now, and turn filters of Python sources on, which it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    known = formats or registry()

    class Images(DataSource):
        @classmethod
        def name(cls) -> str:
            return "images"

        def schema(self) -> T.StructType:
            return SCHEMA

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(Rows(schema, self.options, known))

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return StreamReader(Rows(schema, self.options, known))

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return Writer(self.options, schema, overwrite)

    spark.dataSource.register(Images)
