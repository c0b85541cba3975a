"""One file in order from many tasks: a data source for writing.

    register(spark)
    ordered.write.format("ordered_file").mode("overwrite").options(...).save(path)

The rows (section int, line string) have to be ordered by their section and whatever else; Spark then deals them to tasks by
range, so that one part follows the other. Each task writes its part beside the file and reports its place, its first and
its last section. When all have, the parts are joined in order and the result takes the file's place at once. If a task or
the joining fails, what it wrote goes and the file stays as it was. Of a task that ran twice only the attempt that
committed counts.

Files are reached through pyarrow, so executors and driver need a file system that both can reach under that path: a URI of
an object store or HDFS, or a shared folder.

Options: heads, a JSON list of what stands before each section, empty ones included; separator, between the lines of
a section; terminator, after each line; tail, after all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes copied at once when parts are joined.
COPIED = 1 << 22
SCHEMA = T.StructType([T.StructField("section", T.IntegerType()), T.StructField("line", T.StringType())])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), urlsplit(path).path if path.startswith("file:") else path


def exists(path: str) -> bool:
    system, place = filesystem(path)
    return system.get_file_info(place).type == fs.FileType.File


def replace(path: str, data: bytes) -> None:
    """Write a small file in its entirety, in place of an older one."""
    system, place = filesystem(path)
    _folder(system, place)
    with system.open_output_stream(new := f"{place}.new-{uuid.uuid4().hex}") as out:
        out.write(data)
    system.move(new, place)


def _folder(system: fs.FileSystem, place: str) -> None:
    if "/" in place.rstrip("/"):
        system.create_dir(place.rsplit("/", 1)[0] or "/", recursive=True)


@dataclass
class Part(WriterCommitMessage):
    """A part that a task has written: none if it had no rows."""

    number: int
    place: str | None = None
    first: int = 0
    last: int = 0


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.heads = json.loads(options.get("heads", '[""]'))
        self.separator, self.terminator, self.tail = (options.get(k, "") for k in ("separator", "terminator", "tail"))
        self.run = uuid.uuid4().hex

    def _parts(self, place: str) -> str:
        return f"{place}.parts-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, place = filesystem(self.path)
        task = TaskContext.get()
        part = Part(task.partitionId())
        out = None
        for batch in iterator:
            for section, line in zip(batch.column("section").to_pylist(), batch.column("line").to_pylist()):
                if out is None:
                    system.create_dir(self._parts(place), recursive=True)
                    part.place = f"{self._parts(place)}/{part.number:08d}-{task.taskAttemptId()}"
                    out = system.open_output_stream(part.place)
                    part.first = section
                else:
                    out.write(self._between(part.last, section))
                part.last = section
                out.write(f"{line}{self.terminator}".encode())
        if out is not None:
            out.close()
        return part

    def _between(self, last: int, section: int) -> bytes:
        """What stands between a line of one section and the next line, which is in the same or a later one."""
        if not 0 <= section < len(self.heads) or section < last:
            raise ValueError(f"section {section} after {last}: rows must be ordered, with a head for each section")
        return (self.separator if section == last else "".join(self.heads[last + 1 : section + 1])).encode()

    def commit(self, messages: list[Part | None]) -> None:
        system, place = filesystem(self.path)
        _folder(system, place)
        new = f"{place}.new-{self.run}"
        last = -1
        try:
            with system.open_output_stream(new) as out:
                for part in sorted((m for m in messages if m is not None and m.place), key=lambda m: m.number):
                    out.write(self._between(last, part.first))
                    with system.open_input_stream(part.place) as data:
                        while piece := data.read(COPIED):
                            out.write(piece)
                    last = part.last
                out.write("".join(self.heads[last + 1 :]).encode() + self.tail.encode())
            system.move(new, place)
        except BaseException:
            if system.get_file_info(new).type == fs.FileType.File:
                system.delete_file(new)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = filesystem(self.path)
        if system.get_file_info(self._parts(place)).type == fs.FileType.Directory:
            system.delete_dir(self._parts(place))


class OrderedFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def schema(self) -> T.StructType:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if [f.name for f in schema] != SCHEMA.names:
            raise ValueError("the columns are section and line")
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedFile)


def write(ordered: DataFrame, path: str, *, heads: list[str] | None = None, separator: str = "", terminator: str = "", tail: str = "") -> None:
    """Rows (section, line), ordered, as one file."""
    register(ordered.sparkSession)
    options = {"heads": json.dumps(heads or [""]), "separator": separator, "terminator": terminator, "tail": tail}
    ordered.select(ordered["section"].cast("int").alias("section"), ordered["line"]).write.format("ordered_file").mode("overwrite").options(**options).save(path)
