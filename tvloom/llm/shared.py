"""Where operators keep tables that every executor must see, and small column helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Whole texts that go to Python at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16_000_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tvloom-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at its end, but for those to keep."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.pop()
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there and a lost executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on at most so many rows and bytes of whole texts go to Python at once, so that memory is bounded by the
    batch, in the worker and in the buffers of its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Plans made inside hand this many rows at once to Python at most, for rows with large values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mapped(docs: DataFrame, inputs: list[Column], keep: list[str], fields: list[T.StructField], begin: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """The columns `keep` of docs and new `fields`, made in Arrow batches of bounded size.

    begin() is called once a task; what it returns takes the arrays of the inputs and returns a list of values a field.
    What is kept travels in a struct, so that its names clash with none. A name both kept and new is refused.
    """
    clash = set(keep) & {f.name for f in fields}
    if clash:
        raise ValueError(f"columns both kept and new: {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = begin()
        for batch in batches:
            new = [pa.array(values, kind) for values, kind in zip(made(*batch.columns[1:]), types, strict=True)]
            yield pa.RecordBatch.from_arrays(unpacked(batch, len(keep)) + new, names=schema.names)

    return docs.select(packed_up(docs, keep), *[c.alias(f"i{n}") for n, c in enumerate(inputs)]).mapInArrow(run, schema)


def packed_up(docs: DataFrame, keep: list[str]) -> Column:
    """The columns `keep` as one, the first that goes to Python, so that their names clash with none."""
    # a struct of no fields can't travel
    return (F.struct(*[docs[c] for c in keep]) if keep else F.lit(0)).alias("kept")


def unpacked(batch: pa.RecordBatch, n: int) -> list[pa.Array]:
    """The n columns that `packed_up` has packed."""
    return [batch.column(0).field(i) for i in range(n)]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. `lower` alone does the same where no other letter is present, and is faster."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, LETTERS, LETTERS.lower())).otherwise(F.lower(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
