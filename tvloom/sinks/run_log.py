"""What one run leaves to the next: a table that is only appended to, a folder a run, and its compaction.

Under the path stand `run-<n>` for each run and `base-<n>-<k>`, which stands for all runs up to n. A folder counts once Spark has
marked it as complete, so that a run or a compaction that dies leaves what was there. A run that is written again takes
the place of its first try. Compaction leaves what it replaces to those who are still reading; the next one deletes it.
One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .ordered_file import filesystem

NAME = re.compile(r"(?:run-(\d+)|base-(\d+)-(\d+))$")


def _folders(path: str) -> tuple[dict[int, str], dict[tuple[int, int], str]]:
    """Complete runs and bases by number."""
    system, place = filesystem(path)
    runs, bases = {}, {}
    for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        found = NAME.match(info.base_name)
        if found and system.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File:
            at = f"{path.rstrip('/')}/{info.base_name}"
            if found[1]:
                runs[int(found[1])] = at
            else:
                bases[int(found[2]), int(found[3])] = at
    return runs, bases


def _current(path: str) -> tuple[int, list[str]]:
    """The run up to which the base goes (-1: none), and the folders that count."""
    runs, bases = _folders(path)
    upto = max(bases, default=(-1, 0))
    return upto[0], [bases[k] for k in [upto] if k in bases] + [runs[n] for n in sorted(runs) if n > upto[0]]


def append(rows: DataFrame, path: str, run: int) -> None:
    """The rows of a run. Runs are numbered upwards; one that a compaction has taken in can't be written again."""
    if run < 0 or run <= _current(path)[0]:
        raise ValueError(f"run {run} is already compacted")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/run-{run}")


def runs(path: str) -> list[int]:
    """The runs since the last compaction."""
    upto = _current(path)[0]
    return sorted(n for n in _folders(path)[0] if n > upto)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all runs."""
    folders = _current(path)[1]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """All runs so far become one base of what merge() makes of their rows."""
    runs, bases = _folders(path)
    before = max(bases, default=(-1, 0))
    upto = max([before[0], *runs])
    if upto < 0:
        return
    version = max((k for n, k in bases if n == upto), default=-1) + 1
    merge(read(spark, path, schema)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/base-{upto}-{version}")
    # what the base before has replaced: nobody has planned to read it since
    system, _ = filesystem(path)
    for at in [runs[n] for n in runs if n <= before[0]] + [bases[k] for k in bases if k < before]:
        system.delete_dir(filesystem(at)[1])


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """Nothing is known any more; the runs' numbers stay taken."""
    compact(spark, path, schema, lambda rows: rows.limit(0))
