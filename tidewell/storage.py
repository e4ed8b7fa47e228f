"""Tables that cut lineage, kept in the folder that all machines of a cluster share.

Every table written here goes below ``spark.checkpoint.dir``, so a lost
executor costs only the tasks it ran: later stages read the finished table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to every executor up to this many bytes; beyond that it is shuffled.
BROADCAST_BYTES = 32 << 20

#: Keys that more rows than this have don't go through a shuffle with them; there are at most rows / OFTEN of them.
OFTEN = 100_000

#: Bytes of a written table that make a file of one that is no larger.
FILE_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own, as all its
    tasks run on this machine; on a cluster that is an error, for the machines
    would write to folders that the others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the tables of ``materialize``."""
    path = f"{shared_dir(spark)}/tidewell/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def files(*tables: DataFrame) -> int | None:
    """How many files the tables of ``materialize`` would fill, at least two for each task that runs at a time; None if one is no such table."""
    if any(getattr(t, "_written_at", None) is None for t in tables):
        return None
    context, size = tables[0].sparkSession.sparkContext, 0
    for t in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(t._written_at)
        size += path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(2 * context.defaultParallelism, -(-size // FILE_BYTES))


def materialize(df: DataFrame, label: str = "table", like: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table as read back.

    ``like`` are written tables that together are about as large as ``df`` or
    larger: it goes into no more files than they fill, for each costs
    processes or requests, however few rows it has.
    """
    spark = df.sparkSession
    if like and (most := files(*like)):
        df = df.coalesce(most)
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; other DataFrames are left alone."""
    gone = {getattr(t, "_written_at", None) for t in tables} - {None}
    for entry in [e for e in _written if e[1] in gone]:
        _delete(*entry)
        _written.remove(entry)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those passed to the function that this gives.

    So a step's tables last no longer than the step. What leaves the scope must
    be such a table, or not read any of the others.
    """
    mark, kept = len(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._written_at)
        return table

    yield keep
    for entry in _written[mark:]:
        if entry[1] not in kept:
            _delete(*entry)
    _written[mark:] = [e for e in _written[mark:] if e[1] in kept]


def release() -> None:
    """Delete every table written by ``materialize`` in this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may have ended, and its folder with it
            return


atexit.register(release)


def broadcast_if_small(df: DataFrame, width: Column | int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its measured size, ``width`` bytes a row, is at most ``most``.

    ``df`` should be a materialized table, as it is read once more for its size.
    Beyond the bound the table comes back unhinted, and a join shuffles it.
    """
    per_row = F.lit(width) if isinstance(width, int) else width
    total = df.agg(F.sum(per_row.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= most else df


def often(table: DataFrame, key: str, count: str | None = None) -> DataFrame | None:
    """(key) of those that more than ``OFTEN`` rows of a materialized ``table`` have; None if there is none.

    With ``count``, the table has a row for each key and says how many rows that stands for.
    """
    if count is None:
        if table.count() <= OFTEN:  # known from the files' footers
            return None
        table, count = table.groupBy(key).agg(F.count("*").alias("n")), "n"
    found = materialize(table.where(F.col(count) > OFTEN).select(key), "often")
    return None if found.isEmpty() else found


def join_often(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, width: Column | int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose ``key`` is unique. ``hot`` (key) lists keys that very many rows have.

    What the table has for those, ``width`` bytes a row, is sent to where the
    rows are if it is small, so that their rows aren't brought into one task.
    """
    if hot is None:
        return rows.join(table, key)
    few = broadcast_if_small(hot, 16)
    known = materialize(table.join(few, key, "left_semi"), "hot")
    there = rows.join(broadcast_if_small(known, width), key)
    return there.unionByName(rows.join(few, key, "left_anti").join(table, key))


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship_code(spark: SparkSession, root: str) -> None:
    """Let Python workers import packages from ``root``."""
    env: dict[str, Any] = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hand Python workers at most so many rows and bytes at a time, however long texts are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < number <= most:
            spark.conf.set(key, str(most))
