"""What the pipeline operators share: tables, whole rows beside own columns, long texts in pieces, and cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import scratch

_SPACE = re.compile(rb"[\t-\r ]")
#: Frees an execution's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The caller's columns as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*(F.col(quoted(c)) for c in (docs.columns if columns is None else columns)))


def unboxed(docs: DataFrame, row: str = "row", **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of their struct, some of them ``changed``."""
    return [(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in docs.columns]


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, or with ``_`` before it as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in pieces of about ``most`` bytes, cut before white space: no word is cut, however long."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + most) if len(text) > at + most else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``materialize`` writes meanwhile."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def write(df: DataFrame, path: str) -> None:
    """Write a table as Parquet; the shuffle files that it took are freed, as only the table is read later."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors."""
    path = scratch(df.sparkSession)
    write(df, path)
    for paths in _RECORDS:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that no result depends on any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs  # the only way to any store that Spark writes to
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What a Python worker remembers from one task to the next, by the name of who uses it.
HELD: dict[str, dict] = {}


def release(but: str | None) -> None:
    """Forget what tasks of other kinds have left in this worker."""
    for name, held in HELD.items():
        if name != but:
            held.clear()


def slices(batches, rows: int = 1000) -> Iterator:
    """Arrow batches in slices of at most ``rows``, so that what a task makes of one stays small."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def tidy(run: Callable, holds: str | None = None) -> Callable:
    """``run`` of a mapInArrow, before which others' caches go, and after which freed memory goes back to the system.

    Python workers live on between tasks, several to an executor, and would otherwise hold on to the most
    that any of their tasks has had.
    """

    @functools.wraps(run)
    def wrapped(batches) -> Iterator:
        import pyarrow as pa

        release(holds)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return wrapped
