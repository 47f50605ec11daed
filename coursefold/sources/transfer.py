"""Files written and removed by tasks, and the copy of a folder that counts only once its marker is there.

``coursefold_files`` is a sink: each task writes the files of its rows (name, content) below a folder, or removes those it is given names of. A task
that fails removes what it has written. Once all tasks have ended, the sink's commit writes the marker, if it was given one; if any has
failed, its abort removes what the others had written by then, and there is none. A task that was still running may leave files: they
count for nothing without a marker, and ``copy_folder`` removes what its source has not before it writes one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.records import snapshot_diff
from .files import file_listing
from .written import materialize

SINK = "coursefold_files"
MARKER = "version.json"
#: Lists of what tasks have written, for an abort; a folder that no listing shows.
SENT = "_sent"


class NotReady(RuntimeError):
    """What was copied is no whole state of its source, or nothing was."""


@dataclass
class Sent(WriterCommitMessage):
    """The file that lists what a task has written: so messages are small however many files there are."""

    listed: str


def _folder(uri: str):
    """(file system, path) of a folder, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def put(system, path: str, content: bytes) -> None:
    """A file is written under another name first, so a reader never sees half of one."""
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(part) as out:
            out.write(content)
        system.move(part, path)
    except BaseException:
        _remove(system, [part])
        raise


def _remove(system, paths) -> None:
    from pyarrow import fs

    for path in paths:
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.target, self.sweep = options["target"].rstrip("/"), options.get("sweep") == "true"
        self.marker, self.text, self.job = options.get("marker"), options.get("markertext", ""), options["job"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _folder(self.target)
        done = []
        try:
            for row in iterator:
                if self.sweep:
                    _remove(system, [f"{root}/{row.name}"])
                else:
                    put(system, f"{root}/{row.name}", bytes(row.content))
                    done.append(row.name)
            listed = f"{root}/{SENT}/{self.job}/{uuid.uuid4().hex}"
            put(system, listed, "\n".join(done).encode())
        except BaseException:
            _remove(system, [f"{root}/{name}" for name in done])
            raise
        return Sent(listed)

    def _lists(self) -> tuple:
        from pyarrow import fs

        system, root = _folder(self.target)
        folder = f"{root}/{SENT}/{self.job}"
        return system, root, folder, [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith(".")]

    def commit(self, messages: list) -> None:
        system, root, folder, lists = self._lists()
        if lists:
            system.delete_dir(folder)
        if self.marker:
            put(system, f"{root}/{self.marker}", self.text.encode())

    def abort(self, messages: list) -> None:
        system, root, folder, lists = self._lists()
        for path in lists:
            with system.open_input_stream(path) as f:
                _remove(system, [f"{root}/{name}" for name in f.read().decode().splitlines()])
        if lists:
            system.delete_dir(folder)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options))


def write_files(rows: DataFrame, target: str, marker: str | None = None, text: str = "") -> None:
    """Each row's ``content`` as the file ``name`` below ``target``; then ``marker`` with ``text``."""
    _sink(rows.select("name", F.col("content").cast("binary").alias("content")), target, marker, text)


def remove_files(rows: DataFrame, target: str, marker: str | None = None, text: str = "") -> None:
    """Files ``name`` below ``target`` go, if they are there; then the marker is written."""
    _sink(rows.select("name", F.lit(None).cast("binary").alias("content")), target, marker, text, sweep=True)


def _sink(rows: DataFrame, target: str, marker: str | None, text: str, sweep: bool = False) -> None:
    rows.sparkSession.dataSource.register(FileSink)
    options = {"target": target, "sweep": str(sweep).lower(), "job": uuid.uuid4().hex} | ({"marker": marker, "markertext": text} if marker else {})
    rows.write.format(SINK).options(**options).mode("append").save()


def listed(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below ``root``, none if it is not there."""
    from pyarrow import fs

    system, path = _folder(root)
    if system.get_file_info(path).type != fs.FileType.Directory or not system.get_file_info(fs.FileSelector(path)):
        return spark.createDataFrame([], "name string, length long, etag string" + ", content binary" * content)
    return file_listing(spark, root, content=content).where(~F.col("name").startswith(f"{SENT}/"))


def is_ready(spark: SparkSession, target: str, marker: str = MARKER) -> bool:
    from pyarrow import fs

    system, root = _folder(target.rstrip("/"))
    return system.get_file_info(f"{root}/{marker}").type == fs.FileType.File


def copy_folder(spark: SparkSession, source: str, target: str, version: str, marker: str = MARKER) -> bool:
    """Copy all files below ``source`` to ``target`` and write ``marker`` with ``version`` last; false if it was there before.

    The source is listed before and after. If a file has come, gone or changed meanwhile, the copy may be of no state that it ever had: then, as when a task
    fails, there is no marker, and a later call copies again. Files below ``target`` that the source has not, left by an earlier try, go.
    """
    if is_ready(spark, target, marker):
        return False
    before = materialize(listed(spark, source).select("name", "etag"))
    if before.isEmpty():
        raise NotReady(f"no files below {source}")
    write_files(listed(spark, source, content=True), target)
    changed = snapshot_diff(before, listed(spark, source), "name", "etag").orderBy("name").first()
    if changed:
        raise NotReady(f"{changed.name} changed while it was copied")
    strays = materialize(listed(spark, target).select("name").join(before, "name", "left_anti"))
    remove_files(strays, target, marker, version)
    return True
