"""A sink of whole files: every row is one file, written by the task that holds it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _place(folder: str):
    """(file system, path) of a folder; raises where pyarrow knows no such store."""
    from pyarrow import fs

    if ":" not in folder.split("/")[0]:
        return fs.LocalFileSystem(), folder.rstrip("/")
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").strip("/")
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task that ended: (where they lie, what they are to be called)."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write below a folder of this job; what tasks that ended have written is moved to its place at the commit.

    An attempt has a folder of its own, so one that is lost or repeated leaves
    nothing at its place.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, path = _place(self.folder)
        attempt = f"{path}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        files = []
        for k, row in enumerate(rows):
            at = f"{attempt}/{k}"
            with store.open_output_stream(at) as out:
                out.write(bytes(row["content"]))
            files.append((at, row["name"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _place(self.folder)
        for message in messages:
            for at, name in message.files if message else ():
                target = f"{path}/{name}"
                if store.get_file_info(target).type.name != "NotFound":
                    store.delete_file(target)
                store.move(at, target)
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.folder))

    def _clear(self, store, path: str) -> None:
        if store.get_file_info(f"{path}/{self.job}").type.name != "NotFound":
            store.delete_dir(f"{path}/{self.job}")


class Files(DataSource):
    """format("whole_files"): rows (name, content) as files of the folder given to save()."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name string, content binary) as files in ``folder``; those of the same names are replaced, others stay.

    Tasks write where pyarrow knows the store; elsewhere files go one at a time
    through the driver's Hadoop file system.
    """
    spark = files.sparkSession
    files = files.select("name", "content")
    try:
        _place(folder)
    except Exception:  # noqa: BLE001 - pyarrow's errors of unknown stores differ by build
        conf = spark._jsc.hadoopConfiguration()
        for row in files.toLocalIterator():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['name']}")
            out = path.getFileSystem(conf).create(path, True)
            out.write(bytearray(row["content"]))
            out.close()
        return
    spark.dataSource.register(Files)
    files.write.format("whole_files").mode("append").save(folder)
