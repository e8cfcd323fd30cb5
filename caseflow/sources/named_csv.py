"""A writer of text files that bear names of their own: tasks write aside, the commit puts files in place."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote aside: its place among the tasks, and for each name the file."""

    task: int
    files: dict[str, str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def numbered(name: str, k: int) -> str:
    """The name of the k-th of several parts, before its ending: ``a.csv`` to ``a-2.csv``."""
    stem, ending = posixpath.splitext(name)
    return f"{stem}-{k}{ending}"


class NamedCsv(DataSource):
    """Lines (``file``, ``line``) to files named by ``file`` below ``path``, each led by ``header``.

    A name with rows in one task becomes one file, with rows in several tasks numbered parts. A name
    that is written again replaces all its parts; other files stay. After a failure nothing has
    changed: tasks write below a hidden folder that the commit empties and the abort removes.
    """

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedCsvWriter(self.options["path"], self.options["header"])


class NamedCsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path, header
        self.aside = f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        system, root = _opened(self.path)
        folder = f"{root}/{self.aside}/{context.taskAttemptId()}"
        files: dict[str, str] = {}
        streams: dict[str, pa.NativeFile] = {}
        try:
            for batch in iterator:
                names, lines = (batch.column(k).to_pylist() for k in (0, 1))
                for name, line in zip(names, lines):
                    if name not in streams:
                        if "/" in name:
                            raise ValueError(f"a file name with a slash: {name}")
                        system.create_dir(folder, recursive=True)
                        files[name] = f"{folder}/{len(files)}"
                        streams[name] = system.open_output_stream(files[name])
                        streams[name].write(self.header.encode() + b"\n")
                    streams[name].write(line.encode() + b"\n")
        finally:
            for stream in streams.values():
                stream.close()
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        parts: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for name, file in message.files.items():
                parts.setdefault(name, []).append(file)
        system.create_dir(root, recursive=True)
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file}
        for name, files in parts.items():
            wanted = [name] if len(files) == 1 else [numbered(name, k + 1) for k in range(len(files))]
            for target, file in zip(wanted, files):
                system.move(file, f"{root}/{target}")
            k = 1
            stale = {name} - {*wanted}
            while numbered(name, k) in there:
                stale |= {numbered(name, k)} - {*wanted}
                k += 1
            for gone in stale & there:
                system.delete_file(f"{root}/{gone}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.aside}")
