"""One named text file for each order, as a Spark data source that writes: format "orderfiles".

Rows are (file, line); a file's lines stand together, in order, in one partition. Tasks write under a folder of their own
and report what they wrote; the files get their names when all tasks are done, so that a task that fails or runs twice
leaves nothing behind.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MARK = "\ufeff"  # byte-order mark: spreadsheets then read UTF-8
PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it was written, its name


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class OrderFiles(DataSource):
    """Options: path, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "orderfiles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["file", "line"]:
            raise ValueError("rows must be (file, line)")
        return OrderFilesWriter(self.options["path"], overwrite)


class OrderFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _opened(self.path)
        own, done = f"{root}/{PENDING}/{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=True)
        for name, rows in itertools.groupby(iterator, key=lambda r: r.file):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name for a file: {name!r}")
            at = f"{own}/{len(done)}"
            with fs.open_output_stream(at) as out:
                out.write(MARK.encode())
                for i, row in enumerate(rows):
                    out.write((("\n" if i else "") + (row.line or "")).encode())
            done.append((at, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("lines of one file came from several tasks")
        there = {i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.type == pafs.FileType.File}
        if not self.overwrite and (double := there & set(names)):
            self.abort(messages)
            raise ValueError(f"files that are there already: {sorted(double)[:5]}")
        for at, name in files:
            fs.move(at, f"{root}/{name}")
        if self.overwrite:
            for old in there - set(names):
                fs.delete_file(f"{root}/{old}")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _clear(fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{PENDING}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{PENDING}")
