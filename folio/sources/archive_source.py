"""Data source `paper_archive`: tar archives, or folders of plain files, as a table of their members, and the same as a sink.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("paper_archive").option("endings", ".tex").schema("path string, name string").load(folder)

A row is a member, so an archive is never a cell: archives are read as streams, several small ones in a task, up to
PARTITION_BYTES together. Folders (layout `folder`) are dealt by name, PARTITION_FOLDERS to a task, which lists and reads them itself. The schema asked for says what is read: without `content` only headers are, and `endings` keeps other
members' bytes from leaving the reader. Files are reached by pyarrow's file systems; where only Hadoop's reach them, archives.members()
takes the bytes that Spark's binary source reads.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of archives that a task reads, unless one alone has more.
PARTITION_BYTES = 64 << 20
#: Folders that a task lists and reads; bytes and rows of members that are handed on together.
PARTITION_FOLDERS, BATCH_BYTES, BATCH_ROWS = 1024, 4 << 20, 2000
_TYPES = {"path": pa.string(), "name": pa.string(), "size": pa.int64(), "content": pa.binary()}
SCHEMA = "path string, name string, size long, content binary"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop writes local ones as file:/..."""
    return fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class _Archives(InputPartition):
    files: list[str]


@dataclass
class _Written(WriterCommitMessage):
    archives: int


class ArchiveSource(DataSource):
    """Members of the archives below a folder. Options: endings (comma-separated), partitionBytes, layout (`tar`, `folder`)."""

    @classmethod
    def name(cls) -> str:
        return "paper_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options, schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, schema.fieldNames())


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        if unknown := set(columns) - {"path", "name", "size", "content"}:
            raise ValueError(f"archives have no {', '.join(sorted(unknown))}")
        self.base, self.columns = options["path"], columns
        self.endings = tuple(e.strip().lower() for e in options.get("endings", "").split(",") if e.strip())
        self.most, self.folders = int(options.get("partitionBytes", PARTITION_BYTES)), options.get("layout", "tar") == "folder"

    def partitions(self) -> list[InputPartition]:
        system, base = _system(self.base)
        if self.folders:
            # The driver sees the folders' names only.
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory)
            return [_Archives(names[i : i + PARTITION_FOLDERS]) for i in range(0, max(len(names), 1), PARTITION_FOLDERS)]
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file)
        parts: list[_Archives] = []
        held = self.most
        for path, size in found:
            if held + size > self.most:
                parts.append(_Archives([]))
                held = 0
            parts[-1].files.append(path)
            held += size
        return parts or [_Archives([])]

    def read(self, partition: _Archives) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in (self._in_folders if self.folders else self._in_archives)(partition.files):
            held.append(row)
            size += len(row.get("content") or b"")
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield self._batch(held)
                held, size = [], 0
        yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in self.columns], names=self.columns)

    def _wanted(self, name: str) -> bool:
        return not self.endings or name.lower().endswith(self.endings)

    def _in_folders(self, folders: list[str]) -> Iterator[dict]:
        system, _ = _system(self.base)
        for folder in folders:
            for f in sorted(system.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda f: f.path):
                name = f.path.removeprefix(folder).lstrip("/")
                if f.is_file and self._wanted(name):
                    row = {"path": posixpath.basename(folder), "name": name, "size": f.size}
                    if "content" in self.columns:
                        with system.open_input_stream(f.path, compression=None) as stream:
                            row["content"] = stream.read()
                    yield row

    def _in_archives(self, files: list[str]) -> Iterator[dict]:
        system, base = _system(self.base)
        for path in files:
            shown = path.removeprefix(base).lstrip("/")
            try:
                with system.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                    for member in tar:
                        if member.isfile() and self._wanted(member.name):
                            row = {"path": shown, "name": member.name, "size": member.size}
                            if "content" in self.columns:
                                row["content"] = tar.extractfile(member).read()
                            yield row
            except (tarfile.TarError, EOFError):
                # Not an archive, or a broken one: a row of its path alone marks it, behind what was readable.
                yield {"path": shown}


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        if missing := {"path", "name", "content"} - set(columns):
            raise ValueError(f"archives need {', '.join(sorted(missing))}")
        self.base, self.layout, self._last = options["path"], options.get("layout", "tar"), None

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = _system(self.base)
        system.create_dir(base, recursive=True)
        n = 0
        for path, members in groupby(rows, lambda r: r["path"]):
            self._folder(system, f"{base}/{path}", members) if self.layout == "folder" else self._tar(system, f"{base}/{path}", members)
            n += 1
        return _Written(n)

    def _put(self, system: fs.FileSystem, target: str, fill) -> None:
        """A whole file or none, also if the task is run twice: written aside, then moved."""
        folder = target.rpartition("/")[0]
        if folder != self._last:
            system.create_dir(folder, recursive=True)
            self._last = folder
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            fill(out)
        system.move(aside, target)

    def _tar(self, system: fs.FileSystem, target: str, members: Iterator) -> None:
        def fill(out) -> None:
            with tarfile.open(fileobj=out, mode="w|") as tar:
                for m in members:
                    info = tarfile.TarInfo(m["name"])
                    info.size = len(m["content"])
                    tar.addfile(info, io.BytesIO(m["content"]))

        self._put(system, target, fill)

    def _folder(self, system: fs.FileSystem, target: str, members: Iterator) -> None:
        for m in members:
            self._put(system, f"{target}/{m['name']}", lambda out, m=m: out.write(bytes(m["content"])))

    def commit(self, messages: list) -> None:
        """Nothing is left to do: each archive is whole when it is there."""

    def abort(self, messages: list) -> None:
        """What was written stays: another run puts the same files in its place."""


def read_members(spark: SparkSession, path: str, columns: str = SCHEMA, endings: str = "", layout: str = "tar") -> DataFrame:
    """Members of all archives below a folder, or files of the folders in it: the columns asked for, of names with one of the endings."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("paper_archive").option("endings", endings).option("layout", layout).schema(columns).load(path)


def write_members(rows: DataFrame, path: str, layout: str = "tar") -> None:
    """Write members (path, name, content) as an archive for each path, or as files in a folder for each; one shuffle by path."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    dealt = rows.select("path", "name", "content").repartition("path").sortWithinPartitions("path", "name")
    dealt.write.format("paper_archive").option("layout", layout).mode("append").save(path)
