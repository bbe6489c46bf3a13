"""A sink of files: each row (name, content) becomes one file, and a job leaves all of them or none.

    spark.dataSource.register(FileSink)
    df.write.format("picmeta_files").mode("append").save("file:///somewhere")

A task writes its files into a folder of its own below the job's staging folder,
reads each file's size back, and takes its folder away where anything fails. The
commit renames the folders of the tasks that count, one each, and deletes the
rest of the staging folder, so what a killed or repeated attempt left goes too. An
abort deletes all of it. Rows without a name or content, and names that lead
elsewhere or come twice in a task, are errors; an empty table makes no files.
Folders can be in any store that Arrow reaches by the path's scheme.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int
    size: int


class FileSink(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "picmeta_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added; choose another folder")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows need name and content")
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        files, folder = self._at(self.staging)
        files.create_dir(folder, recursive=True)  # here, not by tasks: one that is late after an abort finds no place to write

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))

    def write(self, iterator: Iterator) -> Written:
        name = f"part-{uuid.uuid4().hex}"
        from pyarrow.fs import FileType

        files, folder = self._at(f"{self.staging}/{name}")
        taken: set[str] = set()
        total = 0
        try:
            for row in iterator:
                if not row.name or row.content is None:
                    raise ValueError("a row without a name or content")
                if "/" in row.name or row.name.startswith((".", "_")) or row.name in taken:
                    raise ValueError(f"{row.name!r} can't be a file's name here")
                if not taken:
                    files.create_dir(folder, recursive=False)
                taken.add(row.name)
                with files.open_output_stream(f"{folder}/{row.name}") as out:
                    out.write(bytes(row.content))
                there = files.get_file_info(f"{folder}/{row.name}").size
                if there != len(row.content):
                    raise OSError(f"{row.name}: {there} bytes of {len(row.content)} were written")
                total += there
        except BaseException:
            if taken and files.get_file_info(folder).type != FileType.NotFound:
                files.delete_dir(folder)
            raise
        return Written(name if taken else None, len(taken), total)

    def commit(self, messages: list[Written | None]) -> None:
        files, staging = self._at(self.staging)
        folder = staging.rpartition("/")[0]
        for m in messages:
            if m is not None and m.folder:
                files.move(f"{staging}/{m.folder}", f"{folder}/{m.folder}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What is left in the staging folder goes."""
        files, staging = self._at(self.staging)
        from pyarrow.fs import FileType

        for left in (2, 1, 0):
            if files.get_file_info(staging).type == FileType.NotFound:
                return
            try:
                files.delete_dir(staging)
            except OSError:  # a task that is just being stopped wrote in between
                if not left:
                    raise
