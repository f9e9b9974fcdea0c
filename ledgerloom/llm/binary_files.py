"""Files of plain bytes: a data source whose writer joins the values of one binary column.

Every task writes a file under a name of its own; only files of tasks that committed are listed in
`files.json`, which the driver writes last, so that a lost executor or a second attempt leaves no doubt.
The folder is reached through pyarrow's file systems, and must be one that the driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "binary_files"
LISTING = "files.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    rows: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, about: str):
        self.path, self.suffix, self.about = path, suffix, about

    def write(self, rows: Iterator) -> Written:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        name, size, count = f"part-{uuid.uuid4().hex}{self.suffix}", 0, 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for (data,) in rows:
                out.write(bytes(data))
                size, count = size + len(data), count + 1
        return Written(name, size, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        listing = {"files": [{"name": m.name, "bytes": m.size, "rows": m.rows} for m in done if m.rows], "about": json.loads(self.about)}
        with system.open_output_stream(f"{root}/{LISTING}", compression=None) as out:
            out.write(json.dumps(listing).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no listing names are no part of the result."""


class BinaryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("suffix", ".bin"), self.options.get("about", "{}"))


def write_files(rows: DataFrame, path: str, suffix: str, about: dict | None = None) -> None:
    """`rows` has one binary column; `about` goes into the listing."""
    rows.sparkSession.dataSource.register(BinaryFiles)
    rows.write.format(NAME).mode("append").option("suffix", suffix).option("about", json.dumps(about or {})).save(path)


def listing(path: str) -> dict:
    system, root = _opened(path)
    with system.open_input_stream(f"{root}/{LISTING}") as f:
        return json.loads(f.read())


def read_file(path: str, name: str) -> bytes:
    system, root = _opened(path)
    with system.open_input_stream(f"{root}/{name}", compression=None) as f:
        return f.read()
