"""Folders of markdown pages as a data source: one `.md` and one `.meta` file for each page.

Tasks write below a hidden folder; their commit messages name what they wrote, and only when all have ended well are the
files moved to their places. A task that fails, or is run again, leaves nothing that readers see: its folder is
in no message. The hidden folder goes at the end, but for what tasks write after their job was given up. Files are reached by pyarrow's file systems, so the folder may be
a local one or any store that pyarrow knows by its address.

The driver lists one folder at a time; what it keeps of it for the tasks is a few bytes for each page.

    spark.dataSource.register(MarkdownFolder)
    pages.select("path", "body", "meta").write.format("markdown").mode("append").save(folder)
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = ".staging"
#: Files that one task reads; moves at once, and those that are waited for together.
FILES, MOVES, WAITING = 500, 16, 2000


def reach(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system, at.rstrip("/")


def entries(system: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """The names of the folders and of the files in a folder, in order; of local ones without an object for each."""
    folders, files = [], []
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                kind = folders if x.is_dir() else files if x.is_file() else []
                kind.append(x.name)
    else:
        for x in system.get_file_info(fs.FileSelector(folder)):
            kind = {fs.FileType.Directory: folders, fs.FileType.File: files}.get(x.type, [])
            kind.append(x.base_name)
    return sorted(folders), sorted(files)


def sidecar(path: str) -> str:
    return path.removesuffix(".md") + ".meta"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    pages: int


class Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = reach(self.root)
        folder, made, n = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", set(), 0
        for row in rows:
            if not row.path or row.path.startswith("/") or not row.path.endswith(".md") or any(p in ("", "..") or p.startswith(".") for p in row.path.split("/")):
                raise ValueError(f"not the path of a page: {row.path!r}")
            for path, text in ((row.path, row.body), (sidecar(row.path), row.meta)):
                parent = f"{folder}/{path}".rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                if text is not None:
                    with system.open_output_stream(f"{folder}/{path}") as out:
                        out.write(text.encode())
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = reach(self.root)
        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message is not None and message.pages:
                    self._move(system, message.folder, root, pool)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _move(self, system: fs.FileSystem, folder: str, root: str, pool: ThreadPoolExecutor) -> None:
        """The files below a folder to the same places below root, a folder after the other."""
        left = [""]
        while left:
            at = left.pop()
            folders, files = entries(system, folder + at)
            left += [f"{at}/{name}" for name in folders]
            if files:
                system.create_dir(root + at, recursive=True)
            for i in range(0, len(files), WAITING):
                list(pool.map(lambda name, at=at: system.move(f"{folder}{at}/{name}", f"{root}{at}/{name}"), files[i : i + WAITING]))

    def _clear(self) -> None:
        system, root = reach(self.root)
        if system.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGING}/{self.job}")
        if system.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{root}/{STAGING}")):
            system.delete_dir(f"{root}/{STAGING}")


@dataclass
class Files(InputPartition):
    """Paths below the root, compressed: names of a folder have most of their letters in common."""

    packed: bytes

    @classmethod
    def of(cls, paths: list[str]) -> Files:
        return cls(zlib.compress("\0".join(paths).encode(errors="surrogateescape")))

    @property
    def paths(self) -> list[str]:
        return [p for p in zlib.decompress(self.packed).decode(errors="surrogateescape").split("\0") if p]


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        system, root = reach(self.root)
        out, own, left = [], [], [""]
        while left:
            at = left.pop()
            folders, files = entries(system, root + at)
            left += [f"{at}/{name}" for name in reversed(folders) if not name.startswith(".")]
            for name in files:
                if name.endswith(".md") and not name.startswith("."):
                    own.append(f"{at}/{name}")
                    if len(own) == FILES:
                        out.append(Files.of(own))
                        own = []
        # a folder without pages is one part without paths
        return out if out and not own else [*out, Files.of(own)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = reach(self.root)

        def text(path: str) -> str | None:
            if system.get_file_info(path).type != fs.FileType.File:
                return None
            with system.open_input_stream(path) as f:
                return f.read().decode()

        for path in partition.paths:
            yield path.lstrip("/"), text(root + path), text(root + sidecar(path))


class MarkdownFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return "path string, body string, meta string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("pages are added or replaced one by one: use the mode append")
        return Writer(self.options["path"])
