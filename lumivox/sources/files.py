"""Files of binary sources: places in any store that Arrow knows, listings, and files that appear all at once or not at all."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pyarrow.fs as fs
from pyspark.sql.datasource import WriterCommitMessage

#: Tasks of which files are moved to their names at a time.
MOVERS = 16


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path within it; paths without a scheme are local."""
    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def found(path: str, suffix: str = "") -> list[fs.FileInfo]:
    """Files of a folder, of a pattern in the last part of the path, or the file itself, by name; hidden ones and those of ``_`` are left out."""
    store, where = place(path)
    info = store.get_file_info(where)
    folder, _, last = where.rpartition("/")
    if info.type == fs.FileType.Directory:
        folder, last = where, "*"
    elif info.type == fs.FileType.File:
        return [info]
    inside = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    files = [x for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "._" and fnmatchcase(x.base_name, last) and x.base_name.endswith(suffix)]
    return sorted(files, key=lambda x: x.path)


def listed(path: str, suffix: str = "") -> list[str]:
    """The same files' names."""
    return [x.path for x in found(path, suffix)]


@dataclass
class Written(WriterCommitMessage):
    """Files that one task has written, by their names to be."""

    names: list[str] = field(default_factory=list)
    waiting: str = ""


class Folder:
    """A folder that a job's files enter together when all its tasks are done.

    Tasks write below a folder of their job, which readers leave out; ``publish`` moves
    the files to their names, ``discard`` removes all of them.
    """

    def __init__(self, path: str):
        self.path, self.job = path, f"_writing-{uuid.uuid4().hex}"

    def _inside(self, *parts: str) -> tuple[fs.FileSystem, str]:
        store, where = place(self.path)
        return store, "/".join([where, *parts])

    @contextmanager
    def task(self) -> Iterator[tuple[ExitStack, Written, fs.FileSystem]]:
        """A folder of this attempt; if it fails, its files go at once."""
        done = Written(waiting=f"{self.job}/{uuid.uuid4().hex}")
        store, own = self._inside(done.waiting)
        store.create_dir(own, recursive=True)
        try:
            with ExitStack() as opened:
                yield opened, done, store
        except BaseException:
            store.delete_dir(own)
            raise

    def new(self, done: Written, name: str):
        """A stream to the file that is to have this name."""
        done.names.append(name)
        store, where = self._inside(done.waiting, name)
        return store.open_output_stream(where)

    def publish(self, messages: list[Written | None], overwrite: bool, suffixes: tuple[str, ...]) -> None:
        """Move all files to their names; with ``overwrite`` the folder's other files of these suffixes go first."""
        if overwrite:
            store, where = self._inside()
            for suffix in suffixes:
                for name in listed(where, suffix):
                    store.delete_file(name)
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(self._move, filter(None, messages)):
                pass
        self.discard()

    def _move(self, message: Written) -> None:
        store, waiting = self._inside(message.waiting)
        _, own = self._inside()
        for name in message.names:
            store.move(f"{waiting}/{name}", f"{own}/{name}")

    def discard(self) -> None:
        store, own = self._inside(self.job)
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)
