"""Spark data sources for what books are kept in: single text files, written whole or not at all, and chapter caches, read by folder.

    spark.dataSource.register(TextFiles)
    rows.write.format("foliant_text_files").mode("append").save(path)

`TextFiles` takes rows (file, place, text), sorted by these within partitions and with all rows of a file in one: a file is written row by row, so no book is ever one row or one
string. Tasks write to a folder of their own below a hidden one; the driver moves the files to their names once all tasks are done, one rename each, and removes what lost or repeated
attempts left. If a task fails for good, nothing is moved.

`CacheFiles` reads site/key/chapters/000001.txt. Folders are listed when the scan is planned, a few to a partition; the options `sites`, `keys`, `first` and `last` say which, and folders and files that
they leave out are neither listed nor opened. These are options, not filters that the source takes over from a query: Spark 4.1 keeps what `pushFilters` took for later queries on the
same DataFrame, which then miss rows.

Paths are those that `pyarrow.fs` knows: a folder that all executors share, or the address of an object store.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_staging"
FOLDERS = 64  # to a partition
BATCH_BYTES = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def checked(name: str) -> str:
    """A file's name below the folder; one that leads elsewhere raises."""
    if not name or name.startswith("/") or any(x in ("", ".", "..") for x in name.split("/")) or name.split("/")[0] == STAGING:
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class TextFiles(DataSource):
    """Options: path; `joiner` between the rows of a file (an empty line), `end` after the last one (a line end)."""

    @classmethod
    def name(cls) -> str:
        return "foliant_text_files"

    def schema(self) -> str:
        return "file string, place long, text string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        if schema.names != ["file", "place", "text"]:
            raise ValueError(f"columns must be file, place, text, not {schema.names}")
        writer = TextFilesWriter(self.options["path"], self.options.get("joiner", "\n\n"), self.options.get("end", "\n"), overwrite)
        fs, folder = writer.staging()
        fs.create_dir(folder, recursive=True)  # tasks make folders in this one only: once an abort has removed it, those that still run fail
        return writer


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, joiner: str, end: str, overwrite: bool) -> None:
        self.path, self.joiner, self.end, self.overwrite = path, joiner, end, overwrite
        self.job = uuid.uuid4().hex

    def staging(self, *parts: str) -> tuple[pafs.FileSystem, str]:
        fs, root = filesystem(self.path)
        return fs, posixpath.join(root, STAGING, self.job, *parts)

    def write(self, iterator) -> Staged:
        fs, folder = self.staging(attempt := uuid.uuid4().hex)
        fs.create_dir(folder, recursive=False)
        name, out, seen, made = None, None, set(), {folder}
        try:
            for row in iterator:
                if row["file"] != name:
                    if out is not None:
                        out.write(self.end.encode())
                        out.close()
                    name, out = checked(row["file"]), None
                    if name in seen:
                        raise ValueError(f"rows of {name!r} are not together")
                    seen.add(name)
                    at = folder
                    for part in name.split("/")[:-1]:
                        if (at := posixpath.join(at, part)) not in made:
                            fs.create_dir(at, recursive=False)
                            made.add(at)
                    out = fs.open_output_stream(posixpath.join(folder, name))
                else:
                    out.write(self.joiner.encode())
                out.write((row["text"] or "").encode())
            if out is not None:
                out.write(self.end.encode())
        finally:
            if out is not None:
                out.close()
        return Staged(attempt)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.base_name != STAGING:
                    (fs.delete_dir if old.type == pafs.FileType.Directory else fs.delete_file)(old.path)
        made: set[str] = set()
        for message in messages:
            if message is None:
                continue
            _, folder = self.staging(message.folder)
            for info in fs.get_file_info(pafs.FileSelector(folder, recursive=True)):
                if info.type == pafs.FileType.File:
                    target = posixpath.join(root, posixpath.relpath(info.path, folder))
                    if (parent := posixpath.dirname(target)) not in made:
                        fs.create_dir(parent, recursive=True)
                        made.add(parent)
                    fs.move(info.path, target)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = self.staging()
        for _ in range(10):  # a task that still runs may put a file into a folder that is being removed
            if fs.get_file_info(folder).type != pafs.FileType.Directory:
                break
            with contextlib.suppress(OSError):
                fs.delete_dir(folder)
            time.sleep(0.05)
        parent = posixpath.dirname(folder)
        if fs.get_file_info(parent).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(parent)):
            fs.delete_dir(parent)


@dataclass
class Folders(InputPartition):
    """(site, key) of some books."""

    books: list[tuple[str, str]]

    def __post_init__(self) -> None:
        super().__init__(self.books)


class CacheFiles(DataSource):
    """Options: path; `sites` and `keys` as JSON lists, `first` and `last` number. Columns site, cache_key, number, text. Files with other names than six digits or more and `.txt` are left out."""

    @classmethod
    def name(cls) -> str:
        return "foliant_cache"

    def schema(self) -> str:
        return "site string, cache_key string, number int, text string"

    def reader(self, schema) -> CacheReader:
        some = {k: set(json.loads(self.options[k])) for k in ("sites", "keys") if k in self.options}
        return CacheReader(self.options["path"], some, int(self.options.get("first", 0)), int(self.options.get("last", 1 << 31)))


class CacheReader(DataSourceReader):
    def __init__(self, path: str, only: dict[str, set[str]], first: int, last: int) -> None:
        self.path, self.only, self.first, self.last = path, only, first, last

    def _below(self, fs: pafs.FileSystem, folder: str, level: str) -> list[str]:
        """Names of the folders in one, of those that are asked for."""
        if level in self.only:
            names = sorted(x for x in self.only[level] if isinstance(x, str) and x and "/" not in x and x not in (".", ".."))
            infos = fs.get_file_info([posixpath.join(folder, x) for x in names])
            return [n for n, i in zip(names, infos, strict=True) if i.type == pafs.FileType.Directory]
        return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.Directory and not i.base_name.startswith("_"))

    def partitions(self) -> list[Folders]:
        fs, root = filesystem(self.path)
        books = [(site, key) for site in self._below(fs, root, "sites") for key in self._below(fs, posixpath.join(root, site), "keys")]
        return [Folders(books[i : i + FOLDERS]) for i in range(0, len(books), FOLDERS)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        kinds = [("site", pa.string()), ("cache_key", pa.string()), ("number", pa.int32()), ("text", pa.string())]
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

        for site, key in partition.books:
            folder = posixpath.join(root, site, key, "chapters")
            for info in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name):
                stem, _, kind = info.base_name.partition(".")
                if kind != "txt" or len(stem) < 6 or not stem.isascii() or not stem.isdigit() or not self.first <= int(stem) <= self.last:
                    continue
                with fs.open_input_stream(info.path) as f:
                    rows.append((site, key, int(stem), f.read().decode()))
                size += len(rows[-1][-1])
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        yield batch()
