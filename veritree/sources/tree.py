"""A file tree as a table: one row per entry, with state and digest, read by partitioned Python tasks."""

from __future__ import annotations

import errno
import fnmatch
import hashlib
import os
import stat
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "path string, category string, size long, device long, inode long, modified_ns long, changed_ns long, sha256 string"


class TreeSource(DataSource):
    """spark.read.format("tree").option("checksums", "true").load(folder); paths are relative and use '/'.

    Categories: file, directory, symbolic_link, non_regular, unreadable, changed, and with the options ignored_files, ignored_folders
    (shell patterns, one a line, case-blind) and tool_state (names at the top, one a line; a trailing * fits what begins so) also
    ignored and tool_state. Ignored folders are not entered, and nothing is followed.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        lines = lambda name: [x for x in self.options.get(name, "").split("\n") if x]
        return TreeReader(self.options["path"], self.options.get("checksums", "false").lower() == "true", lines("ignored_files"), lines("ignored_folders"), lines("tool_state"))


class Part(InputPartition):
    """A folder: whole, or its own entries only; of those, the ones whose name falls in share k of n."""

    def __init__(self, start: str, deep: bool, k: int = 0, n: int = 1):
        super().__init__((start, deep, k, n))


#: Partitions that a first pass over folders aims at, and folders that it lists for that.
PARTS, LISTED = 256, 4096
#: A folder with more entries is dealt out by names.
SHARE = 50_000

_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v)}
_COLUMNS = ("path", "category", "size", "device", "inode", "modified_ns", "changed_ns")


class TreeReader(DataSourceReader):
    """Folders are opened part by part from the root, none of them through a link, and what was opened must be what was listed.

    Filters on the columns before the digest are applied before a file is read, and those on path prefixes before folders are entered.
    """

    def __init__(self, root: str, checksums: bool, ignored_files: list[str], ignored_folders: list[str], tool_state: list[str]):
        self.root, self.checksums = root, checksums
        self.ignored_files, self.ignored_folders, self.tool_state = ([x.casefold() for x in p] for p in (ignored_files, ignored_folders, tool_state))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in _COLUMNS and type(f) is IsNotNull:
                self.filters.append((name, IsNotNull, None))
            elif name in _COLUMNS and type(f) in _TESTS:
                self.filters.append((name, type(f), tuple(f.value) if type(f) is In else f.value))
            else:
                yield f

    def _keeps(self, row: tuple, categories: tuple[str, ...] | None = None) -> bool:
        """Whether an entry passes the filters; with categories, whether it may still pass with one of these."""
        for name, kind, value in self.filters:
            if name == "category" and categories is not None:
                if kind is not IsNotNull and not any(_TESTS[kind](c, value) for c in categories):
                    return False
                continue
            x = row[_COLUMNS.index(name)]
            if x is None or (kind is not IsNotNull and not _TESTS[kind](x, value)):
                return False
        return True

    def _enters(self, folder: str) -> bool:
        """Whether a filter on paths lets anything below a folder pass."""
        for name, kind, value in self.filters:
            if name == "path":
                for prefix in ((value,) if kind in (StringStartsWith, EqualTo) else ()):
                    if not (folder == "" or f"{folder}/".startswith(prefix) or prefix.startswith(f"{folder}/")):
                        return False
        return True

    def _fits(self, path: str, patterns: list[str]) -> bool:
        low = path.casefold()
        return any(fnmatch.fnmatchcase(low, p) or fnmatch.fnmatchcase(low.rpartition("/")[2], p) for p in patterns)

    def _of_tool(self, path: str) -> bool:
        return "/" not in path and self._fits(path, self.tool_state)

    def _open(self, path: str) -> int:
        """A folder's descriptor, by one step a part and through no link; OSError where that fails."""
        fd = os.open(self.root, os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC)
        try:
            for part in path.split("/") if path else ():
                following = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC, dir_fd=fd)
                os.close(fd)
                fd = following
        except OSError:
            os.close(fd)
            raise
        return fd

    def partitions(self) -> list[InputPartition]:
        """Folders are opened up, the shallowest first, until there are enough parts or the pass has listed enough; what it lists are names only."""
        whole, own, listed = deque([""]), [], 0
        while whole and len(whole) + len(own) < PARTS and listed < LISTED:
            at = whole.popleft()
            if not self._enters(at):
                continue
            listed += 1
            try:
                fd = self._open(at)
            except OSError:
                own.append(Part(at, True))  # its reader reports it
                continue
            try:
                entries = 0
                for e in os.scandir(fd):
                    entries += 1
                    path = f"{at}/{e.name}" if at else e.name
                    if e.is_dir(follow_symlinks=False) and not self._fits(path, self.ignored_folders) and not self._of_tool(path):
                        whole.append(path)
            finally:
                os.close(fd)
            n = max(1, -(-entries // SHARE))
            own += [Part(at, False, k, n) for k in range(n)]
        return own + [Part(at, True) for at in whole if self._enters(at)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, deep, k, n = partition.value
        todo = [(start, None)]
        while todo:
            at, known = todo.pop()
            try:
                fd = self._open(at)
            except OSError as e:
                row = (at, "changed" if known is not None and e.errno in (errno.ELOOP, errno.ENOTDIR, errno.ENOENT) else "unreadable", 0, None, None, None, None)
                if self._keeps(row):
                    yield (*row, None)
                continue
            try:
                s = os.fstat(fd)
                if known is not None and (s.st_dev, s.st_ino) != known:
                    row = (at, "changed", 0, None, None, None, None)
                    if self._keeps(row):
                        yield (*row, None)
                    continue
                for e in sorted(os.scandir(fd), key=lambda e: e.name):
                    if n > 1 and zlib.crc32(os.fsencode(e.name)) % n != k:
                        continue
                    yield from self._entry(fd, f"{at}/{e.name}" if at else e.name, e, todo if deep else None)
            finally:
                os.close(fd)

    def _entry(self, fd: int, path: str, e: os.DirEntry, todo: list | None) -> Iterator[tuple]:
        try:
            s = e.stat(follow_symlinks=False)
        except OSError:  # gone or closed since it was listed
            row = (path, "changed", 0, None, None, None, None)
            if self._keeps(row):
                yield (*row, None)
            return
        state = (s.st_size, s.st_dev, s.st_ino, s.st_mtime_ns, s.st_ctime_ns)
        if self._of_tool(path):
            category = "tool_state"
        elif self._fits(path, self.ignored_folders if stat.S_ISDIR(s.st_mode) else self.ignored_files):
            category = "ignored"
        elif stat.S_ISLNK(s.st_mode):
            category = "symbolic_link"
        elif stat.S_ISDIR(s.st_mode):
            category = "directory"
            if todo is not None and self._enters(path):
                todo.append((path, (s.st_dev, s.st_ino)))
        elif not stat.S_ISREG(s.st_mode):
            category = "non_regular"
        else:
            category = "file"
            if self.checksums and self._keeps((path, "file", *state), ("file", "unreadable", "changed")):
                category, digest = self._digest(fd, e.name, state)
                if self._keeps((path, category, *state)):
                    yield (path, category, *state, digest)
                return
        if self._keeps((path, category, *state)):
            yield (path, category, *state, None)

    def _digest(self, folder: int, name: str, state: tuple) -> tuple[str, str | None]:
        """The category and digest of a regular file that was listed with this state."""
        try:
            fd = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC, dir_fd=folder)
        except OSError as e:
            return ("changed" if e.errno in (errno.ELOOP, errno.ENOENT) else "unreadable"), None
        digest = hashlib.sha256()
        try:
            while chunk := os.read(fd, 1 << 20):
                digest.update(chunk)
            s = os.fstat(fd)
        except OSError:
            return "unreadable", None
        finally:
            os.close(fd)
        now = (s.st_size, s.st_dev, s.st_ino, s.st_mtime_ns, s.st_ctime_ns)
        return ("file", digest.hexdigest()) if now == state else ("changed", None)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
