"""A data source of file facts: every regular file under some roots, hidden ones too, hashed and sniffed where it lies.

Content never enters a row. Links and special files give issue rows.

As a batch source it splits what it finds: folders are planned level by level, a folder of many entries is dealt in shares by the hash of their names (each task lists it and takes its
own share), and what lies deeper than the plan went is walked by its own task. Filters on root, path prefix and path ending are taken over from the
plan: folders that can't match aren't opened, files that don't match aren't read.

As a stream it gives changes: its offset counts scans, and each scan compares what it finds with the listing the one before left in the folder ``state``. Tasks deal by
the hash of a path's first two names. A scan that is repeated after a failure finds its own listing and gives the same changes again.
"""

from __future__ import annotations

import hashlib
import os
import stat
import time
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from ..functions.udf import image_size, sniff

SCHEMA = "root_id string, root_kind string, configured_system string, path string, size long, sha256 string, mime string, width int, height int, mtime long, issue string"
CHANGES = "generation long, root_id string, kind string, path string, size long, at timestamp"
#: Entries that one task takes of a folder, folders that the plan opens, rows of an Arrow batch.
ENTRIES, FOLDERS, ROWS = 1000, 2000, 500
_TYPES = pa.schema([("root_id", pa.string()), ("root_kind", pa.string()), ("configured_system", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("mime", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mtime", pa.int64()), ("issue", pa.string())])
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])


class _Part(InputPartition):
    """The entries of ``folder`` that fall in share ``k`` of ``n``; with ``deep`` also all that lies below them."""

    def __init__(self, root: tuple, folder: str, k: int = 0, n: int = 1, deep: bool = False):
        self.root, self.folder, self.k, self.n, self.deep = root, folder, k, n, deep


def share(name: str, n: int) -> int:
    return zlib.crc32(name.encode(errors="surrogateescape")) % n


def facts(root: tuple[str, str, str, str], path: str):
    """The row of one file."""
    rid, kind, system, top = root
    full = os.path.join(top, path)
    info = os.lstat(full)
    if stat.S_ISLNK(info.st_mode):
        return rid, kind, system, path, None, None, None, None, None, None, "symlink-rejected"
    if not stat.S_ISREG(info.st_mode):
        return rid, kind, system, path, None, None, None, None, None, None, "non-regular-rejected"
    h, head = hashlib.sha256(), b""
    with open(full, "rb") as f:
        while part := f.read(1 << 20):
            head = head or part
            h.update(part)
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    mime = sniff(head[:512], ext)
    width, height = image_size(head) if mime.startswith("image/") else (0, 0)
    return rid, kind, system, path, info.st_size, h.hexdigest(), mime, width, height, info.st_mtime_ns // 1000, ""


def entries(full: str) -> tuple[list[str], list[str]]:
    """The names of the folders and of all else in a folder, sorted; a link to a folder isn't one."""
    folders, rest = [], []
    with os.scandir(full) as found:
        for e in found:
            (folders if e.is_dir(follow_symlinks=False) else rest).append(e.name)
    return sorted(folders), sorted(rest)


def below(top: str, folder: str, wanted=lambda path: True):
    """The paths of all files under a folder, relative to ``top``; folders for which ``wanted`` is false aren't opened."""
    folders, rest = entries(os.path.join(top, folder))
    for name in rest:
        yield f"{folder}/{name}" if folder else name
    for name in folders:
        path = f"{folder}/{name}" if folder else name
        if wanted(path):
            yield from below(top, path, wanted)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[tuple], entries_each: int, folders: int):
        self.roots, self.each, self.folders = roots, entries_each, folders
        self.prefixes: list[str] = []
        self.endings: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("root_id",):
                self.roots = [r for r in self.roots if r[0] == f.value]
            elif isinstance(f, In) and f.attribute == ("root_id",):
                self.roots = [r for r in self.roots if r[0] in f.value]
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.endings.append(f.value)
            else:
                yield f

    def _folder_may_match(self, path: str) -> bool:
        return all(f"{path}/".startswith(p) or p.startswith(f"{path}/") for p in self.prefixes)

    def _matches(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and all(path.endswith(e) for e in self.endings)

    def partitions(self):
        out, level, opened = [], [(r, "") for r in self.roots], 0
        while level:
            deeper = []
            for root, folder in level:
                if opened >= self.folders:
                    out.append(_Part(root, folder, deep=True))
                    continue
                opened += 1
                folders, rest = entries(os.path.join(root[3], folder))
                n = -(-len(rest) // self.each)
                out += [_Part(root, folder, k, n) for k in range(n)]
                deeper += [(root, p) for f in folders if self._folder_may_match(p := f"{folder}/{f}" if folder else f)]
            level = deeper
        return out or [_Part(("", "", "", ""), "")]

    def read(self, partition):
        root = partition.root
        if not root[3]:
            return
        if partition.deep:
            paths = below(root[3], partition.folder, self._folder_may_match)
        else:
            _, rest = entries(os.path.join(root[3], partition.folder))
            paths = (f"{partition.folder}/{x}" if partition.folder else x for x in rest if share(x, partition.n) == partition.k)
        rows = []
        for path in paths:
            if self._matches(path):
                rows.append(facts(root, path))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


# ---- changes as a stream -------------------------------------------------------------------------------------------
class _Share(InputPartition):
    def __init__(self, root: tuple, k: int, start: int, end: int):
        self.root, self.k, self.start, self.end = root, k, start, end


class _Changes(DataSourceStreamReader):
    def __init__(self, roots: list[tuple], state: str, shares: int, generation: int):
        self.roots, self.state, self.shares, self.generation = roots, state, shares, generation

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        """One scan more than the last that left listings."""
        done = [int(x) for x in os.listdir(self.state) if x.isdigit()] if os.path.isdir(self.state) else []
        return {"scan": max(done, default=0) + 1}

    def partitions(self, start: dict, end: dict):
        return [_Share(r, k, start["scan"], end["scan"]) for r in self.roots for k in range(self.shares)]

    def _file(self, scan: int, root: str, k: int) -> str:
        return os.path.join(self.state, str(scan), f"{hashlib.sha256(root.encode()).hexdigest()[:16]}-{k}.parquet")

    def _found(self, part: _Share) -> pa.Table:
        own = lambda path: share("/".join(path.split("/")[:2]), self.shares) == part.k
        rows = []
        for path in below(part.root[3], "", lambda p: p.count("/") == 0 or own(p)):
            if own(path):
                info = os.lstat(os.path.join(part.root[3], path))
                if stat.S_ISREG(info.st_mode):
                    rows.append((path, info.st_size, info.st_mtime_ns))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _LISTED, strict=True)], schema=_LISTED)

    def read(self, partition):
        """The share's changes: a file that changed goes and comes again. Its first share also says that the root is due, and each that it failed or (the first) is done."""
        rid, name = partition.root[0], self._file(partition.end, partition.root[0], partition.k)
        row = lambda kind, path=None, size=None: (self.generation, rid, kind, path, size, _moment())
        before = {}
        for scan in range(partition.start, 0, -1):  # a root that failed left no listing: the last one that was left counts
            old = self._file(scan, rid, partition.k)
            if os.path.exists(old):
                before = {p: (s, m) for p, s, m in zip(*(c.to_pylist() for c in pq.read_table(old).columns), strict=True)}
                break
        if partition.k == 0:
            yield row("resumed")
        try:
            if os.path.exists(name):
                now = pq.read_table(name)
            else:
                now = self._found(partition)
                os.makedirs(os.path.dirname(name), exist_ok=True)
                pq.write_table(now, f"{name}.{os.getpid()}")
                os.replace(f"{name}.{os.getpid()}", name)
        except OSError:
            yield row("failed")
            return
        after = {p: (s, m) for p, s, m in zip(*(c.to_pylist() for c in now.columns), strict=True)}
        for path in sorted(before.keys() | after.keys()):
            if before.get(path) != after.get(path):
                if path in before:
                    yield row("gone", path, before[path][0])
                if path in after:
                    yield row("file", path, after[path][0])
        if partition.k == 0:
            yield row("done")

    def commit(self, end: dict) -> None:
        """Listings stay: the next scan starts from them."""


def _moment():
    import datetime

    return datetime.datetime.fromtimestamp(time.time())


class CatalogFiles(DataSource):
    """format("catalog_files") with option roots: lines of id, kind, system, folder, separated by tabs. Batch: ``SCHEMA``; options entries (of a task) and folders (of the plan). Stream: ``CHANGES``;
    options state (a folder that all machines see), shares (tasks a root), generation."""

    @classmethod
    def name(cls):
        return "catalog_files"

    def schema(self):
        return CHANGES if "state" in self.options else SCHEMA

    def _roots(self) -> list[tuple]:
        return [tuple(line.split("\t")) for line in self.options["roots"].splitlines() if line]

    def reader(self, schema):
        return _Reader(self._roots(), int(self.options.get("entries", ENTRIES)), int(self.options.get("folders", FOLDERS)))

    def streamReader(self, schema):
        return _Changes(self._roots(), self.options["state"], int(self.options.get("shares", 4)), int(self.options.get("generation", 1)))


def _lines(roots: list[tuple[str, str, str, str]]) -> str:
    return "\n".join("\t".join(r) for r in roots)


def scan(spark: SparkSession, roots: list[tuple[str, str, str, str]], *, entries: int = ENTRIES, folders: int = FOLDERS) -> DataFrame:
    spark.dataSource.register(CatalogFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("catalog_files").option("roots", _lines(roots)).option("entries", entries).option("folders", folders).load()


def changes(spark: SparkSession, roots: list[tuple[str, str, str, str]], state: str, generation: int, shares: int = 4) -> DataFrame:
    """The messages of one more scan (see ``streaming.roots``): what came and went since the listings in ``state``."""
    spark.dataSource.register(CatalogFiles)
    return spark.readStream.format("catalog_files").option("roots", _lines(roots)).option("state", state).option("generation", generation).option("shares", shares).load()
