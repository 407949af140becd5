"""Folders as data sources: a scan that doesn't enter excluded folders, project files, and growing logs.

Folders are listed through Arrow's file systems, one level at a time. The driver lists only until there is work for the tasks; subtrees that
are left are walked by tasks. Each source is a `pyspark.sql.datasource`, so what it reads is partitioned and filtered as any scan.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..functions import projects as P
from ..operators.tree import EXCLUDED

#: The driver lists until so many folders or files are found; a task reads so many files or bytes of files, and a batch has so many bytes.
SUBTREES, FILES, BYTES, BATCH_BYTES = 64, 256, 64 << 20, 16 << 20
SCHEMES = ("", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def readable(uri: str) -> bool:
    """Whether Arrow has a file system for a location."""
    return (uri.split("://")[0] if "://" in uri else uri.split(":")[0] if uri.startswith("file:") else "") in SCHEMES


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
        return fs, path.rstrip("/") or "/"
    return pafs.LocalFileSystem(), uri.rstrip("/") or "/"


@dataclass
class Wanted:
    """What a scan looks for: names of files (patterns), folders that it doesn't enter, and how many levels it goes down; 0 is all."""

    names: list[str]
    excluded: list[str]
    levels: int = 0

    def name(self, base: str) -> bool:
        return not self.names or any(fnmatch.fnmatchcase(base, p) for p in self.names)

    def enters(self, base: str, level: int) -> bool:
        return base.lower() not in self.excluded and not (self.levels and level >= self.levels)


def listed(fs: pafs.FileSystem, folder: str, level: int, wanted: Wanted) -> tuple[list[pafs.FileInfo], list[str]]:
    """The wanted files of a folder and the folders in it that are entered, by name. A folder that can't be listed has none."""
    try:
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    except PermissionError:
        return [], []
    found.sort(key=lambda f: f.base_name)
    files = [f for f in found if f.type == pafs.FileType.File and wanted.name(f.base_name)]
    return files, [f.path for f in found if f.type == pafs.FileType.Directory and wanted.enters(f.base_name, level)]


def walked(fs: pafs.FileSystem, folder: str, level: int, wanted: Wanted) -> Iterator[pafs.FileInfo]:
    """The wanted files at and below a folder, which stands at a level."""
    rest = [(folder, level)]
    while rest:
        at, n = rest.pop()
        files, folders = listed(fs, at, n, wanted)
        yield from files
        rest += [(f, n + 1) for f in reversed(folders)]


@dataclass
class Part(InputPartition):
    """Subtrees with their levels, and files with their sizes, that a task reads."""

    folders: list[tuple[str, int]]
    files: list[str]


def parts_of(fs: pafs.FileSystem, root: str, wanted: Wanted) -> list[Part]:
    """What the tasks read: the driver lists level by level until there are SUBTREES folders or FILES files."""
    level, folders, files = 1, [root], []
    while folders and len(folders) < SUBTREES and len(files) < SUBTREES * FILES:
        below: list[str] = []
        for folder in folders:
            own, more = listed(fs, folder, level, wanted)
            files += own
            below += more
        folders, level = below, level + 1
    out, held, size = [Part([(f, level)], []) for f in folders], [], 0
    for f in files:
        if held and (len(held) == FILES or size + (f.size or 0) > BYTES):
            out.append(Part([], held))
            held, size = [], 0
        held.append(f.path)
        size += f.size or 0
    return out + ([Part([], held)] if held else [])


def text_of(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace").removeprefix("﻿")


def _options(options: dict[str, str]) -> tuple[str, Wanted]:
    if not options.get("path"):
        raise ValueError("no folder is named")
    split = lambda name, other: [x for x in options.get(name, other).split(",") if x]
    return options["path"], Wanted(split("glob", ""), [x.lower() for x in split("exclude", ",".join(EXCLUDED))], int(options.get("levels", 0)))


def below(root: str, path: str) -> str:
    return path[len(root) :].lstrip("/") if path.startswith(root) else path


class Files(DataSource):
    """path (below the folder), text (null with option text=false), size and modified of all files of a folder.

    Options: path; glob, patterns of names with commas; exclude, names of folders that aren't entered, in any case; levels, 1 for the folder
    alone. A file that is gone or can't be read when its turn comes is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "textfacts_files"

    def schema(self) -> str:
        return "path string, text string, size long, modified timestamp"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.wanted = _options(options)
        self.with_text = options.get("text", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        return parts_of(*opened(self.root), self.wanted)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.root)
        rows, size = [], 0
        names, types = ("path", "text", "size", "modified"), (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for f in _infos(fs, partition, self.wanted):
            try:
                text = text_of(fs, f.path) if self.with_text else None
            except (FileNotFoundError, PermissionError):
                continue
            rows.append((below(root, f.path), text, f.size, f.mtime or datetime.fromtimestamp(0, UTC)))
            size += len(text or "") + 64
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


def _infos(fs: pafs.FileSystem, part: Part | None, wanted: Wanted) -> Iterator[pafs.FileInfo]:
    if part:
        for folder, level in part.folders:
            yield from walked(fs, folder, level, wanted)
        if part.files:
            yield from (f for f in fs.get_file_info(part.files) if f.type == pafs.FileType.File)


class Projects(DataSource):
    """What the project and solution files of a folder tell, a partition for each file.

    Options: path, exclude and levels as for files; table: projects, project_refs, assembly_refs or solution_projects. Filters of the file's
    path (project_id, src_id or solution) and of a project's name, by equality, in, or how they begin or end, leave files unread.
    """

    @classmethod
    def name(cls) -> str:
        return "textfacts_projects"

    def schema(self) -> str:
        return P.TABLES[self.options.get("table", "projects")]

    def reader(self, schema) -> ProjectsReader:
        return ProjectsReader(self.options)


class ProjectsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.table = options.get("table", "projects")
        self.root, self.wanted = _options(options)
        self.wanted.names = ["*.sln"] if self.table == "solution_projects" else ["*.*proj"]
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "begins", StringEndsWith: "ends"}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if type(f) in kinds and column in (P.FILE_COLUMN[self.table], *(["path", "name"] if self.table == "projects" else [])):
                self.tests.append((kinds[type(f)], column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def keeps(self, path: str) -> bool:
        for kind, column, values in self.tests:
            own = P.stem(path) if column == "name" else path
            if not any(own == v if kind in ("is", "in") else own.startswith(v) if kind == "begins" else own.endswith(v) for v in values if v is not None):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.root)
        files, subtrees = [], []
        for part in parts_of(fs, root, self.wanted):
            files += [f for f in part.files if self.keeps(below(root, f))]
            subtrees += [Part([f], []) for f in part.folders]
        return subtrees + [Part([], [f]) for f in files]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        fs, root = opened(self.root)
        for f in _infos(fs, partition, self.wanted):
            if self.keeps(path := below(root, f.path)):
                yield from P.READ[self.table](path, text_of(fs, f.path))


@dataclass
class Span(InputPartition):
    """Bytes of a log that a task reads."""

    path: str
    start: int
    end: int


class Logs(DataSource):
    """path, at (the byte where it starts) and line of the lines that are added to the logs of a folder, as a stream.

    Options: path; glob, by default *.log; levels, by default 1, the folder alone. A line is read when its end is written. A log that has become
    shorter is read anew. Spans of at most BYTES bytes are read by a task each.
    """

    @classmethod
    def name(cls) -> str:
        return "textfacts_logs"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> LogsReader:
        return LogsReader(self.options)


class LogsReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.wanted = _options({"glob": "*.log", "levels": "1"} | dict(options))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = opened(self.root)
        return {below(root, f.path): self._whole(fs, f.path, f.size or 0) for f in walked(fs, root, 1, self.wanted)}

    @staticmethod
    def _whole(fs: pafs.FileSystem, path: str, size: int) -> int:
        """The end of the last line that is written to its end."""
        step = 1 << 16
        with fs.open_input_file(path) as f:
            while size > 0:
                first = max(0, size - step)
                found = f.read_at(size - first, first).rfind(b"\n")
                if found >= 0:
                    return first + found + 1
                size = first
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, root = opened(self.root)
        out: list[InputPartition] = []
        for path, to in sorted(end.items()):
            at = start.get(path, 0)
            at = at if at <= to else 0
            while at < to:
                # Spans are cut at the end of a line, of a longer one behind it.
                cut, size = at, BYTES
                while cut <= at:
                    cut = to if to - at <= size else self._whole(fs, f"{root}/{path}", at + size)
                    size *= 2
                out.append(Span(path, at, cut))
                at = cut
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        fs, root = opened(self.root)
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            f.seek(partition.start)
            at, rest = partition.start, partition.end - partition.start
            kept = b""
            while rest > 0 and (got := f.read(min(rest, 1 << 20))):
                rest -= len(got)
                *lines, kept = (kept + got).split(b"\n")
                for line in lines:
                    yield partition.path, at, line.decode("utf-8", "replace").removesuffix("\r")
                    at += len(line) + 1


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Files, Projects, Logs):
        spark.dataSource.register(source)
