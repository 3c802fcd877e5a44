"""A folder of files as a Spark data source, ``scan_folder``: whole texts, one row a file, and a row with an error for each file that cannot be read.

    spark.dataSource.register(ScanFolder)
    spark.read.format("scan_folder").load("/shared/uploads").where("extension = '.txt' AND length < 1000000")

Files are listed once and dealt into partitions of about ``partition_bytes`` each, so that many small files are one task and a large one has its own. Filters on extension, length and path are
decided on the list, before anything is opened (``spark.sql.python.filterPushdown.enabled``). As a stream, files come in order of (time of change, path) and an offset is the last one
that was read; files changed within the last ``settle_ms`` wait, since they may still be written. Paths may be of any file system that pyarrow knows, and must be
one that all executors see. A directory that vanishes between listing and reading gives errors in rows, no failed task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, extension string, length long, changed_ms long, text string, error string"
PARTITION_BYTES = 64 << 20
SETTLE_MS = 1500
#: Opening a file costs about as much as reading so many bytes.
OPEN_COST = 1 << 20
LISTED = {"path": 0, "name": 1, "extension": 2, "length": 3, "changed_ms": 4}
TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
}


class Files(InputPartition):
    def __init__(self, files: list[tuple]) -> None:
        self.files = files


def listed(uri: str, recursive: bool) -> list[tuple]:
    """(path, name, extension, length, changed_ms) of the files of a folder, or of one file, by path."""
    import pyarrow.fs as fs

    system, root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri("file://" + uri)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=recursive))
    return sorted((f.path, f.base_name, "." + f.extension.lower() if f.extension else "", f.size or 0, (f.mtime_ns or 0) // 1_000_000) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def dealt(files: list[tuple], most: int) -> list[Files]:
    """Files in partitions of about so many bytes, the largest first."""
    parts: list[list[tuple]] = []
    full = most
    for f in sorted(files, key=lambda f: (-f[3], f[0])):
        if full + f[3] + OPEN_COST > most:
            parts.append([])
            full = 0
        parts[-1].append(f)
        full += f[3] + OPEN_COST
    return [Files(x) for x in parts]


def texts(uri: str, files: list[tuple], largest: int) -> Iterator[tuple]:
    """The rows of some files; what goes wrong with one is its row's error."""
    import pyarrow.fs as fs

    system = fs.FileSystem.from_uri(uri)[0] if "://" in uri else fs.LocalFileSystem()
    for path, name, extension, length, changed in files:
        text = error = None
        if length > largest:
            error = f"file of {length} bytes, {largest} at most"
        elif not length:
            error = "empty file"
        else:
            try:
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8-sig")
            except UnicodeDecodeError as e:
                error = f"no UTF-8 text: byte {e.start}"
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
        yield path, name, extension, length, changed, text, error


class _Options:
    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("scan_folder needs a path")
        self.uri = re.sub(r"^file:(?=/[^/])", "file://", options["path"])
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.largest = int(options.get("largest", 512 << 20))
        self.settle_ms = int(options.get("settle_ms", SETTLE_MS))


class FolderReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) is IsNotNull and len(f.attribute) == 1 and f.attribute[0] in LISTED:
                continue  # these are never null
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in LISTED:
                self.filters.append((LISTED[f.attribute[0]], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        keep = lambda row: all(TESTS[kind](row[k], value) for k, kind, value in self.filters)
        return dealt([f for f in listed(self.options.uri, self.options.recursive) if keep(f)], self.options.partition_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return texts(self.options.uri, partition.files, self.options.largest)


class FolderStream(DataSourceStreamReader):
    """Offsets are {"changed_ms": time, "path": path} of the last file read."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"changed_ms": -1, "path": ""}

    def latestOffset(self) -> dict:
        settled = time.time() * 1000 - self.options.settle_ms
        last = max(((f[4], f[0]) for f in listed(self.options.uri, self.options.recursive) if f[4] <= settled), default=(-1, ""))
        return {"changed_ms": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed_ms"], start["path"]), (end["changed_ms"], end["path"])
        return dealt([f for f in listed(self.options.uri, self.options.recursive) if low < (f[4], f[0]) <= high], self.options.partition_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return texts(self.options.uri, partition.files, self.options.largest)


class ScanFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(_Options(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Make scan_folder known to a session, with its filters pushed down."""
    spark.dataSource.register(ScanFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
