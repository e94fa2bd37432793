"""Folders of artifacts as a Spark data source: spark.read.format("artifacts"), readStream and write.

Reading plans partitions from a listing: file names say kind and run, filters on kind,
run_id and path drop files before any is opened, and files are packed into partitions by
size. Of a folder with many folders the driver lists only those; tasks list what is below
them. What the driver holds of a file is a few compressed bytes. Reading as a stream goes on from the last file's time and path. Writing is done in
two steps: tasks write below ``_staging``, each attempt under a name of its own, and the
driver moves the files of the attempts that succeeded to their places when all have.

``register`` enters this library's sources in a session. Folders are those that
pyarrow can open (local, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
import os
import pickle
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import cache
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .kinds import KINDS

SCHEMA = "path string, kind string, run_id string, size long, text string, problem string"
#: A partition has files of so many bytes, and so many files, at most (one file at least).
PART_BYTES, PART_FILES = 64 << 20, 4096
#: Folders beside each other that are so many are listed by tasks; of so many of them the driver counts the files.
MANY_FOLDERS, COUNTED = 256, 16
#: A writing task has so many bytes of text: Spark hands them to Python in one batch.
WRITE_BYTES = 16 << 20
#: Parquet options for rows that hold whole documents: a group of rows, which is read at once, is bounded by bytes however few rows that are.
DOCUMENT_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
STAGING = "_staging"
#: A stream leaves files younger than this to its next batch, as others of the same time may follow.
SETTLE_SECONDS = 1.0


@dataclass(frozen=True)
class Artifact:
    path: str
    kind: str | None
    run_id: str | None
    size: int
    changed: int


def _small(value: object) -> bytes:
    return zlib.compress(pickle.dumps(value), 1)


class Files(InputPartition):
    """Files, kept compressed: the driver has all partitions in memory."""

    def __init__(self, files: Iterable[Artifact]) -> None:
        self.held = _small([(f.path, f.kind, f.run_id, f.size, f.changed) for f in files])

    @property
    def files(self) -> list[Artifact]:
        return [Artifact(*f) for f in pickle.loads(zlib.decompress(self.held))]


class Folders(InputPartition):
    """Folders whose files the task lists."""

    def __init__(self, folders: list[str]) -> None:
        self.held = _small(folders)

    @property
    def folders(self) -> list[str]:
        return pickle.loads(zlib.decompress(self.held))


@dataclass
class Since(InputPartition):
    """Files, or what is in folders, after one time and path up to another."""

    part: InputPartition
    low: tuple[int, str]
    high: tuple[int, str]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


@cache
def _names() -> tuple[dict[str, tuple[int, int, str]], list[tuple[int, int, str, re.Pattern]]]:
    """Plain file names with rank, place and kind, and the patterns of those that hold a run."""
    plain, patterns = {}, []
    for place, (kind, file, legacy, *_) in enumerate(KINDS):
        for rank, name in enumerate((file, *legacy)):
            if name and "{run_id}" in name:
                patterns.append((rank, place, kind, re.compile("(?:^|/)" + re.escape(name).replace(re.escape("{run_id}"), "([^/]+)") + "$")))
            elif name:
                plain[name] = min(plain.get(name, (rank, place, kind)), (rank, place, kind))
    return plain, patterns


def named(below: str) -> tuple[str | None, str | None]:
    """kind and run of a file by its path below the folder; current names go before older ones of all kinds."""
    plain, patterns = _names()
    parts = below.rsplit("/", 2)
    hits = [(*hit, None) for name in (parts[-1], "/".join(parts[-2:])) if (hit := plain.get(name))]
    if len(parts) > 1 and parts[-2] == "results":
        hits += [(rank, place, kind, m[1]) for rank, place, kind, p in patterns if (m := p.search(below))]
    return min(hits, key=lambda h: h[:2])[2:] if hits else (None, None)


def entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """path, whether it is a folder, size and time of what is in a folder, but names that begin with a dot or an underscore; on a local disk one by one."""
    if isinstance(files, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for e in found:
                    if e.name[0] in "._":
                        continue
                    try:
                        stat = None if e.is_dir() else e.stat()
                    except FileNotFoundError:  # moved or deleted meanwhile
                        continue
                    yield (e.path, True, 0, 0) if stat is None else (e.path, False, stat.st_size, stat.st_mtime_ns)
        except FileNotFoundError:
            return
        return
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name[0] not in "._":
            yield info.path, info.type == fs.FileType.Directory, info.size or 0, int(info.mtime_ns or 0)


def below(files: fs.FileSystem, root: str, folders: Iterable[str]) -> Iterator[Artifact]:
    """The files anywhere below some folders of ``root``, one folder in memory at a time."""
    left = list(folders)
    while left:
        for path, deeper, size, changed in entries(files, left.pop()):
            if deeper:
                left.append(path)
            else:
                yield Artifact(path, *named(path[len(root) :].lstrip("/")), size, changed)


def listed(folder: str) -> list[Artifact]:
    """All files of a folder by path, but those whose names begin with a dot or an underscore or lie in such folders."""
    files, root = opened(folder)
    return sorted(below(files, root, [root]), key=lambda a: a.path)


def packed(files: Iterable[Artifact]) -> list[Files]:
    parts: list[Files] = []
    held: list[Artifact] = []
    room = PART_BYTES
    for f in files:
        if held and (room < f.size or len(held) >= PART_FILES):
            parts.append(Files(held))
            held, room = [], PART_BYTES
        held.append(f)
        room -= f.size
    return [*parts, Files(held)] if held else parts


def planned(folder: str, keeps: Callable[[Artifact], bool]) -> list[InputPartition]:
    """Partitions of the files that ``keeps`` lets through. Levels of the tree are listed here until one has MANY_FOLDERS folders; those are dealt out whole, by the numbers of files and bytes that a few of them have."""
    files, root = opened(folder)
    level = [root]

    def listing() -> Iterator[Artifact]:
        nonlocal level
        while level and (level == [root] or len(level) < MANY_FOLDERS):
            deeper = []
            for d in level:
                for path, is_folder, size, changed in entries(files, d):
                    if is_folder:
                        deeper.append(path)
                    elif keeps(a := Artifact(path, *named(path[len(root) :].lstrip("/")), size, changed)):
                        yield a
            level = sorted(deeper)

    def by_path() -> Iterator[Artifact]:
        """Some at a time: a folder of any number of files isn't held whole."""
        found = listing()
        while some := sorted(islice(found, PART_FILES), key=lambda a: a.path):
            yield from some

    parts: list[InputPartition] = list(packed(by_path()))
    if level:
        counted = level[:: -(-len(level) // COUNTED)]
        n = size = 0
        for d in counted:
            for a in islice(below(files, root, [d]), PART_FILES):
                n, size = n + 1, size + a.size
        some = max(1, int(len(counted) / max(n / PART_FILES, size / PART_BYTES, len(counted) / PART_FILES)))
        parts += [Folders(level[a : a + some]) for a in range(0, len(level), some)]
    return parts or [Files(())]


def read_files(folder: str, part: InputPartition, keeps: Callable[[Artifact], bool]) -> Iterator[pa.RecordBatch]:
    """A batch some files; a file that can't be read is a row with a problem."""
    files, root = opened(folder)
    names = ("path", "kind", "run_id", "size", "text", "problem")
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for f in part.files if isinstance(part, Files) else filter(keeps, below(files, root, part.folders)):
        text = problem = None
        try:
            with files.open_input_stream(f.path) as stream:
                text = stream.read().decode("utf-8")
            json.loads(text)
        except UnicodeDecodeError:
            problem = "not UTF-8"
        except ValueError:
            problem = None if f.path.endswith((".yaml", ".yml")) else "not JSON"
        except OSError as e:
            problem = f"not readable: {e}"[:200]
        rows.append((f.path, f.kind, f.run_id, f.size, text, problem or (None if f.kind else "unknown kind")))
        held += f.size
        if held > 8 << 20 or len(rows) >= PART_FILES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


class Reader(DataSourceReader):
    def __init__(self, folder: str, names: str | None = None) -> None:
        self.folder, self.names, self.kept = folder, names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on what the listing tells; the rest is Spark's."""
        known = {("kind",), ("run_id",), ("path",)}
        for f in filters:
            if getattr(f, "attribute", None) in known and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)):
                self.kept.append(f)
            else:
                yield f

    def keeps(self, a: Artifact) -> bool:
        if self.names and not fnmatchcase(a.path.rpartition("/")[2], self.names):
            return False
        for f in self.kept:
            value = getattr(a, f.attribute[0])
            if isinstance(f, IsNotNull):
                good = value is not None
            elif isinstance(f, In):
                good = value is not None and value in f.value
            elif isinstance(f, StringStartsWith):
                good = value is not None and value.startswith(f.value)
            else:
                good = value == f.value and (value is not None or isinstance(f, EqualNullSafe))
            if not good:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return planned(self.folder, self.keeps)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_files(self.folder, partition, self.keeps)


class StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file read; a file that is written again is read again."""

    def __init__(self, folder: str, settle: float) -> None:
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        files, root = opened(self.folder)
        last, until = (0, ""), (time.time() - self.settle) * 1e9
        for a in below(files, root, [root]):
            if a.changed <= until:
                last = max(last, (a.changed, a.path))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        parts = planned(self.folder, lambda a: low < (a.changed, a.path) <= high)
        return [Since(p, low, high) for p in parts]

    def read(self, partition: Since) -> Iterator[pa.RecordBatch]:
        return read_files(self.folder, partition.part, lambda a: partition.low < (a.changed, a.path) <= partition.high)


@dataclass
class Staged(WriterCommitMessage):
    """The folder of one task's attempt, below which its files lie as they belong below the root; a message has one size however many there are."""

    attempt: str


def moved(files: fs.FileSystem, source: str, to: str) -> None:
    """Moves what is below ``source`` to below ``to``, which is there; on a local disk a folder that is new there at once."""
    for info in files.get_file_info(fs.FileSelector(source)):
        at = f"{to}/{info.base_name}"
        if info.type != fs.FileType.Directory:
            files.move(info.path, at)
        elif isinstance(files, fs.LocalFileSystem) and files.get_file_info(at).type == fs.FileType.NotFound:
            files.move(info.path, at)
        else:
            files.create_dir(at, recursive=True)
            moved(files, info.path, at)


class Writer(DataSourceWriter):
    """Writes a file a row (path below the folder, text). Nothing is in its place before all tasks have succeeded.

    Of rows of one path in a task the last is kept. ``save`` gives the tasks few files each.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Staged:
        files, root = opened(self.folder)
        attempt = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(attempt, recursive=True)
        parent = ""
        for row in rows:
            if not row["path"] or row["path"].startswith("/") or ".." in row["path"].split("/"):
                raise ValueError(f"not a path below the folder: {row['path']}")
            above = row["path"].rpartition("/")[0]
            if above != parent:
                files.create_dir(f"{attempt}/{above}", recursive=True)
                parent = above
            with files.open_output_stream(f"{attempt}/{row['path']}") as out:
                out.write((row["text"] or "").encode("utf-8"))
        return Staged(attempt)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.folder)
        for message in messages:
            if message:
                moved(files, message.attempt, root)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Takes away what the job's attempts have staged, whether they have told of it or not."""
        files, root = opened(self.folder)
        at = f"{root}/{STAGING}/{self.job}"
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class Artifacts(DataSource):
    """Options: path, the folder; names, a pattern (of a shell) of the file names that are read; settleSeconds of a stream."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("names"))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], float(self.options.get("settleSeconds", SETTLE_SECONDS)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("artifacts are added or replaced one by one; use mode append")
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Enters the sources and lets Spark push filters into them."""
    from .publication import Publication
    from .tail import Tail

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Artifacts, Publication, Tail):
        spark.dataSource.register(source)


def artifacts(spark: SparkSession, folder: str, names: str | None = None) -> DataFrame:
    """path, kind, run_id, size, text, problem of a folder's files; names decide the kinds. ``names``: a pattern of those that are read."""
    register(spark)
    source = spark.read.format("artifacts")
    return (source.option("names", names) if names else source).load(folder)


def save(files: DataFrame, folder: str, n: int | None = None) -> None:
    """Writes rows (path, text; about ``n``, else they are counted) as files, in tasks of PART_FILES and WRITE_BYTES each: a small table of many files isn't one task, nor are few large files.

    Where the folders at the top are small enough, each is written by one task, so it is
    moved to its place at once; else its files are dealt out.
    """
    register(files.sparkSession)
    top = F.regexp_extract("path", "^[^/]*", 0)
    each = files.groupBy(top).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
    known = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("n").alias("most"), F.max("size").alias("largest")).first()
    tasks = max(1, -(-(known["n"] if n is None else n) // PART_FILES), -(-known["size"] // WRITE_BYTES))
    whole = known["n"] and known["most"] <= PART_FILES and known["largest"] <= WRITE_BYTES
    files.select("path", "text").repartition(tasks, top if whole else F.col("path")).write.format("artifacts").mode("append").save(folder)
