"""The ends of text files as a Spark data source: spark.read.format("tail").option("lines", "40").load(path)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, line_no int, line string"
BLOCK = 64 << 10
WHITE = b" \t\r\n\x0b\x0c"


@dataclass
class File(InputPartition):
    path: str


def last_lines(stream, size: int, lines: int, block: int = BLOCK) -> list[str]:
    """The last lines of a file of ``size`` bytes, read backwards; what is held is these lines and a block."""
    at, held = size, 0
    parts: list[bytes] = []
    while at > 0 and held <= lines - 1:
        step = min(block, at)
        at -= step
        stream.seek(at)
        piece = stream.read(step)
        if not parts:
            piece = piece.rstrip(WHITE)  # blanks may go over several blocks
            if not piece:
                continue
        held += piece.count(b"\n")
        parts.append(piece)
    text = b"".join(reversed(parts)).decode("utf-8", "replace")
    return [line.removesuffix("\r") for line in text.split("\n")][-lines:] if text else []


class Reader(DataSourceReader):
    def __init__(self, path: str, lines: int) -> None:
        self.path, self.lines = path, lines

    def partitions(self) -> list[File]:
        """A file is a task; of a folder, all files in it."""
        from .datasource import opened

        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            return [File(root)]
        return [File(i.path) for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        from .datasource import opened

        if not partition.path:
            return
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as stream:
            for n, line in enumerate(last_lines(stream, stream.size(), self.lines)):
                yield partition.path, n, line


class Tail(DataSource):
    """Options: path, a file or a folder; lines, 40 by default."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("lines", "40")))
