"""Publishing all or nothing: spark.write.format("publication") adds a batch of rows to a folder in one step.

Tasks write their rows to files of their own, one a attempt. When all have succeeded the
driver writes a manifest that names the files of the attempts that did, and moves it into
its place: that one move is the commit. Readers read what manifests name, so files of
failed or repeated attempts, or of a job that broke off, are never seen. A batch has an
identity; a batch that is committed already is not committed again, so a repeated run adds
nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.cases import not_published, to_publish

SCHEMA = "local_case_id string, publication_id string, batch string, document string"
MANIFESTS, DATA = "_manifests", "data"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    from .datasource import opened

    return opened(folder)


def manifests(folder: str) -> list[dict]:
    files, root = opened(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    own = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                own.append(json.loads(stream.read()))
    return own


@dataclass
class File(InputPartition):
    path: str
    batch: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[File]:
        return [File(path, m["batch"]) for m in manifests(self.folder) for path in m["files"]] or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        files, root = opened(self.folder)
        with files.open_input_stream(f"{root}/{partition.path}") as stream:
            for line in stream.read().decode("utf-8").splitlines():
                row = json.loads(line)
                yield row["local_case_id"], row["publication_id"], partition.batch, row["document"]


class Writer(DataSourceWriter):
    """rows: local_case_id, publication_id, document (JSON text); others are left out."""

    def __init__(self, folder: str, batch: str) -> None:
        self.folder, self.batch = folder, batch

    def write(self, rows: Iterator) -> Written:
        files, root = opened(self.folder)
        path, n = f"{DATA}/{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{root}/{DATA}", recursive=True)
        with files.open_output_stream(f"{root}/{path}") as out:
            for row in rows:
                line = {"local_case_id": row["local_case_id"], "publication_id": row["publication_id"], "document": row["document"]}
                out.write(json.dumps(line, ensure_ascii=True).encode() + b"\n")
                n += 1
        return Written(path, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        if any(m["batch"] == self.batch for m in manifests(self.folder)):
            self.abort(messages)
            return
        own = [m for m in messages if m and m.rows]
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        draft = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": self.batch, "rows": sum(m.rows for m in own), "files": [m.path for m in own]}).encode())
        files.move(draft, f"{root}/{MANIFESTS}/{self.batch}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Files no manifest names are never read; those of attempts that told of theirs are taken away."""
        files, root = opened(self.folder)
        for m in messages:
            if m and files.get_file_info(f"{root}/{m.path}").type == fs.FileType.File:
                files.delete_file(f"{root}/{m.path}")


class Publication(DataSource):
    """Options: path, the folder; batch, the identity of what is written."""

    @classmethod
    def name(cls) -> str:
        return "publication"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite or "batch" not in self.options:
            raise ValueError("a publication is appended to, by a batch that has an identity")
        return Writer(self.options["path"], self.options["batch"])


def publish_batch(cases: DataFrame, folder: str) -> DataFrame:
    """Publishes the approved cases that the folder doesn't show yet, and returns those it doesn't show then: none.

    The batch is named after the cases in it, so the same cases make the same batch.
    """
    from .datasource import register

    spark = cases.sparkSession
    register(spark)
    shown = lambda: spark.read.format("publication").load(folder)
    waiting = to_publish(cases)
    new = not_published(waiting, shown())
    document = F.to_json(F.struct(*[F.col(c) for c in new.columns]))
    rows = new.select(F.col("case_id").cast("string").alias("local_case_id"), F.concat(F.lit("pub-"), F.substring(F.sha2(F.col("case_id").cast("string"), 256), 1, 16)).alias("publication_id"), document.alias("document"))
    sums = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("local_case_id", "document")).alias("x"), F.sum(F.shiftright(F.xxhash64("document", "local_case_id"), 24)).alias("s")).first()
    if sums["n"]:
        rows.write.format("publication").mode("append").option("batch", f"{sums['n']}-{sums['x'] & (2**64 - 1):016x}-{sums['s'] & (2**64 - 1):016x}").save(folder)
    return not_published(waiting, shown())
