"""Line deduplication that deletions undo: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at both ends, A-Z taken as a-z; it is carried
as a digest of 128 bits. A *store* in the shared folder knows, of the documents it was
given, how many hold each key (the reference counts), which keys each document holds (so
that a document can be taken back by its id alone), and, of each shard of the keys, a
cuckoo filter of those that at least ``least`` documents hold. An update merges its counts
into the table; keys that come to the limit enter their shard's filter, keys that fall
below it leave it, and a filter that would get too full is built anew from the counts.

To drop lines, the filters go to all tasks, and a line whose fingerprint none holds stays
without a look-up. The few keys below the limit that a filter takes for others are found
by one pass over the counts and sent along, so the outcome is exact. Filters larger than
``FILTER_BYTES`` in sum are not sent: then the keys of each text are joined with the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .shared import column, saved, shared_folder, whole_row

LEAST = 10
SHARDS = 256
#: The filters of all shards together are sent to the tasks up to this size, and so many falsely held keys.
FILTER_BYTES = 32 << 20
FALSE_KEYS = 1 << 16
#: Texts are worked on in runs of rows of so many bytes.
SLICE_BYTES = 2 << 20
SLOTS = 4
KICKS = 400
WHITE = b" \t\n\x0b\x0c\r"
WORD = np.dtype("<u4")


def digests(text: bytes) -> list[bytes]:
    """The digest of each line's key; that of an empty key is b""."""
    return [xxhash.xxh3_128_digest(key) if key else b"" for key in (line.strip(WHITE).lower() for line in text.split(b"\n"))]


def parts(keys: list[bytes], shards: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first bucket (before the mask) and fingerprint, of ``bits`` bits and never 0, of each digest."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    shard = (raw[:, 0].astype(np.int64) * 256 + raw[:, 1]) % shards
    words = raw.view(WORD)
    return shard, words[:, 1].astype(np.int64), np.maximum(words[:, 2] >> np.uint32(32 - bits), 1).astype(np.int64)


def other(bucket, mark, mask):
    """The second bucket of a fingerprint, from which the first is found the same way; of integers or arrays of them."""
    spread = (mark * 0x9E3779B1) & 0xFFFFFFFF
    return bucket ^ ((spread ^ (spread >> 15)) & mask)


class Cuckoo:
    """A cuckoo filter of fingerprints of up to 32 bits, four slots a bucket; what finds no place lies in a short list beside it."""

    def __init__(self, table: np.ndarray, spare: Iterable[int] = ()) -> None:
        self.table, self.spare = table, list(spare)
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """For so many keys at half of its slots."""
        buckets = 1 << max(1, (2 * keys // SLOTS).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    def add(self, bucket: int, mark: int) -> None:
        at = bucket & self.mask
        for kick in range(KICKS):
            row = self.table[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return
            if kick:  # both buckets are full: the fingerprint takes a place, whose owner moves to its own other bucket
                row[kick % SLOTS], mark = mark, int(row[kick % SLOTS])
            at = other(at, mark, self.mask)
        self.spare.append(mark)

    def remove(self, bucket: int, mark: int) -> None:
        """Takes out one such fingerprint, which must have been added."""
        at = bucket & self.mask
        for place in (at, other(at, mark, self.mask)):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place][held[0]] = 0
                return
        self.spare.remove(mark)


class Filters:
    """The filters of all shards in one array, asked for many keys at once."""

    def __init__(self, shards: int, bits: int, rows: list[tuple[int, bytes, list[int]]], false: list[bytes]) -> None:
        tables = {shard: np.frombuffer(table, WORD).reshape(-1, SLOTS) for shard, table, _ in rows}
        self.shards, self.bits, self.false = shards, bits, set(false)
        self.mask, self.first = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        at = 1
        for shard, table in tables.items():
            self.mask[shard], self.first[shard] = len(table) - 1, at
            at += len(table)
        self.table = np.concatenate([np.zeros((1, SLOTS), np.uint32), *tables.values()])
        self.spare = np.array([(shard << 32) | mark for shard, _, spare in rows for mark in spare], np.int64)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        shard, bucket, mark = parts(keys, self.shards, self.bits)
        mask, first = self.mask[shard], self.first[shard]
        bucket = bucket & mask
        held = (self.table[first + bucket] == mark[:, None]).any(1) | (self.table[first + other(bucket, mark, mask)] == mark[:, None]).any(1)
        held &= first > 0
        return held | np.isin((shard << 32) | mark, self.spare) if len(self.spare) else held

    def hold(self, keys: list[bytes]) -> list[bool]:
        """Exactly: without the keys that are known to be taken for others."""
        return [held and key not in self.false for held, key in zip(self.may_hold(keys).tolist(), keys, strict=True)]


def slices(batches: Iterable[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of some SLICE_BYTES of text, one row at least, with their texts in UTF-8."""
    for batch in batches:
        values = text(batch).cast(pa.binary())
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(values), 0)), dtype=np.int64)
        at = 0
        while at < len(values):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at), [x or b"" for x in values.slice(at, end - at).to_pylist()]
            at = end


def own_text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text")


def row_text(batch: pa.RecordBatch) -> pa.Array:
    return pc.struct_field(batch.column("row"), "text")


def keys_of(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and keys: the distinct digests of the lines of each row's ``text``."""
    out = StructType([*[docs.schema[c] for c in names], StructField("keys", ArrayType(BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, own_text):
            keys = pa.array([sorted(set(digests(text)) - {b""}) for text in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], keys], [*names, "keys"])

    return docs.mapInArrow(run, out)


def without(text: bytes, gone: list[bool]) -> bytes:
    return b"\n".join(line for line, drop in zip(text.split(b"\n"), gone, strict=True) if not drop)


@dataclass(frozen=True)
class LineStore:
    """One state of a store; ``insert`` and ``delete`` give the next and leave this one as it is.

    A document is a row: a key counts once for each row that has it. ``delete`` takes back
    all rows of the ids given that were inserted before it; ids it doesn't know change
    nothing, and a document may be inserted again. Null is an id like any other. An update
    reads the counts (some 30 bytes a distinct line) and no text; the driver sees the sizes
    of the shards alone.
    """

    spark: SparkSession
    folder: str
    least: int = LEAST
    shards: int = SHARDS
    bits: int = 32
    version: int = 0

    @classmethod
    def create(cls, spark: SparkSession, least: int = LEAST, shards: int = SHARDS, bits: int = 32) -> LineStore:
        """An empty store in a new shared folder; ``shards``: at most 65,536, each one task's work in an update; ``bits``: of a fingerprint, at most 32."""
        return cls(spark, shared_folder(spark, "lines"), least, shards, bits)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineStore:
        """The last whole state in a folder."""
        row = spark.read.parquet(f"{folder}/states").orderBy(F.col("version").desc()).first()
        return cls(spark, folder, row["least"], row["shards"], row["bits"], row["version"])

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}-{self.version}")

    def counts(self) -> DataFrame:
        """key, n: by how many documents each key is held."""
        return self._table("counts", "key binary, n long, was long, shard int").where("n > 0").select("key", "n", "shard")

    def filters(self) -> DataFrame:
        return self._table("filters", "shard int, buckets long, table binary, spare array<long>")

    def _members(self, kind: str) -> DataFrame:
        """doc_id, keys, at: every row that was inserted, with the state it made."""
        schema = f"doc_id {kind}, keys array<binary>, at int"
        paths = [f"{self.folder}/members-{v}" for v in range(1, self.version + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, kind: str) -> DataFrame:
        schema = f"doc_id {kind}, at int"
        paths = [f"{self.folder}/gone-{v}" for v in range(1, self.version + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, docs: DataFrame) -> LineStore:
        """The state with the rows of ``docs`` (doc_id, text; null texts are one empty line, others are not read)."""
        at = self.version + 1
        rows = keys_of(docs.select("doc_id", "text"), ["doc_id"])
        rows = saved(rows.withColumn("at", F.lit(at)), f"{self.folder}/members-{at}")
        saved(docs.select("doc_id", F.lit(at).alias("at")).limit(0), f"{self.folder}/gone-{at}")
        return self._updated(rows.select(F.explode("keys").alias("key"), F.lit(1).alias("n")))

    def delete(self, ids: DataFrame) -> LineStore:
        """The state without the rows whose doc_id is among those of ``ids``."""
        at, kind = self.version + 1, ids.schema["doc_id"].dataType.simpleString()
        ids = saved(ids.select("doc_id").distinct().withColumn("at", F.lit(at)), f"{self.folder}/gone-{at}")
        members = self._members(kind)
        saved(members.limit(0), f"{self.folder}/members-{at}")
        before = self._gone(kind).groupBy(F.col("doc_id").alias("d")).agg(F.max("at").alias("last"))
        asked = members.join(ids.select(F.col("doc_id").alias("i")), F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
        alive = asked.join(before, F.col("doc_id").eqNullSafe(F.col("d")), "left").where(F.col("last").isNull() | (F.col("at") > F.col("last")))
        return self._updated(alive.select(F.explode("keys").alias("key"), F.lit(-1).alias("n")))

    def _updated(self, change: DataFrame) -> LineStore:
        at, n = self.version + 1, F.col("n").cast("long")
        both = self.counts().select("key", n.alias("n"), n.alias("was")).unionByName(change.select("key", n.alias("n"), F.lit(0).cast("long").alias("was")))
        shard = F.expr(f"cast(conv(hex(substring(key, 1, 2)), 16, 10) as int) % {self.shards}")
        merged = both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("was").alias("was")).withColumn("shard", shard)
        counts = saved(merged.where("n > 0 or was > 0"), f"{self.folder}/counts-{at}")
        self._filtered(counts, f"{self.folder}/filters-{at}")
        done = self.spark.createDataFrame([(at, self.least, self.shards, self.bits)], "version int, least int, shards int, bits int")
        done.coalesce(1).write.mode("append").parquet(f"{self.folder}/states")
        return replace(self, version=at)

    def _filtered(self, counts: DataFrame, path: str) -> DataFrame:
        """The next filters: crossings into and out of the old ones, or, where one would pass nine tenths of its slots, all keys into a new one."""
        held, was = F.col("n") >= self.least, F.col("was") >= self.least
        old = self.filters()
        sizes = counts.where(held).groupBy("shard").agg(F.count("*").alias("keys"))
        anew = sizes.join(old.select("shard", "buckets"), "shard", "left").where(F.coalesce(F.col("keys") > 0.9 * SLOTS * F.col("buckets"), F.lit(True))).select("shard", F.lit(True).alias("anew"))
        marked = counts.where(held | was).join(anew, "shard", "left")
        change = marked.where(F.when(F.col("anew"), held).otherwise(held != was)).select("shard", "key", held.alias("held"))
        shards, bits = self.shards, self.bits

        def run(change: pa.Table, old: pa.Table) -> pa.Table:
            keys, into = change.column("key").to_pylist(), change.column("held").to_pylist()
            if old.num_rows:
                row = old.to_pylist()[0]
                own = Cuckoo(np.frombuffer(row["table"], WORD).reshape(-1, SLOTS).astype(np.uint32), row["spare"])
            else:
                own = Cuckoo.sized(len(keys))
            shard = (change if keys else old).column("shard")[0].as_py()
            _, buckets, marks = parts(keys, shards, bits)
            steps = sorted(zip(into, buckets.tolist(), marks.tolist(), strict=True))  # out before in
            for inside, bucket, mark in steps:
                (own.add if inside else own.remove)(bucket, mark)
            row = {"shard": shard, "buckets": len(own.table), "table": own.table.astype(WORD).tobytes(), "spare": own.spare}
            return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("table", pa.binary()), ("spare", pa.list_(pa.int64()))]))

        stay = old.join(anew, "shard", "left_anti")
        made = change.groupBy("shard").cogroup(stay.groupBy("shard")).applyInArrow(run, "shard int, buckets long, table binary, spare array<long>")
        return saved(made, path)

    def _sent(self) -> Filters | None:
        """The filters with the keys they hold falsely, if both keep within their bounds."""
        size = self.filters().agg(F.coalesce(F.sum(F.length("table") + 8 * F.size("spare")), F.lit(0))).first()[0]
        if size > FILTER_BYTES:
            return None
        rows = [(r["shard"], bytes(r["table"]), r["spare"]) for r in self.filters().toLocalIterator()]
        sent = self.spark.sparkContext.broadcast(Filters(self.shards, self.bits, rows, []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.may_hold(batch.column("key").to_pylist())))

        below = self.counts().where(F.col("n") < self.least).select("key")
        false = below.mapInArrow(run, "key binary").limit(FALSE_KEYS + 1).toArrow().column("key").to_pylist()
        return Filters(self.shards, self.bits, rows, false) if len(false) <= FALSE_KEYS else None

    def apply(self, docs: DataFrame) -> DataFrame:
        """row (all columns of ``docs`` as a struct), n_lines, n_dropped and kept, the text without its dropped lines.

        Every row of ``docs`` must be in the store. All lines of a key held by ``least``
        documents go, wherever they stand; lines of white space alone stay. A null text is
        an empty one, which is one empty line.
        """
        rows = docs.select(whole_row(docs))
        out = StructType([rows.schema["row"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType())])
        filters = self._sent()
        if filters is None:
            return self._joined(rows, out)
        sent = self.spark.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, row_text):
                keys = [digests(text) for text in texts]
                held = iter(sent.value.hold([k for own in keys for k in own if k]))
                gone = [[bool(k) and next(held) for k in own] for own in keys]
                yield finished(batch, [(len(own), sum(own), without(text, own)) for text, own in zip(texts, gone, strict=True)])

        return self._as_text(rows.mapInArrow(run, out))

    def _joined(self, rows: DataFrame, out: StructType) -> DataFrame:
        """The same by a join of each distinct text's keys with the counts."""
        text = F.col("row")["text"]
        rows = rows.withColumn("_id", F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))
        held = self.counts().where(F.col("n") >= self.least).select("key")
        keys = keys_of(rows.select("_id", text.alias("text")), ["_id"]).select("_id", F.explode("keys").alias("key")).distinct()
        gone = keys.join(held, "key").groupBy("_id").agg(F.collect_list("key").alias("_gone"))  # at most a text's lines

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, row_text):
                made = []
                for text, drop in zip(texts, batch.column("_gone").to_pylist(), strict=True):
                    keys, drop = digests(text), set(drop or ())
                    made.append((len(keys), sum(k in drop for k in keys), without(text, [k in drop for k in keys])))
                yield finished(batch, made)

        return self._as_text(rows.join(gone, "_id", "left").select("row", "_gone").mapInArrow(run, out))

    @staticmethod
    def _as_text(made: DataFrame) -> DataFrame:
        return made.withColumn("kept", F.col("kept").cast("string"))


def finished(batch: pa.RecordBatch, made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    lines, dropped, kept = zip(*made, strict=True) if made else ((), (), ())
    columns = [batch.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["row", "n_lines", "n_dropped", "kept"])


def drop_common_lines(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """``apply`` of a new store that holds just ``docs``: lines that ``least`` of its rows have go from all.

    Columns may have any names and nulls; repeated rows are documents of their own; very
    long texts and lines are read whole, in their task; an empty table gives no rows.
    """
    only = docs.select(column("doc_id").alias("doc_id"), column("text").alias("text"))
    return LineStore.create(docs.sparkSession, least, shards).insert(only).apply(docs)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of ``docs``."""
    cut = drop_common_lines(docs.select("doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
