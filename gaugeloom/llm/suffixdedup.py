"""Removes every byte covered by a long string that also starts earlier in the corpus.

The suffixes of all texts are sorted to a depth of LENGTH bytes, blockwise and with a
difference cover: residues D modulo V such that any two positions, moved on by the same
amount less than V, both fall on cover positions. Two equal strings of LENGTH bytes so
hold a common pair of cover positions whose next CORE = LENGTH - V + 1 bytes are equal.

1. The cover sample is ranked first. Its suffixes are sorted by their cores, one bucket of
   suffixes a task and one block of buckets after another; those of a core by their whole
   *context*, the bytes that any string of LENGTH bytes through them can reach. The rank
   of a sample suffix among equal contexts settles long ties: if it isn't the first, all
   strings through it have occurred earlier and are never compared themselves.
2. Of the other suffixes only those are sorted, in buckets again, whose sample has equal
   cores in different contexts, that is near the ends of repeats: by their first eight
   bytes, then by a fingerprint of LENGTH bytes.

Cores, contexts and strings are 48 and 64 bits of polynomial hashes modulo 2**64, so order
within a core is that of fingerprints, not of the alphabet: equal suffixes are neighbours
all the same, and buckets are even whatever the language. Results are exact as far as no
two different strings share the hashes of core and context, or the first eight bytes and
the hash of the whole.

Texts lie in *slabs* in corpus order. A slab sends a bucket the keys of its suffixes in
order, and gets a mark for each, in the same order; it can compute anew which these were,
so no positions travel. Of equal keys a slab sends the first alone, and a core with many
contexts in a slab is dealt by context, so a string that most texts hold sends a few keys
a slab.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import textbytes as tb
from .shared import dropped, saved, shared_folder, short_shuffles

LENGTH = 100
#: A perfect difference set: each number from 1 to 56 is the difference of one pair modulo 57.
V, D = 57, (0, 1, 3, 13, 32, 36, 43, 52)
CORE = LENGTH - V + 1

#: Contexts of a core in a slab beyond which it is dealt by context.
SPREAD_FROM = 4
#: Kinds of sample keys: to be ranked; of a core with many contexts, dealt by context; such a core's witness at its own bucket.
RANK, SPREAD, WITNESS = 0, 1, 2
#: Marks: nothing equal is earlier and the core has this context alone; an equal context or string is earlier; none is, but the core has other contexts.
ALONE, LATER, MIXED = 0, 1, 2


def slab_table(texts: DataFrame) -> DataFrame:
    """slab, ids, keys, sizes, buf: the texts (doc_id, tkey, text) in corpus order, about 2 MB a row; slab ascends in that order."""
    kind = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in tb.slabs(batch.column("text")):
                n = len(s.starts)
                listed = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)  # noqa: B023, E731
                own = [listed(batch.column(c).slice(s.first, n)) for c in ("doc_id", "tkey")]
                sizes = listed(pa.array((s.ends - s.starts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([slab]), *own, sizes, pa.array([s.buf.tobytes()], pa.binary())], ["slab", "ids", "keys", "sizes", "buf"])
                slab += 1

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("tkey")]
    once = texts.dropDuplicates(["doc_id", "tkey"]).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [("slab", LongType()), ("ids", ArrayType(kind)), ("keys", ArrayType(LongType())), ("sizes", ArrayType(IntegerType())), ("buf", BinaryType())]
    return once.select("doc_id", "tkey", "text").mapInArrow(run, StructType([StructField(k, t) for k, t in fields]))


def slabs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tb.Slab]]:
    """The row and the texts of each slab of a batch."""
    for i in range(batch.num_rows):
        ends = np.cumsum(np.asarray(batch.column("sizes")[i].values), dtype=np.int64)
        buf = np.frombuffer(batch.column("buf")[i].as_buffer(), np.uint8)
        yield i, tb.Slab(0, buf, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def anchor_places(slab: tb.Slab) -> tuple[np.ndarray, np.ndarray]:
    """(row, local place) of the cover positions with a whole core, in texts of LENGTH bytes or more."""
    size = slab.ends - slab.starts
    longest = int(size.max()) if len(size) else 0
    if longest < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cover = np.add.outer(np.arange(0, longest, V), np.array(D)).ravel()
    count = np.where(size >= LENGTH, np.searchsorted(cover, size - CORE, "right"), 0)
    row = np.repeat(np.arange(len(size)), count)
    return row, cover[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


class Dealing:
    """Entries of a slab dealt to buckets: those of a bucket in corpus order."""

    def __init__(self, entries: np.ndarray, bucket: np.ndarray) -> None:
        by = np.argsort(bucket, kind="stable")
        self.entries, bucket = entries[by], bucket[by]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        self.cuts, self.buckets = np.append(edge, len(bucket)), bucket[edge].astype(np.int64)

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        for b, a, z in zip(self.buckets.tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield b, self.entries[a:z]

    def marks(self, answers: list[dict], size: int) -> np.ndarray:
        """The mark of each entry, from answers (bucket, marks) of the buckets; entries without an answer have none."""
        out = np.zeros(size, np.uint8)
        place = dict(zip(self.buckets.tolist(), range(len(self.buckets)), strict=True))
        for x in answers:
            i = place[x["bucket"]]
            out[self.entries[self.cuts[i] : self.cuts[i + 1]]] = np.frombuffer(x["marks"], np.uint8)
        return out


class Sample:
    """The cover sample of a slab: its keys, which of them equal an earlier one of the slab, and how the others are dealt."""

    def __init__(self, slab: tb.Slab, buckets: int) -> None:
        self.slab, self.sums = slab, tb.prefix(tb.byte_codes(slab.buf))
        self.row, self.place = anchor_places(slab)
        here = slab.starts[self.row] + self.place
        left, right = np.minimum(self.place, V - 1), np.minimum(slab.ends[self.row] - here, LENGTH)
        self.core = tb.mix(tb.span(self.sums, here, here + CORE), 1) & np.uint64(0xFFFFFFFFFFFF0000)
        self.context = tb.mix(tb.span(self.sums, here - left, here + right) + (left * 1024 + right).astype(np.uint64), 2)
        both = tb.mix(self.core ^ tb.mix(self.context, 5), 6)
        first = firsts(both)
        self.later = ~first
        lead = np.flatnonzero(first)
        by = lead[np.argsort(self.core[lead], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], self.core[by][1:] != self.core[by][:-1]])) if len(by) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(by)))
        self.kind = np.full(len(self.core), RANK, np.uint8)
        self.kind[by[np.repeat(size > SPREAD_FROM, size)]] = SPREAD
        self.witness = by[edge[size > SPREAD_FROM]]
        at = np.where(self.kind == SPREAD, both, tb.mix(self.core, 7)) % np.uint64(buckets)
        self.dealt = Dealing(lead, at[lead])
        self.witnessed = Dealing(self.witness, tb.mix(self.core[self.witness], 7) % np.uint64(buckets))

    def starts_through(self, anchors: np.ndarray) -> np.ndarray:
        """Which positions begin a string of LENGTH bytes of one text through one of the anchors (a mask of them)."""
        row, place, n = self.row[anchors], self.place[anchors], len(self.slab.buf)
        begin = self.slab.starts[row]
        low = begin + np.maximum(place - (V - 1), 0)
        high = begin + np.minimum(place, self.slab.ends[row] - begin - LENGTH) + 1
        return np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n] > 0


def packed(values: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, 8 - width :] = data
    return out.reshape(-1).view("<u8").astype(np.uint64)


def sample_keys(slabs: DataFrame, block: int, blocks: int, buckets: int) -> DataFrame:
    """bucket, slab, cores, contexts, kinds: the sample keys of each slab for the buckets of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, slab in slabs_of(batch):
                s = Sample(slab, buckets)
                rows = []
                told = dict(s.witnessed.slices())
                sent = dict(s.dealt.slices())
                for b in sorted({*sent, *told}):
                    if b % blocks == block:
                        own, more = sent.get(b, np.zeros(0, np.int64)), told.get(b, np.zeros(0, np.int64))
                        both = np.concatenate([own, more])
                        kinds = np.concatenate([s.kind[own], np.full(len(more), WITNESS, np.uint8)])
                        rows.append((b, packed(s.core[both], 6), packed(s.context[both], 8), kinds.tobytes()))
                b, cores, contexts, kinds = zip(*rows, strict=True) if rows else ((), (), (), ())
                slab_id = [batch.column("slab")[i].as_py()] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(slab_id, pa.int64()), *[pa.array(x, pa.binary()) for x in (cores, contexts, kinds)]], ["bucket", "slab", "cores", "contexts", "kinds"])

    return slabs.mapInArrow(run, "bucket long, slab long, cores binary, contexts binary, kinds binary")


_ANSWER = "slab long, bucket long, marks binary"


def answers_of(table: pa.Table, sizes: np.ndarray, marks: np.ndarray) -> pa.Table:
    """slab, bucket, marks of the rows of a bucket that have any mark; sizes: entries a row."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [marks[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    some = [i for i, m in enumerate(parts) if m.any()]
    own = table.select(["slab", "bucket"]).take(pa.array(some, pa.int64()))
    return own.append_column("marks", pa.array([parts[i].tobytes() for i in some], pa.binary()))


def rank_sample(table: pa.Table) -> pa.Table:
    """Sorts a bucket of the sample by core and context and marks each key."""
    table = table.sort_by("slab")
    core, context = unpacked(table["cores"].to_pylist(), 6), unpacked(table["contexts"].to_pylist(), 8)
    kinds = [np.frombuffer(k, np.uint8) for k in table["kinds"].to_pylist()]
    kind = np.concatenate(kinds)
    marks = np.zeros(len(kind), np.uint8)
    # most cores occur once: only the others are sorted by both keys
    some = np.sort(core)
    twice = np.unique(some[1:][some[1:] == some[:-1]])
    at = np.minimum(np.searchsorted(twice, core), max(len(twice) - 1, 0))
    again = (twice[at] == core) if len(twice) else np.zeros(len(core), bool)
    live = np.flatnonzero(again | (kind == SPREAD))
    if len(live):
        o = live[np.lexsort((live, kind[live] == WITNESS, context[live], core[live]))]
        new_core = np.concatenate([[True], core[o][1:] != core[o][:-1]])
        new = new_core | np.concatenate([[True], context[o][1:] != context[o][:-1]])
        group = np.cumsum(new_core) - 1
        mixed = (np.bincount(group, new) > 1) | (np.bincount(group, kind[o] != RANK) > 0)
        marks[o] = np.where(~new, LATER, np.where(mixed[group], MIXED, ALONE))
    real = kind != WITNESS
    return answers_of(table, np.array([(k != WITNESS).sum() for k in kinds]), marks[real])


class Open:
    """The strings of a slab that the sample leaves open, and what it settles."""

    def __init__(self, sample: Sample, answers: list[dict], buckets: int) -> None:
        marks = sample.dealt.marks(answers, len(sample.core))
        self.again = sample.starts_through(sample.later | (marks == LATER))
        at = np.flatnonzero(sample.starts_through(marks == MIXED) & ~self.again)
        self.whole = tb.mix(tb.span(sample.sums, at, at + LENGTH), 3)
        first = firsts(self.whole)
        self.again[at[~first]] = True
        self.at, self.whole = at[first], self.whole[first]
        self.dealt = Dealing(np.arange(len(self.at)), tb.mix(self.whole, 9) % np.uint64(buckets))

    def begins(self, buf: np.ndarray) -> np.ndarray:
        """The first eight bytes of each string, as a number in the order of the bytes."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)[self.at]).view(">u8").ravel().astype(np.uint64)


def told(batch: pa.RecordBatch, i: int, name: str) -> list[dict]:
    return batch.column(name)[i].as_py() or []


def open_keys(joined: DataFrame, buckets: int, open_buckets: int) -> DataFrame:
    """bucket, slab, begins, wholes: the keys of the open strings of each slab (with its answers ``sample``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, slab in slabs_of(batch):
                rest = Open(Sample(slab, buckets), told(batch, i, "sample"), open_buckets)
                if len(rest.at):
                    begins = rest.begins(slab.buf)
                    rows = [(b, packed(begins[own], 8), packed(rest.whole[own], 8)) for b, own in rest.dealt.slices()]
                    b, first, whole = zip(*rows, strict=True)
                    slab_id = pa.array([batch.column("slab")[i].as_py()] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), slab_id, pa.array(first, pa.binary()), pa.array(whole, pa.binary())], ["bucket", "slab", "begins", "wholes"])

    return joined.mapInArrow(run, "bucket long, slab long, begins binary, wholes binary")


def rank_open(table: pa.Table) -> pa.Table:
    """Sorts a bucket of open strings and marks those that are not the first of their kind."""
    table = table.sort_by("slab")
    wholes = table["wholes"].to_pylist()
    begin, whole = unpacked(table["begins"].to_pylist(), 8), unpacked(wholes, 8)
    o = np.lexsort((np.arange(len(whole)), whole, begin))
    marks = np.zeros(len(o), np.uint8)
    marks[o[1:][(begin[o][1:] == begin[o][:-1]) & (whole[o][1:] == whole[o][:-1])]] = LATER
    return answers_of(table, np.array([len(w) // 8 for w in wholes]), marks)


def cut_texts(joined: DataFrame, buckets: int, open_buckets: int) -> DataFrame:
    """doc_id, tkey, n_removed, n_spans, kept_sha256 of each text that loses something; joined: slabs with the answers ``sample`` and ``open``."""
    kind = joined.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, slab in slabs_of(batch):
                rest = Open(Sample(slab, buckets), told(batch, i, "sample"), open_buckets)
                again = rest.again
                again[rest.at[rest.dealt.marks(told(batch, i, "open"), len(rest.at)) == LATER]] = True
                begins, n = np.flatnonzero(again), len(slab.buf)
                gone = np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(begins + LENGTH, minlength=n + 1))[:n] > 0
                opens = gone & ~np.concatenate([[False], gone[:-1]])
                opens[slab.starts[slab.starts < n]] = gone[slab.starts[slab.starts < n]]
                total, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
                removed, spans = total[slab.ends] - total[slab.starts], runs[slab.ends] - runs[slab.starts]
                some = np.flatnonzero(removed)
                digests = [hashlib.sha256(slab.buf[a:z][~gone[a:z]].tobytes()).hexdigest() for a, z in zip(slab.starts[some].tolist(), slab.ends[some].tolist(), strict=True)]
                own = [batch.column(c)[i].values.take(pa.array(some)) for c in ("ids", "keys")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(removed[some]), pa.array(spans[some]), pa.array(digests, pa.string())], ["doc_id", "tkey", "n_removed", "n_spans", "kept_sha256"])

    fields = [("doc_id", kind), ("tkey", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType())]
    return joined.mapInArrow(run, StructType([StructField(k, t) for k, t in fields]))


def by_slab(answers: DataFrame, name: str) -> DataFrame:
    """One row a slab: at most an answer a bucket."""
    return answers.groupBy("slab").agg(F.collect_list(F.struct("bucket", "marks")).alias(name))


def remove_repeats(docs: DataFrame, blocks: int = 2, bucket_entries: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null text is empty. Texts under LENGTH bytes lose nothing. Earlier: smaller doc_id,
    then earlier start; null doc_ids come last. Rows that share a doc_id but not the text
    are ordered by a hash of the text; rows repeated whole are one text, with one result.
    Texts are read whole: a task holds a slab of about 2 MB, or one longer text, and some
    fifty bytes for each of its bytes. An empty table gives no rows. Other columns are not
    read.

    ``blocks``: shares of the sample that are sorted one after another; ``bucket_entries``:
    about how many suffixes a task sorts.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "repeats")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tkey"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    slabs = saved(slab_table(rows.where(F.col("n_bytes") >= LENGTH).select("doc_id", "tkey", "text")), f"{folder}/slabs")
    total = slabs.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    each = int(total * len(D) / V / blocks / bucket_entries) + 1
    buckets, open_buckets = each * blocks, int(total / 8 / bucket_entries) + 1
    for block in range(blocks):
        keys = sample_keys(slabs, block, blocks, buckets).repartition(each, "bucket")
        with short_shuffles(spark):
            keys.groupBy("bucket").applyInArrow(rank_sample, _ANSWER).write.option("compression", "zstd").parquet(f"{folder}/sample/block={block}")
    answers = spark.read.schema(_ANSWER).parquet(*[f"{folder}/sample/block={b}" for b in range(blocks)])
    sample = slabs.join(by_slab(answers, "sample"), "slab", "left")
    keys = open_keys(sample, buckets, open_buckets).repartition(open_buckets, "bucket")
    strings = saved(keys.groupBy("bucket").applyInArrow(rank_open, _ANSWER), f"{folder}/open")
    cut = saved(cut_texts(sample.join(by_slab(strings, "open"), "slab", "left"), buckets, open_buckets), f"{folder}/cut")
    dropped(spark, f"{folder}/slabs")
    found = cut.withColumnsRenamed({"doc_id": "_doc", "tkey": "_key"})
    all_rows = rows.select("doc_id", "tkey", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("_whole"))
    out = all_rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_key")), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))
