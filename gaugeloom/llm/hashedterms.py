"""Hashed terms of whole texts: what both classifiers read of a document.

A term is a word (A-Z taken as a-z), the first five bytes of a longer word, a run of
symbols, or, the same for all, the repetition of the term before. Terms are hashed; (row, term) pairs come out of NumPy work on the bytes of an
Arrow column, a slab of texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from . import textbytes as tb

STEM = 5

#: 1: words; 2: symbols. White space and control bytes are 0 and belong to no term.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[tb.WORD == 1] = 1


def slab_terms(slab: tb.Slab, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each term of a slab, repeats included; 0 <= term < 2**bits."""
    begin, end, row = tb.runs(slab, KIND)
    sums = tb.prefix(tb.byte_codes(slab.buf, tb.ascii_lower()))
    shift = np.uint64(64 - bits)
    word = KIND[slab.buf[begin]] == 1 if len(begin) else np.zeros(0, bool)
    whole = tb.mix(tb.span(sums, begin, end), 1) >> shift
    long = word & (end - begin > STEM)
    stem = tb.mix(tb.span(sums, begin[long], begin[long] + STEM), 2) >> shift
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (row[1:] == row[:-1])) + 1
    repeat = np.full(len(again), tb.mix(np.zeros(1, np.uint64), 3)[0] >> shift)
    return np.concatenate([row, row[long], row[again]]), np.concatenate([whole, stem, repeat]).astype(np.int64)


def counted(row: np.ndarray, term: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs in order, with how often each occurs."""
    both, n = np.unique((row.astype(np.int64) << bits) | term, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), n


def map_texts(docs: DataFrame, columns: list[str], schema: str, fit: Callable[[tb.Slab], dict[str, np.ndarray]]) -> DataFrame:
    """Adds to ``columns`` what ``fit`` gives for each slab of texts: one value a row of each new column.

    The text is the column of that name or, where ``columns`` has a struct "row", its field.
    """
    new = StructType.fromDDL(schema)
    inner = "row" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.compute.struct_field(batch.column("row"), "text") if inner else batch.column("text")
            for slab in tb.slabs(text):
                got = fit(slab)
                own = [batch.column(c).slice(slab.first, len(slab.starts)) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(got[c]) for c in new.names]], [*columns, *new.names])

    return docs.select(*dict.fromkeys([*columns, *([] if inner else ["text"])])).mapInArrow(run, StructType([*[docs.schema[c] for c in columns], *new.fields]))


#: Bytes of terms and counts that a model learns from at most.
LEARN_BYTES = 64 << 20


def trained(docs: DataFrame, rated: DataFrame, bits: int, most: int, seed: int, fit: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that ``fit`` makes of row, term, count and target of a bounded sample of rated documents.

    rated: doc_id, target, one row a document. The sample is the first ``most`` documents
    in an order by a hash of doc_id, as far as their distinct terms and counts take
    LEARN_BYTES, so it does not depend on the order of rows. Texts are read whole where
    they lie; one task learns, and only the model reaches the driver.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = rated.where("doc_id is not null and target is not null").orderBy(order, "doc_id").limit(most)
    # at most ``most`` rows of two numbers: a proven bound
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("target").alias("target"))  # a repeated doc_id counts once

    def terms_of(slab: tb.Slab) -> dict[str, list]:
        row, term, n = counted(*slab_terms(slab, bits), bits)
        cuts = np.searchsorted(row, np.arange(len(slab.starts) + 1))
        pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
        return {"terms": [term[a:z].astype(np.int32).tobytes() for a, z in pairs], "counts": [n[a:z].astype(np.int32).tobytes() for a, z in pairs]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, targets, terms, counts = [], [], [], []
        for batch in batches:
            sizes.append(pa.compute.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4)
            targets.append(batch.column("target").to_numpy(zero_copy_only=False))
            for name, out in (("terms", terms), ("counts", counts)):
                out.append(np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int32))
        size, target, term, count = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((sizes, np.int64), (targets, np.int64), (terms, np.int32), (counts, np.int32)))
        model = fit(np.repeat(np.arange(len(size), dtype=np.int32), size), term, count, target.astype(np.int64))
        for name, values in model.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([values.astype("<f8").tobytes()], pa.binary())], ["name", "numbers"])

    texts = map_texts(sample, ["doc_id", "target"], "terms binary, counts binary", terms_of)
    # a window over at most ``most`` rows
    upto = F.sum(F.octet_length("terms") * 2).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounded = texts.withColumn("upto", upto).where(F.col("upto") <= LEARN_BYTES).select("target", "terms", "counts")
    got = bounded.coalesce(1).mapInArrow(learn, "name string, numbers binary").collect()
    return {r.name: np.frombuffer(bytes(r.numbers), "<f8") for r in got}


def one_label(labels: DataFrame, target: Column) -> DataFrame:
    """doc_id, target with one row a document; of clashing repeats the lowest target holds."""
    return labels.select("doc_id", target.cast("long").alias("target")).groupBy("doc_id").agg(F.min("target").alias("target"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
