"""Benchmark decontamination by winnowing.

Of every ``window`` neighbouring k-grams of words the one with the smallest hash is a
fingerprint (of equals the last). With window + k - 1 = span, two texts that share
``span`` words share the fingerprint chosen in them, so a join of the fingerprints of
training and test texts misses no shared span. Each fingerprint is joined together with
the spans it lies in, extended word by word to ``span`` words on both sides; a span is
known by 128 bits of its words. All items that hold a span are one list, named by a hash,
so a passage of many documents and of many items is joined once a document. Benchmark
items shorter than a span are matched whole, with their own length as k and a window of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .shared import saved, shared_folder, whole_row

SPAN = 10
K = 5

#: Fingerprints of the benchmark mark bits of a table of at most 2**FILTER_BITS bits (16 MiB), of 256 bits a fingerprint if they fit.
FILTER_BITS = 27

#: Spans whose words are looked up at a time.
CHUNK = 4096

#: A word: any characters but those of ASCII that are not digits or small letters.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def winnow(h: np.ndarray, row: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the fingerprints: place is the first word of the k-gram in the arrays given."""
    g = tb.grams(h, k, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = np.arange(n)
    low = g[:n].copy()
    for j in range(1, window):
        other = g[j : j + n]
        less = other <= low
        low[less] = other[less]
        best[less] = np.flatnonzero(less) + j
    inside = row[:n] == row[window + k - 2 : window + k - 2 + n]
    at = np.unique(best[inside])
    return at, g[at]


def fingerprints(h: np.ndarray, row: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, k) for spans, and for each short length a fingerprint of every run of as many words."""
    parts = [(*winnow(h, row, K, SPAN - K + 1), K + 100)]
    parts += [(*winnow(h, row, m, 1), m) for m in short]
    return tuple(np.concatenate(x) for x in zip(*[(a, tb.mix(g, k), np.full(len(a), k)) for a, g, k in parts], strict=True))


def spans_at(slab: tb.Slab, words: tuple, fold: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(which fingerprint, first word, digest, number of words) of every span that a fingerprint (place, k) lies in.

    A fingerprint of K words lies in up to SPAN - K + 1 spans of its text; a short one is
    a span itself.
    """
    begin, end, row, cut = words
    long = k == K + 100
    need = np.where(long, SPAN, k)
    which, first = [], []
    for back in range(SPAN - K + 1):
        start = at - back
        fits = (start >= cut[row[at]]) & (start + need <= cut[row[at] + 1]) & (long | (back == 0))
        which.append(np.flatnonzero(fits))
        first.append(start[fits])
    which, first = np.concatenate(which), np.concatenate(first)
    size = need[which]
    digests = np.empty(len(which), object)
    for n in np.unique(size).tolist():  # at most SPAN lengths
        own = np.flatnonzero(size == n)
        starts, place = np.unique(first[own], return_inverse=True)
        known = np.empty(len(starts), object)
        for a in range(0, len(starts), CHUNK):
            word = starts[a : a + CHUNK, None] + np.arange(n)
            for i, (b, e) in enumerate(zip(begin[word].tolist(), end[word].tolist(), strict=True), a):
                text = fold[slab.buf[b[0] : e[-1]]].tobytes()
                known[i] = xxhash.xxh3_128_digest(b" ".join([text[x - b[0] : y - b[0]] for x, y in zip(b, e, strict=True)]))
        digests[own] = known[place]
    return which, first, digests.tolist(), size


def text_words(slab: tb.Slab, fold: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Begin, end and row of each word with the bounds of the rows; the hash of each word, A-Z taken as a-z."""
    begin, end, row = tb.runs(slab, tb.WORD)
    h = tb.mix(tb.span(tb.prefix(tb.byte_codes(slab.buf, fold)), begin, end))
    return (begin, end, row, row_bounds(row, len(slab.starts))), h


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """item_id, fp, span, need: the fingerprints of each item with the spans (digests of ``need`` words) they lie in."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = tb.ascii_lower()
        for batch in batches:
            for slab in tb.slabs(batch.column("text")):
                words, h = text_words(slab, fold)
                _, _, row, cut = words
                size = np.diff(cut)
                at, g, k = fingerprints(h, row, sorted({int(n) for n in size if 0 < n < SPAN}))
                own = np.where(size[row[at]] < SPAN, size[row[at]], K + 100) == k
                at, g, k = at[own], g[own], k[own]
                which, _, digests, need = spans_at(slab, words, fold, at, k)
                ids = batch.column("item_id").slice(slab.first, len(slab.starts)).take(pa.array(row[at[which]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(g[which].astype(np.int64)), pa.array(digests, pa.binary()), pa.array(need.astype(np.int64))], ["item_id", "fp", "span", "need"])

    return items.mapInArrow(run, "item_id string, fp long, span binary, need long").distinct()


def filter_table(prints: DataFrame) -> tuple[int, bytes]:
    """How many bits of a fingerprint name a bit, and a bit for each that the fingerprints take: at most 2**(FILTER_BITS - 6) words reach the driver."""
    bits = min(FILTER_BITS, max(16, (256 * prints.select("fp").distinct().count()).bit_length()))
    slot = prints.select(F.shiftrightunsigned("fp", 64 - bits).alias("slot"))
    marks = slot.selectExpr("cast(slot div 64 as int) as w", "shiftleft(1L, cast(slot % 64 as int)) as b")
    words = marks.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    return bits, table.tobytes()


def document_fingerprints(docs: DataFrame, marks: tuple[int, bytes], short: list[int], keys: list[str]) -> DataFrame:
    """``keys``, fp, span, lo, hi: fingerprints of documents that may be in the benchmark, with the spans they lie in."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, table = shared.value
        bits, fold = np.frombuffer(table, np.uint64), tb.ascii_lower()
        for batch in batches:
            for slab in tb.slabs(batch.column("text")):
                words, h = text_words(slab, fold)
                _, _, row, cut = words
                at, g, k = fingerprints(h, row, short)
                place = g >> np.uint64(64 - size)
                may = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                at, g, k = at[may], g[may], k[may]
                which, first, digests, need = spans_at(slab, words, fold, at, k)
                own = batch.slice(slab.first, len(slab.starts)).take(pa.array(row[at[which]]))
                lo = first - cut[row[at[which]]]
                columns = [*[own.column(c) for c in keys], pa.array(g[which].astype(np.int64)), pa.array(digests, pa.binary()), pa.array(lo), pa.array(lo + need)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "fp", "span", "lo", "hi"])

    return docs.select(*dict.fromkeys([*keys, "text"])).mapInArrow(run, f"{kept}, fp long, span binary, lo long, hi long")


def find_spans(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct ``keys``, lo, hi, list of every span of a document that items hold, and (list, items): the sorted items of each list.

    Fingerprints of documents pass a filter before they are shuffled; a document's span
    meets one row of the benchmark, however many items hold it. The items of one span
    are gathered in an array: a benchmark is far smaller than a corpus.
    """
    folder = shared_folder(docs.sparkSession, "winnowing")
    prints = saved(item_fingerprints(benchmark), f"{folder}/items")
    short = sorted(r[0] for r in prints.select("need").distinct().collect() if r[0] < SPAN)  # at most 9 lengths
    held = prints.groupBy("span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    held = held.withColumn("list", F.sha2(F.to_json("items"), 256))
    lists = saved(held.select("list", "items").dropDuplicates(["list"]), f"{folder}/lists")
    index = prints.select("fp", "span").distinct().join(held.select("span", "list"), "span")
    hits = document_fingerprints(docs, filter_table(prints), short, keys)
    spans = saved(hits.join(index, ["fp", "span"]).select(*keys, "lo", "hi", "list").distinct(), f"{folder}/spans")
    return spans, lists


def word_counts(keyed: DataFrame) -> DataFrame:
    """doc_id, _text, n_words of every row."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(tb.runs(slab, tb.WORD)[2], minlength=len(slab.starts)) for slab in tb.slabs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["doc_id", "_text", "n_words"])

    return keyed.mapInArrow(run, f"doc_id {kind}, _text long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Null and empty texts have no words and hit nothing; null and empty items match
    nothing; a null item_id is not counted as an item. Texts and items of any length are
    read whole, and only words around a fingerprint are shuffled. Rows that repeat a
    doc_id with the same text get the same result, with another text each its own. Null
    doc_ids are a key like any other. An empty table gives no rows. Other columns are not
    read.
    """
    key = F.xxhash64("text").alias("_text")
    keyed = docs.select("doc_id", key, "text")
    spans, lists = find_spans(keyed, benchmark, ["doc_id", "_text"])
    # a document's distinct spans are no more than its words; overlaps are merged in order
    found = spans.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(
        F.sort_array(F.collect_set("list")).alias("lists"), F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"),
    )
    zero = F.lit(0).cast("long")
    merged = F.aggregate(
        "runs", F.struct(zero.alias("n"), zero.alias("done")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(r["hi"] - F.greatest(r["lo"], acc["done"]), zero)).alias("n"), F.greatest(acc["done"], r["hi"]).alias("done")),
    )
    # documents that hold the same lists have the same items: these are joined once
    found = saved(found.select("_d", "_t", "lists", F.sha2(F.array_join("lists", ","), 256).alias("_set"), merged["n"].alias("n_hit")), shared_folder(docs.sparkSession, "found"))
    sets = found.select("_set", "lists").dropDuplicates(["_set"]).select("_set", F.explode("lists").alias("list")).join(lists, "list")
    sets = sets.groupBy("_set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    sets = sets.select("_set", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("sha"))
    named = found.drop("lists").join(sets, "_set", "left")
    out = word_counts(keyed).join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_text").eqNullSafe(F.col("_t")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.sha2(F.lit(b""), 256)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", none).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever their names.

    Rows with null or empty texts stay; repeated rows go or stay together; an empty table
    stays empty.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    hit = find_spans(keyed, benchmark, ["doc_id", "_text"])[0].select(F.col("doc_id").alias("hit_doc"), F.col("_text").alias("hit_text")).distinct()
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), whole_row(docs))
    return rows.join(hit, F.col("d").eqNullSafe(F.col("hit_doc")) & (F.col("t") == F.col("hit_text")), "left_anti").select("row.*")
