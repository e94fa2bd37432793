"""Source divergence audit: which sources of a language use words unlike each other, and which words make it so.

A *group* is a (lang, source). Every group, and every language as a whole, gives each term
its language keeps a smoothed probability in billionths; f = (p - q)^2 / (p + q), rounded
down, measures how two probabilities differ. All numbers are whole and exact.

Terms of a group: the search needs no f of every term. Terms of nearly the same count in a
group share a bucket; the largest p and the smallest language probability q of a bucket
bound f of all its terms, as f grows with p and falls with q while p > q. The best buckets
that hold ``top`` terms are evaluated first; their ``top``-th value is a limit, and of the
unseen buckets only those whose bound isn't strictly below it are evaluated too.

Pairs of groups: the sum over all kept terms falls apart into the terms of neither (one
product), of one (the group's counts, however many terms have each) and of both, which are
computed from each term's *postings*, its groups with their p. Blocks of ``BLOCK`` groups
of a posting list are met with the whole list in one array operation, and a task sums over
its terms before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import column, saved, shared_folder

LEAST_DOCS = 10
TOP = 10
BILLION = 1_000_000_000
#: Groups of a block, and columns of an array operation.
BLOCK, WIDE = 64, 4096
#: A task hands on its counts when they have so many entries or bytes of words.
ENTRIES, TERM_BYTES = 1 << 19, 32 << 20
#: One number counts both: occurrences in the low bits, documents above them.
LOW_BITS = 36
#: A text is cut into words so many bytes at a time.
PART = 1 << 20
#: Sums of a task are handed on beyond so many bytes.
SUM_BYTES = 64 << 20

_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
_FOLD[65:91] = _FOLD[97:123] = bytes(range(97, 123))
FOLD = bytes(_FOLD)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: runs of letters A-Z, taken as a-z, and characters beyond ASCII."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and rows that have the term, of each group; ``docs`` has lang, source, text."""

    def rows(held: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), both in held.items():
            size, counts = len(both), np.fromiter(both.values(), np.int64, len(both))
            terms = pa.array(list(both), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array(counts & ((1 << LOW_BITS) - 1)), pa.array(counts >> LOW_BITS)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        document, unseen = 1 << LOW_BITS, 0
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for key, text in zip(keys, batch.column("text"), strict=True):
                both, own = held[key], set()
                blob = text.as_py() or b""
                for words in words_of(blob):
                    both.update(words)
                    own.update(words)
                for term in own:
                    both[term] += document
                unseen += len(blob)
                if unseen > TERM_BYTES // 8:
                    unseen = 0
                    if sum(map(len, held.values())) > ENTRIES or sum(len(t) for both in held.values() for t in both) > TERM_BYTES:
                        yield from rows(held)
                        held = defaultdict(Counter)
        yield from rows(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals as the product may pass 64 bits; null where nothing is kept."""
    return F.expr(f"1 + (cast({BILLION} as decimal(10,0)) * cast({count} + 2 as decimal(19,0))) div nullif(cast({total} + 2 * {kept} as decimal(19,0)), 0)")


def distance(p: str, q: str) -> Column:
    """p and q are at most 10^9 + 1, so the square keeps within 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def np_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Audit:
    """The tables of one audit, in a new shared folder."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS) -> None:
        self.folder = shared_folder(docs.sparkSession, "divergence")
        empty = lambda name: F.coalesce(column(name), F.lit("")).alias(name)
        rows = docs.select(empty("lang"), empty("source"), column("text").cast("binary").alias("text"))
        # tasks have counted already: rows are dealt out before they are added up
        counts = term_counts(rows).repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        posting = F.collect_list(F.struct("source", "n")).alias("groups")  # one entry a source of the language
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), posting)
        self.kept = saved(kept.where(F.col("docs") >= least_docs).select("lang", "term", "total", "groups"), f"{self.folder}/kept")
        entries = self.kept.select("lang", "term", "total", F.inline("groups"))
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
        groups = groups.select("lang", "source", zero("group_n"), zero("v"), zero("lang_n"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("sid"))
        #: lang, source, group_n, v, lang_n, sid, p0: every group; p0 is its probability of a term it hasn't.
        self.groups = saved(groups.withColumn("p0", probability("0L", "group_n", "v")), f"{self.folder}/groups")
        cells = entries.join(self.groups, ["lang", "source"])
        cells = cells.withColumn("p", probability("n", "group_n", "v")).withColumn("q", probability("total", "lang_n", "v"))
        #: lang, source, sid, term, n, p, q, p0, bucket: every kept term that a group has.
        self.cells = saved(cells.select("lang", "source", "sid", "term", "n", "p", "q", "p0", self._bucket().alias("bucket")), f"{self.folder}/cells")

    @staticmethod
    def _bucket() -> Column:
        """Counts below 16 by themselves, larger ones by their leading four bits."""
        bits = F.length(F.bin("n"))
        return F.when(F.col("n") < 16, F.col("n")).otherwise(bits * 16 + F.expr("shiftright(n, length(bin(n)) - 4)")).cast("int")

    def buckets(self) -> DataFrame:
        """lang, source, bucket, terms, bound: no term of the bucket has a larger f; buckets without p > q are left out."""
        found = self.cells.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("terms"))
        return found.where("p > q").select("lang", "source", "bucket", "terms", distance("p", "q").alias("bound"))

    def evaluated(self, chosen: DataFrame, top: int) -> DataFrame:
        """lang, source, item, value of the ``top`` best terms of the chosen buckets of each group."""
        cells = self.cells.where("p > q").join(chosen.select("lang", "source", "bucket"), ["lang", "source", "bucket"])
        return best(cells.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value")), top)

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: the ``top`` terms a group has more of than its language, by value, then term."""
        order = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket")
        buckets = self.buckets().withColumn("before", F.coalesce(F.sum("terms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        buckets = saved(buckets, f"{self.folder}/buckets")
        first = saved(self.evaluated(buckets.where(F.col("before") < top), top), f"{self.folder}/first")
        limit = first.groupBy("lang", "source").agg(F.when(F.count("*") == top, F.min("value")).alias("limit"))
        unseen = buckets.where(F.col("before") >= top).join(limit, ["lang", "source"], "left")
        more = self.evaluated(unseen.where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit"))), top)
        return best(first.drop("rank").unionByName(more.drop("rank")), top)

    def shared_terms(self) -> DataFrame:
        """lang, i, j, both: over the terms that the groups i and j have, what f exceeds the sum of the parts that count each alone."""
        posting = self.cells.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("all"))  # at most the sources of the language
        block = F.explode(F.array_distinct(F.transform("all", lambda x: F.floor(x["sid"] / BLOCK).cast("int")))).alias("block")
        blocks = posting.select("lang", block, "all").sortWithinPartitions("lang", "block")

        def rows(sums: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
            for (lang, block), table in sums.items():
                i, j = np.nonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + block * BLOCK, pa.int32()), pa.array(j, pa.int32()), pa.array(table[i, j])], ["lang", "i", "j", "both"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                posting = batch.column("all")
                ends, entry = posting.offsets.to_numpy(), posting.values
                sid, p, p0 = (entry.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sid", "p", "p0"))
                for lang, block, a, z in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), ends[:-1], ends[1:], strict=True):
                    table = sums.get((lang, block), np.zeros((BLOCK, 0), np.int64))
                    if (need := int(sid[a:z].max()) + 1) > table.shape[1]:
                        table = sums[lang, block] = np.pad(table, ((0, 0), (0, need - table.shape[1])))
                        if sum(t.nbytes for t in sums.values()) > SUM_BYTES:
                            yield from rows(sums)
                            table = np.zeros((BLOCK, need), np.int64)
                            sums = {(lang, block): table}
                    mine = a + np.flatnonzero(sid[a:z] // BLOCK == block)
                    at, x, x0 = sid[mine] - block * BLOCK, p[mine][:, None], p0[mine][:, None]
                    for b in range(a, z, WIDE):
                        c = min(z, b + WIDE)
                        y, y0 = p[b:c], p0[b:c]
                        table[at[:, None], sid[b:c]] += np_distance(x, y) - np_distance(x, y0) - np_distance(x0, y) + np_distance(x0, y0)
            yield from rows(sums)

        return blocks.mapInArrow(run, "lang string, i int, j int, both long").where("i <> j").groupBy("lang", "i", "j").agg(F.sum("both").alias("both"))

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: every other source of a group's language, by value, then name."""
        mine = self.groups.select("lang", F.col("sid").alias("i"), "source", "v", F.col("p0").alias("x0"))
        others = self.groups.select("lang", F.col("sid").alias("j"), F.col("source").alias("item"), F.col("p0").alias("y0"))
        same = self.cells.groupBy("lang", F.col("sid").alias("i"), "p", F.col("p0").alias("x0")).agg(F.count("*").alias("m"))
        alone = same.join(others.select("lang", "j", "y0"), "lang").where("i <> j")
        alone = alone.groupBy("lang", "i", "j").agg(F.sum(F.col("m") * (distance("p", "y0") - distance("x0", "y0"))).alias("alone"))
        found = mine.join(others, "lang").where("i <> j").join(alone, ["lang", "i", "j"], "left")
        back = alone.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), F.col("alone").alias("back"))
        found = found.join(back, ["lang", "i", "j"], "left").join(self.shared_terms(), ["lang", "i", "j"], "left")
        neither = F.coalesce(F.col("v") * distance("x0", "y0"), F.lit(0))
        value = neither + sum((F.coalesce(c, F.lit(0)) for c in ("alone", "back", "both")), F.lit(0))
        return best(found.select("lang", "source", "item", value.alias("value")))


def best(found: DataFrame, top: int | None = None) -> DataFrame:
    """lang, source, item, value, rank of each group's items, or of its ``top`` ones."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def audit_sources(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows and ``term`` rows of every group of ``docs``.

    Null lang, source and text are empty ones; a row is a document, repeated rows are
    several; a text without terms, however long, makes its group occur. A language that
    keeps no term has pairs of value 0 and no terms; a group that is its language's only
    one has no pairs. An empty table gives no rows; other columns are not read.
    """
    audit = Audit(docs, least_docs)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return part(audit.pairs(), "pair").unionByName(part(audit.terms(top), "term"))
