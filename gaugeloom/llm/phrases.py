"""Phrase collocation mining over depth-limited count tries.

Texts are cut into pieces at punctuation and line ends and into words. A shard (a run of
rows of some SHARD_WORDS words of one language) becomes a trie whose nodes are phrases
with their counts. No phrase is more frequent than a phrase in it, so three rounds grow
the tries: words; pairs of frequent words; and phrases of up to ``depth`` words whose
neighbouring pairs are all frequent. What is frequent is told to the tasks by a bit table
of at most 2**TABLE_BITS bits, which marks all frequent phrases and perhaps others: those
are counted in vain, and no phrase is lost at any size.

The nodes of all shards are written sorted, dealt out by ranges of their first two words,
so that a node's descendants lie in its range, and summed there. A walk of each range in
order then gives every phrase the counts of its left parts, which are its ancestors; its
suffix links, one for every cut, are joined with the counts of the phrases they lead to
and give the right parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import column, saved, shared_folder

LEAST = 100
DEPTH = 5
TOP = 2000
#: A phrase goes where a longer one has this share of its occurrences, in per cent.
SHARE = 100
#: What a task holds at once, words and bytes of text, and how much of a text it cuts into words at a time.
SHARD_WORDS, SHARD_BYTES, PART = 6 << 20, 64 << 20, 1 << 20
#: The bit table has at most 2**TABLE_BITS bits (16 MiB), and 256 for each phrase if they fit.
TABLE_BITS = 27
#: Words with very many phrases are joined in so many parts.
PARTS = 16

#: Stands for the end of a piece: no byte of UTF-8, and behind all words in their order.
BREAK = b"\xff"
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_byte] = 0xFF
FOLD = bytes(_FOLD)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with a BREAK at the end of each piece, some PART bytes at a time; a piece is never cut."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(BREAK, at + PART)
        end = len(folded) if end < 0 else end
        yield [*folded[at:end].replace(BREAK, b" \xff ").split(), BREAK]
        at = end


@dataclass
class Held:
    """Words of one language as numbers, while a shard grows."""

    ids: dict[bytes, int] = field(default_factory=lambda: defaultdict(count().__next__))
    parts: list[np.ndarray] = field(default_factory=list)
    words: int = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.words += len(words)


@dataclass
class Shard:
    """names: the distinct words in order, and perhaps BREAK; at: the number of the word at each place."""

    lang: str
    names: list[bytes]
    at: np.ndarray

    @classmethod
    def of(cls, lang: str, held: Held) -> Shard:
        names = list(held.ids)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        return cls(lang, [names[i] for i in order], rank[np.concatenate(held.parts)])

    def words(self) -> pa.Array:
        return pa.array(self.names, pa.binary())

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each distinct word, and whether it is a word."""
        head = f"{self.lang}\t".encode()
        hashes = np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in self.names), np.uint64, len(self.names))  # as xxhash64 in SQL
        return hashes, np.array([w != BREAK for w in self.names], bool)


def shards(batches: Iterator[pa.RecordBatch], words: int, size: int) -> Iterator[Shard]:
    """Runs of rows. A task holds so many words or bytes, whatever the number of languages: then the largest shard is handed on."""
    held: dict[str, Held] = defaultdict(Held)
    total = read = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            blob = text.as_py() or b""
            for part in tokens(blob):
                held[lang].add(part)
                total, read = total + len(part), read + min(len(blob), PART)
                if read >= size or total >= words:
                    largest = max(held, key=lambda k: held[k].words)
                    total, read = total - held[largest].words, 0
                    yield Shard.of(largest, held.pop(largest))
    for lang, own in held.items():
        yield Shard.of(lang, own)


NODES = "lang string, phrase string, n long"


def nodes(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """Nodes of a trie, in order, written down with their counts."""
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def word_tries(rows: DataFrame) -> DataFrame:
    """The tries of depth 1, and a node without words that counts all of a shard's words."""
    words, size = SHARD_WORDS, SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, words, size):
            n = len(shard.names) - (shard.names[-1] == BREAK)
            counts = np.bincount(shard.at, minlength=len(shard.names))[:n]
            yield nodes(shard.lang, shard.words()[:n], counts)
            yield nodes(shard.lang, pa.array([b""], pa.binary()), counts.sum(keepdims=True))

    return rows.mapInArrow(run, NODES)


def pair_mark(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a pair of words from theirs."""
    return ((first << np.uint64(7)) | (first >> np.uint64(57))) ^ second


class Marks:
    """The bit table of some frequent words, or of pairs of them."""

    def __init__(self, frequent: DataFrame, pairs: bool) -> None:
        self.bits = min(TABLE_BITS, max(16, (256 * frequent.count()).bit_length()))
        word = lambda i: F.xxhash64(F.concat("lang", F.lit("\t"), F.split("phrase", " ")[i]))
        turned = F.shiftleft(word(0), 7).bitwiseOR(F.shiftrightunsigned(word(0), 57))
        place = F.shiftrightunsigned(turned.bitwiseXOR(word(1)) if pairs else word(0), 64 - self.bits)
        words = frequent.select(place.alias("place")).selectExpr("cast(place div 64 as int) as w", "shiftleft(1L, cast(place % 64 as int)) as b")
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2**(TABLE_BITS - 6) rows
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[found["w"].to_numpy()] = found["b"].to_numpy()
        self.table = table.view(np.uint64)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


@dataclass
class Level:
    """The nodes of one depth of a shard's trie in order, and the places where an occurrence of a node begins."""

    phrases: pa.Array
    begin: np.ndarray
    node: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.node, minlength=len(self.phrases))

    def grown(self, words: pa.Array, begin: np.ndarray, parent: np.ndarray, last: np.ndarray) -> Level:
        """The level below: a node is its parent with one more word."""
        keys, node = np.unique(parent << 32 | last, return_inverse=True)
        phrases = pc.binary_join_element_wise(self.phrases.take(pa.array(keys >> 32)), words.take(pa.array(keys & 0xFFFFFFFF)), b" ")
        return Level(phrases, begin, node)


def pair_level(shard: Shard, good: np.ndarray) -> Level:
    """The nodes of two good words."""
    places = good[shard.at]
    begin = np.flatnonzero(places[:-1] & places[1:])
    return Level(shard.words(), begin, begin).grown(shard.words(), begin, shard.at[begin], shard.at[begin + 1])


def pair_tries(rows: DataFrame, marks: Broadcast) -> DataFrame:
    """The nodes of depth 2 whose words are marked."""
    words, size = SHARD_WORDS, SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, words, size):
            hashes, real = shard.marked()
            level = pair_level(shard, marks.value.test(hashes) & real)
            yield nodes(shard.lang, level.phrases, level.counts())

    return rows.mapInArrow(run, NODES)


def deep_tries(rows: DataFrame, marks: Broadcast, pair_marks: Broadcast, depth: int) -> DataFrame:
    """The nodes of depths 3 to ``depth`` whose neighbouring pairs are all marked, a level at a time."""
    words, size = SHARD_WORDS, SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, words, size):
            hashes, real = shard.marked()
            level = pair_level(shard, marks.value.test(hashes) & real)
            at = shard.at
            good = pair_marks.value.test(pair_mark(hashes[at[level.begin]], hashes[at[level.begin + 1]]))
            link = np.zeros(len(at) + depth, bool)  # does a marked pair begin here?
            link[level.begin[good]] = True
            level = Level(level.phrases, level.begin[good], level.node[good])
            for m in range(3, depth + 1):
                more = link[level.begin + m - 2]
                begin = level.begin[more]
                level = level.grown(shard.words(), begin, level.node[more], at[begin + m - 1])
                yield nodes(shard.lang, level.phrases, level.counts())

    return rows.mapInArrow(run, NODES)


def words_in(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def with_head(tries: DataFrame) -> DataFrame:
    return tries.withColumn("head", F.substring_index("phrase", " ", 2))


def merged(tries: DataFrame, least: int) -> DataFrame:
    """The nodes of all shards summed by prefix range, as far as they are frequent."""
    dealt = with_head(tries).repartitionByRange("lang", "head")
    return dealt.groupBy("lang", "head", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "phrase", "n")


def walked(frequent: DataFrame, share: int) -> DataFrame:
    """lang, phrase, m, n, lefts, inside of every frequent phrase of two words or more.

    lefts: the counts of its first 2, 3, ... words (all but the last); inside: whether a
    phrase that begins with it has ``share`` per cent of its occurrences. A range is read
    in the order of words, so a stack holds the ancestors of the node at hand.
    """
    ordered = with_head(frequent.where("instr(phrase, ' ') > 0")).repartitionByRange("lang", "head").withColumn("words", words_in("phrase")).sortWithinPartitions("lang", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # lang, words, phrase, count, inside
        done: list[tuple] = []

        def leave() -> None:
            lang, words, phrase, n, inside = stack.pop()
            done.append((lang, phrase, len(words), n, [x[3] for x in stack], inside))

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            columns = zip(*done, strict=True) if done else [()] * 6
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "m", "n", "lefts", "inside"])
            done.clear()
            return made

        for batch in batches:
            for lang, words, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "phrase", "n")), strict=True):
                while stack and not (stack[-1][0] == lang and words[: len(stack[-1][1])] == stack[-1][1]):
                    leave()
                if stack and 100 * n >= share * stack[-1][3]:
                    stack[-1][4] = True
                stack.append([lang, words, phrase, n, False])
            yield rows()
        while stack:
            leave()
        yield rows()

    return ordered.select("lang", "words", "phrase", "n").mapInArrow(run, "lang string, phrase string, m int, n long, lefts array<long>, inside boolean")


def floor_score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) by decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(cast(1000 as decimal(4,0)) * cast({a} as decimal(15,0)) * {wide(n)}) div ({wide(l)} * {wide(r)})")


def scored(frequent: DataFrame, totals: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one replaces."""
    nodes_ = walked(frequent, share).withColumnRenamed("n", "a").withColumn("words", words_in("phrase"))
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("c"))
    # a phrase of one word may be part of very many others, so its row is there PARTS times
    alone = F.when(F.instr("part", " ") == 0, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    counts = counts.withColumn("salt", F.explode(alone))
    salt = lambda part: F.when(F.instr(part, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    # the first word is no ancestor within a range: its count comes with the suffix links' own
    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.when(k > 1, F.try_element_at("lefts", k - 1)).alias("l"), F.array_join(F.slice("words", k + 1, F.col("m") - k), " ").alias("part")))
    first = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("l"), F.col("words")[0].alias("part")))
    links = nodes_.select("lang", "phrase", "m", "a", "inside", F.inline(F.concat(first, cuts)))
    met = links.withColumn("salt", salt("part")).join(counts, ["lang", "part", "salt"])
    found = met.groupBy("lang", "phrase").agg(
        F.max("m").alias("m"), F.max("a").alias("a"), F.bool_or("inside").alias("inside"),
        F.max(F.when(F.col("k") == 0, F.col("c"))).alias("first"), F.collect_list(F.when(F.col("k") > 0, F.struct("k", "l", F.col("c").alias("r")))).alias("cuts"),  # at most depth - 1
    )
    found = found.join(totals, "lang").select("lang", "phrase", "m", "a", "inside", "n", F.inline(F.transform("cuts", lambda x: F.struct(x["k"].alias("k"), F.coalesce(x["l"], F.col("first")).alias("l"), x["r"].alias("r")))))
    lowest = F.min(F.struct(floor_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    best = found.groupBy("lang", "phrase", "m", "a", "inside", "n").agg(lowest)
    # the suffix link backwards: does a phrase that ends with this one have its share of it?
    longer = nodes_.where("m >= 3").groupBy("lang", F.array_join(F.slice("words", 2, F.col("m") - 1), " ").alias("phrase")).agg(F.max("a").alias("longest"))
    stays = ~F.col("inside") & (F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    return best.join(longer, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations.

    A null lang is ``und``, a null or empty text has no words; repeated rows count as often
    as they are there; texts of any length are read whole; an empty table, or one without
    frequent phrases, gives no rows; other columns are not read. Equal scores are in the
    order of a, then of the phrase's bytes.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "phrases")
    rows = docs.select(F.coalesce(column("lang"), F.lit("und")).alias("lang"), column("text").cast("binary").alias("text"))
    # shards have counted already: nodes are dealt out before they are added up
    summed = lambda tries: tries.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = saved(summed(word_tries(rows)).where((F.col("n") >= least) | (F.col("phrase") == "")), f"{folder}/words")
    singles, totals = words.where("phrase <> ''"), words.where("phrase = ''").select("lang", "n")
    marks = spark.sparkContext.broadcast(Marks(singles, False))
    pairs = saved(summed(pair_tries(rows, marks)).where(F.col("n") >= least), f"{folder}/pairs")
    pair_marks = spark.sparkContext.broadcast(Marks(pairs, True))
    tries = saved(deep_tries(rows, marks, pair_marks, depth), f"{folder}/tries")
    deep = saved(merged(tries, least), f"{folder}/deep")
    best = scored(singles.unionByName(pairs).unionByName(deep), totals, share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
