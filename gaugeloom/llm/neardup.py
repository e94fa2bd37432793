"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five neighbouring words; its weight in a text is (1 + ln tf) * (1 + ln((1+N)
/ (1 + max(df, N/100))) / ln 100). df is the exact number of documents with the shingle;
below a hundredth of all documents it tells no shingles apart, so only shingles above
that are counted one by one, and there are at most a hundred times as many of them as an
average document has.

Consistent weighted sampling draws (shingle, level) pairs that two texts share with a
chance equal to their weighted Jaccard similarity. ROWS draws make a band; texts with an
equal band share a bucket. All members of a bucket of up to GROUP texts are compared with
each other. A larger one is first dealt into blocks of about GROUP, each with the same
PIVOTS texts; the members of a block are compared, which joins most copies. Then each
member outside the bucket's largest class is compared with all members of the bucket, in
tasks of PROBES by PART texts however many there are, so no pair of a bucket goes
uncompared unless its classes are one. Pairs of weighted Jaccard similarity ``least`` or
more are linked; classes are the connected components. A pair of similarity 0.8 has no
band in common with a chance of (1 - 0.8**ROWS)**BANDS, 0.02 per cent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .shared import dropped, saved, shared_folder, whole_row

SHINGLE = 5
BANDS, ROWS = 12, 3
GROUP, PIVOTS = 64, 16
#: Members outside the largest class, and members in all, that meet in a task.
PROBES, PART = 256, 512
#: A share of all documents: rarer shingles weigh as if they had it.
FLOOR = 1 / 100

#: Quantiles of the three random variables of a draw, at 2**16 levels: r and ln c from Gamma(2, 1), beta uniform.
_LEVELS = 1 << 16


def _gamma2_quantiles() -> np.ndarray:
    """Inverts 1 - (1 + x) exp(-x) by bisection."""
    u = (np.arange(_LEVELS) + 0.5) / _LEVELS
    lo, hi = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_R = _gamma2_quantiles()
_LN_C = np.log(_R)


def shingle_counts(slab: tb.Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, tf) of a slab, by row. A text of one to four words has one shingle, all its words."""
    h, row = tb.words(slab)
    rows = len(slab.starts)
    g = tb.grams(h, SHINGLE, 9)
    inside = row[: len(g)] == row[SHINGLE - 1 : SHINGLE - 1 + len(g)]
    r, g = row[: len(g)][inside], g[inside]
    n = np.bincount(row, minlength=rows)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        first = np.searchsorted(row, few)
        short = [tb.grams(h[a : a + m], m, 9)[0] for a, m in zip(first.tolist(), n[few].tolist(), strict=True)]
        r, g = np.concatenate([r, few]), np.concatenate([g, np.array(short, np.uint64)])
    both = (r.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16))
    both, tf = np.unique(both, return_counts=True)
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), tf


def narrow_slabs(column: pa.Array) -> Iterator[tb.Slab]:
    """Slabs of at most 2**16 rows, as shingle_counts packs rows in 16 bits."""
    for i in range(0, len(column), 1 << 15):
        for slab in tb.slabs(column.slice(i, 1 << 15)):
            slab.first += i
            yield slab


class Frequencies:
    """The number of documents, and the shingles that more than FLOOR of them have with how many have each."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, n: int) -> None:
        order = np.argsort(shingles)
        self.shingles, self.df, self.n = shingles[order], df[order], n

    def idf(self, shingle: np.ndarray) -> np.ndarray:
        least = self.n * FLOOR
        df = np.full(len(shingle), least)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingle), len(self.shingles) - 1)
            df = np.where(self.shingles[at] == shingle, self.df[at], df)
        return 1.0 + np.log((1.0 + self.n) / (1.0 + np.maximum(df, least))) / np.log(1 / FLOOR)

    def weights(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1.0 + np.log(tf)) * self.idf(shingle)


#: Shingles that document_frequencies holds before it counts them.
HELD = 1 << 22


def document_frequencies(docs: DataFrame) -> Frequencies:
    """Exact counts of the shingles that more than FLOOR of all documents have.

    Such a shingle is in more than half of FLOOR of some task's part of the documents. Tasks
    so name candidates with the counts of their parts; those whose named counts reach half
    of FLOOR of all documents (what was not named is less than the other half) are at most
    2 / FLOOR times as many as an average document has shingles, and are counted in full.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[pa.RecordBatch]:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            own = n > rows * FLOOR / 2
            yield pa.RecordBatch.from_arrays([pa.array(np.append(s[own].astype(np.int64), -1)), pa.array(np.append(n[own], rows))], ["s", "n"])

        held, size, rows = [], 0, 0
        for batch in batches:
            for slab in narrow_slabs(batch.column("text")):
                held.append(shingle_counts(slab)[1])
                size, rows = size + len(held[-1]), rows + len(slab.starts)
                if size > HELD:
                    yield from named()
                    held, size, rows = [], 0, 0
        if rows:
            yield from named()

    texts = docs.select("text")
    sums = texts.mapInArrow(name, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    path = shared_folder(docs.sparkSession, "named")
    sums = saved(sums, path)
    total = sums.where("s = -1").select("n").first()
    rows = int(total[0]) if total else 0
    candidates = np.sort(sums.where((F.col("s") >= 0) & (F.col("n") >= rows * FLOOR / 2)).select("s").toArrow()["s"].to_numpy())
    dropped(docs.sparkSession, path)
    if not len(candidates):
        return Frequencies(np.zeros(0, np.uint64), np.zeros(0), rows)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)  # bounded as above

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.uint64)
        table = np.zeros(len(own), np.int64)
        for batch in batches:
            for slab in narrow_slabs(batch.column("text")):
                s = shingle_counts(slab)[1]
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                table += np.bincount(at[own[at] == s], minlength=len(own))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(own[some].astype(np.int64)), pa.array(table[some])], ["s", "n"])

    got = texts.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > rows * FLOOR).toArrow()
    return Frequencies(got["s"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(float), rows)


def bands(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """rows x BANDS keys of the draws; texts without shingles get zeros. row ascends."""
    out = np.zeros((rows, BANDS), np.uint64)
    if not len(row):
        return out
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    have = row[begins]
    place = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    ln_w = np.log(weight)
    for k in range(BANDS * ROWS):
        u = tb.mix(shingle, 1000 + k)
        r = _R[u & np.uint64(0xFFFF)]
        beta = ((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float64) / _LEVELS
        t = np.floor(ln_w / r + beta)
        ln_a = _LN_C[(u >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - beta + 1.0)
        low = np.minimum.reduceat(ln_a, begins)
        hit = np.flatnonzero(ln_a == low[place])
        first = hit[np.concatenate([[True], place[hit][1:] != place[hit][:-1]])]
        draw = tb.mix(u[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), k)
        band = k // ROWS
        out[have, band] = tb.mix(out[have, band] ^ draw, 77 + k)
    return out


def signatures(docs: DataFrame, known: Frequencies) -> DataFrame:
    """doc_id, digest (MD5 of the text), bands: the keys of each text, null if it has no words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most 1 / FLOOR times the shingles of an average document
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in narrow_slabs(batch.column("text")):
                row, shingle, tf = shingle_counts(slab)
                rows = len(slab.starts)
                keys = bands(row, shingle, shared.value.weights(shingle, tf), rows)
                none = np.bincount(row, minlength=rows) == 0
                values = pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                values = pa.compute.if_else(pa.array(none), pa.scalar(None, pa.list_(pa.int64())), values)
                own = batch.slice(slab.first, rows)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("digest"), values], ["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("digest")).mapInArrow(run, f"doc_id {kind}, digest string, bands array<long>")


def mixed_members(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (bucket, node, label, ...) in buckets of several labels, with the size n of the bucket."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return keyed.join(sizes.select("bucket", "n"), "bucket")


GROUPED = ("group", "part", "node", "label", "probe")


def small_groups(members: DataFrame) -> DataFrame:
    """group, part, node, label, probe of buckets of up to GROUP members; buckets with the same members are one group."""
    listed = members.where(F.col("n") <= GROUP).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("all"))
    listed = listed.select(F.xxhash64("all.node").alias("group"), "all").dropDuplicates(["group"])
    return listed.select("group", F.lit(0).alias("part"), F.explode("all").alias("one"), F.lit(True).alias("probe")).select("group", "part", "one.node", "one.label", "probe")


def dealt_groups(large: DataFrame, salt: int = 0) -> DataFrame:
    """The same of larger buckets: blocks of about GROUP with the same PIVOTS nodes, those of the rarest labels first."""
    parts = lambda n: F.ceil(n / (GROUP - PIVOTS)).cast("int")
    dealt = large.select("bucket", F.pmod(F.xxhash64("node", "bucket", F.lit(salt)), parts(F.col("n"))).cast("int").alias("part"), "node", "label")
    first = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(F.xxhash64("node", "bucket", F.lit(salt)).alias("h"), "node", "n")).alias("one"))
    order = Window.partitionBy("bucket").orderBy("many", "one")
    heads = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
    heads = heads.select("bucket", F.explode(F.sequence(F.lit(0), parts(F.col("one.n")) - 1)).alias("part"), "one.node", "label")
    return dealt.unionByName(heads).select(F.xxhash64("bucket", F.lit(salt)).alias("group"), "part", "node", "label", F.lit(True).alias("probe"))


def with_rest(large: DataFrame) -> DataFrame:
    """``large`` with top, the largest label of the bucket, and rest, how many members have another."""
    counts = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("many")).groupBy("bucket").agg(F.max(F.struct("many", "label")).alias("top"))
    return large.join(counts, "bucket").withColumn("rest", F.col("n") - F.col("top.many")).withColumn("top", F.col("top.label"))


def probed_groups(large: DataFrame) -> DataFrame:
    """The same of buckets (with top and rest) in which each member outside the largest class shall meet every member: chunks of probes by parts of members."""
    share = lambda size, salt, most: F.pmod(F.xxhash64("node", "bucket", F.lit(salt)), F.ceil(size / most)).cast("int")
    every = lambda size, most: F.explode(F.sequence(F.lit(0), F.ceil(size / most).cast("int") - 1))
    probes = large.where("label <> top").select("bucket", share(F.col("rest"), 71, PROBES).alias("chunk"), every(F.col("n"), PART).alias("part"), "node", "label", F.lit(True).alias("probe"))
    others = large.select("bucket", every(F.col("rest"), PROBES).alias("chunk"), share(F.col("n"), 72, PART).alias("part"), "node", "label", F.lit(False).alias("probe"))
    return probes.unionByName(others).select(F.xxhash64("bucket", "chunk").alias("group"), "part", "node", "label", "probe")


#: Nodes whose texts will be compared mark bits of a table of at most 2**FILTER_BITS bits (16 MiB), of 16 bits a node if they fit.
FILTER_BITS = 27


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, digest, and the smallest doc_id as first), from one row of each.

    Texts pass a filter before they are shuffled; beyond some millions of nodes it lets
    more and more through, but no text that is wanted is held back.
    """
    bits_ = min(FILTER_BITS, max(16, (16 * wanted.count()).bit_length()))
    slot = wanted.select(F.shiftrightunsigned(F.xxhash64("digest"), 64 - bits_).alias("slot"))
    words = slot.selectExpr("cast(slot div 64 as int) as w", "shiftleft(1L, cast(slot % 64 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits_ - 6), np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            own = bits[batch.column("slot").to_numpy()]
            if own.any():
                yield batch.filter(pa.array(own)).select(["doc_id", "digest", "text"])

    digest = F.md5(F.col("text").cast("binary"))
    rows = docs.where("text is not null").select("doc_id", digest.alias("digest"), "text", F.shiftrightunsigned(F.xxhash64(digest), 64 - bits_).alias("slot"))
    some = rows.mapInArrow(run, f"doc_id {kind}, digest string, text string")
    need = wanted.select("node", F.col("digest").alias("_digest"), "first")
    return some.join(need, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")


def links_of(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, labels: np.ndarray, probe: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join members of different labels, as few as join them all. row: the member of each shingle, ascending.

    Each probe is compared with all members that are in another set so far.
    """
    n = len(labels)
    cut = np.searchsorted(row, np.arange(n + 1))
    total = np.bincount(row, weight, n)
    of, out = np.unique(labels, return_inverse=True)[1], []
    place, count = np.unique(shingle, return_inverse=True, return_counts=True)[1:]
    shared = count[place] > 1  # what one member has alone is common to no two
    row, place, weight, cut = row[shared], place[shared], weight[shared], np.concatenate([[0], np.cumsum(shared)])[cut]
    own = np.zeros(len(count))
    for p in np.flatnonzero(probe).tolist():
        a, z = cut[p], cut[p + 1]
        if a == z or (of == of[p]).all():
            continue
        own[place[a:z]] = weight[a:z]
        common = np.bincount(row, np.minimum(weight, own[place]), n)
        own[place[a:z]] = 0
        near = np.flatnonzero((of != of[p]) & (common > 0) & (common >= least * (total + total[p] - common)))
        for b in near.tolist():
            if of[b] != of[p]:
                of[of == of[b]] = of[p]
                out.append((p, b))
    return out


def verified(groups: DataFrame, texts: DataFrame, known: Frequencies, least: float) -> DataFrame:
    """(a, b): links between members (group, part, node, label, probe) of a group and part whose texts (node, text) are near enough."""
    shared = texts.sparkSession.sparkContext.broadcast(known)
    pieces = groups.join(texts, "node").select(*GROUPED, "text")

    def compare(table: pa.Table) -> pa.Table:
        order = np.lexsort((~table["probe"].to_numpy(), table["node"].to_numpy()))
        nodes, first = np.unique(table["node"].to_numpy()[order], return_index=True)  # a node once, as a probe if it is one
        table = table.take(pa.array(order[first]))
        row, shingle, tf = [], [], []
        for slab in narrow_slabs(table["text"].combine_chunks()):
            r, s, n = shingle_counts(slab)
            row.append(r + slab.first), shingle.append(s), tf.append(n)
        row, shingle, tf = np.concatenate(row), np.concatenate(shingle), np.concatenate(tf)
        found = links_of(row, shingle, shared.value.weights(shingle, tf), table["label"].to_numpy(), table["probe"].to_numpy(), least)
        a, b = (np.array(found, np.int64).reshape(-1, 2)).T
        return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

    return pieces.groupBy("group", "part").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) lead to.

    Each step gives a node the smallest label of its neighbours and of the node that its
    own label names, so distances halve. Labels only fall: when their sum stays, they do.
    """
    sides = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{folder}/sides")
    labels = saved(sides.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), f"{folder}/step0")
    total, step = None, 0
    while True:
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        step += 1
        known = labels.select(F.col("node").alias("b"), "label")
        leads = sides.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = saved(leads.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")), f"{folder}/step{step}")


def linked(near: DataFrame, texts: DataFrame, members: DataFrame, known: Frequencies, least: float, folder: str) -> DataFrame:
    """(node, label): the classes of near (node, bands). members: the mixed buckets while each node is a class of its own."""
    large = members.where(F.col("n") > GROUP)
    groups = small_groups(members).unionByName(dealt_groups(large))
    labels = components(saved(verified(groups, texts, known, least), f"{folder}/links0"), f"{folder}/labels0")
    if large.isEmpty():
        return labels
    now = large.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    rest = saved(with_rest(mixed_members(now)), f"{folder}/rest")
    groups = probed_groups(rest)
    links = saved(verified(groups, texts, known, least), f"{folder}/links1")
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links), f"{folder}/labels1")


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, digest (MD5 of the text), class_id, class_size and keep of every row; see near_duplicates."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "neardup")
    known = document_frequencies(docs)
    signed = saved(signatures(docs, known), f"{folder}/signed")
    # ids are settled when written; eight bytes instead of a digest in all that follows
    nodes = signed.where("bands is not null").groupBy("digest").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "node").select(F.xxhash64("band", "key").alias("bucket"), "node", F.col("node").alias("label"))
    members = saved(mixed_members(keyed), f"{folder}/members")
    near = saved(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "first", "bands"), f"{folder}/near")
    texts = saved(texts_of(near, docs), f"{folder}/texts")
    labels = linked(near, texts, members, known, least, folder)
    labelled = nodes.join(labels, "node", "left").select("digest", "first", "rows", F.coalesce("label", "node").alias("label"))
    labelled = saved(labelled, f"{folder}/labelled")
    groups = saved(labelled.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size")), f"{folder}/groups")
    by_text = saved(labelled.join(groups, "label").select("digest", "class_id", "class_size"), f"{folder}/by_text")
    dropped(spark, f"{folder}/texts", f"{folder}/members", f"{folder}/nodes")
    joined = signed.join(by_text, "digest", "left")
    alone = F.col("bands").isNull()
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    keep = F.coalesce(class_id == F.col("doc_id"), class_id.isNull())
    return joined.select("doc_id", "digest", class_id.alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), keep.alias("keep"))


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size and keep of every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the class; keep marks its row. Equal texts with
    words are one class whatever their length. Null texts and texts without words are
    alone: class_id is their doc_id and they are kept. A null doc_id is never smallest; if
    a class has no other, its class_id is null and all its rows are kept. Rows that repeat
    whole are members of one class and, if smallest, all marked. An empty table gives no
    rows. Texts are read whole; a task holds up to about PROBES + PART texts at a time, however
    long. Other columns are not read.
    """
    return classes(docs, least).drop("digest")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each class, with all its columns, whatever their names.

    Of rows that repeat a doc_id with the same text one stays; null and empty texts stay
    once a doc_id. An empty table stays empty.
    """
    doc = lambda: F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    kept = classes(docs, least).where("keep").select(doc().alias("doc"), F.coalesce("digest", F.lit("")).alias("digest")).distinct()
    keyed = docs.select(doc().alias("doc"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"), whole_row(docs))
    return keyed.join(kept, ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"]).select("row.*")
