"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

The tree has three levels, region, rack and shard. At each level every child draws
-ln(u) / weight, where u is a hash of the key and the child's name, and the smallest draw
wins, so a child is chosen with a chance proportional to its weight. Changing the weight
of one subtree moves rows only into it or out of it. ``grow`` adds a shard in a region of
its own: no older draw changes, so rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n_shards: int, base: int = 8) -> list[Leaf]:
    """n equal shards: the first ``base`` in racks of two and regions of two racks, each further one as ``grow`` adds it.

    So tree(n + 1, base) is tree(n, base) with one more shard. ``base`` is the number a
    cluster started with; to start with fewer than eight shards, give it.
    """
    if n_shards < base or base < 1:
        raise ValueError(f"{n_shards} shards are fewer than the {base} that the tree starts with")
    leaves = [Leaf(f"g{i // 4}", f"k{i // 2}", i) for i in range(base)]
    for _ in range(n_shards - base):
        leaves = grow(leaves)
    return leaves


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no older draw changes, so rows move only into it."""
    i = max(x.shard for x in leaves) + 1
    return [*leaves, Leaf(f"g+{i}", f"k+{i}", i, weight)]


#: 52 bits of an MD5 digest make u; that many fit a double exactly.
_BITS = 13


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1] from the MD5 of 'key/name'; a null key counts as the word null."""
    digest = F.substring(F.md5(F.concat(F.coalesce(key, F.lit("null")), F.lit("/" + name))), 1, _BITS)
    u = (F.conv(digest, 16, 10).cast("double") + 1.0) / float(16**_BITS)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; the earlier child wins a tie."""
    if len(children) == 1:
        return children[0][2]
    best = F.array_min(F.array(*[F.struct(draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)]))["i"]
    out = children[-1][2]
    for i in range(len(children) - 2, -1, -1):
        out = F.when(best == i, children[i][2]).otherwise(out)
    return out


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: descends region, rack and shard."""
    key = key.cast("string")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for x in leaves:
        if x.weight <= 0:
            raise ValueError(f"shard {x.shard} has no weight")
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    top = []
    for region, racks in regions.items():
        below = []
        for rack, own in racks.items():
            last = _winner(key, [(f"shard:{x.shard}", x.weight, F.lit(x.shard)) for x in own])
            below.append((f"rack:{rack}", sum(x.weight for x in own), last))
        top.append((f"region:{region}", sum(x.weight for own in racks.values() for x in own), _winner(key, below)))
    return _winner(key, top).cast("int")


def with_slots(rows: DataFrame, shard: str, block: str, order: list[Column], slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    A window over a whole shard would be one task, so rows are numbered in each (shard,
    block); the numbers of the blocks before are added. ``block`` holds a bounded number
    of values, so the counts are a small table whatever the input.
    """
    counts = rows.groupBy(shard, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_s"), F.col(block).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, block).orderBy(*order)
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1)
    # at most shards * blocks rows of two numbers, a bound fixed by the parameters
    joined = numbered.join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col(block) == F.col("_b")))
    return joined.withColumn(slot, (F.col("_before") + F.col("_k")).cast("long")).drop("_s", "_b", "_before", "_k")


def shard_documents(docs: DataFrame, n_shards: int = 8, base: int = 8) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, ...) with shard, slot and the shard after growth by one.

    Null texts have size 1 and the checksum of the empty text; a null doc_id is a key of
    its own. Repeated rows share a shard and get a slot each. Texts of any length are read
    for their size and checksum alone. Slots follow 4096 blocks of a hash of doc_id and
    checksum and in each doc_id, checksum and size. An empty table gives no rows. Other
    columns are not read.
    """
    leaves = tree(n_shards, base)
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary")).cast("long")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), leaves).alias("shard"),
        place(F.col("doc_id"), grow(leaves)).alias("grown_shard"),
    )
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.col("text_crc32").cast("string"), F.lit("/slot"))
    rows = rows.withColumn("_block", F.substring(F.md5(key), 1, 3))
    out = with_slots(rows, "shard", "_block", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
