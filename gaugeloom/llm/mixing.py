"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The corpus has T words. Slot i of the schedule maps the point frac((i + 1/2) / golden
ratio) through the cumulative target shares and so names a source; ranking a source's
slots says which of its blocks each takes. A source's documents, in an order shuffled by
hash, form a stream of words cut into blocks of ``block`` words; a source that must give
more words than it has goes round its stream again. A source stops when its target is
reached, the last block cut short; what the schedule's small discrepancy leaves missing
is added as closing slots. Every source so gives exactly the whole part of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .shared import saved, shared_folder, whole_row

#: White space of the size rule.
WORDS = r"[^\x20\x09-\x0D]+"
#: 1 / golden ratio.
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size) with target: sources in code point order, null last, weigh ``weights`` in turn.

    The targets share the total by weight, none above ``most`` times its source's size,
    the excess reshared. That is a water level: source s takes min(weight * level, most *
    size). Sorted by most * size / weight, the first k sources are full, where k is the
    smallest number whose level keeps all others below their limit; sums along that order
    give it without iterating. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(most))
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    sofar = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(sofar), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(sofar), F.lit(0.0))
    t = t.withColumn("level", left / open_weight)
    t = t.withColumn("fits", F.col("level") * F.col("weight") <= F.col("full"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    t = t.withColumn("level", F.coalesce(level, F.lit(0.0)))
    return t.select("source", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("full")).alias("target"))


def plan_blocks(t: DataFrame, block: int) -> DataFrame:
    """Adds to (source, source_size, target): sid, quota (whole words to give), blocks of a turn, slots and the words of the last slot.

    A turn of a source's stream is cut into blocks of ``block`` words, its last block short.
    """
    size = F.greatest("source_size", F.lit(1))
    t = t.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("quota", F.floor(F.col("target") + 1e-6).cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("turns", F.floor(F.col("quota") / size)).withColumn("rest", F.col("quota") % size)
    return t.withColumn("slots", F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / block)).withColumn("last", F.col("rest") % block)


def source_slots(spark: SparkSession, plan: DataFrame, slots: int, cells: int = 1024) -> DataFrame:
    """(sid, slot, rank): golden-ratio points mapped through the cumulative shares of plan.slots and ranked within each source.

    Points meet sources through a grid of ``cells`` cells, an equality join whatever the
    number of sources. Ranks come from runs of slots numbered apart, with the counts of
    the runs before added. Slots past a source's need are dropped; what the points leave
    missing follows as closing slots.
    """
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = plan.where("slots > 0").select("sid", F.col("slots").alias("need"), F.sum("slots").over(upto).alias("upto"))
    s = s.select("sid", "need", ((F.col("upto") - F.col("need")) / F.lit(max(slots, 1))).alias("lo"), (F.col("upto") / F.lit(max(slots, 1))).alias("hi"))
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int")
    grid = s.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("lo") * cells), F.lit(cells - 1)).cast("int"), last)))
    run = max(1024, -(-slots // 4096))
    x = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    named = points.join(grid, "cell").where("x >= lo and x < hi").select("slot", "sid", "need", F.floor(F.col("slot") / run).alias("run"))
    counts = named.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    runs_before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("sid", "run", F.coalesce(F.sum("n").over(runs_before), F.lit(0)).alias("before"))
    ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(before, ["sid", "run"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k")).where("rank < need").select("sid", "slot", F.col("rank").cast("long").alias("rank"))
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    lack = s.join(have, "sid", "left").withColumn("have", F.coalesce(F.col("have"), F.lit(0))).where("have < need")
    closing = lack.select("sid", F.explode(F.sequence(F.col("have").cast("long"), (F.col("need") - 1).cast("long"))).alias("rank"))
    return ranked.unionByName(closing.select("sid", (F.lit(slots) + F.col("rank")).cast("long").alias("slot"), "rank"))


def shuffle_key(doc_id: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(doc_id.isNull(), "//").otherwise("/"), size.cast("string"), F.lit(f"/{seed}")))


def stream_offsets(sized: DataFrame, seed: int) -> DataFrame:
    """Each document's first word in its source's shuffled stream.

    Order: shuffle_key, doc_id, size. Sums run inside each of 4096 key ranges of a source
    (the first hex digits of the key), so a source that holds most rows is many tasks, and
    rows that share a doc_id are spread by their sizes; the sums of the ranges before are
    a table of at most 4096 rows a source.
    """
    d = sized.withColumn("h", shuffle_key(F.col("doc_id"), F.col("size"), seed)).withColumn("part", F.substring("h", 1, 3))
    sums = d.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside)).join(starts, ["sid", "part"])
    return d.withColumn("offset", (F.col("before") + F.col("upto") - F.col("size")).cast("long")).drop("h", "part", "upto", "before")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def schedule(sized: DataFrame, folder: str, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The plan (one row a source) and the slots, each with the block and the words it takes.

    sized: doc_id, source, size. The plan is written to ``folder``: several steps read it.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = saved(plan_blocks(targets(per, list(weights), most), block), f"{folder}/plan")
    total = int(plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    slots = source_slots(spark, plan, total).join(plan.select("sid", "blocks", "slots", "last", "source_size"), "sid")
    at = F.pmod(F.col("rank"), F.greatest("blocks", F.lit(1)))
    whole = F.least(F.lit(block), F.col("source_size") - at * block)
    words = F.when((F.col("rank") == F.col("slots") - 1) & (F.col("last") > 0), F.col("last")).otherwise(whole)
    return plan, slots.select("sid", "slot", "rank", at.cast("long").alias("at"), words.cast("long").alias("words"), whole.cast("long").alias("whole"))


def mix(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, block: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) and first_slot of every row.

    first_slot: the slot of the schedule, from 0, in which the mix first takes a word of the
    row; null if it takes none. The schedule's order is the order of the mix.

    Null texts and texts of white space have size 0 and take nothing; a null source is a
    source, last in order; an empty table gives no rows. A text of any length is cut where
    blocks end. Repeated rows are separate documents, one after another in the stream.
    Other columns are not read. Reruns give the same rows. The table of sources is put in
    order in one task, a small row a source.
    """
    folder = shared_folder(docs.sparkSession, "mixing")
    return mix_sizes(saved(sizes_of(docs), f"{folder}/sized"), folder, weights, most, block, seed).drop("turns")


def mix_sizes(sized: DataFrame, folder: str, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, block: int = 1024, seed: int = 7) -> DataFrame:
    """The same of a written table of doc_id, source and size, with turns: the slots in which the mix begins the row, one a copy."""
    plan, slots = schedule(sized, folder, weights, most, block)
    took = slots.groupBy("sid", "at").agg(
        F.sum(F.when(F.col("words") == F.col("whole"), 1).otherwise(0)).alias("times"),
        F.max(F.when(F.col("words") < F.col("whole"), F.col("words")).otherwise(0)).alias("cut"),
        F.sort_array(F.collect_list("slot")).alias("turns"),  # a block is taken ``most`` times and once more at most
    )
    known = plan.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    numbered = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    placed = stream_offsets(numbered, seed).withColumn("row", F.struct("offset", "doc_id", "size", "source", "source_size", "target"))
    # documents are cut where blocks end, so that one equality joins them to the blocks taken
    end = F.col("offset") + F.col("size")
    blocks = F.sequence(F.floor(F.col("offset") / block).cast("long"), F.floor((F.greatest(end, F.col("offset") + 1) - 1) / block).cast("long"))
    parts = placed.select("row", "sid", "offset", end.alias("end"), F.explode(blocks).alias("at"))
    lo = F.greatest(F.col("offset") - F.col("at") * block, F.lit(0))
    hi = F.least(F.col("end") - F.col("at") * block, F.lit(block))
    got = F.greatest(hi - lo, F.lit(0)) * F.coalesce("times", F.lit(0)) + F.greatest(F.least(hi, F.coalesce("cut", F.lit(0))) - lo, F.lit(0))
    begins = F.col("at") == F.floor(F.col("offset") / block)
    joined = parts.join(took, ["sid", "at"], "left").select("sid", "row", got.alias("got"), begins.cast("int").alias("begins"), F.when(begins, F.col("turns")).alias("turns"))
    # offsets tell rows apart unless their size is 0: equal rows of size 0 are counted and unfolded
    per_row = joined.groupBy("sid", "row").agg(F.sum("got").cast("long").alias("taken"), F.sum("begins").alias("copies"), F.first("turns", ignorenulls=True).alias("turns"))
    per_row = per_row.withColumn("turns", F.when(F.col("taken") > 0, F.col("turns")))
    copies = F.when(F.col("row.size") > 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    per_row = per_row.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return per_row.select("row.doc_id", "row.source", "row.size", "row.source_size", "row.target", "taken", F.get("turns", F.lit(0)).alias("first_slot"), "turns")


def take_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as whole documents in the order of the schedule: each row of ``docs`` as often as the mix takes its words, rounded to whole copies.

    A copy stands where the schedule begins it; rows without words stand first.
    A document of which the mix takes less than half is left out. Rows without words have
    no size to mix and stay once; an empty table stays empty. Rows that share doc_id,
    source and size share what was taken of them evenly. All columns are kept, whatever
    their names.
    """
    folder = shared_folder(docs.sparkSession, "mixing")
    # words are counted once; all that follows reads the counts
    counted = saved(docs.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), word_count(F.col("text")).alias("n"), whole_row(docs)), f"{folder}/counted")
    mixed = mix_sizes(counted.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("n").alias("size")), folder, **params)
    took = mixed.groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("took"), F.min("turns").alias("turns"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("took") / F.greatest("size", F.lit(1)))).cast("int")
    took = took.withColumn("copies", copies).where("copies > 0")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    taken = counted.join(took, same).select("row", "turns", copy)
    slot = F.coalesce(F.get("turns", F.least(F.col("copy"), F.size("turns") - 1)), F.lit(-1))
    return taken.withColumn("slot", slot).repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")
