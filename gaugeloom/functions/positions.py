"""The position of every row in a total order, for any number of rows: no window over one partition.

Rows are dealt out by ranges of the order, sorted in each range and written; the counts of
the ranges, as many as there are partitions, give each range the number of rows before it.
The rows are written as a range's bounds may differ when it is computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.folders import shared_folder

#: A row's number in its partition is in the low bits of monotonically_increasing_id.
_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their positions from 0 in ``order`` (columns, ascending unless they say otherwise). Ties are in any order."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark, 'positions')}/rows"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    held = spark.read.schema(sorted_.schema).parquet(path)
    part = F.shiftrightunsigned("_id", _BITS)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + (F.col("_id") - F.shiftleft(F.col("_part"), _BITS))
    return held.withColumn("_part", part).join(starts, "_part").withColumn(name, at).select(*rows.columns, name)


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """The same, from 0 in each group of ``keys``, of which there may be few with very many rows. A null is a key."""
    placed = numbered(rows, [*keys, *order], "_place")
    firsts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    firsts = firsts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return placed.join(firsts, same).withColumn(name, F.col("_place") - F.col("_first")).select(*rows.columns, name)


def even_chunk(position: Column, total: Column, n: int) -> Column:
    """The chunk 0..n-1 of a position when ``total`` rows are cut into n runs, the first ones a row longer."""
    small, longer = F.floor(total / n), total % n
    head = longer * (small + 1)
    return F.when(position < head, F.floor(position / (small + 1))).otherwise(longer + F.floor((position - head) / F.greatest(small, F.lit(1)))).cast("int")
