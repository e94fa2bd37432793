"""Tables in the folder that the whole cluster shares: where lineage ends and steps hand rows on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.folders import shared_folder  # noqa: F401  (for the operators)

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each query when it ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def saved(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written as Parquet and read again: computed once, by a lineage that ends here."""
    with short_shuffles(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def column(name: str) -> Column:
    """The column of just this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(rows: DataFrame) -> Column:
    """All columns as one struct, so that names given beside it clash with none."""
    return F.struct(*[column(c) for c in rows.columns]).alias("row")
