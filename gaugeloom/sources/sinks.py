"""Writing: JSON documents, gated tables and idempotent publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.cases import not_published, problems, to_publish


def stamped(doc: Column, namespace: str, kind: str, fields: list[str], wrap_key: str | None = None) -> Column:
    """A document (struct with the named fields) with its schema id before its own fields, or under ``wrap_key`` if the kind has one."""
    schema = F.lit(f"{namespace}/{kind.replace('_', '-')}/v1").alias("schema")
    return F.struct(schema, doc.alias(wrap_key)) if wrap_key else F.struct(schema, *[doc[f].alias(f) for f in fields if f != "schema"])


def save_json(rows: DataFrame, folder: str, pretty: bool = False) -> None:
    """One JSON object a line. Artifacts are small; tables go to Parquet."""
    rows.select(F.to_json(F.struct(*rows.columns), {"pretty": str(pretty).lower()}).alias("value")).write.mode("overwrite").text(folder)


def save_valid(cases: DataFrame, folder: str) -> DataFrame:
    """Writes cases only if none breaks a rule; returns the broken rules.

    The cases are written to a folder beside it first and read from there, so what was
    checked is what is kept, and they are computed once. That folder stays only if a rule
    is broken: then the broken cases are read from it.
    """
    staged = f"{folder.rstrip('/')}.checked"
    cases.write.mode("overwrite").parquet(staged)
    own = cases.sparkSession.read.schema(cases.schema).parquet(staged)
    bad = problems(own)
    if bad.isEmpty():
        own.write.mode("overwrite").parquet(folder)
        path = cases.sparkSession._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(cases.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        return cases.sparkSession.createDataFrame([], bad.schema)
    return bad


def publish(cases: DataFrame, upload: Callable[[pd.DataFrame], pd.DataFrame], read_back: Callable[[], DataFrame]) -> DataFrame:
    """Uploads approved cases without a remote id, a batch a call, and returns those the remote side doesn't show.

    A case that is read back already isn't sent again, so a repeated task or run adds nothing.
    """
    waiting = to_publish(cases)
    new = not_published(waiting, read_back())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield upload(batch)[["case_id"]].assign(case_id=lambda d: d["case_id"].astype(str))

    new.mapInPandas(send, "case_id string").write.format("noop").mode("overwrite").save()
    return not_published(waiting, read_back())


def emit(rows: DataFrame) -> DataFrame:
    """A JSON text a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
