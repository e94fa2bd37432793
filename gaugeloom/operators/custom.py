"""Evaluators of one's own in SQL: a function named module:function becomes a table function.

    custom.register(spark, "score_length", "my.evaluators:length", metric="length")
    SELECT * FROM score_length(TABLE(runs))

The function gets a row (a dict) and a memory (a dict that lasts over the rows of one case,
in the order of its runs) and returns a score, a dict with score and comment, or None where
it doesn't apply. The rows of a case meet in one task; they are handed on one by one, so a
case may have any number of them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Evaluator = Callable[[dict, dict], "float | dict | None"]


def named(ref: str) -> Evaluator:
    """The function that module:function names."""
    module, _, function = ref.partition(":")
    if not function:
        raise ValueError(f"not module:function: {ref!r}")
    return getattr(importlib.import_module(module), function)


def outcome(got: float | dict | None) -> tuple[str, float | None, str | None]:
    """outcome, score and comment of what an evaluator returned."""
    if got is None:
        return "skipped", None, None
    score, comment = (got.get("score"), got.get("comment")) if isinstance(got, dict) else (got, None)
    return ("skipped", None, comment) if score is None else ("scored", float(score), comment)


def table_function(ref: str, metric: str) -> type:
    """The class of a table function over case runs: case_id and, if they have an order, run_ordinal."""

    class Evaluate:
        def __init__(self) -> None:
            self.evaluate, self.memory = named(ref), {}

        @staticmethod
        def analyze(runs: AnalyzeArgument) -> AnalyzeResult:
            if not runs.isTable:
                raise ValueError("call it with TABLE(...)")
            fields = {f.name: f for f in runs.dataType.fields}
            if "case_id" not in fields:
                raise ValueError(f"the table has no case_id, but {', '.join(fields)}")
            keys = [fields[k] for k in ("case_id", "run_ordinal") if k in fields]
            rest = [StructField("metric", StringType()), StructField("outcome", StringType()), StructField("score", DoubleType()), StructField("comment", StringType())]
            order = [OrderingColumn("run_ordinal")] if "run_ordinal" in fields else []
            return AnalyzeResult(StructType([*keys, *rest]), partitionBy=[PartitioningColumn("case_id")], orderBy=order)

        def eval(self, row: Row) -> Iterator[tuple]:
            own = row.asDict(recursive=True)
            try:
                found = outcome(self.evaluate(own, self.memory))
            except Exception as e:  # noqa: BLE001 - an evaluator's failure is a result
                found = "error", None, f"{type(e).__name__}: {e}"[:300]
            yield (*[own[k] for k in ("case_id", "run_ordinal") if k in own], metric, *found)

    return Evaluate


def register(spark: SparkSession, name: str, ref: str, metric: str | None = None) -> None:
    """Enters the evaluator as a table function; its module must be where the tasks can import it."""
    named(ref)
    spark.udtf.register(name, udtf(table_function(ref, metric or ref.rpartition(":")[2])))


def longer_than_before(row: dict, memory: dict) -> dict | None:
    """An example: does a response have more characters than all before it of its case?"""
    size = row.get("n_chars")
    if size is None:
        return None
    most = memory.get("most", -1)
    memory["most"] = max(most, size)
    return {"score": float(size > most), "comment": f"{size} after {most}" if most >= 0 else "first"}


def brief(row: dict, memory: dict) -> float | None:
    """An example: has the response at most 16 characters?"""
    return None if row.get("response") is None else float(len(row["response"]) <= 16)
