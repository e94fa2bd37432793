"""Row-level evaluators, and the long score table they make.

An evaluator is a column expression over a joined row (case and run) that gives a score
or null where it doesn't apply. Evaluators that need a model or a user function run over
partitions through ``judged``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import jsontext
from ..functions.jsonvalues import contains as part_of, json_valid
from ..functions.matching import all_matched

DETERMINISTIC = ("expected_tools", "contains", "json_valid", "trajectory_match")
JUDGED = ("correctness", "contract", "trajectory_llm")


def contains_all(text: Column, needles: Column) -> Column:
    """1.0 if every needle is in the text, whatever the case; null (skipped) without needles."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.forall(needles, lambda n: F.contains(low, F.lower(n)))
    return F.when(F.coalesce(F.size(needles), F.lit(0)) > 0, hit.cast("double"))


def valid_json(text: Column) -> Column:
    return json_valid(text).cast("double")


#: Arguments are compared to so many levels; expectations deeper than that are an error.
DEPTH = 8

_CALLS = "array<struct<name:string,args:string>>"


def expected_tools(calls: Column | str, expected: Column | str, forbidden: Column | str, depth: int = DEPTH) -> Column:
    """1.0 if each expected call finds, after the one before, a call of its name whose args hold its args, and no forbidden tool is called.

    calls, expected: JSON lists of {name, args}; forbidden: JSON list of names. No
    expectations pass.
    """
    calls, expected, forbidden = (F.col(c) if isinstance(c, str) else c for c in (calls, expected, forbidden))
    made = F.coalesce(F.from_json(calls, _CALLS), F.array().cast(_CALLS))
    deep = F.raise_error(F.lit(f"an expected call has args deeper than {depth} levels")).cast("string")
    want = F.transform(F.coalesce(F.from_json(expected, _CALLS), F.array().cast(_CALLS)), lambda e: F.struct(e["name"].alias("name"), F.when(jsontext.deeper(e["args"], depth), deep).otherwise(e["args"]).alias("args")))
    # leaves are made only where names agree: a call meets one expected call at most
    holds = lambda e, c: F.get(F.transform(F.array(jsontext.wanted_leaves(e["args"], depth)), lambda w: F.when(F.size(w) == 0, True).otherwise(jsontext.met(w, jsontext.leaves(c["args"], depth)))), F.lit(0))
    fits = lambda e, c: F.when(e["name"] == c["name"], holds(e, c)).otherwise(False)
    # both lists are made once, then the expected calls are crossed off in order
    lists = F.array(F.struct(made.alias("made"), want.alias("want")))
    left = F.transform(lists, lambda x: F.size(x["want"]) - F.aggregate(x["made"], F.lit(0), lambda at, c: F.when((at < F.size(x["want"])) & fits(F.get(x["want"], at), c), at + 1).otherwise(at)))
    taboo = F.coalesce(F.from_json(forbidden, "array<string>"), F.array().cast("array<string>"))
    return ((F.get(left, F.lit(0)) == 0) & ~F.arrays_overlap(F.transform(made, lambda c: F.coalesce(c["name"], F.lit(""))), taboo)).cast("double")


def names_in_order(names: Column, expected: Column) -> Column:
    """expected_tools for calls without args, in the JVM: how many expected names are met in order equals all."""
    step = lambda at, name: F.when(F.get(expected, at) == name, at + 1).otherwise(at)
    return (F.aggregate(names, F.lit(0), step) == F.size(expected)).cast("double")


def forbidden_used(names: Column, forbidden: Column) -> Column:
    """The forbidden names that were called, in call order, repeats kept."""
    return F.filter(names, lambda n: F.array_contains(forbidden, n))


def _match(mode: str, args: str, have: list[dict], want: list[dict]) -> bool:
    def same(h: dict, w: dict) -> bool:
        if h.get("name") != w.get("name"):
            return False
        a, b = h.get("args") or {}, w.get("args") or {}
        return args == "ignore" or (a == b if args == "exact" else part_of(a, b))

    def covered(small: list[dict], suits: Callable[[dict, dict], bool], big: list[dict]) -> bool:
        return len(small) <= len(big) and all_matched([[i for i, b in enumerate(big) if suits(s, b)] for s in small])

    if mode == "strict":
        return len(have) == len(want) and all(map(same, have, want))
    if mode == "subset":
        return covered(have, same, want)
    return (mode == "superset" or len(have) == len(want)) and covered(want, lambda w, h: same(h, w), have)


def trajectory_match(mode: str = "unordered", args: str = "subset") -> Callable[..., Column]:
    """A function of (calls, reference) as JSON text: strict, unordered, subset or superset; null without a reference.

    Without order, calls and reference are matched one to one (bipartite matching), so a
    call that suits several references takes none that another needs.
    """
    if mode not in ("strict", "unordered", "subset", "superset") or args not in ("exact", "ignore", "subset"):
        raise ValueError(f"unknown trajectory match {mode}/{args}")

    @F.pandas_udf(T.DoubleType())
    def score(calls: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else float(_match(mode, args, json.loads(c or "[]"), json.loads(r))) for c, r in zip(calls, reference, strict=True)], dtype=float)

    return score


def score_table(runs: DataFrame, evaluators: dict[str, Column]) -> DataFrame:
    """run_ordinal, case_id, metric, outcome, score, comment: a row a run row and evaluator.

    A run that failed (error) scores 0.0 for every evaluator, also for those that don't
    apply; otherwise a null score is skipped. Evaluators read only rows without error, as
    a Python function under when() would see all rows: the table is split and united.
    """
    def long(rows: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), value(c).cast("double").alias("score")) for m, c in evaluators.items()])
        return rows.select("run_ordinal", "case_id", F.explode(cells).alias("e"), "error")

    good = long(runs.where("error is null"), lambda c: c)
    bad = long(runs.where("error is not null"), lambda c: F.lit(0.0))
    both = good.unionByName(bad)
    return both.select("run_ordinal", "case_id", "e.metric", F.when(F.col("e.score").isNull(), "skipped").otherwise("scored").alias("outcome"), "e.score", F.substring("error", 1, 300).alias("comment"))


def judged(runs: DataFrame, metric: str, judge: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Scores by a model: ``judge`` gets a batch of rows and gives score, comment and error a row, once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = judge(batch)
            failed = got["error"].notna()
            yield pd.DataFrame({"run_ordinal": batch["run_ordinal"], "case_id": batch["case_id"].astype(str), "metric": metric, "outcome": ["error" if f else "scored" if s == s and s is not None else "skipped" for f, s in zip(failed, got["score"], strict=True)], "score": got["score"].astype(float), "comment": got["comment"].where(~failed, got["error"])})

    return runs.where("error is null").mapInPandas(run, "run_ordinal int, case_id string, metric string, outcome string, score double, comment string")


def join_cases(case_runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Run rows with their case; rows of unknown cases fall away. Spark broadcasts the cases if they are few."""
    return case_runs.join(cases, "case_id")


def error_counts(case_runs: DataFrame) -> DataFrame:
    """error_class, n of the runs that failed; a failure without class is the agent's."""
    failed = case_runs.where("error is not null")
    return failed.groupBy(F.coalesce("error_class", F.lit("agent")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def all_infrastructure(case_runs: DataFrame) -> DataFrame:
    """One row: abort, whether there are runs and every one failed for reasons of infrastructure."""
    ours = F.col("error").isNotNull() & (F.col("error_class") == "infrastructure")
    return case_runs.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_and(F.coalesce(ours, F.lit(False))), F.lit(False)).alias("all")).select((F.col("some") & F.col("all")).alias("abort"))


def expectation_problems(text: Column, needle: Column, taboo: Column) -> Column:
    """Violations of a simulation's expectations on all the assistant said, as an array."""
    low = F.lower(text)
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    missing = F.when((F.coalesce(needle, F.lit("")) != "") & ~F.contains(low, F.lower(needle)), F.concat(F.lit("expected assistant text containing "), quoted(needle)))
    said = F.when((F.coalesce(taboo, F.lit("")) != "") & F.contains(low, F.lower(taboo)), F.concat(F.lit("forbidden assistant text "), quoted(taboo), F.lit(" appeared")))
    return F.filter(F.array(missing, said), lambda x: x.isNotNull())
