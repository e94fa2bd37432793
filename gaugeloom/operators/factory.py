"""From evaluator specs to scores in one call: each spec becomes a column expression, or a judge that is given by the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import custom
from .evaluators import DETERMINISTIC, JUDGED, contains_all, expected_tools, join_cases, judged, score_table, trajectory_match, valid_json

#: Columns of a run joined with its case: response (text), calls and trajectory (JSON lists of {name, args}), reference (JSON object).
RUN = ("response", "calls", "reference")

Judge = Callable[[pd.DataFrame], pd.DataFrame]


def reference(name: str) -> Column:
    return F.get_json_object("reference", f"$.{name}")


def needles(spec: dict) -> Column:
    """The texts a response must contain: of the spec, else of the case, one or several; none if neither names any."""
    value = spec.get("value")
    if value:
        return F.array(*[F.lit(v) for v in ([value] if isinstance(value, str) else value)])
    own = reference("contains")
    listed = F.from_json(own, "array<string>")
    return F.when(own.startswith("["), listed).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def own_function(ref: str) -> Column:
    """A function module:function of one row; it remembers nothing. Errors are its scores' absence."""
    custom.named(ref)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        evaluate = custom.named(ref)
        return pd.Series([custom.outcome(evaluate(row, {}))[1] for row in rows.to_dict("records")], dtype=float)

    return score(F.struct(*RUN))


def key_of(spec: dict) -> str:
    """The metric a spec makes: its name, else what its type or prompt says."""
    kind = spec.get("type", "")
    if kind in DETERMINISTIC:
        return kind
    prompt = str(spec.get("prompt") or "").lower().removesuffix("_prompt")
    return spec.get("name") or (prompt if kind == "openevals" else "") or kind


def column_of(spec: dict) -> Column | None:
    """The expression of a spec over RUN; None for a judge. A type that is none of these, without a prompt, is an error."""
    kind = spec.get("type", "")
    if kind == "expected_tools":
        return expected_tools(F.col("calls"), reference("expected_tools"), reference("forbidden_tools"))
    if kind == "contains":
        return contains_all(F.col("response"), needles(spec))
    if kind == "json_valid":
        return valid_json(F.coalesce("response", F.lit("")))
    if kind == "trajectory_match":
        return trajectory_match(spec.get("match_mode", "unordered"), spec.get("args_match", "subset"))(F.col("calls"), F.nullif(reference("trajectory"), F.lit("[]")))
    if kind == "custom":
        return own_function(spec["ref"])
    if kind == "openevals" and not spec.get("prompt"):
        raise ValueError("an openevals evaluator needs a prompt")
    if kind in (*JUDGED, "openevals") or spec.get("prompt"):
        return None
    raise ValueError(f"unknown evaluator type {kind!r}")


def compiled(specs: list[dict]) -> tuple[dict[str, Column], dict[str, dict]]:
    """(metric to expression, metric to judge spec). Two specs of one metric are an error."""
    columns: dict[str, Column] = {}
    judges: dict[str, dict] = {}
    for spec in specs:
        key, found = key_of(spec), column_of(spec)
        if key in columns or key in judges:
            raise ValueError(f"two evaluators make {key}")
        if found is None:
            judges[key] = spec
        else:
            columns[key] = found
    return columns, judges


def scored_by(specs: list[dict], runs: DataFrame, cases: DataFrame, judges: dict[str, Judge] | None = None) -> DataFrame:
    """The score table of runs (run_ordinal, case_id, error, response, calls) of cases (case_id, reference) by all specs.

    ``judges``: a function for each metric that is judged; one that isn't given is an error.
    """
    columns, wanted = compiled(specs)
    lacking = sorted(set(wanted) - set(judges or {}))
    if lacking:
        raise ValueError(f"no judge for {', '.join(lacking)}")
    both = join_cases(runs, cases.select("case_id", "reference"))
    out = score_table(both, columns) if columns else None
    for metric in wanted:
        own = judged(both, metric, judges[metric])
        out = own if out is None else out.unionByName(own)
    return out
