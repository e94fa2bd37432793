"""Scores of repeated runs: per-run statistics, pass rates, slices and the verdict.

Input is the long table ``scores`` (run_ordinal, case_id, metric, outcome, score, comment)
with outcome scored, error or skipped. Pass rates are macro averages: the mean over cases
of each case's mean over repeats. Both levels are plain groupBys, so the first combines
on the map side and only one row a case and metric is shuffled again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.positions import even_chunk, numbered
from ..schemas import EMPTY, SLICE_DIMS

DIGITS = 4


def rounded(value: Column, digits: int = DIGITS) -> Column:
    """Half to even, as recorded results are rounded."""
    return F.bround(value, digits)


def scored(scores: DataFrame) -> DataFrame:
    return scores.where("outcome = 'scored'")


def run_stats(scores: DataFrame) -> DataFrame:
    """run_ordinal, metric, n, avg, min, max, errors, skipped. A metric without scores has n 0 and nulls."""
    hit = F.when(F.col("outcome") == "scored", F.col("score"))
    return scores.groupBy("run_ordinal", "metric").agg(
        F.count(hit).alias("n"), F.avg(hit).alias("avg"), F.min(hit).alias("min"), F.max(hit).alias("max"),
        F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )


def by_dimension(rows: DataFrame, dims: tuple[str, ...] = SLICE_DIMS) -> DataFrame:
    """Each row once a dimension, as dim and value; a missing value is ``unspecified``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit(EMPTY)).alias("value")) for d in dims])
    return rows.withColumn("_slice", F.explode(pairs)).withColumn("dim", F.col("_slice.dim")).withColumn("value", F.col("_slice.value")).drop("_slice", *dims)


def run_slices(scores: DataFrame, cases: DataFrame, dims: tuple[str, ...] = SLICE_DIMS) -> DataFrame:
    """Micro means: run_ordinal, dim, value, metric, n, avg over the scored rows of a run.

    Rows are added up by all tags at once before a row becomes one a dimension.
    """
    known = scored(scores).join(cases.select("case_id", *dims), "case_id", "left")
    cells = known.groupBy("run_ordinal", "metric", *dims).agg(F.count("score").alias("c"), F.sum("score").alias("s"))
    sums = by_dimension(cells, dims).groupBy("run_ordinal", "dim", "value", "metric").agg(F.sum("c").alias("n"), F.sum("s").alias("s"))
    return sums.select("run_ordinal", "dim", "value", "metric", "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("avg"))


def case_means(scores: DataFrame) -> DataFrame:
    """case_id, metric, mean, low, n: a case's repeats in one row a metric."""
    return scored(scores).groupBy("case_id", "metric").agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.count("score").alias("n"))


def case_cells(scores: DataFrame, skipped: bool = False) -> DataFrame:
    """case_id, metric, total, n, low, high, bad: a case's repeats in one row a metric, in parts that can be merged.

    With ``skipped`` also the metrics that a case was only skipped for: they tell that it ran.
    """
    hit = F.when(F.col("outcome") == "scored", F.col("score"))
    return (scores if skipped else scores.where("outcome <> 'skipped'")).groupBy("case_id", "metric").agg(
        F.sum(hit).alias("total"), F.count_if(F.col("outcome") == "scored").alias("n"), F.min(hit).alias("low"), F.max(hit).alias("high"), F.count_if(F.col("outcome") == "error").alias("bad"),
    )


def merged_cells(cells: DataFrame) -> DataFrame:
    """The cells of all scores from those of parts of them."""
    return cells.groupBy("case_id", "metric").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bad").alias("bad"))


def _mean() -> Column:
    return F.when(F.col("n") > 0, F.col("total") / F.col("n"))


def rates_of_cells(cells: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.6) -> DataFrame:
    """metric_rates from a case's cells."""
    rates = cells.withColumn("mean", _mean()).groupBy("metric").agg(
        F.avg("mean").alias("pass_rate"), F.avg("low").alias("min_over_repeats"), F.count("mean").alias("n_cases"),
        F.sum("n").alias("n_scores"), F.sum("bad").alias("errors"),
    )
    return rates.withColumn("threshold", threshold_of(F.col("metric"), thresholds, default)).withColumn("passed", F.coalesce(F.col("pass_rate") >= F.col("threshold"), F.lit(False)))


def metric_rates(scores: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.6) -> DataFrame:
    """metric, pass_rate, min_over_repeats, n_cases, n_scores, errors, threshold, passed; rates unrounded.

    Metrics that only failed keep a row with null rates; metrics that were only skipped have none.
    """
    return rates_of_cells(case_cells(scores), thresholds, default)


def threshold_of(metric: Column, thresholds: dict[str, float] | None, default: float) -> Column:
    if not thresholds:
        return F.lit(float(default))
    known = F.create_map(*[F.lit(x) for pair in ((k, float(v)) for k, v in thresholds.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, metric), F.lit(float(default)))


def cube(scores: DataFrame, cases: DataFrame, dims: tuple[str, ...] = SLICE_DIMS) -> DataFrame:
    """dim, value, metric, n, rate, low, n_cases, n_scores, errors: all that rates, slices and the verdict need, from one pass.

    The dim ``all`` has the metrics over all cases. A row without metric has the number n
    of cases of its slice. A case's repeats are combined before they are shuffled; scores
    and cases meet by case_id, where a case is one row with its metrics, of which there
    are few; cases of equal tags are added up before they become a row a dimension.
    """
    return cube_of_cells(case_cells(scores, True), cases, dims)


def cube_of_cells(cells: DataFrame, cases: DataFrame, dims: tuple[str, ...] = SLICE_DIMS) -> DataFrame:
    """The cube from case_cells, those of skipped metrics included."""
    per = cells.select("case_id", "metric", _mean().alias("mean"), "low", "n", "bad")
    own = per.groupBy("case_id").agg(F.collect_list(F.struct("metric", "mean", "low", "n", "bad")).alias("own"))
    known = own.join(cases.select("case_id", *dims), "case_id", "left")
    marker = F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("low"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))
    tagged = known.select(*dims, F.explode(F.concat("own", marker)).alias("m")).groupBy(*dims, "m.metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("m.mean").alias("means"), F.sum("m.low").alias("lows"), F.count("m.mean").alias("cases"), F.sum("m.n").alias("scores"), F.sum("m.bad").alias("bad"),
    )
    rows = by_dimension(tagged.withColumn("all", F.lit("all")), ("all", *dims))
    average = lambda c: F.try_divide(F.sum(c), F.sum("cases"))
    return rows.groupBy("dim", "value", "metric").agg(
        F.sum("rows").alias("n"), average("means").alias("rate"), average("lows").alias("low"), F.sum("cases").alias("n_cases"),
        F.sum("scores").alias("n_scores"), F.sum("bad").alias("errors"),
    )


def cube_rates(cells: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.6) -> DataFrame:
    """metric_rates from a cube."""
    m = cells.where("dim = 'all' and metric is not null and (n_scores > 0 or errors > 0)")
    m = m.select("metric", F.col("rate").alias("pass_rate"), F.col("low").alias("min_over_repeats"), "n_cases", "n_scores", "errors")
    return m.withColumn("threshold", threshold_of(F.col("metric"), thresholds, default)).withColumn("passed", F.coalesce(F.col("pass_rate") >= F.col("threshold"), F.lit(False)))


def cube_slices(cells: DataFrame, slice_min: float = 0.5, as_recorded: bool = True) -> DataFrame:
    """slice_rates from a cube."""
    own = cells.where("dim <> 'all'")
    sizes = own.where("metric is null").select("dim", "value", "n")
    rate = rounded(F.col("rate"))
    rates = own.where("metric is not null and n_cases > 0").select("dim", "value", "metric", rate.alias("rate"), ((rate if as_recorded else F.col("rate")) >= slice_min).alias("passed"))
    return sizes.join(rates, ["dim", "value"], "left").select("dim", "value", "n", "metric", "rate", F.coalesce("passed", F.lit(True)).alias("passed"))


def slice_rates(scores: DataFrame, cases: DataFrame, slice_min: float = 0.5, dims: tuple[str, ...] = SLICE_DIMS, as_recorded: bool = True) -> DataFrame:
    """Macro means: dim, value, metric, n (cases of the slice, scored or not), rate (rounded), passed.

    A slice passes by its rate as it is recorded, rounded; without ``as_recorded`` by the unrounded one.
    """
    return cube_slices(cube(scores, cases, dims), slice_min, as_recorded)


def weak_slices(rates: DataFrame) -> DataFrame:
    """dim, value, weak: slices of which a metric doesn't pass; a slice without metrics passes."""
    return rates.groupBy("dim", "value").agg(F.bool_and("passed").alias("passed"), F.max("n").alias("n")).where("not passed").select("dim", "value", "n", F.concat_ws("=", "dim", "value").alias("weak"))


def verdict(rates: DataFrame, weak: DataFrame, slice_min: float = 0.5, overall_pass: float = 0.6, dims: tuple[str, ...] = SLICE_DIMS) -> DataFrame:
    """One row: verdict, overall_score, n_metrics, n_weak, reasons (metrics by name, slices by dimension, the overall score).

    rates and weak have a row a metric and a slice, so the arrays are short.
    """
    m = rates.agg(
        rounded(F.avg("pass_rate")).alias("overall_score"), F.count(F.lit(1)).alias("n_metrics"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("metrics_ok"),
        F.sort_array(F.collect_list(F.when(~F.col("passed"), F.struct("metric", rounded(F.col("pass_rate")).alias("rate"), "threshold")))).alias("missed"),
    )
    place = reduce(lambda acc, d: F.when(F.col("dim") == d[1], d[0]).otherwise(acc), enumerate(dims), F.lit(len(dims)))
    w = weak.agg(F.count(F.lit(1)).alias("n_weak"), F.sort_array(F.collect_list(F.struct(place.alias("place"), "value", "weak"))).alias("weak"))
    both = m.join(w)  # one row each
    low = F.col("overall_score").isNotNull() & (F.col("overall_score") < overall_pass)
    reasons = F.concat(
        F.when(F.col("n_metrics") == 0, F.array(F.lit("no metrics were scored"))).otherwise(F.array().cast("array<string>")),
        F.transform("missed", lambda x: F.concat(F.lit("metric "), x["metric"], F.lit(" "), F.coalesce(x["rate"].cast("string"), F.lit("None")), F.lit(" < "), x["threshold"].cast("string"))),
        F.transform("weak", lambda x: F.concat(F.lit("slice "), x["weak"], F.lit(f" below slice_min {slice_min}"))),
        F.when(low, F.array(F.concat(F.lit("overall "), F.col("overall_score").cast("string"), F.lit(f" < {overall_pass}")))).otherwise(F.array().cast("array<string>")),
    )
    ok = (F.col("n_metrics") > 0) & F.col("metrics_ok") & (F.col("n_weak") == 0) & (F.coalesce(F.col("overall_score"), F.lit(-1.0)) >= overall_pass)
    return both.select(F.when(ok, "pass").otherwise("fail").alias("verdict"), "overall_score", "n_metrics", "n_weak", reasons.alias("reasons"))


def verdict_of(scores: DataFrame, cases: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.6, slice_min: float = 0.5, overall_pass: float = 0.6, dims: tuple[str, ...] = SLICE_DIMS, as_recorded: bool = True) -> DataFrame:
    """The verdict from scores and cases in one pass over the scores; ``as_recorded`` as of slice_rates."""
    cells = cube(scores, cases, dims)
    return verdict(cube_rates(cells, thresholds, default), weak_slices(cube_slices(cells, slice_min, as_recorded)), slice_min, overall_pass, dims)


def incomplete(verdicts: DataFrame, stages: DataFrame, required: list[str]) -> DataFrame:
    """The verdict becomes ``incomplete`` if a required stage is neither ok nor recovered."""
    done = stages.where(F.col("stage").isin(required) & F.col("status").isin("ok", "recovered")).agg(F.countDistinct("stage").alias("_done"))
    return verdicts.join(done).withColumn("verdict", F.when(F.col("_done") < len(set(required)), "incomplete").otherwise(F.col("verdict"))).drop("_done")


def evaluator_errors(scores: DataFrame) -> DataFrame:
    return scores.where("outcome = 'error'").groupBy("metric").agg(F.count(F.lit(1)).alias("errors"))


def dead_evaluators(stats: DataFrame) -> DataFrame:
    """Metrics of the first run without a score but with errors."""
    return stats.where("run_ordinal = 0 and n = 0 and errors > 0").select("metric", "errors")


#: What a judge writes when it hasn't judged (a fixed pattern).
SUSPECT = r"(?i)^\s*(test\b|placeholder|lorem)"


def suspect_comments(scores: DataFrame, judges: list[str], width: int = 160) -> DataFrame:
    hit = F.col("metric").isin(judges) & F.col("comment").rlike(SUSPECT)
    return scored(scores).where(hit).select("case_id", "run_ordinal", "metric", F.substring("comment", 1, width).alias("comment"))


def case_rows(scores: DataFrame) -> DataFrame:
    """case_id, metric, scores in repeat order, mean (rounded), comments of scores below 1 (cut at 300)."""
    one = F.struct("run_ordinal", "score", F.when(F.col("score") < 1, F.substring("comment", 1, 300)).alias("comment"))
    rows = scored(scores).groupBy("case_id", "metric").agg(F.sort_array(F.collect_list(one)).alias("s"), rounded(F.avg("score")).alias("mean"))
    comments = F.filter(F.col("s.comment"), lambda c: c.isNotNull() & (c != ""))
    return rows.select("case_id", "metric", F.col("s.score").alias("scores"), "mean", comments.alias("comments"))


def failing_cases(scores: DataFrame, agent_errors: DataFrame | None = None) -> DataFrame:
    """case_id, metrics (name to mean, below 1), comments (first two of each), agent_errors (first two)."""
    bad = case_rows(scores).where("mean < 1").groupBy("case_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "mean")))).alias("metrics"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.slice("comments", 1, 2).alias("c"))))).alias("comments"),
    )
    if agent_errors is None:
        return bad.withColumn("agent_errors", F.array().cast("array<string>"))
    errs = agent_errors.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("run_ordinal", "error"))).alias("e"))
    first = F.slice(F.coalesce("e.error", F.array().cast("array<string>")), 1, 2)
    return bad.join(errs, "case_id", "full").withColumn("agent_errors", first).drop("e")


def case_drilldown(cases: DataFrame, case_runs: DataFrame, scores: DataFrame, case_id: object) -> DataFrame:
    """One row: the case, its runs, how many failed, its scored marks and their mean; zeros and nulls where it never ran."""
    of = lambda rows: rows.where(F.col("case_id") == case_id)
    ran = of(case_runs).groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"), F.count("error").alias("failed"))
    marks = of(scored(scores)).groupBy("case_id").agg(F.count("score").alias("marks"), rounded(F.avg("score")).alias("mean"))
    out = of(cases).join(ran, "case_id", "left").join(marks, "case_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("runs", "failed", "marks")})


def score_matrix(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a case and run, a column a metric; the metrics are named, so no pass finds them.

    Each metric is a column of one aggregation: a pivot would first aggregate by metric too,
    in a table of as many rows as there are scores.
    """
    return scored(scores).groupBy("case_id", "run_ordinal").agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])


def matrix_rows(matrix: DataFrame, metrics: list[str]) -> DataFrame:
    """score_matrix back to one row a score; empty cells vanish."""
    return matrix.unpivot(["case_id", "run_ordinal"], metrics, "metric", "score").where("score is not null")


def contiguous_chunks(rows: DataFrame, order: str, n: int) -> DataFrame:
    """chunk 0..n-1: near-equal runs in order, of any number of rows."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))  # one row
    placed = numbered(rows, [order], "_at").join(total)
    return placed.withColumn("chunk", even_chunk(F.col("_at"), F.col("_total"), n)).drop("_at", "_total")
