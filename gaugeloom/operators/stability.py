"""Do repeats agree? First by what the agent did, then, if it did the same, by the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scores import rounded, scored


def behaviour(case_runs: DataFrame) -> DataFrame:
    """case_id, trajectories, outputs (distinct hashes, exact), llm_mock_calls, runs.

    case_runs: case_id, trajectory_hash, output_hash and, if known, llm_mock_calls. A
    case's repeats are few, so its distinct hashes are small sets, combined on the map side.
    """
    llm = F.sum("llm_mock_calls") if "llm_mock_calls" in case_runs.columns else F.lit(0)
    return case_runs.groupBy("case_id").agg(
        F.size(F.collect_set("trajectory_hash")).cast("long").alias("trajectories"), F.size(F.collect_set("output_hash")).cast("long").alias("outputs"),
        F.coalesce(llm, F.lit(0)).cast("long").alias("llm_mock_calls"), F.count(F.lit(1)).alias("runs"),
    )


def disagreeing(scores: DataFrame) -> DataFrame:
    """case_id, metric of scores that differ between repeats."""
    return scored(scores).groupBy("case_id", "metric").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).where("n > 1 and lo <> hi").select("case_id", "metric", "lo", "hi")


def unstable_cases(seen: DataFrame, scores: DataFrame) -> DataFrame:
    """case_id, trajectories, llm_mock_calls, metrics (that disagree, sorted)."""
    shaky = seen.where("trajectories > 1").select("case_id", "trajectories", "llm_mock_calls")
    metrics = disagreeing(scores).groupBy("case_id").agg(F.sort_array(F.collect_set("metric")).alias("metrics"))
    return shaky.join(metrics, "case_id", "left").withColumn("metrics", F.coalesce("metrics", F.array().cast("array<string>")))


def score_flips(seen: DataFrame, scores: DataFrame, judges: list[str]) -> DataFrame:
    """case_id, metric, lo, hi, kind: scores that differ although the agent did the same; of a judge, or of a rule on a changed output."""
    steady = seen.where("trajectories <= 1").select("case_id")
    kind = F.when(F.col("metric").isin(judges), "evaluator").otherwise("output")
    return disagreeing(scores).join(steady, "case_id", "left_semi").withColumn("kind", kind)


def summary(seen: DataFrame) -> DataFrame:
    """One row: cases, unstable, text_varies, llm_attributed, stable_fraction (null without cases)."""
    shaky = F.col("trajectories") > 1
    s = seen.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(shaky).alias("unstable"), F.count_if(F.col("outputs") > 1).alias("text_varies"),
        F.count_if(shaky & (F.col("llm_mock_calls") > 0)).alias("llm_attributed"),
    )
    return s.withColumn("stable_fraction", F.when(F.col("cases") > 0, rounded(1 - F.col("unstable") / F.col("cases"))))
