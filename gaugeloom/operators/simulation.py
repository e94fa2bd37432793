"""Simulated conversations: why each stopped, what it broke, and cases mined from failures.

messages: conv_id, ordinal, role, content. Outcomes are aggregates of each conversation's
messages, not a replay, so one shuffle on conv_id gives them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .evaluators import expectation_problems


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, transcript: the messages of a conversation in order. A conversation is as long as its turns allow."""
    return messages.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("transcript"))


def said(transcript: Column, role: str) -> Column:
    return F.transform(F.filter(transcript, lambda m: m["role"] == role), lambda m: m["content"])


def outcomes(talks: DataFrame) -> DataFrame:
    """``talks`` (conv_id, transcript, max_turns, success_contains, expect_contains, expect_not_contains) with turns, stop_reason, violations.

    Success is the first reply with the needle; what follows it is cut off, as a
    simulation would have stopped there, and so is what follows the last turn. Without
    success a conversation that used all its turns was truncated (max_turns) if another
    user message waited, else it is exhausted.
    """
    replies, asked = said(F.col("transcript"), "assistant"), said(F.col("transcript"), "user")
    needle = F.lower(F.coalesce("success_contains", F.lit("")))
    hits = F.transform(F.col("replies"), lambda r: F.contains(F.lower(F.coalesce(r, F.lit(""))), needle))
    t = talks.withColumn("replies", replies).withColumn("asked", asked)
    used = F.least(F.size("replies"), F.col("max_turns"))
    first = F.array_position(F.slice(hits, 1, F.greatest(used, F.lit(0))), True).cast("int")
    t = t.withColumn("first_hit", F.when((needle != "") & (first > 0), first)).withColumn("turns", F.coalesce(F.col("first_hit"), used).cast("int"))
    waiting = F.size("asked") > F.col("turns")
    reason = F.when(F.col("first_hit").isNotNull(), "success").when((F.col("turns") >= F.col("max_turns")) & waiting, "max_turns").otherwise("exhausted")
    t = t.withColumn("stop_reason", reason)
    text = F.array_join(F.slice("replies", 1, F.greatest("turns", F.lit(0))), " ")
    never = F.when((F.col("stop_reason") == "max_turns") & (needle != ""), F.array(F.concat(F.lit("never reached success condition '"), F.col("success_contains"), F.lit("' within "), F.col("max_turns").cast("string"), F.lit(" turns"))))
    violations = F.concat(expectation_problems(text, F.col("expect_contains"), F.col("expect_not_contains")), F.coalesce(never, F.array().cast("array<string>")))
    return t.withColumn("violations", violations).withColumn("transcript", played(F.col("transcript"), F.col("turns"))).drop("replies", "first_hit")


def played(transcript: Column, turns: Column) -> Column:
    """The transcript up to the reply of the last turn; with fewer replies all of it."""
    last = F.aggregate(
        transcript, F.struct(F.lit(0).alias("n"), F.lit(0).alias("replies"), F.lit(0).alias("cut")),
        lambda acc, m: F.struct((acc["n"] + 1).alias("n"), (acc["replies"] + (m["role"] == "assistant").cast("int")).alias("replies"), F.when((m["role"] == "assistant") & (acc["replies"] + 1 == turns), acc["n"] + 1).otherwise(acc["cut"]).alias("cut")),
    )["cut"]
    return F.when(last > 0, F.slice(transcript, F.lit(1), F.greatest(last, F.lit(1)))).otherwise(transcript)


def tail(messages: Column, n: int) -> Column:
    return F.slice(messages, F.greatest(F.lit(1), F.size(messages) - (n - 1)), n)


def mined(results: DataFrame) -> DataFrame:
    """conv_id, first_message, user_turns, transcript_tail, violations of conversations that broke something or were truncated and have a user message."""
    bad = results.where("(size(violations) > 0 or stop_reason = 'max_turns') and size(asked) > 0")
    rest = F.slice("asked", 2, F.greatest(F.least(F.size("asked"), F.greatest("turns", F.lit(1))) - 1, F.lit(0)))
    return bad.select("conv_id", F.get("asked", F.lit(0)).alias("first_message"), rest.alias("user_turns"), tail(F.col("transcript"), 4).alias("transcript_tail"), "violations", "stop_reason")


def totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("scenarios"), F.count_if(F.col("stop_reason") == "success").alias("successes"), F.count_if(F.size("violations") > 0).alias("with_violations"))


def call_deltas(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, calls: so far) with delta: the calls of the turn itself, never below 0."""
    before = F.lag("calls", 1, 0).over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("delta", F.greatest(F.lit(0), F.col("calls") - before))
