"""Live progress of runs, and conversations followed as their messages come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def progress(done: DataFrame) -> DataFrame:
    """group, done, errors, batch or stream alike: done has a row a finished case (group, error).

    One row a group stays in state, so the state is as large as the list of intents.
    """
    return done.groupBy("group").agg(F.count(F.lit(1)).alias("done"), F.count_if(F.coalesce(F.col("error"), F.lit(False))).alias("errors"))


def with_totals(counts: DataFrame, planned: DataFrame) -> DataFrame:
    """planned (group, total) with what is done and the fraction."""
    out = planned.join(counts, "group", "left").withColumn("done", F.coalesce("done", F.lit(0))).withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out.withColumn("fraction", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(F.lit(1.0)))


OUT = "conv_id long, turns int, stop_reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Talk(StatefulProcessor):
    """One conversation: its replies so far, and a timer for its silence.

    The state of a conversation goes when it is over or falls silent. That it is over is
    remembered for as long as its messages may come late, by a timer too, and then
    forgotten.
    """

    def __init__(self, needle: str, max_turns: int, idle_ms: int) -> None:
        self.needle, self.max_turns, self.idle_ms = needle.lower(), max_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.talk = handle.getValueState("talk", "turns int, over boolean, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turns, over, before = self.talk.get() if self.talk.exists() else (0, False, None)
        messages = pd.concat(list(rows)).sort_values("turn", kind="stable")
        reason = None
        for role, text in zip(messages["role"], messages["text"], strict=True):
            if over:
                break
            if role == "user":
                reason = "max_turns" if turns >= self.max_turns else None
            elif role == "assistant":
                turns += 1
                reason = "success" if self.needle and self.needle in (text or "").lower() else None
            over = reason is not None
        at = max(int(messages["ts"].max().timestamp() * 1000), before - self.idle_ms if before else 0) + self.idle_ms
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.talk.update((turns, over, at))
        if reason is not None:
            yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "stop_reason": [reason]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns, over, _ = self.talk.get() if self.talk.exists() else (0, True, None)
        self.talk.clear()
        if not over:
            yield pd.DataFrame({"conv_id": [key[0]], "turns": [min(turns, self.max_turns)], "stop_reason": ["exhausted"]})

    def close(self) -> None:
        pass


def follow(messages: DataFrame, needle: str, max_turns: int, idle_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """A row for each conversation that ends: success as soon as a reply holds the needle, max_turns when a user goes on after the last turn, exhausted when it has been silent for ``idle_seconds``.

    messages (a stream): conv_id, turn, role, text, ts. Messages of a batch are put in
    order of turn; a conversation that is over ignores what follows. Time is that of the
    messages, which may come ``late``. The session keeps state in RocksDB from here on.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = messages.withWatermark("ts", late).groupBy("conv_id")
    return keyed.transformWithStateInPandas(Talk(needle, max_turns, idle_seconds * 1000), OUT, "Append", "EventTime")


def conversations(cases: DataFrame, agent, max_turns: int = 20) -> DataFrame:
    """Plays each case (case_id, opening, user_turns) against ``agent``, a function of the messages so far that returns a reply.

    A failing turn ends the conversation, empties its response and keeps its log. Cases
    are played in the tasks that hold them; the agent is built once a task if it has a
    method ``start``.
    """
    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = agent.start() if hasattr(agent, "start") else agent
        for batch in batches:
            out = []
            for case_id, opening, more in zip(batch["case_id"], batch["opening"], batch["user_turns"], strict=True):
                talk, error, n = [], None, 0
                for message in [opening, *(more if more is not None else [])][:max_turns]:
                    talk.append({"role": "user", "content": message})
                    n += 1
                    try:
                        talk.append({"role": "assistant", "content": str(own(talk))})
                    except Exception as e:  # noqa: BLE001 - an agent's failure is a result
                        error = f"{type(e).__name__}: {e}"[:300]
                        break
                out.append((case_id, None if error else talk[-1]["content"], n, error, talk))
            yield pd.DataFrame(out, columns=["case_id", "response", "turns", "error", "transcript"])

    return cases.mapInPandas(play, "case_id string, response string, turns int, error string, transcript array<struct<role:string,content:string>>")
