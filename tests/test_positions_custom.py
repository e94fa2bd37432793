"""Positions of any number of rows, greedy takes by size, ends of logs, evaluators in SQL."""

from __future__ import annotations

import io
import random
import sys

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions.positions import even_chunk, numbered, numbered_within
from gaugeloom.operators import coverage as cov, custom, scores as sc
from gaugeloom.sources import artifacts as art
from gaugeloom.sources.tail import last_lines


def test_positions_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(10**6), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, x int, i int").repartition(5)
    got = {r.i: r.position for r in numbered(frame, [F.col("x").desc(), "i"]).collect()}
    assert got == {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    within = {r.i: r.position for r in numbered_within(frame, ["k"], ["x", "i"]).collect()}
    want = {}
    for key in ("a", "b", None):
        want |= {i: n for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]))}
    assert within == want
    plan = numbered(frame, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert numbered(frame.limit(0), ["x"]).count() == 0 and plan.count("Window") <= 2  # the one over the counts of the ranges


@pytest.mark.parametrize(("rows", "n"), [(7, 3), (3, 7), (0, 2), (12, 4), (1001, 10)])
def test_chunks_are_near_equal(spark, rows, n):
    sizes = [rows // n + (i < rows % n) for i in range(n)]
    got = sorted((r.id, r.chunk) for r in sc.contiguous_chunks(spark.range(rows), "id", n).collect())
    assert [c for _, c in got] == [c for c, size in enumerate(sizes) for _ in range(size)]
    assert spark.range(rows).select(even_chunk(F.col("id"), F.lit(rows), n).alias("c")).agg(F.max("c")).first()[0] == (None if not rows else max(c for c, size in enumerate(sizes) if size))


def folded(sizes, wanted):
    takes = []
    for size in sorted(sizes, reverse=True):
        take = min(size, max(1, wanted // 2)) if wanted > 0 else 0
        wanted -= take
        takes.append(take)
    return takes


def test_takes_by_size_equal_the_fold():
    rng = random.Random(2)
    for _ in range(800):
        sizes = [rng.choice([0, 1, 1, 1, 2, 3, rng.randrange(1, 40), rng.randrange(1, 2000)]) for _ in range(rng.randrange(1, 60))]
        wanted = rng.randrange(0, sum(sizes) + 5)
        grouped = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
        parts, end = cov.halving_takes(grouped, wanted)
        flat = sorted(sizes, reverse=True)
        assert [parts.get(i, s if i < end else 0) for i, s in enumerate(flat)] == folded(sizes, wanted)
        assert len(parts) <= 2 * max(1, wanted).bit_length() + 2
    parts, end = cov.halving_takes([(10**6, 3), (10, 10**9), (1, 10**12)], 10**9)
    assert end > 10**7 and len(parts) < 80  # no loop over cells


def test_multi_turn_of_random_plans(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, rng.choice(["happy", "failure", "cross", None]), rng.randrange(0, 30)) for i in range(80)]
        share = rng.choice([0.0, 0.1, 0.35, 1.0])
        got = {r.ordinal: r.multi_turn for r in cov.multi_turn(spark.createDataFrame(rows, "ordinal int, kind string, count int"), share).collect()}
        own = sorted((r for r in rows if r[1] in ("happy", "failure")), key=lambda r: (-r[2], r[0]))
        want = {i: 0 for i, *_ in rows} | dict(zip([r[0] for r in own], folded([r[2] for r in own], round(share * sum(r[2] for r in rows))), strict=True))
        assert got == want
    assert cov.multi_turn(spark.createDataFrame([], "ordinal int, kind string, count int"), 0.5).count() == 0


def test_last_lines_are_read_backwards():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["é", "a", "\n", "\r\n", " ", "long" * 9]) for _ in range(rng.randrange(80)))
        data = text.encode()
        lines = rng.randrange(1, 12)
        stripped = text.rstrip(" \t\r\n\x0b\x0c")
        want = [x.removesuffix("\r") for x in stripped.split("\n")][-lines:] if stripped else []
        assert last_lines(io.BytesIO(data), len(data), lines, block=rng.choice([1, 3, 7, 1000])) == want


def test_the_end_of_a_large_log_is_cheap(spark, tmp_path):
    log = tmp_path / "run.log"
    with log.open("wb") as out:
        for _ in range(200):
            out.write(b"x" * (1 << 20))  # one line of 200 MB before the last ones
        out.write("".join(f"\nline {i} é" for i in range(500)).encode() + b"\n\n")

    class Counted(io.FileIO):
        got = 0

        def read(self, n=-1):
            piece = super().read(n)
            Counted.got += len(piece)
            return piece

    assert last_lines(Counted(str(log)), log.stat().st_size, 40)[0] == "line 460 é" and Counted.got < 1 << 20
    rows = art.log_tail(spark, str(log), 3).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [(0, "line 497 é"), (1, "line 498 é"), (2, "line 499 é")]
    (tmp_path / "empty.log").write_text("\n \n")
    assert art.log_tail(spark, str(tmp_path / "empty.log")).count() == 0


EVALUATORS = '''
def share(row, memory):
    if row["text"] is None:
        return None
    if row["text"] == "boom":
        raise ValueError("no")
    return len(row["text"]) / 4
'''


def test_evaluators_named_in_sql(spark, tmp_path):
    (tmp_path / "own_evaluators.py").write_text(EVALUATORS)
    spark.sparkContext.addPyFile(str(tmp_path / "own_evaluators.py"))
    sys.path.insert(0, str(tmp_path))
    custom.register(spark, "score_share", "own_evaluators:share")
    runs = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "boom"), (None, "xxxx"), ("a", "x")], "case_id string, text string")
    got = spark.sql("SELECT * FROM score_share(TABLE({r}))", r=runs)
    assert got.columns == ["case_id", "metric", "outcome", "score", "comment"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "share", "scored", 0.5, None), ("b", "share", "skipped", None, None), ("c", "share", "error", None, "ValueError: no"), (None, "share", "scored", 1.0, None), ("a", "share", "scored", 0.25, None)], key=str)
    with pytest.raises(Exception, match="no case_id"):
        spark.sql("SELECT * FROM score_share(TABLE({r}))", r=runs.withColumnRenamed("case_id", "other")).collect()
    with pytest.raises(ValueError, match="module:function"):
        custom.register(spark, "x", "nothing")


def test_evaluators_remember_a_case_in_the_order_of_its_runs(spark):
    custom.register(spark, "score_longer", "gaugeloom.operators.custom:longer_than_before", "longer")
    rows = [(f"c{i % 3}", i, (i * 37) % 50 if i % 7 else None) for i in range(60)]
    runs = spark.createDataFrame(random.Random(5).sample(rows, 60), "case_id string, run_ordinal int, n_chars int").repartition(4)
    got = {(r.case_id, r.run_ordinal): r.score for r in spark.sql("SELECT * FROM score_longer(TABLE({r}))", r=runs).collect()}
    most, want = {}, {}
    for case, i, size in rows:
        want[case, i] = None if size is None else float(size > most.get(case, -1))
        most[case] = max(most.get(case, -1), size or -1)
    assert got == want
