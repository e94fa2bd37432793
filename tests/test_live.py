"""The artifact data source, publishing all or nothing, timers of silent talks, and views kept up to date."""

from __future__ import annotations

import pickle
import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from gaugeloom.operators import scores as sc
from gaugeloom.sources import artifacts as art, datasource as ds, publication as pub
from gaugeloom.streaming import progress as pg
from gaugeloom.streaming.incremental import LiveScores


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_listing_drops_files_before_they_are_opened(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"results/run-r{i}.json", json.dumps({"i": i}))
    put(tmp_path, "results/report-old.json", "{}")
    put(tmp_path, "dataset.json", b"\xff\xfe")
    put(tmp_path, "note.json", "{}")
    put(tmp_path, "evaluators.yaml", "a: [")
    put(tmp_path, "_staging/x/0", "half")
    rows = {os.path.basename(r.path): (r.kind, r.run_id, r.problem) for r in ds.artifacts(spark, str(tmp_path)).collect()}
    assert len(rows) == 34 and rows["run-r3.json"] == ("run", "r3", None) and rows["report-old.json"] == ("score_report", "old", None)
    assert rows["dataset.json"] == ("dataset", None, "not UTF-8") and rows["note.json"] == (None, None, "unknown kind") and rows["evaluators.yaml"] == ("evaluators", None, None)
    few = ds.artifacts(spark, f"file://{tmp_path}").where("kind = 'run' and run_id in ('r1', 'r2', 'gone')")
    assert "Filter (" not in few._jdf.queryExecution().executedPlan().toString()  # all of it is the source's
    assert sorted(r.run_id for r in few.collect()) == ["r1", "r2"]
    reader = ds.Reader(str(tmp_path))
    left = list(reader.pushFilters([EqualTo(("kind",), "run"), StringStartsWith(("run_id",), "r2"), GreaterThan(("size",), 1), In(("path",), (f"{tmp_path}/results/run-r2.json", f"{tmp_path}/results/run-r21.json"))]))
    assert left == [GreaterThan(("size",), 1)]
    assert [f.run_id for p in reader.partitions() for f in p.files] == ["r2", "r21"]


def test_partitions_are_packed_by_size():
    files = [ds.Artifact(f"f{i}", None, None, size, 0) for i, size in enumerate([10, 200 << 20, 10, 40 << 20, 30 << 20, *[0] * 9000])]
    parts = ds.packed(files)
    assert [f for p in parts for f in p.files] == files
    assert all(len(p.files) <= ds.PART_FILES and (len(p.files) == 1 or sum(f.size for f in p.files) <= ds.PART_BYTES) for p in parts)


def test_empty_and_missing_folders(spark, tmp_path):
    assert ds.artifacts(spark, str(tmp_path)).count() == 0
    assert ds.artifacts(spark, str(tmp_path / "none")).where("kind = 'run'").count() == 0


def test_stream_goes_on_from_the_last_file(spark, tmp_path):
    ds.register(spark)
    seen = []

    def go():
        stream = spark.readStream.format("artifacts").option("settleSeconds", "0").load(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(lambda rows, _: seen.append(sorted(os.path.basename(r.path) for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(60)

    put(tmp_path, "in/results/run-a.json", "{}")
    put(tmp_path, "in/dataset.json", "{}")
    go()
    go()
    put(tmp_path, "in/results/run-b.json", "{}")
    put(tmp_path, "in/dataset.json", '{"again": 1}')
    go()
    assert [s for s in seen if s] == [["dataset.json", "run-a.json"], ["dataset.json", "run-b.json"]]


def test_artifacts_are_written_when_all_tasks_have_succeeded(spark, tmp_path):
    root = str(tmp_path / "out")
    ds.register(spark)
    good = spark.createDataFrame([(f"results/run-{i}.json", f'{{"i": {i}}}') for i in range(20)], "path string, text string").repartition(4)
    good.write.format("artifacts").mode("append").save(root)
    assert ds.artifacts(spark, root).where("kind = 'run' and problem is null").count() == 20
    bad = good.select(F.concat(F.lit("new/"), "path").alias("path"), "text").unionByName(spark.createDataFrame([("../out of here", "x")], "path string, text string"))
    with pytest.raises(Exception, match="not a path below"):
        bad.write.format("artifacts").mode("append").save(root)
    assert ds.artifacts(spark, root).count() == 20 and os.listdir(f"{root}/_staging") == []


def test_repeated_attempts_add_nothing(tmp_path):
    row = {"path": "analysis.json", "text": "é"}
    writer = ds.Writer(str(tmp_path / "a"))
    writer.write(iter([row]))  # an attempt whose task was lost
    writer.commit([writer.write(iter([row])), None])
    assert [p.name for p in (tmp_path / "a").rglob("*") if p.is_file()] == ["analysis.json"] and (tmp_path / "a/analysis.json").read_text(encoding="utf-8") == "é"
    case = {"local_case_id": "c", "publication_id": "p", "document": "{}"}
    shown = lambda: [r for part in pub.Reader(str(tmp_path / "p")).partitions() for r in pub.Reader(str(tmp_path / "p")).read(part)]
    first = pub.Writer(str(tmp_path / "p"), "one")
    first.write(iter([case]))
    kept = first.write(iter([case]))
    assert shown() == []  # nothing counts before the manifest is there
    first.commit([kept])
    assert shown() == [("c", "p", "one", "{}")]
    again = pub.Writer(str(tmp_path / "p"), "one")
    again.commit([again.write(iter([case]))])
    broken = pub.Writer(str(tmp_path / "p"), "two")
    broken.abort([broken.write(iter([case]))])
    assert shown() == [("c", "p", "one", "{}")]


KILLED = """
    import os, sys
    sys.path.insert(0, {repo!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from gaugeloom.sources import datasource as ds
    ds.register(spark)

    def broken(batches):
        for n, batch in enumerate(batches):
            yield batch
        context = TaskContext.get()
        if context.attemptNumber() == 0 and context.partitionId() % 2:
            os._exit(1)  # the worker is gone after its rows were handed on

    rows = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("local_case_id"), F.lit("p").alias("publication_id"), F.lit("{{}}").alias("document"))
    rows.mapInArrow(broken, rows.schema).write.format("publication").mode("append").option("batch", "b").save({root!r})
    got = spark.read.format("publication").load({root!r})
    print("ROWS", got.count(), got.select("local_case_id").distinct().count())
"""


def test_a_killed_worker_publishes_nothing_twice(tmp_path):
    code = textwrap.dedent(KILLED).format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), root=str(tmp_path / "p"))
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert "ROWS 40 40" in ran.stdout, ran.stderr[-2000:]


def test_publishing_again_adds_nothing(spark, tmp_path):
    cases = spark.createDataFrame([("a", "approved", None, 1), ("b", "pending", None, 2), ("c", "approved", "there", 3), ("d", "approved", None, 4)], "case_id string, review_status string, publication_id string, n int")
    root = str(tmp_path / "p")
    for _ in range(2):
        assert pub.publish_batch(cases, root).count() == 0
    rows = spark.read.format("publication").load(root)
    assert sorted(r.local_case_id for r in rows.collect()) == ["a", "d"] and len(pub.manifests(root)) == 1
    with pytest.raises(Exception, match="identity"):
        rows.write.format("publication").mode("append").save(root)


def test_talks_end_by_words_turns_and_silence_and_leave_no_state(spark, tmp_path):
    m = [(1, 0, "user", "a"), (1, 1, "assistant", "DONE now"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "x"), (3, 1, "assistant", "y"), (4, 0, "user", None), (4, 1, "assistant", None)]
    schema = "conv_id long, turn long, role string, text string"
    frames = [spark.createDataFrame(m, schema).withColumn("ts", F.timestamp_seconds("turn")), spark.createDataFrame([(1, 5, "assistant", "done again"), (3, 2, "assistant", "done")], schema).withColumn("ts", F.timestamp_seconds(F.col("turn") + 9))]
    frames += [spark.createDataFrame([(9, 0, "user", "late")], schema).withColumn("ts", F.timestamp_seconds(F.lit(x))) for x in (10**6, 10**9)]
    ended, left = [], []
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        q = pg.follow(stream, "done", 1).writeStream.foreachBatch(lambda rows, _: ended.extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(ended) == [(1, 1, "success"), (2, 1, "max_turns"), (3, 2, "success"), (4, 1, "exhausted")]
    assert max(left[:2]) >= 4 and left[-1] <= 1  # the clock's own


def report(run, cases):
    return json.dumps({"schema": "x/score-report/v1", "run_id": run, "cases": cases})


def test_views_kept_up_equal_those_of_all_reports(spark, tmp_path):
    score = lambda s: {"score": s, "comment": ""}
    live, inbox = LiveScores(spark, str(tmp_path / "live")), tmp_path / "in"
    assert live.metrics().count() == 0
    batches = [
        {"r0": [{"case_id": "a", "scores": {"m": score(1.0), "k": score(0.5)}, "errors": {}, "skipped": {}}, {"case_id": "b", "scores": {}, "errors": {"m": "boom"}, "skipped": {"k": "no"}}]},
        {"r1": [{"case_id": "a", "scores": {"m": score(0.0)}, "errors": {}, "skipped": {}}, {"case_id": "b", "scores": {"m": score(1.0)}, "errors": {}, "skipped": {}}], "r0": [{"case_id": "a", "scores": {"m": score(0.3)}, "errors": {}, "skipped": {}}]},
        {"r2": [{"case_id": "c", "scores": {"m": score(0.25)}, "errors": {"k": "x"}, "skipped": {}}]},
    ]
    for batch in batches:
        for run, cases in batch.items():
            put(inbox, f"results/score-report-{run}.json", report(run, cases))
        live.follow(str(inbox), settle=0.0, availableNow=True).awaitTermination(120)
    rows = [(r, c["case_id"], m, "scored", s["score"]) for b, only in zip(batches, ("r0", "r1", "r2"), strict=True) for r, cs in b.items() if r == only for c in cs for m, s in c["scores"].items()]
    rows += [("r0", "b", "m", "error", None), ("r0", "b", "k", "skipped", None), ("r2", "c", "k", "error", None)]
    scores = spark.createDataFrame(rows, "run_id string, case_id string, metric string, outcome string, score double")
    want = sorted(map(tuple, sc.metric_rates(scores, default=0.5).collect()))
    for view in (live, live.compact(str(tmp_path / "small"))):
        assert sorted(map(tuple, view.metrics(default=0.5).collect())) == want
        assert sorted(map(tuple, view.disagreeing().collect())) == [("a", "m", 0.0, 1.0)]
        assert len(view.run_metrics().collect()) == 5
    cases = spark.createDataFrame([("a", "i", None, "v"), ("b", "j", "f", "v"), ("d", "never ran", None, None)], "case_id string, intent string, failure_mode string, variant string")
    assert sorted(map(tuple, live.slices(cases).collect()), key=str) == sorted(map(tuple, sc.slice_rates(scores, cases).collect()), key=str)
    assert live.verdict(cases, default=0.5).first() == sc.verdict_of(scores, cases, default=0.5, overall_pass=0.8).first()
    live.absorb(spark.createDataFrame([("p", "score_report", "r9", report("r9", [{"case_id": "z", "scores": {"m": score(1.0)}}]))], "path string, kind string, run_id string, text string"), 50)
    live.absorb(spark.createDataFrame([("p", "score_report", "r9", report("r9", [{"case_id": "z", "scores": {"m": score(0.0)}}]))], "path string, kind string, run_id string, text string"), 50)
    assert live.cells().where("case_id = 'z'").select("total", "n").first() == (0.0, 1)  # a batch tried again replaces itself


def test_what_cases_did_is_kept_up_as_sets(spark, tmp_path):
    call = lambda k: [{"name": "w", "args": {"k": k}}]
    run = lambda run_id, rows: json.dumps({"run_id": run_id, "timestamp": f"2026-01-0{run_id[1]}", "case_runs": [{"case_id": c, "outputs": {"response": text}, "tool_calls": call(k), "mock_calls": [{"layer": layer}], "error": None} for c, text, k, layer in rows]})
    batches = [{"r1": [("a", "x", 1, "llm"), ("b", "x", 1, "rule")]}, {"r2": [("a", "y", 1, "llm"), ("b", "x", 2, "rule")], "r1": [("a", "other", 9, "llm")]}, {"r3": [("a", "x", 1.0, "real"), ("c", None, 1, "llm")]}]
    live, inbox = LiveScores(spark, str(tmp_path / "live")), tmp_path / "in"
    for batch in batches:
        for run_id, rows in batch.items():
            put(inbox, f"results/run-{run_id}.json", run(run_id, rows))
        live.follow(str(inbox), settle=0.0, availableNow=True).awaitTermination(120)
    got = {r.case_id: (r.trajectories, r.outputs, r.llm_mock_calls, r.runs) for r in live.behaviour().collect()}
    assert got == {"a": (2, 3, 2, 3), "b": (2, 2, 0, 2), "c": (1, 1, 1, 1)}  # 1 and 1.0 are hashed apart, as they print apart
    assert live.stability().first().asDict() == {"cases": 3, "unstable": 2, "text_varies": 2, "llm_attributed": 1, "stable_fraction": 0.3333}
    assert sorted(map(tuple, live.compact(str(tmp_path / "small")).behaviour().collect())) == sorted(map(tuple, live.behaviour().collect()))
    assert live.flips([]).count() == 0


def test_many_files_are_few_tasks_and_small_messages(spark, tmp_path):
    """A task tells of its files in one size; a small table of many files is written by several tasks, and read by few."""
    rows = lambda n: iter([{"path": f"p{i}/work/state.json", "text": "{}"} for i in range(n)])
    writer = ds.Writer(str(tmp_path / "a"))
    one, many = writer.write(rows(1)), writer.write(rows(500))
    assert len(pickle.dumps(many)) == len(pickle.dumps(one))
    writer.commit([one, None, many])
    assert len(ds.listed(str(tmp_path / "a"))) == 500 and not (tmp_path / "a" / ds.STAGING / writer.job).exists()
    again = ds.Writer(str(tmp_path / "a"))
    again.commit([again.write(iter([{"path": "p1/work/state.json", "text": "new"}, {"path": "p1/other.json", "text": "{}"}]))])
    assert (tmp_path / "a/p1/work/state.json").read_text() == "new" and len(ds.listed(str(tmp_path / "a"))) == 501
    files = spark.range(9000).coalesce(1).selectExpr("concat('results/run-', id, '.json') AS path", "'{}' AS text")
    ds.save(files, str(tmp_path / "b"), 9000)
    assert len(ds.listed(str(tmp_path / "b"))) == 9000
    assert art.documents(spark, str(tmp_path / "b")).count() == 9000 and art.small_files(spark, str(tmp_path / "b"), "*.json").rdd.getNumPartitions() <= 128


def test_large_files_are_dealt_out_by_bytes(spark, tmp_path):
    """A writing task is given so many bytes at most, however few files they are."""
    tasks = []
    files = spark.range(40).selectExpr("concat('results/run-', id, '.json') AS path", "concat('{\"a\": \"', repeat('x', 2 << 20), '\"}') AS text")
    wide = type(files).repartition
    try:
        type(files).repartition = lambda self, n, *cols: tasks.append(n) or wide(self, n, *cols)
        ds.save(files, str(tmp_path / "a"), 40)
    finally:
        type(files).repartition = wide
    assert tasks == [6] and len(ds.listed(str(tmp_path / "a"))) == 40  # 80 MB, 16 MB each


def test_a_batch_is_read_from_its_source_once(spark, tmp_path):
    """Whatever is made of a batch, its source is read once, and nothing of it is left beside the parts."""
    reads = spark.sparkContext.accumulator(0)
    text = json.dumps({"run_id": "r1", "cases": [{"case_id": "a", "scores": {"m": {"score": 0.5}}, "errors": {"e": "bad"}, "skipped": {"s": "why"}}]})

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("p", "score_report", "r1", text)], "path string, kind string, run_id string, text string").coalesce(1)
    live = LiveScores(spark, str(tmp_path / "live"))
    live.absorb(rows.mapInArrow(counted, rows.schema), 0)
    assert reads.value == 1
    assert sorted((r.metric, r.total, r.n, r.bad) for r in live.cells().collect()) == [("e", None, 0, 1), ("m", 0.5, 1, 0), ("s", None, 0, 0)]
    assert not [f for name in ("_batch", "_scores") for f in (tmp_path / "live" / name).rglob("*.parquet")]


def test_many_folders_are_listed_by_tasks(tmp_path):
    """The driver holds a few bytes a file; of many folders it holds the folders, and filters hold below them too."""
    for i in range(400):
        for name in ("evaluators.yaml", "work/state.json", ".hidden.json", "skills/one/SKILL.md"):
            put(tmp_path, f"many/p{i}/{name}", "{}")
    put(tmp_path, "many/dataset.json", "{}")
    reader = ds.Reader(str(tmp_path / "many"))
    parts = reader.partitions()
    assert [type(p).__name__ for p in parts] == ["Files", "Folders"] and len(pickle.dumps(parts)) < 10 * 1201
    paths = lambda r: [p for part in r.partitions() for b in r.read(part) for p in b.column("path").to_pylist()]
    assert sorted(paths(reader)) == sorted(a.path for a in ds.listed(str(tmp_path / "many"))) and len(paths(reader)) == 1201
    assert list(reader.pushFilters([EqualTo(("kind",), "evaluators")])) == [] and len(paths(reader)) == 400
    assert len(paths(ds.Reader(str(tmp_path / "many"), "SKILL.md"))) == 400
    stream = ds.StreamReader(str(tmp_path / "many"), 0.0)
    start, end = stream.initialOffset(), stream.latestOffset()
    put(tmp_path, "many/p7/evaluators.yaml", "{} ")
    late = stream.latestOffset()
    read = lambda a, b: [p for part in stream.partitions(a, b) for batch in stream.read(part) for p in batch.column("path").to_pylist()]
    assert len(read(start, end)) == 1200 and read(end, late) == [str(tmp_path / "many/p7/evaluators.yaml")] and len(read(start, late)) == 1201
    for i in range(5000):
        put(tmp_path, f"flat/results/run-c{i}.json", "{}")
    flat = ds.Reader(str(tmp_path / "flat")).partitions()
    assert [len(p.files) for p in flat] == [4096, 904] and len(pickle.dumps(flat)) < 40 * 5000


def test_small_projects_are_written_whole(spark, tmp_path):
    """A project's files are one task's, so its folder is moved at once; a folder of more files than a task has is dealt out by file."""
    dealt = []
    wide = type(spark.range(1)).repartition
    try:
        wide_type = type(spark.range(1))
        wide_type.repartition = lambda self, n, *cols: dealt.append((n, str(cols[0]))) or wide(self, n, *cols)
        rows = spark.range(6000).selectExpr("concat('p', id div 3, '/', id % 3, '/dataset.json') AS path", "'{}' AS text")
        ds.save(rows, str(tmp_path / "a"))
        ds.save(rows.selectExpr("concat('all/', path) AS path", "text"), str(tmp_path / "b"))
    finally:
        wide_type.repartition = wide
    assert [n for n, _ in dealt] == [2, 2] and "regexp_extract" in dealt[0][1] and "regexp_extract" not in dealt[1][1]
    assert len(ds.listed(str(tmp_path / "a"))) == len(ds.listed(str(tmp_path / "b"))) == 6000


def test_scores_are_read_from_the_text_in_one_pass(spark):
    """No report is written out again to be read, nor worked out again to count its cases; a list with something that is no case loses none of the others."""
    texts = ['{"cases": [{"case_id": "a", "scores": {"m": {"score": 1, "comment": "x"}, "k": {"score": "bad"}}, "errors": {"e": "why"}, "skipped": {"s": null}}]}', '{"cases": [1, "x", null, {"case_id": 12, "scores": {"m": {"score": 2}}}]}', '{"cases": [{"case_id": 1e3, "scores": 5, "errors": {"e": "kept"}}]}', '{"cases": {"case_id": "a", "scores": {"m": {"score": 1}}}}', '{"cases": [{"case_id": "a", "case_id": "b", "scores": {"m": {"score": 1}}}]}', "{", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("doc", F.try_parse_json("text"))
    rows = art.score_rows(docs, ["n"])
    want = [(0, "a", "e", "error", None, "why"), (0, "a", "k", "scored", None, None), (0, "a", "m", "scored", 1.0, "x"), (0, "a", "s", "skipped", None, None), (1, "12", "m", "scored", 2.0, None), (2, "1000", "e", "error", None, "kept")]
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[:3]) == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("StructField(cases") <= 1
