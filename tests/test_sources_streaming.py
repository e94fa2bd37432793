import json

import pandas as pd
from pyspark.sql import functions as F

from gaugeloom.operators import scores as sc, stability as st
from gaugeloom.sources import artifacts as art, sinks
from gaugeloom.streaming import progress as pg

NS = "demo"


def write(folder, name, doc):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def project(folder):
    write(folder, "dataset.json", {"schema": f"{NS}/dataset/v1", "name": "d", "mocks": {"tools": {"w": [{"matchArgs": {}, "response": None}]}}, "coverage": {"plan": {"cells": [1]}},
          "cases": [{"id": "c1", "inputs": {"messages": [{"role": "user", "content": "hi"}]}, "metadata": {"intent": "i"}, "review": {"status": "approved"}}]})
    for n, s in (("aa", 1.0), ("bb", 0.0)):
        write(folder, f"results/run-{n}.json", {"schema": f"{NS}/run/v1", "run_id": n, "timestamp": n, "case_runs": [{"case_id": "c1", "outputs": {"response": "x"}, "error": None, "tool_calls": [{"name": "w", "args": {"k": 1}}], "mock_calls": [{"tool": "w", "layer": "rule", "rule": 0}]}]})
        write(folder, f"results/score-report-{n}.json", {"schema": f"{NS}/score-report/v1", "run_id": n, "cases": [{"case_id": "c1", "scores": {"m": {"score": s, "comment": ""}}, "errors": {"j": "none"}, "skipped": {}}]})
    write(folder, "work/state.json", {"schema": f"{NS}/pipeline-state/v1", "stages": {"infer": {"status": "ok", "seconds": 1.5}}})
    write(folder, "broken.json", "{")
    write(folder, "odd.json", {"a": 1})
    write(folder, "agent.py", "TOOLS = []\ndef build_agent(model):\n    pass\n")
    write(folder, "run.log", "\n".join(f"line {i}" for i in range(9)) + "\n")


def test_folder_to_tables(spark, tmp_path):
    project(tmp_path)
    docs = art.documents(spark, str(tmp_path)).cache()
    assert {(r.path.rsplit("/", 1)[1], r.problem) for r in art.problems(docs).collect()} == {("broken.json", "not JSON"), ("odd.json", "unknown kind")}
    assert {(r.kind, r.run_id) for r in art.index(docs).collect()} == {("dataset", None), ("run", "aa"), ("run", "bb"), ("score_report", "aa"), ("score_report", "bb"), ("pipeline_state", None)}
    c = art.cases(docs).first()
    assert (c.case_id, c.intent, c.review_status) == ("c1", "i", "approved")
    runs = art.runs(docs)
    assert [r.run_ordinal for r in runs.orderBy("run_id").collect()] == [0, 1]
    assert runs.select("trajectory_hash").distinct().count() == 1
    from gaugeloom.functions.jsonvalues import digest

    assert runs.first().trajectory_hash == digest({"tool_calls": [["w", {"k": 1}]], "error": None})[:12]
    assert art.ledger(runs).count() == 2
    s = art.scores(docs)
    m = {r.metric: r for r in sc.metric_rates(s).collect()}
    assert m["m"].pass_rate == 0.5 and m["j"].errors == 2
    flips = st.score_flips(st.behaviour(runs), s, ["m"]).collect()
    assert [(r.case_id, r.kind) for r in flips] == [("c1", "evaluator")]
    assert art.mock_rules(docs).first().match_args == "{}"
    assert art.folded(docs, "coverage_plan").select(F.to_json("doc").alias("d")).first().d == '{"cells":[1]}'
    assert [(r.stage, r.status) for r in art.stages(docs).collect()] == [("infer", "ok")]
    assert [r.line for r in art.log_tail(spark, str(tmp_path / "run.log"), 2).orderBy("line_no").collect()] == ["line 7", "line 8"]
    assert art.agent_targets(spark, str(tmp_path)).count() == 1
    assert "cases" in art.catalog(spark, str(tmp_path)) and spark.table("cases").count() == 1


def test_gated_write_and_publish(spark, tmp_path):
    bad = spark.createDataFrame([("", '{"q":1}', "pending")], "case_id string, inputs string, review_status string")
    assert sinks.save_valid(bad, str(tmp_path / "x")).count() == 1 and not (tmp_path / "x").exists()
    good = spark.createDataFrame([("a", '{"q":1}', "approved", None)], "case_id string, inputs string, review_status string, publication_id string")
    assert sinks.save_valid(good, str(tmp_path / "y")).count() == 0 and spark.read.parquet(str(tmp_path / "y")).count() == 1
    remote = tmp_path / "remote"
    remote.mkdir()

    def upload(batch: pd.DataFrame) -> pd.DataFrame:
        for i in batch["case_id"]:
            (remote / i).write_text("")
        return batch

    def read_back():
        return spark.createDataFrame([(p.name,) for p in remote.iterdir()], "local_case_id string")

    assert sinks.publish(good, upload, read_back).count() == 0 and [p.name for p in remote.iterdir()] == ["a"]


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("i", False), ("i", True), ("j", None)], "group string, error boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = pg.progress(stream).writeStream.outputMode("complete").format("memory").queryName("prog").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("prog").collect())) == sorted(map(tuple, pg.progress(rows).collect())) == [("i", 2, 1), ("j", 1, 0)]
    planned = spark.createDataFrame([("i", 4), ("k", 0)], "group string, total int")
    assert {r.group: r.fraction for r in pg.with_totals(pg.progress(rows), planned).collect()} == {"i": 0.5, "k": 1.0}


def test_replay_stops_at_an_error(spark):
    cases = spark.createDataFrame([("a", "hi", ["more"]), ("b", "fail", ["never"])], "case_id string, opening string, user_turns array<string>")

    def agent(talk):
        if talk[-1]["content"] == "fail":
            raise ValueError("boom")
        return f"reply {len(talk)}"

    got = {r.case_id: r for r in pg.conversations(cases, agent).collect()}
    assert (got["a"].response, got["a"].turns) == ("reply 3", 2)
    assert (got["b"].response, got["b"].turns, got["b"].error) == (None, 1, "ValueError: boom")


def test_report_views(spark, tmp_path):
    from gaugeloom.plans.views import Report

    project(tmp_path)
    write(tmp_path, "agent-map.json", {"schema": f"{NS}/agent-map/v1", "intents": [{"id": "i"}, {"id": "k"}], "scenarios": [{"id": "s", "intent": "i"}], "tools": [{"name": "w", "args_schema": {"required": ["k"]}}],
          "graph": {"nodes": [{"id": "n", "kind": "agent", "prompt": "p", "evidence": ["b"]}, {"id": "n", "kind": "graph-node", "evidence": ["a"]}]}})
    write(tmp_path, "simulation.json", {"schema": f"{NS}/simulation/v1", "results": [{"scenario_id": "s", "stop_reason": "success", "turns": 1, "transcript": [], "violations": ["v"]}]})
    r = Report(spark, str(tmp_path), default=0.6, judges=("j",))
    for name in r.register():
        spark.table(name).collect()
    s = r.summary().first()
    assert (s.verdict, s.overall_score, s.metrics_passing, s.approved, s.stable_fraction) == ("fail", 0.5, 0, 1, 1.0)
    assert [tuple(x) for x in r.intents().orderBy("ordinal").collect()] == [(0, "i", 1, 1), (1, "k", 0, 0)]
    n = r.nodes().first()
    assert (n.kind, n.prompt, n.evidence) == ("agent", "p", ["a", "b"])
    assert r.simulation_totals().first().asDict() == {"scenarios": 1, "successes": 1, "with_violations": 1}
    assert r.tools().first().mockable and r.coverage().count() == 1
    assert {x.rule for x in r.ledger_totals().collect()} == {1}


def test_names_give_kind_and_rank_without_a_join(spark, tmp_path):
    """The kind of a file is told in its own row: nothing is shuffled or read again; files of any kind are read by tasks that list them."""
    names = ["work/mock-rules.json", "mocks.json", "results/report-a.json", "x/results/score-report-b.json", "results/run-c.json", "state.json", "odd.json"]
    rows = art.kind_of_files(spark.createDataFrame([(n,) for n in names], "path string"), spark)
    assert [tuple(r) for r in rows.collect()] == [(names[0], "mock_rules", None, 0), (names[1], "mock_rules", None, 2), (names[2], "score_report", "a", 1), (names[3], "score_report", "b", 0), (names[4], "run", "c", 0), (names[5], "pipeline_state", None, 1), (names[6], None, None, None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    write(tmp_path, "p1/agent.py", "TOOLS = []\ndef build_agent(model):\n    pass\n")
    write(tmp_path, "p1/skills/one/SKILL.md", "---\nname: n\n---\nbody")
    assert "BatchScan artifacts" in art.agent_targets(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert [(r.name, r.text) for r in art.skill_files(spark, str(tmp_path)).collect()] == [("one", "---\nname: n\n---\nbody")] and art.agent_targets(spark, str(tmp_path)).count() == 1
