import json

import pandas as pd
from pyspark.sql import functions as F

from gaugeloom.functions import jsonschema as js, samples as sm, text as tx
from gaugeloom.operators import coverage as cov, evaluators as ev, simulation as sim


def call(name, **args):
    return {"name": name, "args": args}


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(json.dumps(v) if isinstance(v, (list, dict)) else v for v in cells.values())], ", ".join(f"{k} string" for k in cells)).select(column.alias("x")).first().x


def test_expected_tools(spark):
    f = ev.expected_tools("c", "e", "f")
    assert one(spark, f, c=[call("w", city="Paris", units="C")], e=[call("w", city="Paris")], f=[]) == 1.0
    assert one(spark, f, c=[call("w", city="Oslo")], e=[call("w", city="Paris")], f=[]) == 0.0
    assert one(spark, f, c=[call("b"), call("a")], e=[call("a"), call("b")], f=[]) == 0.0
    assert one(spark, f, c=[call("rm")], e=[], f=["rm"]) == 0.0
    assert one(spark, f, c=[], e=[], f=[]) == 1.0


def test_trajectory_match(spark):
    a, b = call("a", x=1), call("b", y=2)
    m = lambda mode, args="subset": ev.trajectory_match(mode, args)("c", "e")
    assert one(spark, m("strict"), c=[a, b], e=[b, a]) == 0.0
    assert one(spark, m("unordered"), c=[a, b], e=[b, a]) == 1.0
    assert one(spark, m("superset"), c=[a, b], e=[a]) == 1.0
    assert one(spark, m("subset"), c=[a], e=[a, b]) == 1.0
    assert one(spark, m("strict", "exact"), c=[call("a", x=1, z=1)], e=[a]) == 0.0
    assert one(spark, m("strict", "ignore"), c=[call("a", q=9)], e=[a]) == 1.0


def test_score_table_scores_failed_runs_zero(spark):
    runs = spark.createDataFrame([(0, "a", None, "Yes!"), (0, "b", "boom", None), (0, "c", None, "no")], "run_ordinal int, case_id string, error string, response string")
    needles = F.when(F.col("case_id") != "c", F.array(F.lit("YES")))
    got = {r.case_id: (r.outcome, r.score) for r in ev.score_table(runs, {"contains": ev.contains_all(F.col("response"), needles)}).collect()}
    assert got == {"a": ("scored", 1.0), "b": ("scored", 0.0), "c": ("skipped", None)}


def test_judge_seam(spark):
    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": [1.0, None][: len(batch)], "comment": ["ok", None][: len(batch)], "error": [None, "no model"][: len(batch)]})

    runs = spark.createDataFrame([(0, "a", None), (0, "b", None)], "run_ordinal int, case_id string, error string").coalesce(1)
    assert [(r.outcome, r.comment) for r in ev.judged(runs, "correctness", judge).orderBy("case_id").collect()] == [("scored", "ok"), ("error", "no model")]


def test_schema_messages(spark):
    schema = {"type": "object", "properties": {"query": {"type": "string"}, "n": {"type": "integer", "minimum": 1}, "k": {"$ref": "#/$defs/K"}}, "required": ["query"], "$defs": {"K": {"enum": ["a", "b"]}}}
    check = js.schema_problems(schema)
    f = lambda v: one(spark, check(F.col("v")), v=v)
    assert f({"query": 5}) == ["$.query: expected string, got int"]
    assert f({"query": "x", "n": True}) == ["$.n: expected integer, got bool"]
    assert f({"n": 0}) == ["$: missing required 'query'", "$.n: below minimum 1"]
    assert f({"query": "x", "k": "c"}) == ["$.k: 'c' not in enum ['a', 'b']"]
    assert f({"query": "x"}) == []
    assert js.Validator(schema, partial=True).problems({}) == []


def test_edge_cases_take_turns(spark):
    args = {"properties": {"city": {"type": "string"}, "days": {"type": "integer", "maximum": 5}, "unit": {"enum": ["C", "F"]}}, "required": ["city", "days"]}
    tools = spark.createDataFrame([("w", json.dumps(args), json.dumps({"required": ["t"]}))], "tool string, args_schema string, output_schema string")
    got = [r.id for r in js.edge_cases(tools).orderBy("place").collect()]
    assert got[:5] == ["edge.w.missing_required.city", "edge.w.wrong_type.days", "edge.w.out_of_enum.unit", "edge.w.boundary.days", "edge.w.malformed_output"]
    assert got[5] == "edge.w.missing_required.days" and js.edge_cases(tools, 2).count() == 2


def test_required_cells_and_gaps(spark):
    s = spark.createDataFrame([("i", "s", None)], "intent string, scenario string, failure_mode string")
    need = cov.required_cells(s, spark.createDataFrame([("a",), ("b",)], "topic string"), spark.createDataFrame([("out_of_scope",)], "failure_type string"))
    assert need.count() == 3
    case = spark.createDataFrame([("i", "a", "s", "none")], "intent string, topic string, scenario string, failure_mode string")
    assert cov.gaps(need, case).count() == 2


def test_plan_arithmetic(spark):
    rows = [(0, i, "a", f"s{i}", "happy", None) for i in range(3)] + [(0, 9, "a", "f", "failure", "x")]
    s = spark.createDataFrame(rows, "intent_ord int, scenario_ord int, intent string, scenario string, kind string, failure_mode string")
    plan = cov.intent_cells(s, ["t1", "t2"], 0, 2)
    assert [(r.topic, r["count"]) for r in plan.orderBy("ordinal").collect()] == [("t1", 1), ("t2", 1), ("t1", 1), ("t2", 2)]
    full = cov.topped_up(plan, 12)
    assert [r["count"] for r in full.orderBy("ordinal").collect()] == [4, 3, 3, 2]
    turns = cov.multi_turn(full, 0.5)
    assert [r.multi_turn for r in turns.orderBy("ordinal").collect()] == [3, 1, 1, 1]


def test_achieved_of_empty_plan_is_full(spark):
    plan = spark.createDataFrame([], "intent string, topic string, scenario string, failure_mode string, kind string, count int")
    cases = spark.createDataFrame([("i", None, None, None)], "intent string, topic string, scenario string, failure_mode string")
    assert cov.coverage_percent(cov.achieved(plan, cases)).first().pct == 100.0


TALK = "conv_id string, ordinal int, role string, content string"


def outcome(spark, messages, **s):
    rows = [("c", i, r, t) for i, (r, t) in enumerate(messages)]
    t = sim.transcripts(spark.createDataFrame(rows, TALK))
    spec = {"max_turns": 3, "success_contains": "done", "expect_contains": "", "expect_not_contains": ""} | s
    return sim.outcomes(t.select("*", *[F.lit(v).alias(k) for k, v in spec.items()]))


def test_stop_reasons(spark):
    u, a = "user", "assistant"
    r = outcome(spark, [(u, "hi"), (a, "All Done"), (u, "bye")]).first()
    assert (r.stop_reason, r.turns, r.violations) == ("success", 1, [])
    bad = outcome(spark, [(u, "1"), (a, "x"), (u, "2"), (a, "y"), (u, "3")], max_turns=2, expect_contains="z")
    r = bad.first()
    assert (r.stop_reason, r.turns, len(r.violations)) == ("max_turns", 2, 2)
    assert outcome(spark, [(u, "1"), (a, "x")], max_turns=1).first().stop_reason == "exhausted"
    m = sim.mined(bad).first()
    assert (m.first_message, m.user_turns) == ("1", ["2"]) and len(m.transcript_tail) == 4


SKILL = """---
name: triage
allowed-tools: search, page_oncall
---
# Triage
Some words that are
wrapped over lines.

- Never page twice for
  the same incident.
- short
Use lookup here.
"""


def test_skill_text(spark):
    f = spark.createDataFrame([("triage", SKILL)], "name string, text string")
    assert f.select(tx.front_value(F.col("text"), "name").alias("x")).first().x == "triage"
    assert [r.line for r in tx.rules(f).collect()] == ["Never page twice for the same incident."]
    lines = [r.line for r in tx.logical_lines(f).orderBy("unit").collect()]
    assert lines[0] == "Some words that are wrapped over lines."
    tools = spark.createDataFrame([("search",), ("lookup",)], "tool string")
    assert {(r.tool, r.how) for r in tx.skill_tools(f, tools).collect()} == {("search", "allowed"), ("page_oncall", "unknown"), ("lookup", "mentioned")}
    spec = spark.range(1).select(tx.model_spec(F.lit("api:big@high")).alias("s")).first().s
    assert (spec.provider, spec.model, spec.effort) == ("api", "big", "high")


def test_samples_conform_and_corruptions_do_not():
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 3}, "when": {"type": "string", "format": "date"}, "code": {"type": "string", "pattern": "^\\d{4}$"}, "k": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/K"}]}, "l": {"type": "array", "items": {"type": "number", "exclusiveMaximum": 1}, "minItems": 2}}, "$defs": {"K": {"enum": ["a"]}}}
    assert sm.sample(schema) == {"n": 3, "when": "2026-01-15", "code": "1111", "k": "a", "l": [0.0, 0.0]}
    check = js.Validator(schema)
    assert check.problems(sm.sample(schema)) == []
    assert check.problems(sm.spoiled(schema)) == ["$: missing required 'n'"] and check.problems(sm.spoiled(schema, "wrong_type")) == ["$.n: expected integer, got str"]


def test_map_checks(spark):
    from gaugeloom.operators import agentmap as am

    intents = spark.createDataFrame([("i.a", ["doc:1"]), ("Bad Id", [])], "intent string, evidence array<string>")
    scenarios = spark.createDataFrame([("s1", "i.a", "happy", None, ["k"], ["tool:w"]), ("s2", "i.a", "failure", "odd", [], ["tool:gone"]), ("s3", "i.x", "happy", None, [], [])], "scenario string, intent string, kind string, failure_mode string, skills array<string>, evidence array<string>")
    got = {(r.kind, r.id, r.problem) for r in am.map_problems(intents, scenarios, spark.createDataFrame([("timeout",)], "failure_type string"), spark.createDataFrame([("w",)], "tool string"), spark.createDataFrame([("k",)], "skill string")).collect()}
    assert got == {
        ("intent", "Bad Id", "id is no slug"), ("intent", "Bad Id", "no evidence"), ("intent", "Bad Id", "no happy scenario"), ("intent", "Bad Id", "no failure scenario"),
        ("scenario", "s2", "failure mode does not apply"), ("scenario", "s2", "unknown tool gone"), ("scenario", "s3", "unknown intent"), ("scenario", "s3", "no evidence"),
    }
    facts = spark.createDataFrame([("tool", "pay"), ("skill", "triage")], "name string, value string")
    gates = {"tool_error": F.col("name") == "tool", "never": F.lit(False)}
    assert [tuple(r) for r in am.failure_gates(facts, gates).collect()] == [("tool_error", ["tool:pay"])]
    nodes = spark.createDataFrame([("n", "use w here", []), ("m", "use w", ["w"])], "id string, prompt string, tools array<string>")
    assert [tuple(r) for r in am.node_tools(nodes, spark.createDataFrame([("w",)], "tool string")).collect()] == [("n", "w")]
    t = "tool string, ordinal int, description string, args_schema string"
    m = am.merged_tools(spark.createDataFrame([("w", 0, "src", "{}")], t), spark.createDataFrame([("w", 0, "live", None), ("z", 1, "new", None)], t))
    assert [(r.tool, r.description, r.args_schema, r.live) for r in m.orderBy("place").collect()] == [("w", "live", "{}", True), ("z", "new", None, True)]


def test_specs(spark, tmp_path):
    from gaugeloom.sources import specs

    (tmp_path / "s.yaml").write_text("- id: a\n  opening: hi\n  max_turns: 2\n  expect:\n    contains: x\n")
    assert specs.scenarios(spark, str(tmp_path / "s.yaml")).first().expect_contains == "x"
    (tmp_path / "e.yaml").write_text("evaluators:\n- type: contains\n- type: correctness\n  prompt: TONE_PROMPT\n- type: own\n  name: mine\n")
    assert specs.judge_metrics(specs.evaluators(spark, str(tmp_path / "e.yaml"))) == ["tone", "mine"]
    docs = spark.createDataFrame([("/p/a/dataset.json", "dataset"), ("/p/a/work/state.json", "pipeline_state"), ("/p/x.json", None)], "path string, kind string")
    assert [tuple(r) for r in specs.projects(docs).collect()] == [("/p/a", 2)]
