"""Specifications of many projects as rows, typed thresholds, evaluators from specs, mock blocks, report lines."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import authoring as au, custom, evaluators as ev, factory, mocks
from gaugeloom.sources import specs


def test_scenarios_and_evaluators_of_many_files(spark):
    files = [
        ("a.yaml", "- {id: s, opening: hi, max_turns: 2, success_contains: x}\n- {id: '', opening: hi, max_turns: 0}\n"), ("b.json", '{"scenarios": [{"id": "t", "opening": "o", "max_turns": 1, "expect": {"not_contains": "n"}, "extra": 1}]}'),
        ("c.yaml", "a: ["), ("d.yaml", None), ("e.yaml", ""),
    ]
    rows = {(r.path, r.ordinal): r for r in specs.scenario_rows(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows["a.yaml", 0].problem is None and rows["a.yaml", 1].problem == "id, max_turns, success_contains or expect is missing"
    assert (rows["b.json", 0].scenario_id, rows["b.json", 0].expect_not_contains, rows["b.json", 0].followups, rows["b.json", 0].problem) == ("t", "n", [], None)
    assert {p for (p, i), r in rows.items() if r.problem == "not YAML"} == {"c.yaml", "d.yaml", "e.yaml"}
    files = [("a", "- type: contains\n- {type: correctness}\n- {type: openevals, prompt: TONE_PROMPT}\n- {type: custom}\n- {type: custom, name: n, ref: 'a:b'}\n- {name: x}\n- {type: own, prompt: Z}"), ("b", "evaluators: []"), ("c", "x: [")]
    got = [(r.path, r.ordinal, r.metric, r.judge, r.problem) for r in specs.evaluator_rows(spark.createDataFrame(files, "path string, text string")).orderBy("path", "ordinal").collect()]
    assert got[:5] == [("a", 0, "contains", False, None), ("a", 1, "correctness", True, None), ("a", 2, "tone", True, None), ("a", 3, "custom", False, "no module:function"), ("a", 4, "n", False, None)]
    assert got[5][4] == "no type" and got[6][2:4] == ("z", True) and [g[4] for g in got[7:]] == ["no evaluators are given"] * 2


def test_thresholds_are_typed():
    t = specs.Thresholds.of({"thresholds": {"metrics": {"m": 1, "k": "0.25"}, "default": 0.5}, "runs": {"repeats": 3}})
    assert t == specs.Thresholds({"m": 1.0, "k": 0.25}, 0.5, 0.5, 0.8) and t.for_metric("m") == 1.0 and t.for_metric("z") == 0.5
    assert specs.Thresholds.of({}) == specs.Thresholds.of({"thresholds": None}) == specs.Thresholds()
    for wrong, said in (({"thresholds": {"default": "high"}}, "thresholds.default: not a number"), ({"thresholds": {"metrics": {"m": True}}}, "thresholds.metrics.m"), ({"thresholds": {"odd": 1}}, "unknown thresholds: odd"), ([], "mapping"), ({"thresholds": [1]}, "mapping")):
        with pytest.raises(ValueError, match=said):
            specs.Thresholds.of(wrong)


def subsequence(expected, actual):
    rest = iter(actual)
    from gaugeloom.functions.jsonvalues import contains

    return all(any(a.get("name") == e.get("name") and contains(a.get("args") or {}, e.get("args") or {}) for a in rest) for e in expected)


def test_expected_tools_equal_the_plain_version(spark):
    import random

    rng = random.Random(6)
    args = [{}, {"a": 1}, {"a": 1.0, "b": {"c": [1, True]}}, {"b": {"c": [1.0, 1]}}, {"b": {}}, {"a": "1"}, {"a": 2**53 + 1}]
    call = lambda: {"name": rng.choice("tuv"), "args": rng.choice(args)}
    rows = [(i, json.dumps([call() for _ in range(rng.randrange(6))]), json.dumps([call() for _ in range(rng.randrange(3))]), json.dumps(rng.sample("tuvw", rng.randrange(2)))) for i in range(400)]
    rows += [(1000, None, None, None), (1001, "[]", '[{"name": "t"}]', "[]"), (1002, '[{"name": "t", "args": null}]', '[{"name": "t"}]', None)]
    frame = spark.createDataFrame(rows, "i int, calls string, expected string, forbidden string")
    got = frame.select("i", ev.expected_tools("calls", "expected", "forbidden").alias("s"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: float(subsequence(json.loads(e or "[]"), json.loads(c or "[]")) and not {a["name"] for a in json.loads(c or "[]")} & set(json.loads(f or "[]"))) for i, c, e, f in rows}
    assert {r.i: r.s for r in got.collect()} == want and len(set(want.values())) == 2
    deep = spark.createDataFrame([("[]", json.dumps([{"name": "t", "args": {"a": {"b": {"c": 1}}}}]))], "c string, e string")
    with pytest.raises(Exception, match="deeper than 2 levels"):
        deep.select(ev.expected_tools("c", "e", F.lit("[]"), depth=2)).collect()


def test_specs_compile_or_say_why_not(spark):
    columns, judges = factory.compiled([{"type": "contains", "value": "x"}, {"type": "correctness", "name": "right"}, {"type": "TONE", "prompt": "p {outputs}"}])
    assert list(columns) == ["contains"] and list(judges) == ["right", "TONE"]
    for specs_, said in (([{"type": "odd"}], "unknown evaluator type 'odd'"), ([{"type": "openevals"}], "needs a prompt"), ([{"type": "contains"}] * 2, "two evaluators make contains"), ([{"type": "custom", "ref": "nothing"}], "module:function"), ([{"type": "trajectory_match", "match_mode": "odd"}], "unknown trajectory match")):
        with pytest.raises(ValueError, match=said):
            factory.compiled(specs_)
    runs = spark.createDataFrame([(0, "a", None, "Has Needle", "[]"), (0, "b", None, "{}", None), (0, "c", "boom", None, None), (0, "gone", None, "x", "[]")], "run_ordinal int, case_id string, error string, response string, calls string")
    cases = spark.createDataFrame([("a", '{"contains": "needle", "trajectory": []}'), ("b", '{"contains": ["{", "}"]}'), ("c", "{}")], "case_id string, reference string")
    with pytest.raises(ValueError, match="no judge for right"):
        factory.scored_by([{"type": "correctness", "name": "right"}], runs, cases)
    judge = lambda batch: pd.DataFrame({"score": [1.0] * len(batch), "comment": "ok", "error": [None] * len(batch)})
    got = {(r.case_id, r.metric): (r.outcome, r.score) for r in factory.scored_by([{"type": "contains"}, {"type": "json_valid"}, {"type": "trajectory_match"}, {"type": "correctness", "name": "right"}], runs, cases, {"right": judge}).collect()}
    assert got == {
        ("a", "contains"): ("scored", 1.0), ("a", "json_valid"): ("scored", 0.0), ("a", "trajectory_match"): ("skipped", None), ("a", "right"): ("scored", 1.0), ("b", "contains"): ("scored", 1.0), ("b", "json_valid"): ("scored", 1.0),
        ("b", "trajectory_match"): ("skipped", None), ("b", "right"): ("scored", 1.0), ("c", "contains"): ("scored", 0.0), ("c", "json_valid"): ("scored", 0.0), ("c", "trajectory_match"): ("scored", 0.0),
    }
    assert custom.outcome(None) == ("skipped", None, None) and custom.outcome(True)[1] == 1.0 and custom.outcome({"score": None, "comment": "x"}) == ("skipped", None, "x")


def test_mock_blocks_follow_precedence(spark):
    rule = "tool string, rule_idx int, match_args string, response string"
    cases = spark.createDataFrame([("a", "own"), ("b", ""), ("c", None)], "case_id string, strategy string")
    shared = spark.createDataFrame([("t", 1, "{}", "rest"), ("t", 0, '{"k": 1}', "one"), ("u", None, None, None)], rule)
    own = spark.createDataFrame([("a", "t", 0, "{}", "mine"), ("b", "t", None, None, None)], "case_id string, " + rule)
    at = lambda **more: {r.case_id: (r.on_miss, r.strategy, {t: [x.response for x in rules] for t, rules in r.tools.items()}) for r in mocks.mock_blocks(cases, own, shared, **more).collect()}
    assert at() == {"a": ("real", "own", {"t": ["mine"], "u": []}), "b": ("real", None, {"t": [], "u": []}), "c": ("real", None, {"t": ["one", "rest"], "u": []})}
    assert {k: v[:2] for k, v in at(dataset_on_miss="strict", strategy="run", dataset_strategy="set").items()} == {"a": ("strict", "own"), "b": ("strict", "run"), "c": ("strict", "run")}
    assert {v[:2] for v in at(on_miss="llm", dataset_on_miss="strict", dataset_strategy="set").values()} == {("llm", "own"), ("llm", "set")}


def test_authored_cases_with_odd_documents(spark):
    raw = [(1, "no json"), (2, "[]"), (3, '{"cell": 0.0, "user_message": "x"}'), (4, '{"cell": true, "user_message": "x"}'), (5, '{"cell": null, "user_message": "x"}'), (6, '{"cell": 0}'), (7, '{"cell": 0, "user_message": "hi", "expected_tools": [{"name": null}]}'),
           (8, '{"cell": 0, "user_message": " hi ", "expected_tools": [{"name": "t", "args": "[1]"}], "evidence": ["doc"], "contains": " c ", "mock_overrides": [{"tool": "t", "match_args": "oops", "response": "5"}]}'), (9, '{"cell": 0, "user_message": "next"}')]
    cells = spark.createDataFrame([(0, "k", "i", "t", "s", "none", 1, ["happy"], None, None)], "cell int, key string, intent string, topic string, scenario string, failure_mode string, count int, variants array<string>, tool string, edge string")
    tools = spark.createDataFrame([("t", '{"required": ["z"]}', None)], "tool string, args_schema string, output_schema string")
    cases, errors = au.authored_cases(spark.createDataFrame(raw, "ordinal int, doc string"), cells, tools, [], ["happy"])
    kept = cases.collect()
    assert [(r.ordinal, r.message, r.expected_tools, r.mocks, r.reference.contains, r.evidence) for r in kept] == [(8, "hi", '[{"name":"t","args":{}}]', '[{"tool":"t","matchArgs":{},"response":5}]', "c", ["doc"])]
    said = {r.ordinal: r.error for r in errors.collect()}
    assert said[6] == "empty user_message for cell k dropped" and said[7] == "case for k expects unknown tool None; dropped" and {3, 4, 5} <= set(said) and 8 not in said


def test_specification_files_are_read_once(spark):
    """Whether files are whole, broken or empty, they come in one pass."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    texts = [("a", "evaluators:\n- type: contains\n- {type: custom, name: x}\n"), ("b", "evaluators: []"), ("c", "a: ["), ("d", "- null\n- {type: new, prompt: MY_PROMPT}")]
    files = spark.createDataFrame(texts, "path string, text string").coalesce(1).mapInArrow(counted, "path string, text string")
    none = "no evaluators are given"
    want = [("a", 0, "contains", "contains", False, None), ("a", 1, "custom", "x", False, "no module:function"), ("b", None, None, None, None, none), ("c", None, None, None, None, none), ("d", 0, None, None, True, "no type"), ("d", 1, "new", "my", True, None)]
    assert sorted(map(tuple, specs.evaluator_rows(files).select("path", "ordinal", "type", "metric", "judge", "problem").collect()), key=lambda r: (r[0], r[1] or 0)) == want
    assert passes.value == 4
    got = [(r.path, r.ordinal, r.scenario_id, r.followups, r.problem) for r in specs.scenario_rows(spark.createDataFrame([("a", "- {id: s, opening: hi, max_turns: 1}"), ("c", "a: [")], "path string, text string")).collect()]
    assert sorted(got) == [("a", 0, "s", [], "success_contains or expect is missing"), ("c", None, None, None, "not YAML")]
