"""Cases at the edges of what an evaluation's records mean."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import jsonschema as js, samples as sm, text as tx
from gaugeloom.functions.jsonvalues import case_identity, digest, document_identity
from gaugeloom.operators import agentmap as am, cases as cs, mocks, scores as sc, simulation as sim
from gaugeloom.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_engine_stats_need_the_mark(spark):
    rows = [("llm", None, 0, False, None), ("llm", False, 2, False, ""), ("llm", True, 1, True, "late"), ("rule", True, 0, False, None)]
    got = mocks.engine_stats(spark.createDataFrame(rows, "layer string, valid boolean, repairs int, fallback boolean, error string")).first()
    assert tuple(got) == (3, 1, 1, 1, 1)


def test_tail_ends_where_the_conversation_stopped(spark):
    said = [("user", "a"), ("assistant", "no"), ("user", "b"), ("assistant", "done"), ("user", "c"), ("assistant", "late trash")]
    messages = spark.createDataFrame([("t", i, r, c) for i, (r, c) in enumerate(said)], "conv_id string, ordinal int, role string, content string")
    talks = sim.transcripts(messages).select("*", F.lit(3).alias("max_turns"), F.lit("done").alias("success_contains"), F.lit("x").alias("expect_contains"), F.lit("").alias("expect_not_contains"))
    got = sim.mined(sim.outcomes(talks)).first()
    assert [m.content for m in got.transcript_tail] == ["a", "no", "b", "done"] and got.stop_reason == "success"


def test_new_cases_meet_repeated_ids_once(spark):
    have = spark.createDataFrame([("a",), ("a",)], "case_id string")
    new = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "case_id string, ordinal int")
    add, dup = cs.add_new(have, new)
    assert [r.case_id for r in add.collect()] == ["b"] and sorted((r.case_id, r.ordinal) for r in dup.collect()) == [("a", 0), ("b", 2)]


def test_policy_is_checked_where_it_applies(spark):
    rows = [("llm", None, None, None, None, None), ("real", "odd", None, None, "s", []), ("llm", "a:b", "maybe", -1, "s", ["t"])]
    got = cs.policy_problems(spark.createDataFrame(rows, "on_miss string, model string, on_invalid string, max_repairs int, strategy string, strategies array<string>"))
    assert sorted(r.problem for r in got.collect()) == ["invalid on_invalid", "max_repairs must not be negative", "model is required when on_miss is llm", "strategy is not declared"]


def test_imports_keep_explicit_nulls(spark):
    doc = {"examples": [{"id": 1, "inputs": {"q": 1}, "reference_outputs": None, "outputs": {"x": 1}, "metadata": {}, "additional_metadata": {"intent": "i", "source": "old"}}]}
    got = cs.import_rows(spark.createDataFrame([(json.dumps(doc),)], "doc string"), source_path="f.json").first()
    assert got.reference_outputs is None and json.loads(got.metadata) == {"intent": "i", "source": "import", "source_path": "f.json"}


def test_reviews_are_refused_loudly(spark):
    cases = spark.createDataFrame([("a", "pending", "")], "case_id string, review_status string, review_note string")
    wrong = spark.createDataFrame([("a", "maybe"), ("z", "approved")], "case_id string, status string")
    assert {tuple(r) for r in cs.review_problems(cases, wrong).collect()} == {("a", "invalid review status maybe"), ("z", "unknown case id")}
    with pytest.raises(Exception, match="invalid review status"):
        cs.set_review(cases, wrong).collect()


def test_rules_are_equal_as_json(spark):
    rule = "case_id string, tool string, rule_idx int, match_args string, response string"
    own = spark.createDataFrame([("c", "t", 0, '{"b": 1, "a": 2}', '"x"'), ("e", "t", None, None, None)], rule)
    data = spark.createDataFrame([("t", 0, '{"a":2,"b":1}', '"x"'), ("t", 1, "{}", '"y"')], "tool string, rule_idx int, match_args string, response string")
    got = sorted((r.case_id, r.rule_idx, r.response) for r in mocks.with_fallback(own, data).collect())
    assert got == [("c", 0, '"x"'), ("c", 1, '"y"'), ("e", 0, '"x"'), ("e", 1, '"y"')]


def test_first_match_of_nested_rules(spark):
    rules = [("t", 0, '{"a": {"b": 1}}', "deep"), ("t", 1, '{"n": 1}', "flat"), ("t", 2, "{}", "any")]
    r = spark.createDataFrame(rules, "tool string, rule_idx int, match_args string, response string")
    calls = [(0, "t", '{"a": {"b": 1.0, "c": 2}}'), (1, "t", '{"a": {"b": 2}, "n": true}'), (2, "t", '{"n": "1"}'), (3, "t", None), (4, "u", "{}"), (5, "t", '{"n": null}')]
    got = {x.call_id: x.rule_idx for x in mocks.first_match(spark.createDataFrame(calls, "call_id int, tool string, args string"), r).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: None, 5: 2}


def test_labels_specs_and_numbers(spark):
    label = lambda t: one(spark, tx.dns_label(F.lit(t)))
    assert [label(t) for t in ("a__b", "--x.", "##", "é1")] == ["a--b", "x", "agent", "é1"] and len(label("x" * 80)) == 50
    spec = lambda t: tuple(one(spark, tx.model_spec(F.lit(t))) or ())
    assert spec("claude:m@high") == ("anthropic", "m", "high") and spec("scripted:a.b:f@x") == ("scripted", "a.b:f@x", None) and spec("plain") == ()
    assert one(spark, tx.percent(F.lit(12.5))) == "1250%" and one(spark, tx.number(F.lit(None).cast("double"))) == "—"
    assert one(spark, tx.excerpt(F.lit("#Head\nsome\n words"))) == "some words"


def test_identities_keep_nulls(spark):
    none = F.lit(None).cast("string")
    tags = {"intent": "unspecified", "topic": "unspecified", "scenario": "unspecified", "failure_mode": "none"}
    assert one(spark, case_identity(none, none, none, none, none)) == f"case-{digest({'inputs': None, **tags})[:10]}"
    assert one(spark, document_identity(F.lit("{}"), F.lit('{"topic": null}'))) == f"case-{digest({'inputs': {}, **tags, 'topic': None})[:10]}"


def test_samples_follow_the_order_of_keywords():
    own = sm.sample
    assert own({"const": 1, "enum": [2], "examples": [3]}) == 1 and own({"enum": [2], "examples": [3]}) == 2 and own({}) == {}
    assert own({"type": "string", "minLength": 12}) == "example-exam" and own({"type": "integer", "exclusiveMinimum": 4}) == 5
    assert own({"allOf": [{"type": "number"}, {"maximum": -2}]}) == -2.0
    assert sm.spoiled({}) == {"error": "malformed tool output"} and sm.spoiled({"type": "string"}) == "malformed: example"
    assert sm.spoiled({"properties": {"o": {"type": ["null", "object"]}}}, "wrong_type") == {"o": "free text instead of structured data"}


def test_stamps_and_wraps(spark):
    doc = F.struct(F.lit(1).alias("a"), F.lit("old").alias("schema"))
    assert json.loads(one(spark, F.to_json(sinks.stamped(doc, "ns", "agent_map", ["a", "schema"])))) == {"schema": "ns/agent-map/v1", "a": 1}
    assert json.loads(one(spark, F.to_json(sinks.stamped(F.array(F.lit(1)), "ns", "mock_rules", [], "tools")))) == {"schema": "ns/mock-rules/v1", "tools": [1]}


def test_skills_reach_nodes(spark):
    n = "id string, kind string, prompt string, tools array<string>, skills array<string>, source string"
    nodes = [("a", "llm", "use triage", None, None, None), ("b", "llm", "", ["load_skill"], None, None), ("c", "llm", "", [], ["page"], "state"), ("d", "tool", "triage", None, None, None), ("e", "llm", "", [], None, None)]
    got = {tuple(r) for r in am.node_skills(spark.createDataFrame(nodes, n), spark.createDataFrame([("triage",), ("page",)], "skill string")).collect()}
    assert got == {("a", "triage", "prompt"), ("b", "page", "loader"), ("b", "triage", "loader"), ("c", "page", "state")}


def test_cube_holds_slices_without_scores(spark):
    s = spark.createDataFrame([(0, "a", "m", "scored", 1.0), (0, "a", "k", "error", None), (0, "b", "m", "skipped", None)], "run_ordinal int, case_id string, metric string, outcome string, score double")
    cases = spark.createDataFrame([("a", "i", None, "v"), ("b", "j", "f", "v")], "case_id string, intent string, failure_mode string, variant string")
    got = {(r.dim, r.value, r.metric): (r.n, r.rate, r.passed) for r in sc.slice_rates(s, cases).collect()}
    assert got[("intent", "i", "m")] == (1, 1.0, True) and got[("intent", "j", None)] == (1, None, True) and got[("variant", "v", "m")] == (2, 1.0, True) and ("intent", "i", "k") not in got
    plain, cubed = ({r.metric: (r.pass_rate, r.n_cases, r.n_scores, r.errors, r.passed) for r in x.collect()} for x in (sc.metric_rates(s), sc.cube_rates(sc.cube(s, cases))))
    assert plain == cubed == {"m": (1.0, 1, 1, 0, True), "k": (None, 0, 0, 1, False)}
