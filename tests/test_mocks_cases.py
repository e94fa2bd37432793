import json

from pyspark.sql import functions as F

from gaugeloom.functions import jsonvalues as jv
from gaugeloom.operators import cases as cs, mocks

RULES = "tool string, rule_idx int, match_args string, response string"
CALLS = "call_id int, tool string, args string"


def test_first_match_wins_and_wildcards(spark):
    rules = spark.createDataFrame([("w", 0, '{"city": "SFO"}', "fog"), ("w", 1, "{}", "any"), ("t", 0, '{"ticket": {"service": "db"}}', "deep")], RULES)
    calls = spark.createDataFrame([(1, "w", '{"city": "SFO", "u": 1}'), (2, "w", '{"city": "OSL"}'), (3, "t", '{"ticket": {"service": "db", "severity": 2}}'), (4, "t", '{"ticket": "db"}'), (5, "x", "{}")], CALLS)
    got = {r.call_id: (r.rule_idx, r.response) for r in mocks.first_match(calls, rules).collect()}
    assert got == {1: (0, "fog"), 2: (1, "any"), 3: (0, "deep"), 4: (None, None), 5: (None, None)}


def test_subset_equality_is_that_of_numbers():
    assert jv.contains({"a": 1, "b": {"c": [1, 2]}}, {"a": 1.0, "b": {"c": [1, 2]}})
    assert not jv.contains({"b": {"c": [1, 2]}}, {"b": {"c": [1]}})
    assert not jv.contains({"a": None}, {"x": None})


def test_unanswered_calls(spark):
    rules = spark.createDataFrame([("a", 0, '{"k": 1}', "r"), ("empty", None, None, None)], RULES)
    calls = spark.createDataFrame([(1, "a", '{"k": 1}'), (2, "a", '{"k": 2}'), (3, "empty", "{}"), (4, "free", "{}")], CALLS)
    miss = mocks.unanswered(calls, rules)
    assert sorted(r.call_id for r in miss.collect()) == [2, 3]
    assert mocks.verify_summary(miss, "llm").first().asDict() == {"policy": "llm", "misses": 0, "llm_answered": 2, "ok": True}
    assert not mocks.verify_summary(miss, "real").first().ok


def test_merge_and_fallback(spark):
    data = spark.createDataFrame([("a", 0, "{}", "d"), ("b", 0, '{"k": 1}', "e"), ("b", 1, "{}", "f")], RULES)
    own = spark.createDataFrame([("c", "b", 0, '{"k": 1}', "e"), ("z", "b", 0, "{}", "all")], "case_id string, " + RULES)
    merged = sorted((r.case_id, r.tool, r.rule_idx, r.response) for r in mocks.merge_rules(data, own).collect())
    assert merged == [("c", "a", 0, "d"), ("c", "b", 0, "e"), ("z", "a", 0, "d"), ("z", "b", 0, "all")]
    more = sorted((r.case_id, r.rule_idx, r.response) for r in mocks.with_fallback(own, data).collect())
    assert more == [("c", 0, "e"), ("c", 1, "f"), ("z", 0, "all")]


def test_ledger_counts_twice_where_marked(spark):
    rows = [("r", None, False, None, None), ("r", "llm", True, "boom", False), ("r", "fallback", True, None, None), ("r", "error", None, "x", None), ("r", "odd", None, None, None)]
    t = mocks.ledger_totals(spark.createDataFrame(rows, "run string, layer string, fallback boolean, error string, valid boolean"), ["run"]).first()
    assert (t.rule, t.llm, t.real, t.fallback, t.error, t.invalid) == (1, 1, 0, 2, 2, 1)


def test_identity(spark):
    raw = spark.createDataFrame([(0, None, '{"q": 1}', None, None, None, None), (1, "own", "{}", "i", None, None, None)], "ordinal int, case_id string, inputs string, intent string, topic string, scenario string, failure_mode string")
    got = cs.normalize(raw).orderBy("ordinal").collect()
    assert got[0].case_id == "case-9b69462f29" and got[1].case_id == "own"
    assert {r.review_status for r in got} == {"pending"}


def test_hashes(spark):
    r = spark.range(1).select(jv.trajectory_hash(F.lit('[["t", {"b": 1, "a": 2}]]'), F.lit(None).cast("string")).alias("t")).first().t
    assert r == jv.digest({"tool_calls": [["t", {"a": 2, "b": 1}]], "error": None})[:12]


def test_json_valid(spark):
    texts = ['{"a": 1}', "{} x", "NaN", '{"a":1,"a":2}', "", None, "3"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", jv.json_valid("t").alias("v")).orderBy("i").collect()]
    assert got == [True, False, True, True, False, False, True]


def test_import_and_dedup(spark):
    doc = {"cases": [], "examples": [{"inputs": {"q": 1}, "outputs": {"r": 2}, "additional_metadata": {"m": 3}}]}
    got = cs.import_rows(spark.createDataFrame([(json.dumps(doc),), (json.dumps([{"inputs": 5}]),)], "doc string")).collect()
    assert {(r.inputs, r.reference_outputs, r.metadata, r.source) for r in got} == {('{"q":1}', '{"r":2}', '{"m":3,"source":"import","source_path":null}', "import"), ("5", None, '{"source":"import","source_path":null}', "import")}
    have = spark.createDataFrame([("a",)], "case_id string")
    new = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "case_id string, ordinal int")
    add, dup = cs.add_new(have, new)
    assert [(r.case_id, r.ordinal) for r in add.collect()] == [("b", 1)] and dup.count() == 2


def test_problems_and_review(spark):
    cases = spark.createDataFrame([("a", "{}", "pending"), ("a", '{"q":1}', "odd"), (None, '{"q":1}', "approved")], "case_id string, inputs string, review_status string")
    assert sorted(r.problem for r in cs.problems(cases).collect()) == ["duplicate id", "inputs must be a non-empty object", "invalid review status", "missing id"]
    gate = cs.review_gate(spark.createDataFrame([("x", "pending"), ("y", "pending")], "case_id string, review_status string"), spark.createDataFrame([("x",)], "case_id string"), False)
    assert {r.case_id: r.review_status for r in gate.collect()} == {"x": "rejected", "y": "pending"}


def test_rule_problems(spark):
    rows = [("t", 0, '{"matchArgs": {}, "response": null}'), ("t", 1, '{"matchArgs": 3, "response": 1}'), ("t", 2, '{"matchArgs": {}}'), ("t", 3, "[]")]
    got = sorted((r.rule_idx, r.problem) for r in cs.rule_problems(spark.createDataFrame(rows, "tool string, rule_idx int, rule string")).collect())
    assert [g for g in got if g[0] in (1, 2)] == [(1, "matchArgs must be an object"), (2, "response is missing")]
    assert not [g for g in got if g[0] == 0] and (3, "rule must be an object") in got
