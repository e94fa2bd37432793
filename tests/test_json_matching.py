"""JSON in the JVM against plain Python: canonical form, hashes, leaves, rule matching; one-to-one matching against all assignments."""

from __future__ import annotations

import itertools
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import jsontext as jt, jsonvalues as jv
from gaugeloom.functions.matching import all_matched
from gaugeloom.operators import evaluators as ev, mocks

PIECES = ["a", "B", "é", '"', "\\", "\n", "/", ",", ":", "{", "}", "[", "]", " ", "1", "\x01", "\x1f", "\x7f", "😀", "", "￿", "'", " ", "\b", "u0003", "\\u0003", "true"]


def number(rng):
    kinds = [
        lambda: rng.choice([0, -1, 5, 10**20, 10**40, -7, 2**53 + 1]),
        rng.random,
        lambda: struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0],
        lambda: rng.choice([1.0, -0.0, 1e5, 1e16, 1e-5, 1e22, 1e23, 5e-324, 1.7976931348623157e308, 2e-3, 2.0**70]),
        lambda: round(rng.uniform(-1000, 1000), rng.randrange(4)),
    ]
    x = rng.choice(kinds)()
    return x if math.isfinite(x) else 1.5


def text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(5)))


def value(rng, depth):
    kind = rng.randrange(7)
    if depth == 0 or kind < 3:
        return rng.choice([number(rng), text(rng), None, True, False])
    if kind < 5:
        return {text(rng): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(3))]


def has_python(frame):
    return "Python" in frame._jdf.queryExecution().executedPlan().toString()


def test_canonical_form_is_pythons(spark):
    rng = random.Random(1)
    rows = [(i, json.dumps(value(rng, 4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i in range(800)]
    rows += [(10_000 + i, json.dumps(number(rng))) for i in range(1500)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", jt.canonical(F.col("t")).alias("c"), jv.json_digest("t").alias("d"))
    assert not has_python(got)
    want = {i: (jv.canonical(json.loads(t)), jv.digest(json.loads(t))) for i, t in rows}
    assert {r.i: (r.c, r.d) for r in got.collect()} == want


def test_canonical_form_of_nothing_and_of_no_json(spark):
    one = lambda t: spark.range(1).select(jt.canonical(F.lit(t).cast("string")).alias("c")).first().c
    assert one(None) is None and one(" 1 ") == "1" and one("-0") == "0" and one("-0.0") == "-0.0"
    whole = lambda t: spark.range(1).select(jt.parsed(F.lit(t)).isNotNull().alias("v")).first().v
    assert [t for t in ("", "1 2", "[1] x", "1] [2", "1}", '{"a": 1}}', "01", "{'a': 1}", "[1,]", "nul") if whole(t)] == []
    with pytest.raises(Exception, match="no JSON"):
        one("[1] x")


def test_identities_need_no_python_worker(spark):
    rows = [(json.dumps({"z": 1.50, "a": ["x", {"k": None}]}), "in", None, "s", None), (None, None, None, None, "é")]
    frame = spark.createDataFrame(rows, "inputs string, intent string, topic string, scenario string, failure_mode string")
    got = frame.select(jv.case_identity("inputs", "intent", "topic", "scenario", "failure_mode").alias("c"), jv.output_hash("intent", F.lit('[["t", {"b": 1, "a": 2.0}]]'), "topic").alias("o"))
    assert not has_python(got)
    want = []
    for inputs, intent, topic, scenario, mode in rows:
        d = jv.digest({"inputs": json.loads(inputs or "null"), "intent": intent or "unspecified", "topic": topic or "unspecified", "scenario": scenario or "unspecified", "failure_mode": mode or "none"})
        want.append((f"case-{d[:10]}", jv.digest({"response": intent, "tool_calls": [["t", {"b": 1, "a": 2.0}]], "error": topic})[:12]))
    assert list(map(tuple, got.collect())) == want


LEAF = [1, 1.0, True, "1", 0, False, None, 2**53, 2**53 + 1, float(2**53), [1, 2], [1.0, 2], [2, 1], [{"x": 1}], [{"x": True}], {}, [], "", "a=b", 0.1, 1e300, 10**25]


def matcher(rng, depth):
    own = {}
    for _ in range(rng.randrange(0, 3)):
        own[rng.choice(["k", "l", 'q"]="', "é"])] = matcher(rng, depth - 1) if depth and rng.random() < 0.4 else rng.choice(LEAF)
    return own


def test_rules_match_as_plain_containment(spark):
    rng = random.Random(3)
    rules = [("t", i, json.dumps(matcher(rng, 3)), f"r{i}") for i in range(60)] + [("u", 0, "{}", "any"), ("v", 0, None, "none"), ("w", 0, '{"k": 1}', "one")]
    rules = [r for r in rules if r[0] != "t" or json.loads(r[2]) or r[1] > 55]
    calls = [(i, "t", json.dumps(matcher(rng, 4))) for i in range(400)] + [(1000, "u", "[1]"), (1001, "u", None), (1002, "v", "{}"), (1003, "w", None), (1004, "w", '{"k": true, "z": 2}'), (1005, "x", "{}"), (1006, "w", '{"k": true, "z": 2}'), (1006, "w", '{"k": 2}')]
    r = spark.createDataFrame(rules, "tool string, rule_idx int, match_args string, response string")
    c = spark.createDataFrame(calls, "call_id int, tool string, args string")

    def first(tool, args):
        have = json.loads(args) if args else None
        return next((i for t, i, m, _ in rules if t == tool and (not m or not json.loads(m) or jv.contains(have, json.loads(m)))), None)

    want = sorted((i, t, a, first(t, a)) for i, t, a in calls if a) + sorted((i, t, a, first(t, a)) for i, t, a in calls if not a)
    assert len({w[3] for w in want}) > 15
    rows = lambda found: sorted((tuple(x) for x in found.select("call_id", "tool", "args", "rule_idx").collect()), key=lambda x: (x[2] is None, x[0], x[1], x[2]))
    by_list, by_index = mocks.first_match(c, r), mocks.first_match_indexed(c, r)
    assert rows(by_list) == rows(by_index) == sorted(want, key=lambda x: (x[2] is None, x[0], x[1], x[2]))
    assert not has_python(by_list) and not has_python(by_index)
    chain = mocks.first_match_constant(c, {t: [(json.loads(m or "{}"), x) for k, _, m, x in rules if k == t] for t in ("t", "u", "v", "w")})
    number = {t: [i for k, i, _, _ in rules if k == t] for t in ("t", "u", "v", "w")}
    assert [(*x[:3], x[3] if x[3] is None else number[x[1]][x[3]]) for x in rows(chain)] == rows(by_list)


def test_rule_index_holds_each_rule_once(spark):
    """Ten thousand rules that share a leaf: no call meets more than its own."""
    r = spark.range(10_000).select(F.lit("t").alias("tool"), F.col("id").cast("int").alias("rule_idx"), F.format_string('{"p": 1, "o": {"k": %d}}', "id").alias("match_args"), F.lit("x").alias("response"))
    c = spark.range(0, 10_000, 7).select(F.col("id").alias("call_id"), F.lit("t").alias("tool"), F.format_string('{"o": {"k": %d, "z": 0}, "p": 1.0}', "id").alias("args"))
    found = mocks.first_match_indexed(c, r, depth=2)
    assert found.where("call_id <=> rule_idx").count() == c.count()


def test_matching_equals_all_assignments():
    rng = random.Random(7)
    for _ in range(600):
        n, m = rng.randrange(0, 6), rng.randrange(0, 6)
        suits = [[j for j in range(m) if rng.random() < 0.4] for _ in range(n)]
        want = any(all(p[i] in suits[i] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else False
        assert all_matched(suits) == want
    assert all_matched([[i, i + 1] for i in range(2000)])  # long chains need no recursion


def test_trajectories_match_whatever_the_order(spark):
    rng = random.Random(11)
    args = [{}, {"a": 1}, {"b": 2}, {"a": 1, "b": 2}]
    rows = [(i, json.dumps([{"name": "t", "args": rng.choice(args)} for _ in range(rng.randrange(4))]), json.dumps([{"name": "t", "args": rng.choice(args)} for _ in range(rng.randrange(4))])) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, calls string, reference string")

    def brute(small, big, suits):
        return any(all(suits(s, big[j]) for s, j in zip(small, p, strict=True)) for p in itertools.permutations(range(len(big)), len(small)))

    part = lambda h, w: jv.contains(h["args"], w["args"])
    got = frame.select("i", *[ev.trajectory_match(m)("calls", "reference").alias(m) for m in ("unordered", "superset", "subset")]).collect()
    for (_, h, w), r in zip(rows, sorted(got), strict=True):
        have, want = json.loads(h), json.loads(w)
        over = brute(want, have, lambda x, y: part(y, x))
        assert (r.unordered, r.superset, r.subset) == (float(over and len(have) == len(want)), float(over), float(brute(have, want, part)))
