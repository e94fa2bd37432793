"""Schemas compiled to columns against the plain validator, message by message."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import jsonschema as js, schemacheck as sk

NAMES = ["a", "b", "long name", "é", "q'q"]
VALUES = [0, 1, -3, 1.0, 2.5, 1e20, 10**18 + 1, True, False, None, "", "a", "1", "it's", 'say "x"', "both ' and \"", "tab\t", "é x", "back\\slash", "2026-01-15", "12", "١٢", "x\n"]
PATTERNS = ["^a", "\\d{2}$", "^[a-z]+$", "x$", "\\w\\s", ".y"]


def value(rng, depth):
    kind = rng.randrange(8)
    if depth == 0 or kind < 4:
        return rng.choice(VALUES)
    if kind < 6:
        return {rng.choice(NAMES): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def schema(rng, depth):
    out = {}
    if rng.random() < 0.7:
        out["type"] = rng.choice(["string", "integer", "number", "boolean", "object", "array", "null", ["string", "null"], ["object", "array"], "odd"])
    for key, make in (
        ("minLength", lambda: rng.randrange(3)), ("maxLength", lambda: rng.randrange(4)), ("minItems", lambda: rng.randrange(3)), ("maxItems", lambda: rng.randrange(3)), ("minimum", lambda: rng.choice([0, 1.5])),
        ("maximum", lambda: rng.choice([1, 2.5, 10**18])), ("exclusiveMinimum", lambda: 0), ("exclusiveMaximum", lambda: rng.choice([1, 1.0])), ("pattern", lambda: rng.choice(PATTERNS)),
        ("enum", lambda: [value(rng, 1) for _ in range(3)]), ("const", lambda: value(rng, 1)), ("required", lambda: rng.sample(NAMES, 2)), ("additionalProperties", lambda: False),
    ):
        if rng.random() < (0.05 if key in ("enum", "const") else 0.25):
            out[key] = make()
    if depth:
        sub = lambda: schema(rng, depth - 1) if rng.random() < 0.8 else {"$ref": "#/$defs/" + rng.choice(["D", "E", "gone"])}
        if rng.random() < 0.6:
            out["properties"] = {n: sub() for n in rng.sample(NAMES, rng.randrange(1, 4))}
        if rng.random() < 0.4:
            out["items"] = sub()
        if rng.random() < 0.2:
            out["allOf"] = [sub() for _ in range(2)]
        if rng.random() < 0.2:
            out[rng.choice(["anyOf", "oneOf"])] = [sub() for _ in range(rng.randrange(3))]
    return out


def python_in(frame):
    return "Python" in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(4))
def test_compiled_schemas_say_what_the_validator_says(spark, seed):
    rng = random.Random(seed)
    texts = [json.dumps(value(rng, 3), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(60)] + ["", "[1] x", "nul"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    checks, plain = [], []
    while len(checks) < 8:
        own = schema(rng, 2) | {"$defs": {"D": schema(rng, 0), "E": {"properties": {"a": {"$ref": "#/$defs/D"}}, "required": ["b"]}}}
        partial = rng.random() < 0.3
        try:
            checks.append(sk.Compiler(own, partial)(F.col("t")).alias(f"c{len(checks)}"))
            plain.append(js.Validator(own, partial))
        except sk.Uncompiled:
            continue
    got = frame.select("i", *checks)
    assert not python_in(got)

    def said(check, text):
        try:
            return check.problems(json.loads(text))
        except ValueError:
            return ["$: not JSON"]

    wrong = [(check.root, t, list(r[k + 1]), said(check, t)) for r, t in zip(sorted(got.collect()), texts, strict=True) for k, check in enumerate(plain) if list(r[k + 1]) != said(check, t)]
    assert wrong == []


def test_what_is_not_compiled_is_still_checked(spark):
    tree = {"type": "object", "properties": {"left": {"$ref": "#/$defs/T"}}, "$defs": {"T": {"type": "object", "properties": {"left": {"$ref": "#/$defs/T"}}, "required": ["v"]}}}
    with pytest.raises(sk.Uncompiled):
        sk.Compiler(tree)(F.lit("{}"))
    one = lambda schema, t: spark.createDataFrame([(t,)], "t string").select(js.schema_problems(schema)(F.col("t")).alias("p")).first().p
    assert one(tree, '{"left": {"v": 1, "left": {}}}') == ["$.left.left: missing required 'v'"]
    assert one({"pattern": "(?P<x>a)\\Z"}, '"b"') == ["$: does not match pattern '(?P<x>a)\\\\Z'"]
    assert one({"enum": [1]}, "true") == [] and one({"enum": [{"a": 'q"'}]}, '{"a": "q\\""}') == []


def test_schemas_of_a_table_of_tools(spark):
    schemas = {"w": {"type": "object", "required": ["q"], "properties": {"q": {"type": "integer"}}}, "v": {"properties": {"n": {"$ref": "#/$defs/N"}}, "$defs": {"N": {"properties": {"n": {"$ref": "#/$defs/N"}}, "required": ["k"]}}}, "u": {}}
    rows = [("w", '{"q": "x"}'), ("w", "{}"), ("v", '{"n": {"k": 1, "n": {}}}'), ("u", "5"), ("u", "x"), ("none", "{"), ("w", None)]
    frame = spark.createDataFrame(rows, "tool string, t string")
    table = spark.createDataFrame([(t, json.dumps(s)) for t, s in schemas.items()], "tool string, s string")
    joined = frame.join(table, "tool", "left")
    known = js.known_schemas(table, "s")
    got = {(r.tool, r.t): list(r.p) for r in joined.select("tool", "t", js.conformance("t", "s", known).alias("p")).collect()}
    assert got == {(r.tool, r.t): list(r.p) for r in joined.select("tool", "t", js.conformance("t", "s").alias("p")).collect()}
    assert got["v", '{"n": {"k": 1, "n": {}}}'] == ["$.n.n: missing required 'k'"] and got["w", None] == ["$: not JSON"]
    flat = js.known_schemas(table.where("tool <> 'v'"), "s")
    assert not python_in(joined.where("tool <> 'v'").select(js.conformance("t", "s", flat).alias("p")))


def test_equal_schemas_are_sampled_once_a_batch(monkeypatch):
    import pandas as pd

    from gaugeloom.functions import jsonschema as js, samples

    calls = []
    own = samples.sample
    monkeypatch.setattr(samples, "sample", lambda s: calls.append(s) or own(s))
    texts = ['{"type": "integer", "minimum": 4}', None, '{"type": "boolean"}'] * 50
    got = js.sample_of.func(pd.Series(texts))
    assert got.tolist() == [json.dumps(own(json.loads(t or "{}"))) for t in texts] and len(calls) == 3
