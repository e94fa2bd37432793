"""Queries on what generators author and on evaluators made from specs, over the synthetic tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import jsonschema as js
from ..operators import authoring as au, factory, mocks
from . import adapters as ad
from .adapters import LINES_SQL, table
from .registry import query

SPECS = [
    {"type": "expected_tools"}, {"type": "contains"}, {"type": "json_valid"}, {"type": "trajectory_match", "match_mode": "superset", "args_match": "ignore"},
    {"type": "custom", "name": "brief", "ref": "gaugeloom.operators.custom:brief"}, {"type": "openevals", "prompt": "TONE_PROMPT"},
]


def _tone(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands for a judge: it can't judge what has no full stop."""
    urgent = batch["response"].str.contains("URGENT")
    return pd.DataFrame({"score": urgent.astype(float), "comment": "ok", "error": batch["response"].where(batch["response"].str.contains("LOW")).map(lambda x: None if x != x or x is None else "no tone")})


@query(f"""WITH {LINES_SQL}, l AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AS af, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'N') AS n FROM lines GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, '{{"p": "' || o_orderpriority || '"' || CASE WHEN o_orderstatus = 'F' THEN '}}' ELSE '' END AS resp, coalesce(af, false) AS af, coalesce(r, false) AS r, coalesce(n, false) AS n FROM orders JOIN l ON k = o_orderkey),
m AS (SELECT k, s, 'expected_tools' AS metric, (af AND NOT r)::INT::DOUBLE AS score FROM o UNION ALL SELECT k, s, 'contains', CASE WHEN k % 2 = 0 THEN contains(p, 'URGENT')::INT::DOUBLE END FROM o
UNION ALL SELECT k, s, 'json_valid', (s = 'F')::INT::DOUBLE FROM o UNION ALL SELECT k, s, 'trajectory_match', CASE WHEN k % 3 = 0 THEN n::INT::DOUBLE END FROM o UNION ALL SELECT k, s, 'brief', (length(resp) <= 16)::INT::DOUBLE FROM o)
SELECT k AS case_id, metric, CASE WHEN s = 'P' OR score IS NOT NULL THEN 'scored' ELSE 'skipped' END AS outcome, CASE WHEN s = 'P' THEN 0.0 ELSE score END AS score FROM m
UNION ALL SELECT k, 'tone', CASE WHEN contains(p, 'LOW') THEN 'error' ELSE 'scored' END, contains(p, 'URGENT')::INT::DOUBLE FROM o WHERE s <> 'P'""")
def scored_by_specs(spark, d):
    """Five evaluators and a judge from their specs: an order is a case, its lines are the calls of its run."""
    one = F.struct("run_ordinal", F.col("l_returnflag").alias("name"), F.struct(F.col("l_linestatus").alias("s")).alias("args"))
    calls = ad.lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    o = table(spark, d, "orders").join(calls, "o_orderkey")
    key = F.col("o_orderkey")
    expected = F.array(F.struct(F.lit("A").alias("name"), F.struct(F.lit("F").alias("s")).alias("args")))
    reference = F.to_json(F.struct(expected.alias("expected_tools"), F.array(F.lit("R")).alias("forbidden_tools"), F.when(key % 2 == 0, F.array(F.lit("urgent"))).alias("contains"), F.when(key % 3 == 0, F.array(F.struct(F.lit("N").alias("name")))).alias("trajectory")))
    cases = o.select(key.alias("case_id"), reference.alias("reference"))
    response = F.concat(F.lit('{"p": "'), "o_orderpriority", F.lit('"'), F.when(F.col("o_orderstatus") == "F", "}").otherwise(""))
    runs = o.select(F.lit(0).alias("run_ordinal"), key.alias("case_id"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"), response.alias("response"), F.to_json(F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["args"].alias("args")))).alias("calls"))
    s = factory.scored_by(SPECS, runs, cases, {"tone": _tone})
    return s.select(F.col("case_id").cast("long").alias("case_id"), "metric", "outcome", "score")


@query("""WITH d AS (SELECT DISTINCT c_mktsegment AS tool FROM customer),
own AS (SELECT c_custkey AS k, 'BUILDING' AS tool, 'BUILDING:0 ' || c_name AS rule FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'MACHINERY', 'MACHINERY:' FROM customer WHERE c_custkey % 8 = 0),
r AS (SELECT k, tool, rule FROM own UNION ALL SELECT c.c_custkey, d.tool, d.tool || ':0 all,1 rest' FROM customer c, d WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.k = c.c_custkey AND o.tool = d.tool))
SELECT c_custkey AS case_id, 'llm' AS on_miss, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'run' END AS strategy, string_agg(rule, '; ' ORDER BY tool) AS rules FROM customer JOIN r ON k = c_custkey GROUP BY ALL""")
def mock_blocks(spark, d):
    """The rules, policy and strategy of each customer: own lists go before the dataset's, an empty one too."""
    c = table(spark, d, "customer")
    tools = c.select(F.col("c_mktsegment").alias("tool")).distinct()
    rules = tools.select("tool", F.explode(F.array(*[F.struct(F.lit(i).alias("rule_idx"), F.lit("{}").alias("match_args"), F.lit(x).alias("response")) for i, x in ((1, "rest"), (0, "all"))])).alias("r")).select("tool", "r.*")
    own = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("case_id"), F.lit("BUILDING").alias("tool"), F.lit(0).alias("rule_idx"), F.lit("{}").alias("match_args"), F.col("c_name").alias("response"))
    none = F.lit(None)
    empty = c.where("c_custkey % 8 = 0").select(F.col("c_custkey").alias("case_id"), F.lit("MACHINERY").alias("tool"), none.cast("int").alias("rule_idx"), none.cast("string").alias("match_args"), none.cast("string").alias("response"))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 3 == 0, "own").when(F.col("c_custkey") % 3 == 1, "").alias("strategy"))
    b = mocks.mock_blocks(cases, own.unionByName(empty), rules, on_miss="llm", strategy="run", dataset_on_miss="strict", dataset_strategy="set")
    listed = F.transform(F.array_sort(F.map_entries("tools")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda r: F.concat_ws(" ", r["rule_idx"].cast("string"), r["response"])), ",")))
    return b.select("case_id", "on_miss", "strategy", F.array_join(listed, "; ").alias("rules"))


_RAW = """raw AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 7 < 5 THEN c_custkey % 7 END AS cell, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS message, CASE WHEN c_custkey % 13 = 0 THEN 'lost' ELSE 'find' END AS tool,
  CASE WHEN c_custkey % 19 = 0 THEN '"x"' ELSE (c_custkey % 7)::VARCHAR END AS said FROM customer),
ok AS (SELECT raw.*, r_name AS key FROM raw JOIN region ON r_regionkey = cell WHERE message <> '' AND tool = 'find')"""


def _authored(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    args = F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))
    given = F.when(k % 2 == 0, text(F.replace(args, F.lit('"'), F.lit('\\"')))).otherwise(args)
    override = lambda when, tool, response: F.when(when, F.concat(F.lit('{"tool": "'), F.lit(tool), F.lit('", "match_args": "{}", "response": '), F.lit(response), F.lit("}")))
    overrides = F.array(override(k % 4 == 0, "pay", '"{\\"paid\\": 1}"'), override(k % 6 == 0, "gone", '"1"'), override(k % 10 == 0, "find", '"{"'))
    doc = F.concat(
        F.lit('{"cell": '), F.when(k % 19 == 0, '"x"').otherwise((k % 7).cast("string")), F.lit(', "user_message": '), F.when(k % 11 == 0, '" "').otherwise(text(F.concat(F.lit(" "), "c_name"))),
        F.lit(', "expected_tools": [{"name": '), F.when(k % 13 == 0, '"lost"').otherwise('"find"'), F.lit(', "args": '), given, F.lit('}], "forbidden_tools": ["pay", "gone"], "mock_overrides": ['), F.array_join(F.filter(overrides, lambda o: o.isNotNull()), ", "),
        F.lit('], "variant": '), F.when(k % 3 == 0, '"adversarial"').otherwise('"odd"'), F.lit(', "user_turns": '), F.when(k % 5 == 0, '["more", " "]').otherwise("[]"), F.lit(', "mock_strategy": '), F.when(k % 9 == 0, '"wild"').when(k % 2 == 0, '"calm"').otherwise("null"), F.lit("}"),
    )
    raw = table(spark, d, "customer").select(k.alias("ordinal"), doc.alias("doc"))
    r = table(spark, d, "region")
    cells = r.select(F.col("r_regionkey").cast("int").alias("cell"), F.col("r_name").alias("key"), F.col("r_name").alias("intent"), F.lit("t").alias("topic"), F.lit("s").alias("scenario"), F.lit("none").alias("failure_mode"), F.lit(60).alias("count"), F.array(F.lit("happy")).alias("variants"), F.when(F.col("r_regionkey") == 3, "pay").alias("tool"), F.when(F.col("r_regionkey") == 3, "malformed_output").alias("edge"))
    tools = spark.createDataFrame([("find", '{"properties": {"k": {"type": "integer", "maximum": 700}}}', None), ("pay", "{}", '{"type": "object", "required": ["paid"], "properties": {"paid": {"type": "integer"}, "note": {"type": "string"}}}')], "tool string, args_schema string, output_schema string")
    return au.authored_cases(raw, cells, tools, ["calm"], ["happy", "adversarial"])


@query(f"""WITH {_RAW}, t AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k) AS n FROM ok)
SELECT k AS ordinal, key, message, '[{{"name":"find","args":{{"k":' || k || '}}}}]' AS expected_tools, 'pay' AS forbidden, CASE WHEN k % 5 = 0 THEN 'multi-turn' WHEN k % 3 = 0 THEN 'adversarial' ELSE 'happy' END AS variant, CASE WHEN k % 9 <> 0 AND k % 2 = 0 THEN 'calm' END AS strategy,
CASE WHEN cell = 3 THEN '[{{"tool":"pay","matchArgs":{{}},"response":{{"note": "note"}}}}]' WHEN k % 4 = 0 THEN '[{{"tool":"pay","matchArgs":{{}},"response":{{"paid": 1}}}}]' END AS mocks FROM t WHERE n <= 60""")
def authored_cases(spark, d):
    """Cases a generator wrote for five cells: what is usable of them, with a malformed output where the cell is about one."""
    c, _ = _authored(spark, d)
    return c.select("ordinal", "key", "message", "expected_tools", F.array_join("forbidden_tools", ",").alias("forbidden"), "variant", "strategy", "mocks")


@query(f"""WITH {_RAW}
SELECT k AS ordinal, CASE WHEN cell IS NULL THEN 'case with unknown cell index ' || said || ' dropped' WHEN message = '' THEN 'empty user_message for cell ' || r_name || ' dropped' ELSE 'case for ' || r_name || ' expects unknown tool ''lost''; dropped' END AS error
FROM raw LEFT JOIN region ON r_regionkey = cell WHERE cell IS NULL OR message = '' OR tool = 'lost'
UNION ALL SELECT k, 'case for ' || key || ': expected_tools find args violate args_schema: $.k: above maximum 700' FROM ok WHERE k > 700
UNION ALL SELECT k, 'mock override for unknown tool in ' || key || ' ignored' FROM ok WHERE k % 6 = 0
UNION ALL SELECT k, 'mock override for find in ' || key || ' ignored (invalid JSON)' FROM ok WHERE k % 10 = 0
UNION ALL SELECT k, 'case for ' || key || ': unknown mock strategy ''wild'' ignored' FROM ok WHERE k % 9 = 0""")
def authored_errors(spark, d):
    _, errors = _authored(spark, d)
    return errors.select("ordinal", "error")


@query("""SELECT p_partkey AS k, '{"size": ' || CASE WHEN p_size > 3 THEN p_size ELSE 1 END || ', "name": "name", "kind": "' || p_type || '"}' AS sample, '{"name": "name", "kind": "' || p_type || '"}' AS lacking, '{"size": "not-a-number", "name": "name", "kind": "' || p_type || '"}' AS wrong FROM part""")
def schema_samples_spoiled(spark, d):
    """A schema a part: a value it allows, one without its required member, and one with a member of another type."""
    limit = F.when(F.col("p_size") > 3, F.concat(F.lit(', "minimum": '), F.col("p_size").cast("string"))).otherwise("")
    schema = F.concat(F.lit('{"type": "object", "required": ["size"], "properties": {"size": {"type": "integer"'), limit, F.lit('}, "name": {"type": "string"}, "kind": {"enum": ["'), "p_type", F.lit('", "other"]}}}'))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), schema.alias("s"))
    return p.select("k", js.sample_of("s").alias("sample"), js.spoiled_of("s").alias("lacking"), js.wrong_type_of("s").alias("wrong"))
