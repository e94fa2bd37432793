"""Queries over an artifact folder: the synthetic tables written as JSON documents and read back, beside SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import agentmap as am, cases as cs, mocks, scores as sc
from ..sources import artifacts as art, sinks
from ..sources.folders import shared_folder
from .adapters import table
from .registry import query, r6
from .views import Report

NAMESPACE = "demo"
_written: dict[tuple[str, str], str] = {}


def _list(rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """One row: the items in order, as a list of that name. The nations are 25 rows."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))), lambda a, b: (a["o"] - b["o"]).cast("int"))
    return rows.agg(F.transform(both, lambda p: p["x"]).alias(name))


def folder(spark: SparkSession, d: str) -> str:
    """A folder of documents about the nations: a dataset, three runs with reports, a map, a state, simulations, and one that is unknown."""
    key = (spark.sparkContext.applicationId, d)
    if key in _written:
        return _written[key]
    root = shared_folder(spark, "artifacts")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("int").alias("k"), "n_name", "r_name")
    k = F.col("k")
    tool = F.concat(F.lit("t"), (k % 4).cast("string"))

    def save(doc: DataFrame, kind: str, name: str) -> None:
        doc = doc.select(F.struct(*doc.columns).alias("doc")).select(sinks.stamped(F.col("doc"), NAMESPACE, kind, doc.columns).alias("s")).select("s.*")
        doc.coalesce(1).write.json(f"{root}/{name}")

    case = F.struct(
        F.concat(F.lit("n"), k.cast("string")).alias("id"), F.struct(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ask "), "n_name").alias("content"))).alias("messages")).alias("inputs"),
        F.struct(F.array(F.struct(tool.alias("name")), F.struct(F.lit("end").alias("name"))).alias("expected_tools")).alias("reference_outputs"),
        F.struct(F.col("r_name").alias("intent"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("topic"), F.col("n_name").alias("scenario"), F.when(k % 3 == 0, "timeout").otherwise("none").alias("failure_mode"), F.lit("happy").alias("variant"), F.lit("synthetic").alias("source"), F.when(k % 5 == 0, F.array(F.lit("more"))).alias("user_turns")).alias("metadata"),
        F.struct(F.when(k % 4 == 1, "pending").otherwise("approved").alias("status"), F.lit("").alias("note")).alias("review"),
    )
    cells = _list(n.groupBy("r_name").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k")), "k", F.struct(F.col("r_name").alias("intent"), F.lit("p0").alias("topic"), F.lit("failure").alias("kind"), F.lit("timeout").alias("failure_mode"), F.col("c").alias("count"), F.lit(1).alias("multi_turn")), "cells")
    rules = _list(n.where("k < 3"), "k", F.struct(F.struct(k.alias("k")).alias("matchArgs"), F.col("n_name").alias("response")), "rules")
    data = _list(n, "k", case, "cases").join(cells).join(rules)
    save(data.select(F.lit("nations").alias("name"), F.struct(F.struct(F.col("rules").alias("t0")).alias("tools"), F.lit("real").alias("on_miss")).alias("mocks"), F.struct(F.struct("cells").alias("plan")).alias("coverage"), "cases"), "dataset", "dataset")
    for run in range(3):
        layer = F.get(F.array(F.lit("rule"), F.lit("llm"), F.lit("real")), (k + run) % 3)
        ran = F.struct(
            F.concat(F.lit("n"), k.cast("string")).alias("case_id"), F.struct(F.concat("n_name", ((k * run) % 3).cast("string")).alias("response")).alias("outputs"),
            F.when(k % 7 == run, "boom").alias("error"), F.when(k % 7 == run, F.when(k % 2 == 0, "infrastructure").otherwise("agent")).alias("error_class"),
            F.array(F.struct(tool.alias("name"), F.struct(((k * run) % 2).alias("k")).alias("args"))).alias("tool_calls"), F.array(F.struct(tool.alias("tool"), layer.alias("layer"), (k % 3 > 0).alias("valid"))).alias("mock_calls"),
        )
        save(_list(n, "k", ran, "case_runs").select(F.lit(f"r{run}").alias("run_id"), F.lit(f"2026-01-0{run + 1}").alias("timestamp"), "case_runs"), "run", f"results/run-r{run}")
        one = lambda m, s: F.struct(F.lit(m).alias("key"), F.struct(s.cast("double").alias("score"), F.lit("").alias("comment")).alias("value"))
        m2 = F.when((k % 5 != 0) & (k % 6 != 1), one("m2", k % 2))
        marks = F.map_from_entries(F.filter(F.array(one("m1", ((k + run) % 4) / 4), m2), lambda x: x.isNotNull()))
        note = lambda c: F.map_from_entries(F.filter(F.array(F.when(c, F.struct(F.lit("m2").alias("key"), F.lit("no").alias("value")))), lambda x: x.isNotNull()))
        report = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("case_id"), marks.alias("scores"), note((k % 5 != 0) & (k % 6 == 1)).alias("errors"), note(k % 5 == 0).alias("skipped"))
        save(_list(n, "k", report, "cases").select(F.lit(f"r{run}").alias("run_id"), "cases"), "score_report", f"results/report-r{run}")
    talk = F.array(F.struct(F.lit("user").alias("role"), F.col("n_name").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("yes").alias("content")))
    result = F.struct(F.col("n_name").alias("scenario_id"), F.when(k % 2 == 0, "success").otherwise("max_turns").alias("stop_reason"), (k % 5).alias("turns"), talk.alias("transcript"), F.when(k % 3 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("violations"))
    save(_list(n, "k", result, "results"), "simulation", "simulation")
    t = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r"), "r_name")
    stage = F.struct(F.col("r_name").alias("key"), F.struct(F.when(F.col("r") < 2, "ok").when(F.col("r") < 4, "running").otherwise("failed").alias("status"), F.col("r").alias("attempts"), F.col("r").cast("double").alias("seconds")).alias("value"))
    save(_list(t, "r", stage, "s").select(F.map_from_entries("s").alias("stages")), "pipeline_state", "state")
    tools = _list(t, "r", F.struct(F.concat(F.lit("t"), F.col("r").cast("string")).alias("name"), F.lit("function").alias("kind"), F.col("r_name").alias("description"), F.when(F.col("r") == 2, False).alias("mockable")), "tools")
    intents = _list(t, "r", F.struct(F.col("r_name").alias("id")), "intents")
    scenarios = _list(n, "k", F.struct(F.col("r_name").alias("intent"), F.col("n_name").alias("id")), "scenarios")
    nodes = _list(n, "k", F.struct(F.col("r_name").alias("id"), F.when(k % 2 == 0, "graph-node").otherwise("llm").alias("kind"), F.when(k % 4 == 3, F.col("n_name")).alias("prompt"), F.array(F.concat(F.lit("e"), (k % 6).cast("string"))).alias("evidence")), "nodes")
    save(tools.join(intents).join(scenarios).join(nodes).select("tools", "intents", "scenarios", F.struct("nodes").alias("graph")), "agent_map", "map")
    t.limit(1).select(F.lit(1).alias("a")).coalesce(1).write.json(f"{root}/odd")
    _written[key] = root
    return root


def report(spark: SparkSession, d: str) -> Report:
    return Report(spark, folder(spark, d), default=0.5, overall_pass=0.4, judges=("m1",))


_BASE = """n AS (SELECT n_nationkey::INT AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cr AS (SELECT n.*, run, 'n' || k AS case_id, CASE WHEN k % 7 = run THEN 'boom' END AS error, (k * run) % 3 AS resp, (k * run) % 2 AS arg, CASE (k + run) % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'llm' ELSE 'real' END AS layer FROM n, (VALUES (0), (1), (2)) r(run)),
s AS (SELECT case_id, k, r_name, run, 'm1' AS metric, 'scored' AS outcome, ((k + run) % 4) / 4.0::DOUBLE AS score FROM cr UNION ALL
  SELECT case_id, k, r_name, run, 'm2', CASE WHEN k % 5 = 0 THEN 'skipped' WHEN k % 6 = 1 THEN 'error' ELSE 'scored' END, CASE WHEN k % 5 = 0 OR k % 6 = 1 THEN NULL ELSE (k % 2)::DOUBLE END FROM cr),
per AS (SELECT metric, case_id, k, r_name, avg(score) AS a, min(score) AS lo, max(score) AS hi, count(score) AS n, count(*) FILTER (outcome = 'error') AS bad FROM s WHERE outcome <> 'skipped' GROUP BY ALL),
rates AS (SELECT metric, avg(a) AS rate, avg(lo) AS low, count(a) AS n_cases, sum(n)::BIGINT AS n_scores, sum(bad)::BIGINT AS errors FROM per GROUP BY metric),
members AS (SELECT case_id, dim, value FROM (SELECT 'n' || k AS case_id, r_name AS intent, CASE WHEN k % 3 = 0 THEN 'timeout' ELSE 'none' END AS failure_mode, 'happy' AS variant FROM n) UNPIVOT (value FOR dim IN (intent, failure_mode, variant))),
slices AS (SELECT dim, value, metric, any_value(z.n) AS n, round(avg(a), 4) AS rate FROM (SELECT dim, value, count(*) AS n FROM members GROUP BY ALL) z LEFT JOIN (SELECT dim, value, metric, a FROM members JOIN per USING (case_id) WHERE a IS NOT NULL) x USING (dim, value) GROUP BY ALL),
seen AS (SELECT case_id, count(DISTINCT arg || coalesce(error, '')) AS trajectories, count(DISTINCT resp || '/' || arg || coalesce(error, '')) AS outputs, count(*) FILTER (layer = 'llm') AS llm FROM cr GROUP BY case_id)"""


@query("SELECT kind, run_id FROM (VALUES ('dataset', NULL), ('run', 'r0'), ('run', 'r1'), ('run', 'r2'), ('score_report', 'r0'), ('score_report', 'r1'), ('score_report', 'r2'), ('simulation', NULL), ('pipeline_state', NULL), ('agent_map', NULL)) v(kind, run_id)")
def folder_index(spark, d):
    return art.index(art.documents(spark, folder(spark, d))).select("kind", "run_id")


@query("SELECT 'unknown kind' AS problem, 1::BIGINT AS n")
def folder_problems(spark, d):
    return report(spark, d).problems().groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE event_type WHEN 'view' THEN 'dataset' WHEN 'click' THEN 'score_report' WHEN 'error' THEN 'mock_rules' END AS kind, CASE WHEN event_type = 'click' THEN 'x' || event_id END AS run_id, count(*) AS n FROM events GROUP BY ALL")
def upload_kinds(spark, d):
    e, none = F.col("event_type"), F.lit('{"a": 1}')
    name = F.when(e == "click", F.concat(F.lit("results/report-x"), F.col("event_id").cast("string"), F.lit(".json"))).when(e == "error", "mocks.json").otherwise("other.json")
    files = table(spark, d, "events").select(F.concat(F.lit("/up/"), F.col("event_id").cast("string"), F.lit("/"), name).alias("path"), F.when(e == "view", '{"schema": "demo/dataset/v1"}').otherwise(none).alias("text"))
    return art.upload(files).groupBy("kind", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BASE} SELECT case_id, intent, topic, scenario, failure_mode, review_status, input, turns, expected_tools FROM (SELECT 'n' || k AS case_id, r_name AS intent, 'p' || k % 3 AS topic, n_name AS scenario, CASE WHEN k % 3 = 0 THEN 'timeout' ELSE 'none' END AS failure_mode,
CASE WHEN k % 4 = 1 THEN 'pending' ELSE 'approved' END AS review_status, 'ask ' || n_name AS input, (1 + (k % 5 = 0)::INT)::INT AS turns, 't' || k % 4 || ', end' AS expected_tools FROM n)""")
def view_cases(spark, d):
    return report(spark, d).case_table().select("case_id", "intent", "topic", "scenario", "failure_mode", "review_status", "input", "turns", "expected_tools")


@query(f"WITH {_BASE} SELECT metric, round(rate, 6) AS pass_rate, round(low, 6) AS min_over_repeats, n_cases, n_scores, errors, coalesce(rate >= 0.5, false) AS passed FROM rates")
def view_metrics(spark, d):
    return report(spark, d).metrics().select("metric", r6(F.col("pass_rate")).alias("pass_rate"), r6(F.col("min_over_repeats")).alias("min_over_repeats"), "n_cases", "n_scores", "errors", "passed")


@query(f"WITH {_BASE} SELECT run::INT AS run_ordinal, metric, count(score) AS n, round(avg(score), 6) AS \"avg\", count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'skipped') AS skipped FROM s GROUP BY ALL")
def view_run_metrics(spark, d):
    return report(spark, d).run_metrics().select("run_ordinal", "metric", "n", r6(F.col("avg")).alias("avg"), "errors", "skipped")


@query(f"WITH {_BASE} SELECT dim, value, metric, n, round(rate, 3) AS rate, coalesce(rate >= 0.5, true) AS passed FROM slices")
def view_slices(spark, d):
    return report(spark, d).slices().select("dim", "value", "metric", "n", F.round("rate", 3).alias("rate"), "passed")


@query(f"""WITH {_BASE}, w AS (SELECT count(*) AS n FROM (SELECT dim, value FROM slices GROUP BY ALL HAVING NOT bool_and(coalesce(rate >= 0.5, true))))
SELECT CASE WHEN bool_and(rate >= 0.5) AND any_value(w.n) = 0 AND round(avg(rate), 4) >= 0.4 THEN 'pass' ELSE 'fail' END AS verdict, round(avg(rate), 3) AS overall_score, count(*) FILTER (rate >= 0.5) AS metrics_passing,
(SELECT count(*) FROM n WHERE k % 4 <> 1) AS approved, (SELECT round(1 - count(*) FILTER (trajectories > 1) / count(*), 4) FROM seen) AS stable_fraction FROM rates, w""")
def view_summary(spark, d):
    return report(spark, d).summary().select("verdict", F.round("overall_score", 3).alias("overall_score"), "metrics_passing", "approved", "stable_fraction")


@query(f"WITH {_BASE}, f AS (SELECT case_id, string_agg(metric, ',' ORDER BY metric) AS metrics FROM per WHERE n > 1 AND lo <> hi GROUP BY case_id) SELECT case_id, trajectories, llm AS llm_mock_calls, coalesce(metrics, '') AS metrics FROM seen LEFT JOIN f USING (case_id) WHERE trajectories > 1")
def view_unstable(spark, d):
    return report(spark, d).unstable().select("case_id", "trajectories", "llm_mock_calls", F.array_join("metrics", ",").alias("metrics"))


@query(f"WITH {_BASE} SELECT case_id, metric, lo, hi, 'evaluator' AS kind FROM per JOIN seen USING (case_id) WHERE per.n > 1 AND lo <> hi AND trajectories <= 1")
def view_flips(spark, d):
    return report(spark, d).flips()


@query(f"""WITH {_BASE}, b AS (SELECT case_id, string_agg(metric, ',' ORDER BY metric) AS metrics FROM per WHERE round(a, 4) < 1 GROUP BY case_id),
e AS (SELECT case_id, count(*) AS n FROM cr WHERE error IS NOT NULL GROUP BY case_id)
SELECT coalesce(b.case_id, e.case_id) AS case_id, coalesce(metrics, '') AS metrics, least(coalesce(e.n, 0), 2)::INT AS agent_errors FROM b FULL JOIN e ON b.case_id = e.case_id""")
def view_failing(spark, d):
    f = report(spark, d).failing()
    return f.select("case_id", F.coalesce(F.array_join(F.map_keys("metrics"), ","), F.lit("")).alias("metrics"), F.size("agent_errors").alias("agent_errors"))


@query(f"WITH {_BASE} SELECT case_id, run::INT AS run_ordinal, max(score) FILTER (metric = 'm1') AS m1, max(score) FILTER (metric = 'm2') AS m2 FROM s WHERE outcome = 'scored' GROUP BY ALL")
def view_score_matrix(spark, d):
    return report(spark, d).case_matrix(["m1", "m2"])


@query("SELECT 'dataset' AS scope, 't0' AS tool, n_nationkey::INT AS rule_idx, '{\"k\":' || n_nationkey || '}' AS match_args, '\"' || n_name || '\"' AS response, false AS wildcard FROM nation WHERE n_nationkey < 3")
def view_mock_rules(spark, d):
    return report(spark, d).mock_rules().select("scope", "tool", "rule_idx", "match_args", "response", "wildcard")


@query(f"WITH {_BASE} SELECT 'r' || run AS run_id, count(*) FILTER (layer = 'rule') AS rule, count(*) FILTER (layer = 'llm') AS llm, count(*) FILTER (layer = 'real') AS real, count(*) FILTER (layer = 'llm' AND k % 3 = 0) AS invalid FROM cr GROUP BY run")
def view_ledger(spark, d):
    return report(spark, d).ledger_totals().select("run_id", "rule", "llm", "real", "invalid")


@query(f"WITH {_BASE} SELECT count(*) FILTER (layer = 'rule') AS rule, count(*) FILTER (layer = 'llm') AS llm, count(*) FILTER (layer = 'real') AS real, count(*) FILTER (layer = 'llm' AND k % 3 = 0) AS invalid FROM cr")
def view_ledger_sum(spark, d):
    return mocks.summed_totals(report(spark, d).ledger_totals()).select("rule", "llm", "real", "invalid")


@query("""WITH c AS (SELECT r_name AS intent, count(*) AS planned, count(*) FILTER (n_nationkey % 3 = 0 AND n_nationkey % 4 <> 1 AND n_name = 'unspecified') AS have FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'failure' AS kind, sum(planned)::BIGINT AS planned, sum(least(have, planned))::BIGINT AS covered FROM c""")
def view_coverage(spark, d):
    return report(spark, d).coverage_by_kind()


@query(f"WITH {_BASE} SELECT count(*) AS scenarios, count(*) FILTER (k % 2 = 0) AS successes, count(*) FILTER (k % 3 = 0) AS with_violations FROM n")
def view_simulation(spark, d):
    return report(spark, d).simulation_totals()


@query("SELECT CASE WHEN r_regionkey < 2 THEN 'ok' WHEN r_regionkey < 4 THEN 'running' ELSE 'failed' END AS status, count(*) AS stages, sum(r_regionkey)::DOUBLE AS seconds FROM region GROUP BY 1")
def view_stages(spark, d):
    return report(spark, d).stage_totals()


@query("SELECT 'incomplete' AS verdict")
def view_incomplete(spark, d):
    r = report(spark, d)
    return sc.incomplete(r.verdict(), r.stages, ["AFRICA", "EUROPE"]).select("verdict")


@query("SELECT r_regionkey::INT AS ordinal, 't' || r_regionkey AS tool, 'function' AS kind, r_name AS description, r_regionkey <> 2 AS mockable, false AS side_effecting FROM region")
def view_tools(spark, d):
    return report(spark, d).tools().select("ordinal", "tool", "kind", "description", "mockable", "side_effecting")


@query(f"WITH {_BASE} SELECT r_name AS intent, count(*) AS scenarios, count(*) AS cases FROM n GROUP BY 1")
def view_intents(spark, d):
    return report(spark, d).intents().select("intent", "scenarios", "cases")


@query(f"""WITH {_BASE} SELECT r_name AS id, coalesce(arg_max('llm', k) FILTER (k % 2 = 1), 'graph-node') AS kind, arg_max(n_name, k) FILTER (k % 4 = 3) AS prompt, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT 'e' || k % 6 AS e FROM n x WHERE x.r_name = n.r_name)) AS evidence FROM n GROUP BY r_name""")
def view_nodes(spark, d):
    return report(spark, d).nodes().select("id", "kind", "prompt", F.array_join("evidence", ",").alias("evidence"))


@query(f"WITH {_BASE} SELECT case_id, run::INT AS run_ordinal, n_name || resp AS response, error, 't' || k % 4 || '({{\"k\":' || arg || '}})' AS calls FROM cr".replace("{{", "{").replace("}}", "}"))
def folder_runs(spark, d):
    r = report(spark, d).runs
    calls = F.from_json("tool_calls", "array<struct<name:string,args:string>>")
    return r.select("case_id", "run_ordinal", "response", "error", cs.inline_calls(calls).alias("calls"))


@query("SELECT r_name AS intent, 'p0' AS topic, count(*)::INT AS count FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def folder_plan(spark, d):
    return report(spark, d).plan().select("intent", "topic", "count")


@query("SELECT r_regionkey AS k, '{\"schema\":\"demo/agent-map/v1\",\"name\":\"' || r_name || '\",\"n\":' || r_regionkey || '}' AS json FROM region")
def stamped_json(spark, d):
    doc = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("n"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.to_json(sinks.stamped(doc, NAMESPACE, "agent_map", ["name", "n"])).alias("json"))


@query("SELECT n_nationkey AS case_id, 'inputs must be a non-empty object' AS problem FROM nation WHERE n_nationkey % 5 = 0")
def gated_write(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("case_id"), F.when(F.col("n_nationkey") % 5 == 0, "{}").otherwise('{"q": 1}').alias("inputs"), F.lit("pending").alias("review_status"))
    return sinks.save_valid(c, shared_folder(spark, "gated")).select(F.col("case_id").cast("long").alias("case_id"), "problem")


@query("SELECT n_nationkey AS case_id, '{\"q\": 1}' AS inputs FROM nation")
def gated_write_kept(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("case_id"), F.lit('{"q": 1}').alias("inputs"), F.lit("pending").alias("review_status"))
    at = shared_folder(spark, "gated")
    sinks.save_valid(c, at)
    return spark.read.parquet(at).select(F.col("case_id").cast("long").alias("case_id"), "inputs")


@query("""WITH t AS (SELECT n_nationkey::INT AS k, n_name FROM nation)
SELECT failure_type, string_agg(fact, ' ' ORDER BY o) AS evidence FROM (
  SELECT unnest(['input_validation', 'provider_error', 'out_of_scope']) AS failure_type, 'app:always' AS fact, 0 AS o
  UNION ALL SELECT 'branch_misrouting', 'edge:' || r_name || '->a|b', r_regionkey FROM region WHERE r_regionkey < 2
  UNION ALL SELECT x, 'tool:find' || k, k FROM t, (VALUES ('tool_misuse'), ('tool_error_handling'), ('prompt_injection'), ('retrieval_grounding')) v(x) WHERE k < 3
  UNION ALL SELECT x, 'tool:pay' || k, k FROM t, (VALUES ('tool_misuse'), ('tool_error_handling'), ('prompt_injection')) v(x) WHERE k BETWEEN 3 AND 5
  UNION ALL SELECT 'state_loss', 'app:multi-turn', 0
  UNION ALL SELECT 'constraint_violation', left('constraint:' || repeat(n_name, 20), 71), k FROM t WHERE k < 2
  UNION ALL SELECT 'skill_misuse', 'skill:' || n_name, k FROM t WHERE k > 22) GROUP BY failure_type""")
def failure_gates(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("ordinal"), "n_name")
    tools = n.where("ordinal <= 5").select("ordinal", F.concat(F.when(F.col("ordinal") < 3, "find").otherwise("pay"), F.col("ordinal").cast("string")).alias("tool"))
    edges = table(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("ordinal"), F.col("r_name").alias("source"), F.array(F.lit("a"), F.lit("b")).alias("targets"))
    held = n.where("ordinal < 2").select("ordinal", F.repeat("n_name", 20).alias("text"))
    skills = n.where("ordinal > 22").select("ordinal", F.col("n_name").alias("skill"))
    code = n.limit(1).select(F.lit("graph = compile(checkpointer=x)").alias("text"))
    return am.failure_gates(am.agent_facts(tools, edges, held, skills, code, False)).select("failure_type", F.array_join("evidence", " ").alias("evidence"))
