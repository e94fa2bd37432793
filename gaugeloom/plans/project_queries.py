"""Queries over many small projects, one a supplier, written as files and scanned at once; and over the report of the nations' folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import cases as cs, evaluators as ev, scores as sc
from ..sources import artifacts as art, datasource as ds, sinks, specs
from ..sources.folders import shared_folder
from . import adapters as ad
from .adapters import GRADES_SQL, table
from .folder_queries import _BASE, report
from .registry import query

_written: dict[tuple[str, str], str] = {}


def _projects(spark: SparkSession, d: str) -> str:
    """A folder a supplier: a dataset, a state, progress, a deployment (for some), specifications, an agent's source and a skill."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        root = shared_folder(spark, "projects").removeprefix("file://")
        s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal"), 0).cast("long").alias("bal"))
        k, name = F.col("k"), F.col("name")
        text = k.cast("string")
        scenario = F.concat(F.lit("- id: s"), text, F.lit("\n  opening: hello "), name, F.lit("\n  max_turns: "), F.when(k % 5 == 0, "0").otherwise("3"), F.lit("\n  followups: [more, 'no: 1']\n"), F.when(k % 3 > 0, F.concat(F.lit("  expect: {contains: "), name, F.lit("}\n"))).otherwise(""))
        evaluators = F.concat(F.lit("evaluators:\n- type: contains\n- type: openevals\n  prompt: TONE_PROMPT\n- {type: custom, name: own"), text, F.when(k % 4 == 0, "").otherwise(", ref: 'm:f'"), F.lit("}\n"))
        agent = F.concat(F.when(k % 2 == 0, "TOOLS = []\n").otherwise("TOOL = []\n"), F.lit("def build_agent():\n    return None\n"))
        progress = F.concat(F.lit('{"done": '), (k % 7).cast("string"), F.lit(', "total": 7}'))
        deployment = F.when(k % 3 == 0, F.concat(F.lit('{"target": "local", "status": "'), F.when(k % 2 == 0, "running").otherwise("stopped"), F.lit('"}')))
        state = F.concat(F.lit('{"stages": {"plan": {"status": "ok"}, "run": {"status": "'), F.when(k % 2 == 0, "running").otherwise("ok"), F.lit('"}, "score": {"status": "'), F.when(k % 4 < 2, "running").otherwise("ok"), F.lit('"}}}'))
        skill = F.concat(F.lit("---\nname: "), name, F.lit("\n---\n# Title\n\nWords   of\n"), F.repeat(F.concat(name, F.lit(" ")), 30))
        files = {"dataset.json": F.lit('{"cases": []}'), "work/state.json": state, "work/run-progress.json": progress, "deployment.json": deployment, "scenarios.yaml": F.when(k % 11 == 0, "a: [").otherwise(scenario), "evaluators.yaml": F.when(k % 13 == 0, "evaluators: []").otherwise(evaluators), "agent.py": agent, "skills/one/SKILL.md": skill}
        rows = F.array(*[F.struct(F.concat(F.lit("p"), text, F.lit(f"/{path}")).alias("path"), body.alias("text")) for path, body in files.items()])
        ds.save(s.select(F.explode(rows).alias("f")).select("f.*").where("text is not null"), root, s.count() * len(files))
        _written[key] = root
    return _written[key]


def _project(path: str = "path"):
    """The number in p<number> of a file's folder."""
    return F.regexp_extract(path, r"/p(\d+)/", 1).cast("long")


def _files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return ds.artifacts(spark, _projects(spark, d)).where(F.col("kind") == kind)


@query("""SELECT s_suppkey AS project, CASE WHEN s_suppkey % 11 > 0 THEN 's' || s_suppkey END AS scenario_id, CASE WHEN s_suppkey % 11 > 0 THEN 'hello ' || s_name END AS opening, CASE WHEN s_suppkey % 11 > 0 THEN 'more|no: 1' END AS followups, CASE WHEN s_suppkey % 11 > 0 AND s_suppkey % 3 > 0 THEN s_name END AS expect_contains,
CASE WHEN s_suppkey % 11 = 0 THEN 'not YAML' ELSE nullif(concat_ws(', ', CASE WHEN s_suppkey % 5 = 0 THEN 'max_turns' END, CASE WHEN s_suppkey % 3 = 0 THEN 'success_contains or expect' END), '') || ' is missing' END AS problem FROM supplier""")
def scenario_specs(spark, d):
    s = specs.scenario_rows(_files(spark, d, "scenarios").select("path", "text"))
    return s.select(_project().alias("project"), "scenario_id", "opening", F.array_join("followups", "|").alias("followups"), "expect_contains", "problem")


@query("""SELECT s_suppkey AS project, x.type, x.metric, x.judge, x.problem FROM (SELECT *, unnest(CASE WHEN s_suppkey % 13 = 0 THEN [{'type': NULL, 'metric': NULL, 'judge': NULL, 'problem': 'no evaluators are given'}]
ELSE [{'type': 'contains', 'metric': 'contains', 'judge': false, 'problem': NULL}, {'type': 'openevals', 'metric': 'tone', 'judge': true, 'problem': NULL}, {'type': 'custom', 'metric': 'own' || s_suppkey, 'judge': false, 'problem': CASE WHEN s_suppkey % 4 = 0 THEN 'no module:function' END}] END) AS x FROM supplier)""")
def evaluator_specs(spark, d):
    e = specs.evaluator_rows(_files(spark, d, "evaluators").select("path", "text"))
    return e.select(_project().alias("project"), "type", "metric", "judge", "problem")


@query("SELECT s_suppkey AS project, (5 + 1 + (s_suppkey % 3 = 0)::INT - 1)::BIGINT AS artifacts FROM supplier")
def discovered_projects(spark, d):
    """Projects below two roots, one of which isn't there, with how many known artifacts each has."""
    root = _projects(spark, d)
    p = specs.discovered(spark, [root, f"{root}/none"])
    return p.select(F.regexp_extract("folder", r"/p(\d+)$", 1).cast("long").alias("project"), "artifacts")


@query("SELECT s_suppkey AS project, (s_suppkey % 7)::INT AS done, 7 AS total FROM supplier")
def run_progress_records(spark, d):
    doc = F.from_json("text", "struct<done:int,total:int>")
    return _files(spark, d, "run_progress").select(_project().alias("project"), doc["done"].alias("done"), doc["total"].alias("total"))


@query("SELECT s_suppkey AS project, 'local' AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'running' ELSE 'stopped' END AS status FROM supplier WHERE s_suppkey % 3 = 0")
def deployment_records(spark, d):
    doc = F.from_json("text", "struct<target:string,status:string>")
    return _files(spark, d, "deployment").select(_project().alias("project"), doc["target"].alias("target"), doc["status"].alias("status"))


@query("SELECT s_suppkey AS project, CASE WHEN s_suppkey % 2 = 0 THEN 'run' ELSE 'score' END AS stage FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 < 2")
def running_stages(spark, d):
    """The first stage of each project that is running."""
    from .views import Report

    return Report(spark, _projects(spark, d)).running_stage(["plan", "run", "score"]).select(_project().alias("project"), "stage")


@query("SELECT s_suppkey AS project FROM supplier WHERE s_suppkey % 2 = 0")
def agent_sources(spark, d):
    return art.agent_targets(spark, _projects(spark, d)).select(_project().alias("project"))


@query("SELECT s_suppkey AS project, 'one' AS folder, s_name AS name, left('Words of ' || trim(repeat(s_name || ' ', 30)), 300) AS excerpt FROM supplier")
def skill_excerpts(spark, d):
    s = art.skill_files(spark, _projects(spark, d))
    return s.select(_project().alias("project"), F.col("name").alias("folder"), tx.front_value(F.col("text"), "name").alias("name"), tx.excerpt(tx.body(F.col("text"))).alias("excerpt"))


@query("SELECT s_suppkey AS project, '/p' || s_suppkey || '/x/agent.py' AS path, '.p' || s_suppkey || '.x.agent' AS module FROM supplier")
def module_paths(spark, d):
    path = F.concat(F.lit("/p"), F.col("s_suppkey").cast("string"), F.lit("/x/agent.py"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), path.alias("path"), tx.module_path(path).alias("module"))


@query("SELECT n_nationkey AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def emitted_json(spark, d):
    """Rows as a JSON text each, written, read again and told apart."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    path = shared_folder(spark, "json")
    sinks.save_json(n, path)
    same = sinks.emit(n).join(spark.read.text(path).withColumnRenamed("value", "json"), "json", "left_semi")
    return same.select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("k"), "json")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE 'case-' || left(sha256('{"failure_mode": "none", "inputs": {"q": "' || c_name || '"}, "intent": "' || c_mktsegment || '", "scenario": "unspecified", "topic": "unspecified"}'), 10) END AS case_id, 'pending' AS review_status FROM customer""")
def normalized_cases(spark, d):
    none = F.lit(None).cast("string")
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("case_id"), F.to_json(F.struct(F.col("c_name").alias("q"))).alias("inputs"), F.col("c_mktsegment").alias("intent"), none.alias("topic"), none.alias("scenario"), none.alias("failure_mode"))
    return cs.normalize(raw).select(F.col("ordinal").alias("k"), "case_id", "review_status")


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '…' ELSE text END AS preview, lang, NULL::VARCHAR AS absent FROM documents")
def previews_padded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", cs.preview(F.col("text")).alias("preview"), "lang")
    return cs.padded(docs, {"doc_id": "long", "preview": "string", "lang": "string", "absent": "string"})


@query(f"WITH {GRADES_SQL}, r AS (SELECT metric, avg(score) AS rate FROM marks WHERE outcome = 'scored' GROUP BY 1) SELECT metric, CASE metric WHEN 'toxic' THEN 0.1 ELSE 0.75 END::DOUBLE AS threshold, rate >= CASE metric WHEN 'toxic' THEN 0.1 ELSE 0.75 END AS passed FROM r")
def typed_thresholds(spark, d):
    """Metrics of documents against the thresholds of a configuration."""
    t = specs.Thresholds.of({"thresholds": {"metrics": {"toxic": "0.1"}, "default": 0.75}})
    return sc.metric_rates(ad.document_scores(spark, d), t.metrics, t.default).select("metric", "threshold", "passed")


@query("SELECT o_orderkey AS case_id, o_orderpriority AS intent, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def runs_of_known_cases(spark, d):
    """Runs of cases that aren't in the dataset fall away."""
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"))
    cases = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("intent"))
    return ev.join_cases(runs, cases).select("case_id", "intent", "line")


@query(f"""WITH {_BASE}, c AS (SELECT r_name, count(*) AS planned FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT section, line FROM (
  SELECT 2 AS section, format('  {{:<10}} {{:<16}} {{:7.1f}}s  ', r_name, CASE WHEN r_regionkey < 2 THEN 'ok' WHEN r_regionkey < 4 THEN 'running' ELSE 'failed' END, r_regionkey::DOUBLE) AS line FROM region
  UNION ALL SELECT 3, rpad('  ' || metric, 20, ' ') || ' pass_rate=' || round(rate, 4) || ' threshold=0.5 errors=' || errors || ' [' || CASE WHEN rate >= 0.5 THEN 'ok' ELSE 'FAIL' END || ']' FROM rates
  UNION ALL SELECT 4, 'coverage: 0/' || sum(planned) || ' (0.0%)' FROM c
  UNION ALL SELECT 5, 'stability: repeats=3 unstable_cases=' || count(*) FILTER (trajectories > 1) || ' text_varies=' || count(*) FILTER (outputs > 1) FROM seen
  UNION ALL SELECT 6, '  [warning] ' || 'file: unknown kind')""")
def report_text(spark, d):
    """The report of the nations as lines; that of the problem names a file, which has another name each time."""
    t = report(spark, d).text("nations").where("section >= 2")
    return t.select("section", F.when(F.col("section") == 6, F.regexp_replace("line", r"\] .*: ", "] file: ")).otherwise(F.col("line")).alias("line"))


@query(f"""WITH {_BASE}, w AS (SELECT dim || '=' || value AS weak FROM slices GROUP BY dim, value HAVING NOT bool_and(coalesce(rate >= 0.5, true))), b AS (SELECT case_id FROM per WHERE round(a, 4) < 1 UNION SELECT case_id FROM cr WHERE error IS NOT NULL)
SELECT (SELECT count(*) FROM w)::INT AS weak, 5 AS gaps, least((SELECT count(*) FROM b), 10)::INT AS failing, (SELECT min(case_id) FROM b) AS first_failing, (SELECT string_agg(metric || ': ' || errors || ' error(s)', ',' ORDER BY metric) FROM rates WHERE errors > 0) AS evaluator_errors""")
def report_analysis(spark, d):
    a = report(spark, d).analysis(failing=10)
    return a.select(F.size("weak_slices").alias("weak"), F.size("coverage_gaps").alias("gaps"), F.size("failing_cases").alias("failing"), F.get("failing_cases", F.lit(0)).alias("first_failing"), F.array_join("evaluator_errors", ",").alias("evaluator_errors"))


@query("SELECT (SELECT count(*) FROM nation) AS cases, (SELECT count(*) FROM region) AS intents, (SELECT count(*) FROM nation) AS scenarios, (SELECT count(*) FROM region) AS tools, 0::BIGINT AS skills, 3::BIGINT AS runs")
def bundle_summary(spark, d):
    return report(spark, d).bundle()


@query("SELECT r_regionkey::INT AS ordinal, left('{\"tool\":\"t' || r_regionkey || '\",\"description\":\"' || r_name || '\",\"kind\":\"function\"}', 40) AS brief FROM region")
def tool_briefs(spark, d):
    return report(spark, d).tool_briefs(40).select("ordinal", "brief")


@query(f"WITH {_BASE} SELECT (SELECT count(*) FILTER (k % 4 <> 1) FROM n) AS approved, (SELECT count(*) FILTER (k % 4 = 1) FROM n) AS pending, 0::BIGINT AS rejected, 3::BIGINT AS runs, (SELECT count(error) FROM cr) AS failed_runs")
def review_progress(spark, d):
    return report(spark, d).review_progress()
