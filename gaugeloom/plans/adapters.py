"""The roles that the synthetic tables play: which rows are cases, runs, calls and talks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tie breaks of an order's lines: (l_orderkey, l_linenumber) is not unique.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

LINES_SQL = f"""lines AS (
  SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1)::INT AS run_ordinal FROM lineitem
), scores AS (
  SELECT l_orderkey AS case_id, run_ordinal, m.metric,
    CASE m.metric WHEN 'kept' THEN (l_returnflag <> 'R')::INT::DOUBLE WHEN 'settled' THEN (l_linestatus = 'F')::INT::DOUBLE ELSE l_discount * 10 END AS score
  FROM lines, (VALUES ('kept'), ('settled'), ('discount')) m(metric)
), cases AS (
  SELECT o_orderkey AS case_id, o_orderpriority AS intent, o_orderstatus AS failure_mode, c_mktsegment AS variant FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

METRICS = ("kept", "settled", "discount")


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Lines as repeats of their order."""
    run = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    return table(spark, sf_dir, "lineitem").withColumn("run_ordinal", run)


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three metrics; every line is scored for each. Repeats aren't numbered unless a query asks for their order."""
    return _unpivoted(table(spark, sf_dir, "lineitem").withColumn("run_ordinal", F.lit(0)))


def ordered_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpivoted(lines(spark, sf_dir))


def line_marks() -> Column:
    """metric and score of each metric of a line."""
    return F.array(
        F.struct(F.lit("kept").alias("metric"), (F.col("l_returnflag") != "R").cast("double").alias("score")),
        F.struct(F.lit("settled").alias("metric"), (F.col("l_linestatus") == "F").cast("double").alias("score")),
        F.struct(F.lit("discount").alias("metric"), (F.col("l_discount") * 10).alias("score")),
    )


def _unpivoted(rows: DataFrame) -> DataFrame:
    s = rows.select(F.col("l_orderkey").alias("case_id"), "run_ordinal", F.explode(line_marks()).alias("s"))
    return s.select("run_ordinal", "case_id", "s.metric", F.lit("scored").alias("outcome"), "s.score", F.lit(None).cast("string").alias("comment"))


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("intent"), F.col("o_orderstatus").alias("failure_mode"), F.col("c_mktsegment").alias("variant"))


def line_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repeat did (return flag) and said (flag and status), hashed."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("case_id"), F.sha2("l_returnflag", 256).alias("trajectory_hash"), F.sha2(F.concat("l_returnflag", "l_linestatus"), 256).alias("output_hash"), (F.col("l_linestatus") == "O").cast("long").alias("llm_mock_calls"))


GRADES_SQL = """marks AS (
  SELECT d.doc_id AS case_id, 0 AS run_ordinal, m.metric, CASE m.metric WHEN 'quality' THEN l.quality ELSE l.toxic END::DOUBLE AS score,
    CASE WHEN (CASE m.metric WHEN 'quality' THEN l.quality ELSE l.toxic END) IS NOT NULL THEN 'scored' WHEN d.lang = 'es' THEN 'error' ELSE 'skipped' END AS outcome,
    CASE WHEN m.metric = 'toxic' AND l.toxic = 1 THEN 'Test ' ELSE '' END || left(d.text, 200) AS comment, d.lang, d.source
  FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES ('quality'), ('toxic')) m(metric)
)"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule (quality) and a judge (toxic) on documents; without a label skipped, or failed if Spanish."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in ("quality", "toxic")])
    s = d.join(lab, "doc_id", "left").select("doc_id", "lang", "source", F.substring("text", 1, 200).alias("text"), "toxic", F.explode(pairs).alias("s"))
    outcome = F.when(F.col("s.score").isNotNull(), "scored").when(F.col("lang") == "es", "error").otherwise("skipped")
    prefix = F.when((F.col("s.metric") == "toxic") & (F.col("toxic") == 1), "Test ").otherwise("")
    return s.select(F.lit(0).alias("run_ordinal"), F.col("doc_id").alias("case_id"), "s.metric", outcome.alias("outcome"), "s.score", F.concat(prefix, F.col("text")).alias("comment"), "lang", "source")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries: views are answered by rules, clicks and sign-ups by a model, purchases by fallbacks, errors fail."""
    e = table(spark, sf_dir, "events")
    layer = F.when(F.col("event_type") == "view", "rule").when(F.col("event_type").isin("click", "signup"), "llm").when(F.col("event_type") == "purchase", "fallback").otherwise("error")
    return e.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("props").alias("args"), layer.alias("layer"), (F.col("value") > 100).alias("fallback"),
        F.when(F.col("value") > 200, "slow").when(F.col("value") < 10, "").alias("error"), F.when((F.col("event_type") != "click") | (F.col("event_id") % 5 > 0), F.col("event_type") != "signup").alias("valid"), (F.col("event_id") % 3).cast("int").alias("repairs"), F.col("props").alias("response"), F.col("value").alias("seconds"),
    )


LEDGER_SQL = """ledger AS (
  SELECT user_id AS case_id, event_id AS seq, event_type AS tool, props AS args, value > 100 AS fallback, CASE WHEN value > 200 THEN 'slow' WHEN value < 10 THEN '' END AS error, CASE WHEN event_type <> 'click' OR event_id % 5 > 0 THEN event_type <> 'signup' END AS valid, event_id % 3 AS repairs,
    CASE WHEN event_type = 'view' THEN 'rule' WHEN event_type IN ('click', 'signup') THEN 'llm' WHEN event_type = 'purchase' THEN 'fallback' ELSE 'error' END AS layer
  FROM events
)"""


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("props").alias("args"), F.col("user_id").alias("case_id"))


#: Rule lists of three tools; purchase has none, error an empty one. A constant, as a dataset's rules are.
RULES = {
    "click": [({"k": 1}, "first"), ({"k": 2}, "second"), ({}, "any")],
    "view": [({"k": 3}, "third"), ({"k": 3}, "never"), ({"k": 99}, "last")],
    "signup": [({"k": 10, "z": 1}, "both"), ({"k": 10}, "ten")],
}


def rule_table(spark: SparkSession) -> DataFrame:
    import json

    rows = [(t, i, json.dumps(m), r) for t, own in RULES.items() for i, (m, r) in enumerate(own)]
    return spark.createDataFrame([*rows, ("error", None, None, None)], "tool string, rule_idx int, match_args string, response string")


RULES_SQL = "rules(tool, rule_idx, k, z, response) AS (VALUES ('click', 0, 1, NULL, 'first'), ('click', 1, 2, NULL, 'second'), ('click', 2, NULL, NULL, 'any'), ('view', 0, 3, NULL, 'third'), ('view', 1, 3, NULL, 'never'), ('view', 2, 99, NULL, 'last'), ('signup', 0, 10, 1, 'both'), ('signup', 1, 10, NULL, 'ten'))"


def talks(spark: SparkSession, sf_dir: str, max_turns: int = 2, needle: str = "tion", taboo: str = "trash") -> DataFrame:
    """Conversations as simulated scenarios with one success condition."""
    from ..operators.simulation import transcripts

    m = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"))
    return transcripts(m).select("conv_id", "transcript", F.lit(max_turns).alias("max_turns"), F.lit(needle).alias("success_contains"), F.lit("the").alias("expect_contains"), F.lit(taboo).alias("expect_not_contains"))


TALKS_SQL = """talks AS (
  SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS replies, list(text ORDER BY turn) FILTER (role = 'user') AS asked, list(role || ': ' || text ORDER BY turn) AS said FROM conversations GROUP BY conv_id
), hits AS (
  SELECT *, coalesce(len(replies), 0) AS n_replies, coalesce(len(asked), 0) AS n_asked, least(coalesce(len(replies), 0), 2) AS used,
    list_position(list_transform(replies[1:2], lambda r: contains(lower(r), 'tion')), true) AS hit FROM talks
), stops AS (
  SELECT *, coalesce(nullif(hit, 0), used)::INT AS turns, CASE WHEN hit > 0 THEN 'success' WHEN used >= 2 AND n_asked > used THEN 'max_turns' ELSE 'exhausted' END AS stop_reason FROM hits
), results AS (
  SELECT *, list_filter([
    CASE WHEN NOT contains(lower(coalesce(array_to_string(replies[1:turns], ' '), '')), 'the') THEN 'expected assistant text containing ''the''' END,
    CASE WHEN contains(lower(coalesce(array_to_string(replies[1:turns], ' '), '')), 'trash') THEN 'forbidden assistant text ''trash'' appeared' END,
    CASE WHEN stop_reason = 'max_turns' THEN 'never reached success condition ''tion'' within 2 turns' END], lambda x: x IS NOT NULL) AS violations
  FROM stops
)"""


def part_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan: a cell a brand and type, asking for as many parts as the largest size divided by ten."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("m"), F.min("p_partkey").alias("ordinal"))
    return p.select(F.col("p_brand").alias("intent"), F.col("p_type").alias("topic"), F.lit("unspecified").alias("scenario"), F.lit("none").alias("failure_mode"), F.when(F.col("p_type").isin("SMALL", "ECONOMY"), "happy").otherwise("failure").alias("kind"), F.floor(F.col("m") / 10).cast("int").alias("count"), "ordinal", F.lit(2).alias("multi_turn"))


def part_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size <= 25")
    return p.select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("intent"), F.col("p_type").alias("topic"), F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("failure_mode"))


PARTS_SQL = """plan AS (
  SELECT p_brand AS intent, p_type AS topic, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'happy' ELSE 'failure' END AS kind, (max(p_size) // 10)::INT AS n, min(p_partkey) AS ordinal FROM part GROUP BY ALL
), held AS (SELECT p_brand AS intent, p_type AS topic, count(*) AS have FROM part WHERE p_size <= 25 GROUP BY ALL
), done AS (SELECT plan.*, coalesce(have, 0) AS have, least(coalesce(have, 0), n) AS covered FROM plan LEFT JOIN held USING (intent, topic))"""
