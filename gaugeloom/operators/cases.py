"""Datasets of cases: normalising, identity, selecting, importing, review and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.jsonvalues import case_identity
from ..schemas import MISS_POLICIES, REVIEW_STATES

PENDING_NOTE = "new cases start as pending"


def normalize(raw: DataFrame) -> DataFrame:
    """raw: ordinal, case_id, inputs and reference_outputs (JSON text), intent, topic, scenario, failure_mode, ...

    A case without id gets its identity; its review is pending whatever it says.
    """
    own = case_identity("inputs", "intent", "topic", "scenario", "failure_mode")
    given = F.when(F.coalesce(F.col("case_id"), F.lit("")) != "", F.col("case_id"))
    return raw.withColumn("case_id", F.coalesce(given, own)).withColumn("review_status", F.lit("pending")).withColumn("review_note", F.lit(PENDING_NOTE))


def add_new(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases to add, duplicates): of equal ids the first stays, ids that exist already are duplicates, however often they do."""
    known = existing.select(F.col("case_id").alias("_id")).distinct()
    seen = new.join(known, F.col("case_id") == F.col("_id"), "left")
    ranked = seen.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal")))
    fresh = F.col("_id").isNull() & (F.col("_n") == 1)
    return ranked.where(fresh).drop("_id", "_n"), ranked.where(~fresh).drop("_id", "_n")


def select_cases(cases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Approved cases, or those of ``ids`` (case_id, place) in their order; unknown and unapproved ids come with a problem."""
    if ids is None:
        return cases.where("review_status = 'approved'").withColumn("problem", F.lit(None).cast("string"))
    problem = F.when(F.col("review_status").isNull(), "unknown id").when(F.col("review_status") != "approved", "not approved")
    return ids.join(cases, "case_id", "left").withColumn("problem", problem)


def import_rows(document: DataFrame, column: str = "doc", source_path: str | None = None) -> DataFrame:
    """ordinal, inputs, reference_outputs, metadata (JSON text), source, source_path of foreign cases in JSON documents.

    The list is the document itself or lies under cases, examples or goldens, the first
    that isn't empty. outputs is another name where the key reference_outputs is absent,
    additional_metadata where metadata is absent or empty. The metadata names import as
    its source, and the path; ids, reviews and publications are left behind.
    """
    doc = F.try_parse_json(F.col(column))
    at = lambda v, path: F.try_variant_get(v, path, "string")
    listed = F.coalesce(*[F.when(F.size(F.from_json(at(doc, p), "array<string>")) > 0, at(doc, p)) for p in ("$.cases", "$.examples", "$.goldens")], F.col(column))
    items = document.select(F.posexplode(F.from_json(listed, "array<string>")).alias("ordinal", "item"))
    item = F.try_parse_json("item")
    filled = lambda path: F.when(F.size(F.json_object_keys(at(item, path))) > 0, at(item, path))
    named = F.coalesce(F.array_contains(F.json_object_keys("item"), "reference_outputs"), F.lit(False))
    metadata = F.coalesce(filled("$.metadata"), filled("$.additional_metadata"), F.lit("{}"))
    mark = F.create_map(F.lit("source"), F.to_json(F.struct(F.lit("import").alias("v"))), F.lit("source_path"), F.to_json(F.struct(F.lit(source_path).alias("v")), {"ignoreNullFields": "false"}))
    kept = F.map_filter(F.from_json(metadata, "map<string,variant>"), lambda k, _: ~k.isin("source", "source_path"))
    marks = F.transform_values(mark, lambda _, v: F.try_variant_get(F.parse_json(v), "$.v", "variant"))
    return items.select(
        "ordinal", at(item, "$.inputs").alias("inputs"),
        F.when(named, at(item, "$.reference_outputs")).otherwise(at(item, "$.outputs")).alias("reference_outputs"),
        F.to_json(F.map_concat(kept, marks)).alias("metadata"), F.lit("import").alias("source"), F.lit(source_path).cast("string").alias("source_path"),
    )


def review_problems(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id, problem of decisions that cannot be taken: an invalid status, or an unknown id."""
    wrong = decisions.where(~F.coalesce(F.col("status").isin(*REVIEW_STATES), F.lit(False))).select("case_id", F.concat(F.lit("invalid review status "), F.coalesce("status", F.lit("None"))).alias("problem"))
    return wrong.unionByName(unknown_ids(decisions.select("case_id"), cases).select("case_id", F.lit("unknown case id").alias("problem"))).distinct()


def set_review(cases: DataFrame, decisions: DataFrame, note: str = "") -> DataFrame:
    """``cases`` with the status of decisions (case_id, status) set; see review_problems for those that must be refused.

    An invalid status fails the job when it meets a case; an unknown id meets none.
    """
    d = decisions.groupBy("case_id").agg(F.max("status").alias("_status"))
    valid = F.when(F.col("_status").isNull() | F.col("_status").isin(*REVIEW_STATES), F.col("_status")).otherwise(F.raise_error(F.concat(F.lit("invalid review status "), F.col("_status"))))
    changed = F.col("_status").isNotNull()
    return cases.join(d, "case_id", "left").withColumn("review_status", F.coalesce(valid, "review_status")).withColumn("review_note", F.when(changed, F.lit(note)).otherwise(F.col("review_note"))).drop("_status")


def unknown_ids(ids: DataFrame, cases: DataFrame) -> DataFrame:
    return ids.join(cases, "case_id", "left_anti")


def review_gate(cases: DataFrame, misses: DataFrame, auto_approve: bool) -> DataFrame:
    """Pending cases with a missed mock are rejected; the rest are approved only if told to."""
    bad = misses.select("case_id").distinct().withColumn("_miss", F.lit(True))
    pending = F.col("review_status") == "pending"
    status = F.when(pending & F.col("_miss").isNotNull(), "rejected").when(pending & F.lit(auto_approve), "approved").otherwise(F.col("review_status"))
    return cases.join(bad, "case_id", "left").withColumn("review_status", status).drop("_miss")


def problems(cases: DataFrame, rules: DataFrame | None = None, mocks: DataFrame | None = None) -> DataFrame:
    """case_id, problem: a row for each rule that a case breaks.

    rules: case_id, tool, rule_idx, rule (JSON text) of the cases' own mock blocks; mocks:
    case_id, strategy, strategies of blocks that choose a strategy. Their problems join
    those of the cases.
    """
    twice = cases.where("coalesce(case_id, '') <> ''").groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("duplicate id").alias("problem"))
    inputs = F.get_json_object("inputs", "$")
    checks = F.array(
        F.when(F.coalesce(F.col("case_id"), F.lit("")) == "", "missing id"),
        F.when(F.coalesce(inputs.isin("{}", "null", ""), F.lit(True)) | ~F.coalesce(F.ltrim("inputs").startswith("{"), F.lit(False)), "inputs must be a non-empty object"),
        F.when(~F.coalesce(F.col("review_status").isin(*REVIEW_STATES), F.lit(False)), "invalid review status"),
    )
    out = cases.select("case_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem")).unionByName(twice)
    if rules is not None:
        out = out.unionByName(rule_problems(rules, ["case_id"]).select("case_id", F.concat("tool", F.lit("["), F.col("rule_idx").cast("string"), F.lit("]: "), "problem").alias("problem")))
    if mocks is not None:
        unknown = F.col("strategy").isNotNull() & ~F.coalesce(F.array_contains("strategies", F.col("strategy")), F.lit(False))
        out = out.unionByName(mocks.where(unknown).select("case_id", F.concat(F.lit("unknown mock strategy "), "strategy").alias("problem")))
    return out


def dataset_header_problems(headers: DataFrame, schema_id: str) -> DataFrame:
    """problem rows of datasets (schema, mocks as JSON text): the schema id, a mock block that is no object, tools that are no object of lists."""
    block = F.try_parse_json("mocks")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(block, path, "variant"))
    lists = F.map_filter(F.from_json(F.get_json_object("mocks", "$.tools"), "map<string,string>"), lambda _, v: ~F.ltrim(v).startswith("["))
    checks = F.array(
        F.when(~F.coalesce(F.col("schema") == schema_id, F.lit(False)), f"schema must be {schema_id}"),
        F.when(F.col("mocks").isNotNull() & ~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)), "mocks must be an object"),
        F.when(kind("$.tools").isNotNull() & ~kind("$.tools").startswith("OBJECT"), "mocks.tools must be an object"),
    )
    named = F.transform(F.map_keys(lists), lambda k: F.concat(F.lit("mocks.tools."), k, F.lit(" must be a list of rules")))
    every = F.concat(F.filter(checks, lambda c: c.isNotNull()), F.coalesce(named, F.array().cast("array<string>")))
    return headers.select(F.explode(every).alias("problem"))


def policy_problems(mocks: DataFrame) -> DataFrame:
    """problem rows of mock blocks (on_miss, model, on_invalid, max_repairs, strategy, strategies).

    The model is asked for and checked under the policy llm alone; a strategy is checked
    against those declared if there are any.
    """
    policy = F.coalesce(F.col("on_miss"), F.lit("real"))
    model = F.nullif(F.col("model"), F.lit(""))
    declared = F.coalesce(F.size("strategies"), F.lit(0)) > 0
    bad = F.array(
        F.when(~policy.isin(*MISS_POLICIES), "invalid on_miss"),
        F.when((policy == "llm") & model.isNull(), "model is required when on_miss is llm"),
        F.when((policy == "llm") & ~F.contains(model, F.lit(":")), "model must be provider:model"),
        F.when(F.col("on_invalid").isNotNull() & ~F.col("on_invalid").isin("fallback", "error"), "invalid on_invalid"),
        F.when(F.col("max_repairs") < 0, "max_repairs must not be negative"),
        F.when(declared & (F.coalesce(F.col("strategy"), F.lit("")) != "") & ~F.array_contains("strategies", F.col("strategy")), "strategy is not declared"),
    )
    return mocks.select(F.explode(F.filter(bad, lambda c: c.isNotNull())).alias("problem"))


def rule_problems(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys``, tool, rule_idx, problem: rules (tool, rule_idx, rule as JSON text) with matchArgs that is no object, or without the key response; a null response is one."""
    v = F.try_parse_json("rule")
    match = F.schema_of_variant(F.try_variant_get(v, "$.matchArgs", "variant"))
    bad = F.array(
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "rule must be an object"),
        F.when(match.isNotNull() & ~match.startswith("OBJECT"), "matchArgs must be an object"),
        F.when(v.isNotNull() & F.try_variant_get(v, "$.response", "variant").isNull() & ~F.coalesce(F.array_contains(F.json_object_keys("rule"), "response"), F.lit(False)), "response is missing"),
    )
    return rules.select(*(keys or []), "tool", "rule_idx", F.explode(F.filter(bad, lambda c: c.isNotNull())).alias("problem"))


def case_rows(cases: DataFrame) -> DataFrame:
    """The case table of a report: first user message, turns and expected tools in one cell each."""
    doc = F.try_parse_json("inputs")
    first = F.coalesce(F.try_variant_get(doc, "$.messages[0].content", "string"), F.substring("inputs", 1, 200))
    tools = F.from_json(F.get_json_object("reference_outputs", "$.expected_tools"), "array<struct<name:string>>")
    named = F.coalesce(F.array_join(F.transform(tools, lambda t: t["name"]), ", "), F.lit(""))
    turns = F.lit(1) + F.coalesce(F.size("user_turns"), F.lit(0))
    return cases.select("case_id", "intent", "topic", "scenario", "failure_mode", "variant", "source", "review_status", first.alias("input"), turns.alias("turns"), named.alias("expected_tools"))


def matching(cases: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Conjunction of IN filters; an empty list filters nothing."""
    out = cases
    for column, values in filters.items():
        if values:
            out = out.where(F.col(column).isin(values))
    return out


def padded(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns in order, with nulls for those that are absent."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def to_publish(cases: DataFrame) -> DataFrame:
    return cases.where("review_status = 'approved' and publication_id is null")


def not_published(sent: DataFrame, remote: DataFrame) -> DataFrame:
    """Cases that the remote side doesn't show after an upload: any row is an error."""
    return sent.join(remote.select(F.col("local_case_id").alias("case_id")), "case_id", "left_anti")


def dataset_summary(cases: DataFrame) -> DataFrame:
    """what, value, n: cases by status, by failure mode and by source, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("what"), F.coalesce(c, F.lit("none")).alias("value")) for k, c in (("status", F.col("review_status")), ("failure_mode", F.col("failure_mode")), ("source", F.col("source")))])
    return cases.select(F.explode(pairs).alias("p")).groupBy("p.what", "p.value").agg(F.count(F.lit(1)).alias("n"))


def intent_counts(intents: DataFrame, scenarios: DataFrame, cases: DataFrame) -> DataFrame:
    """intents (ordinal, intent) with how many scenarios (intent) and cases (intent) each has."""
    count = lambda rows, name: rows.groupBy("intent").agg(F.count(F.lit(1)).alias(name))
    out = intents.join(count(scenarios, "scenarios"), "intent", "left").join(count(cases, "cases"), "intent", "left")
    return out.select("ordinal", "intent", F.coalesce("scenarios", F.lit(0)).alias("scenarios"), F.coalesce("cases", F.lit(0)).alias("cases"))


def inline_calls(calls: Column) -> Column:
    """``name(args)`` joined by arrows, a dash for none."""
    text = F.array_join(F.transform(calls, lambda c: F.concat(c["name"], F.lit("("), F.coalesce(c["args"], F.lit("")), F.lit(")"))), " → ")
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, text).otherwise("—")


def preview(value: Column, width: int = 800) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("…"))).otherwise(value)
