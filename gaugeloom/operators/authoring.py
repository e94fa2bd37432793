"""What generators author, checked before it is used: mock rules, strategies of a mock engine, and cases.

Documents come as rows with JSON text; tools: tool, args_schema, output_schema (JSON text).
Everything wrong is a row of problems, everything usable goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.jsonschema import argument_problems, conformance, known_schemas, sample_of, spoiled_of
from ..functions.jsontext import json_string, parsed

DEFAULT = "default"


def _problem(rows: DataFrame, keys: list[str], texts: Column) -> DataFrame:
    return rows.select(*keys, F.explode(texts).alias("problem"))


def _prefixed(prefix: Column, problems: Column) -> Column:
    return F.transform(problems, lambda p: F.concat(prefix, F.lit(" "), p))


def _outputs(tools: DataFrame) -> DataFrame:
    """tool, its output schema and a sample of it: a row a tool."""
    return tools.select("tool", F.coalesce("output_schema", F.lit("{}")).alias("_output")).withColumn("_sample", sample_of("_output"))


def strategy_problems(strategies: DataFrame, tools: DataFrame) -> DataFrame:
    """strategy, tool, problem of entries (strategy, tool, behavior, fallback_response, examples: array of JSON text).

    An entry names a known tool and says how it behaves; a fallback and the responses of
    examples conform to the tool's output schema, their args as far as given to its args
    schema; there is a strategy called default.
    """
    keys = ["strategy", "tool"]
    args_schemas, output_schemas = (known_schemas(tools, c) for c in ("args_schema", "output_schema"))
    known = tools.select("tool", F.coalesce("args_schema", F.lit("{}")).alias("_args"), F.coalesce("output_schema", F.lit("{}")).alias("_output"), F.lit(True).alias("_known"))
    e = strategies.join(known, "tool", "left")
    lost = e.where("_known is null").select(*keys, F.lit("unknown tool").alias("problem"))
    silent = e.where("_known and coalesce(trim(behavior), '') = ''").select(*keys, F.lit("needs a behavior text").alias("problem"))
    usable = e.where("_known and coalesce(trim(behavior), '') <> ''")
    fallback = _problem(usable.where("fallback_response is not null"), keys, _prefixed(F.lit("fallback_response"), conformance("fallback_response", "_output", output_schemas)))
    x = usable.select(*keys, "_args", "_output", F.posexplode("examples").alias("i", "x"))
    where = F.concat(F.lit("example "), F.col("i").cast("string"))
    members = F.json_object_keys("x")
    args, response = F.get_json_object("x", "$.args"), F.to_json(F.try_variant_get(F.try_parse_json("x"), "$.response", "variant"))
    whole = F.coalesce(F.array_contains(members, "args") & F.array_contains(members, "response") & F.ltrim(args).startswith("{"), F.lit(False))
    x = x.withColumns({"_where": where, "_whole": whole, "_a": args, "_r": F.coalesce(response, F.lit("null"))})
    broken = x.where(~F.col("_whole")).select(*keys, F.concat("_where", F.lit(" needs args (object) and response")).alias("problem"))
    good = x.where("_whole")
    wrong = _problem(good, keys, _prefixed(F.concat("_where", F.lit(" args")), argument_problems("_a", "_args", args_schemas))).unionByName(_problem(good, keys, _prefixed(F.concat("_where", F.lit(" response")), conformance("_r", "_output", output_schemas))))
    named = strategies.agg(F.coalesce(F.bool_or(F.col("strategy") == DEFAULT), F.lit(False)).alias("has"))
    missing = named.where("not has").select(F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("string").alias("tool"), F.lit("a default strategy is required").alias("problem"))
    out = lost
    for part in (silent, fallback, broken, wrong, missing):
        out = out.unionByName(part)
    return out


def completed_strategies(strategies: DataFrame, tools: DataFrame, behavior: str = "generic") -> DataFrame:
    """strategy, tool, behavior, fallback_response: entries of known tools, and a default entry for each tool without one.

    A fallback that doesn't conform is replaced by a sample of the output schema.
    """
    known = _outputs(tools)
    own = strategies.where("coalesce(trim(behavior), '') <> ''").join(known, "tool")
    fits = F.col("fallback_response").isNull() | (F.size(conformance("fallback_response", "_output", known_schemas(tools, "output_schema"))) == 0)
    own = own.withColumn("_fits", fits).select("strategy", "tool", "behavior", F.when(F.col("_fits"), F.col("fallback_response")).otherwise(F.col("_sample")).alias("fallback_response"))
    bare = tools.select("tool").distinct().join(own.where(F.col("strategy") == DEFAULT).select("tool"), "tool", "left_anti")
    return own.unionByName(bare.select(F.lit(DEFAULT).alias("strategy"), "tool", F.lit(behavior).alias("behavior"), F.lit(None).cast("string").alias("fallback_response")))


def authored_rules(rules: DataFrame, tools: DataFrame, wildcard: bool = True) -> DataFrame:
    """tool, rule_idx, match_args, response, repaired: rules of known tools, each response that doesn't conform replaced by a sample.

    With ``wildcard`` a tool whose last rule doesn't match all, or that has none, gets one
    more that does and answers with a sample.
    """
    known = _outputs(tools)
    own = rules.join(known, "tool").withColumn("repaired", F.size(conformance("response", "_output", known_schemas(tools, "output_schema"))) > 0)
    own = own.select("tool", "rule_idx", "match_args", F.when(F.col("repaired"), F.col("_sample")).otherwise(F.col("response")).alias("response"), "repaired")
    if not wildcard:
        return own
    last = own.groupBy("tool").agg(F.max("rule_idx").alias("_last"), F.max_by("match_args", "rule_idx").alias("_match"))
    wild = F.coalesce(F.regexp_replace("_match", r"\s", ""), F.lit("none")) == "{}"
    short = known.join(last, "tool", "left").where(~wild)
    more = short.select("tool", (F.coalesce("_last", F.lit(-1)) + 1).cast("int").alias("rule_idx"), F.lit("{}").alias("match_args"), F.col("_sample").alias("response"), F.lit(False).alias("repaired"))
    return own.unionByName(more)


def case_problems(cases: DataFrame, cells: int, tools: DataFrame, variants: list[str]) -> DataFrame:
    """ordinal, problem of authored cases (ordinal, cell, message, expected: array of tools, variant): a cell out of range, no message, unknown tools or variant."""
    bad = F.array(
        F.when(~F.coalesce((F.col("cell") >= 0) & (F.col("cell") < cells), F.lit(False)), "cell is out of range"),
        F.when(F.coalesce(F.trim("message"), F.lit("")) == "", "message is empty"),
        F.when(F.col("variant").isNotNull() & ~F.col("variant").isin(variants), F.concat(F.lit("unknown variant "), "variant")),
    )
    own = _problem(cases, ["ordinal"], F.filter(bad, lambda b: b.isNotNull()))
    named = cases.select("ordinal", F.explode(F.array_distinct("expected")).alias("tool")).join(tools.select("tool").distinct(), "tool", "left_anti")
    return own.unionByName(named.select("ordinal", F.concat(F.lit("unknown tool "), "tool").alias("problem")))


#: An authored case as a generator writes it; args, matchers and responses are JSON texts or values.
RAW = """struct<cell:variant,user_message:string,expected_tools:array<struct<name:string,args:string>>,forbidden_tools:array<string>,
 mock_overrides:array<struct<tool:string,match_args:string,response:string>>,variant:string,user_turns:array<string>,expected_response:string,
 contains:string,contract:string,evidence:array<string>,mock_strategy:string>"""


#: What is said of an authored case and of its parts that can't be used (fixed wording).
SAID = {
    "cell": "case with unknown cell index %s dropped",
    "message": "empty user_message for cell %s dropped",
    "tool": "case for %s expects unknown tool %s; dropped",
    "args": "case for %s: expected_tools %s args violate args_schema: %s",
    "override": "mock override for unknown tool in %s ignored",
    "response": "mock override for %s in %s ignored (invalid JSON)",
    "strategy": "case for %s: unknown mock strategy '%s' ignored",
}


def _error(kind: str, *values: Column | str) -> Column:
    return F.format_string(SAID[kind], *values)


def _said(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit(""))


def _json_text(value: Column) -> Column:
    """A value that may be JSON text or JSON: null if it is neither."""
    return F.when(parsed(value).isNotNull(), value)


def authored_cases(raw: DataFrame, cells: DataFrame, tools: DataFrame, strategies: list[str], variants: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) of what a generator wrote for a plan's cells.

    raw: ordinal, doc (JSON text, see RAW); cells: cell (from 0), key, intent, topic,
    scenario, failure_mode, count, variants (array), tool, edge (kind of an edge case). A
    case of no cell, without a message or with an unknown expected tool is dropped;
    overrides of unknown tools or without a response, unknown variants and strategies are
    ignored; args that break their schema are told and kept. A cell on malformed output
    gets a rule that answers with one. Of a cell's cases the first ``count`` stay.

    cases: ordinal, cell, key, the cell's tags, variant, message, expected_tools (JSON),
    forbidden_tools, user_turns, mocks (JSON list of tool, matchArgs, response), strategy,
    reference (response, contains, contract), evidence. errors: ordinal, place, error.
    """
    args_schemas = known_schemas(tools, "args_schema")
    names = tools.agg(F.coalesce(F.collect_set("tool"), F.array().cast("array<string>")).alias("_known"))  # one row: the tools of an agent
    r = raw.select("ordinal", F.from_json("doc", RAW).alias("r")).where("r is not null").join(names)
    index = F.try_variant_get(F.col("r.cell"), "$", "int")
    given = F.when(F.schema_of_variant(F.col("r.cell")) == "BIGINT", index)
    r = r.withColumn("cell", given).join(cells.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell"), "left")
    empty = F.array().cast("array<string>")
    known = lambda t: F.coalesce(F.array_contains(F.col("_known"), t), F.lit(False))
    strangers = F.filter(F.coalesce("r.expected_tools", F.array().cast("array<struct<name:string,args:string>>")), lambda e: ~known(e["name"]))
    r = r.withColumn("_message", _said(F.col("r.user_message"))).withColumn("_lost", F.get(strangers, F.lit(0)))
    no_cell = F.col("_cell").isNull()
    quoted = F.coalesce(F.concat(F.lit("'"), F.col("_lost.name"), F.lit("'")), F.lit("None"))
    dropped = (
        F.when(no_cell, _error("cell", F.coalesce(F.to_json("r.cell"), F.lit("null")))).when(F.col("_message") == "", _error("message", "key")).when(F.size(strangers) > 0, _error("tool", "key", quoted))
    )
    r = r.withColumn("_dropped", dropped)
    lost = r.where("_dropped is not null").select("ordinal", F.lit(-1).alias("place"), F.col("_dropped").alias("error"))
    good = r.where("_dropped is null")
    calls = good.select("ordinal", "key", F.posexplode("r.expected_tools").alias("place", "e"))
    own_args = F.when(F.ltrim(F.col("e.args")).startswith("{") & parsed(F.col("e.args")).isNotNull(), F.col("e.args")).otherwise("{}")
    calls = calls.select("ordinal", "key", "place", F.col("e.name").alias("tool"), own_args.alias("args")).join(tools.select("tool", F.coalesce("args_schema", F.lit("{}")).alias("_args")), "tool")
    wrong = calls.select("ordinal", "key", "place", "tool", F.explode(argument_problems("args", "_args", args_schemas)).alias("p"))
    wrong = wrong.select("ordinal", "place", _error("args", "key", "tool", "p").alias("error"))
    listed = calls.groupBy("ordinal").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", "tool", "args"))), lambda c: F.struct(c["tool"].alias("name"), F.parse_json(c["args"]).alias("args")))).alias("expected_tools"))
    overrides = good.select("ordinal", "key", "_known", F.posexplode("r.mock_overrides").alias("place", "o"))
    response, matcher = _json_text(F.col("o.response")), F.when(F.ltrim(F.col("o.match_args")).startswith("{"), _json_text(F.col("o.match_args")))
    overrides = overrides.select("ordinal", "key", F.col("place"), F.col("o.tool").alias("tool"), known(F.col("o.tool")).alias("is_known"), F.coalesce(matcher, F.lit("{}")).alias("match_args"), response.alias("response"))
    ignored = overrides.where("not is_known or response is null").select("ordinal", (F.col("place") + 1000).alias("place"), F.when(~F.col("is_known"), _error("override", "key")).otherwise(_error("response", "tool", "key")).alias("error"))
    malformed = good.where("edge = 'malformed_output' and tool is not null").select("ordinal", F.col("tool").alias("_edge_tool"))
    broken = tools.select(F.col("tool").alias("_edge_tool"), spoiled_of(F.coalesce("output_schema", F.lit("{}"))).alias("response"))
    injected = malformed.join(broken, "_edge_tool").select("ordinal", F.lit(10**6).alias("place"), F.col("_edge_tool").alias("tool"), F.lit("{}").alias("match_args"), "response")
    rules = overrides.where("is_known and response is not null").select("ordinal", "place", "tool", "match_args", "response")
    rules = rules.join(malformed.withColumnRenamed("_edge_tool", "tool"), ["ordinal", "tool"], "left_anti").unionByName(injected)
    one = F.concat(F.lit('{"tool":'), json_string(F.col("tool")), F.lit(',"matchArgs":'), "match_args", F.lit(',"response":'), "response", F.lit("}"))
    mocks = rules.groupBy("ordinal").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("place", one.alias("x"))))["x"], ","), F.lit("]")).alias("mocks"))
    chosen = _said(F.col("r.mock_strategy"))
    strange = good.where((chosen != "") & ~chosen.isin(strategies)).select("ordinal", F.lit(10**6).alias("place"), _error("strategy", "key", chosen).alias("error"))
    turns = F.filter(F.coalesce("r.user_turns", empty), lambda t: F.trim(t) != "")
    variant = F.when(F.size(turns) > 0, "multi-turn").when(F.col("r.variant").isin(variants), F.col("r.variant")).otherwise(F.get("variants", F.lit(0)))
    told = F.nullif(F.col("r.evidence"), empty)
    kept = good.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("ordinal"))).where(F.col("_n") <= F.col("count"))
    kept = kept.join(listed, "ordinal", "left").join(mocks, "ordinal", "left").select(
        "ordinal", "cell", "key", "intent", "topic", "scenario", "failure_mode", "tool", "edge", variant.alias("variant"), F.col("_message").alias("message"), F.coalesce("expected_tools", F.lit("[]")).alias("expected_tools"),
        F.filter(F.coalesce("r.forbidden_tools", empty), known).alias("forbidden_tools"), turns.alias("user_turns"), "mocks", F.when(chosen.isin(strategies), chosen).alias("strategy"),
        F.struct(F.coalesce("r.expected_response", F.lit("")).alias("response"), F.nullif(_said(F.col("r.contains")), F.lit("")).alias("contains"), F.nullif(_said(F.col("r.contract")), F.lit("")).alias("contract")).alias("reference"),
        F.coalesce(told, F.array("scenario")).alias("evidence"),
    )
    errors = lost.unionByName(wrong).unionByName(ignored).unionByName(strange)
    return kept, errors
