"""Mocked tools: which rule answers a call, which calls no rule answers, and ledgers of who answered.

calls: call_id, tool, args (JSON text). rules: scope columns, tool, rule_idx, match_args
(JSON text, '{}' matches all), response. A tool's rules are one array, so calls are
joined with lists, one row each.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import jsontext
from ..functions.jsonvalues import json_digest


def deepest(rules: DataFrame) -> int:
    """How deep the matchers of a rule table are: one number, by a pass over the rules."""
    return rules.agg(F.coalesce(F.max(jsontext.depth_of(F.col("match_args"))), F.lit(1))).first()[0] or 1


def first_match(calls: DataFrame, rules: DataFrame, keys: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """``calls`` with rule_idx and response of the first rule that matches; nulls if none does.

    ``keys``: further columns that calls and rules share, such as the case. A list of
    rules is one array, so a call meets its list in one row and rows don't multiply; for
    tools with very many rules there is ``first_match_indexed``. A rule matches a call
    that has all its leaves (jsontext.leaves); ``depth``: of the deepest matcher, found by
    a pass over the rules if it isn't given.
    """
    on = ["tool", *(keys or [])]
    depth = depth or deepest(rules)
    wanted = jsontext.wanted_leaves(F.col("match_args"), depth).alias("wanted")
    lists = rules.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("rule_idx", "response", wanted))).alias("_rules"))
    # the leaves of a call are made once, not once a rule
    first = lambda have: F.get(F.filter("_rules", lambda r: jsontext.met(r["wanted"], have)), F.lit(0))
    found = F.get(F.transform(F.array(jsontext.leaves(F.col("args"), depth)), lambda have: first(have)), F.lit(0))
    return calls.join(lists, on, "left").withColumn("_found", found).withColumn("rule_idx", F.col("_found.rule_idx")).withColumn("response", F.col("_found.response")).drop("_rules", "_found")


def first_match_indexed(calls: DataFrame, rules: DataFrame, keys: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """first_match for thousands of rules a tool: calls are looked up in an inverted index from leaves to rules.

    A rule stands in the index once, under that of its leaves which the fewest rules of
    its tool share, and only the first of rules that ask the same. Calls of one tool with
    equal args have one answer, so each is looked up once, by all its leaves; a rule found
    matches if the call has the rest of its leaves too. Rules without leaves match all
    calls. The first of the matching rules is the answer. A leaf whose path begins no entry
    of the index isn't looked up: paths are marked in one bit table of 4 KB, which may let
    more leaves pass but holds back none that an entry has.
    """
    on = ["tool", *(keys or [])]
    depth = depth or deepest(rules)
    wanted = F.array_sort(F.array_distinct(jsontext.wanted_leaves(F.col("match_args"), depth))).alias("wanted")
    listed = rules.where("rule_idx is not null").select(*on, "rule_idx", "response", wanted)
    known = listed.groupBy(*on, "wanted").agg(F.min("rule_idx").alias("rule_idx"))
    entries = known.select(*on, "rule_idx", "wanted", F.explode("wanted").alias("leaf"))
    sharing = entries.groupBy(*on, "leaf").agg(F.count("*").alias("sharing"))
    rarest = F.min_by("leaf", F.struct("sharing", "leaf")).alias("leaf")
    index = entries.join(sharing, [*on, "leaf"]).groupBy(*on, "rule_idx").agg(rarest, F.first("wanted").alias("wanted"))
    free = known.where(F.size("wanted") == 0).select(*on, F.col("rule_idx").alias("free"))
    own_id = F.unhex(F.sha2("args", 256)).alias("_id")
    place = lambda leaf: F.bitmap_bit_position(F.xxhash64(*on, F.substring_index(leaf, "]=", 1)))
    bits = index.agg(F.bitmap_construct_agg(place(F.col("leaf"))).alias("_bits"))  # one row
    byte = lambda p: F.conv(F.hex(F.substring("_bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known_path = lambda leaf: F.get(F.transform(F.array(place(leaf)), lambda p: F.floor(byte(p) / F.pow(F.lit(2), p % 8)) % 2 == 1), F.lit(0))
    asked = calls.select(*on, "args").distinct().join(bits).select(*on, own_id, F.array_distinct(jsontext.leaves(F.col("args"), depth)).alias("have"), "_bits")
    # an outer explode, as Spark would compute the leaves again to filter empty ones for another
    looked = asked.select(*on, "_id", "have", F.explode_outer(F.filter("have", known_path)).alias("leaf")).where("leaf is not null")
    hits = looked.join(index, [*on, "leaf"]).where(jsontext.met(F.col("wanted"), F.col("have")))
    first = hits.groupBy(*on, "_id").agg(F.min("rule_idx").alias("hit"))
    found = calls.withColumn("_id", own_id).join(first, [*on, "_id"], "left").join(free, on, "left")
    found = found.withColumn("rule_idx", F.least("hit", "free")).drop("_id", "hit", "free")
    return found.join(listed.select(*on, "rule_idx", "response"), [*on, "rule_idx"], "left").select(*calls.columns, "rule_idx", "response")


def first_match_constant(calls: DataFrame, rules: dict[str, list[tuple[dict, str]]]) -> DataFrame:
    """first_match for rule lists known when the plan is made: a chain of predicates, no join."""
    def levels(value: object) -> int:
        return 1 + max(map(levels, value.values()), default=0) if isinstance(value, dict) else 0

    flat = [(tool, i, matcher or {}) for tool, own in rules.items() for i, (matcher, _) in enumerate(own)]
    depth = max((levels(matcher) for *_, matcher in flat), default=1)
    one = calls.sparkSession.range(1).select(*[jsontext.wanted_leaves(F.lit(json.dumps(matcher)), depth).alias(f"r{n}") for n, (*_, matcher) in enumerate(flat)])
    place = F.lit(None).cast("int")
    for (tool, i, _), wanted in reversed(list(zip(flat, one.first() if flat else (), strict=True))):
        hit = F.col("tool") == tool
        if wanted:
            hit &= F.coalesce(reduce(and_, [F.array_contains("_args", leaf) for leaf in wanted]), F.lit(False))
        place = F.when(hit, i).otherwise(place)
    texts = {tool: F.array(*[F.lit(response) for _, response in own]) for tool, own in rules.items()}
    response = F.lit(None).cast("string")
    for tool, own in texts.items():
        response = F.when(F.col("tool") == tool, F.get(own, F.col("rule_idx"))).otherwise(response)
    return calls.withColumn("_args", jsontext.leaves(F.col("args"), depth)).withColumn("rule_idx", place).withColumn("response", response).drop("_args")


def merge_rules(dataset_rules: DataFrame, case_rules: DataFrame) -> DataFrame:
    """case_id, tool, rule_idx, ...: a case's list replaces the dataset's for its tool.

    dataset_rules: tool, rule_idx, match_args, response; case_rules the same with case_id.
    Only cases with rules of their own are in case_rules; others use dataset_rules as they
    are. A dataset mocks some dozens of tools, so their names are one small array.
    """
    own = case_rules.groupBy("case_id").agg(F.collect_set("tool").alias("own"))
    tools = dataset_rules.agg(F.collect_set("tool").alias("tools"))  # one row
    missing = own.join(tools).select("case_id", F.explode(F.array_except("tools", "own")).alias("tool"))
    inherited = missing.join(dataset_rules, "tool")
    columns = ["case_id", "tool", "rule_idx", "match_args", "response"]
    return case_rules.select(*columns).unionByName(inherited.select(*columns))


def with_fallback(case_rules: DataFrame, dataset_rules: DataFrame) -> DataFrame:
    """case_id, tool, rule_idx, match_args, response: a case's rules, then the dataset's that it doesn't hold already, unless its last rule matches all.

    Rules are equal as JSON, whatever the order of keys or the blanks. An empty list, a
    row with a null rule_idx, is followed by all of the dataset's rules.
    """
    canon = lambda r: r.withColumn("_match", F.coalesce(json_digest("match_args"), json_digest(F.lit("{}")))).withColumn("_response", json_digest(F.when(F.try_parse_json("response").isNotNull(), F.col("response")).otherwise(F.to_json(F.struct("response")))))
    real = F.col("rule_idx").isNotNull()
    last = case_rules.groupBy("case_id", "tool").agg(F.max_by("match_args", F.when(real, F.col("rule_idx"))).alias("last"), F.count("rule_idx").alias("n"))
    wild = F.coalesce(F.regexp_replace("last", r"\s", ""), F.lit("{}")).isin("{}", "null")
    open_lists = last.where((F.col("n") == 0) | ~wild).select("case_id", "tool", "n")
    same = ["case_id", "tool", "_match", "_response"]
    # the dataset's rules are hashed before a case has them all
    more = open_lists.join(canon(dataset_rules), "tool").join(canon(case_rules.where(real)).select(*same), same, "left_anti")
    columns = ["case_id", "tool", "rule_idx", "match_args", "response"]
    order = Window.partitionBy("case_id", "tool").orderBy(F.col("_old"))
    ranked = more.withColumnRenamed("rule_idx", "_old").withColumn("rule_idx", (F.col("n") + F.row_number().over(order) - 1).cast("int"))
    return case_rules.where(real).select(*columns).unionByName(ranked.select(*columns))


def mock_blocks(cases: DataFrame, case_rules: DataFrame, dataset_rules: DataFrame, on_miss: str | None = None, strategy: str | None = None, dataset_on_miss: str | None = None, dataset_strategy: str | None = None) -> DataFrame:
    """One answer a case: case_id, on_miss, strategy and tools, a map from a tool to its rules in order.

    A case's own list of a tool goes before the dataset's, an empty one too. What a run
    asks for on a miss goes before the dataset's, that before ``real``; a case's own
    strategy (cases: case_id, strategy) before the run's, that before the dataset's.
    case_rules: case_id and the columns of dataset_rules: tool, rule_idx (null: an empty
    list), match_args, response.
    """
    rule = F.struct("rule_idx", "match_args", "response")
    listed = lambda rows, *keys: rows.groupBy(*keys, "tool").agg(F.sort_array(F.collect_list(F.when(F.col("rule_idx").isNotNull(), rule))).alias("rules"))
    in_map = F.map_from_entries(F.collect_list(F.struct("tool", "rules")))
    shared = listed(dataset_rules).agg(in_map.alias("_shared"))  # one row: a dataset mocks some dozens of tools
    own = listed(case_rules, "case_id").groupBy("case_id").agg(in_map.alias("_own"))
    none = F.from_json(F.lit("{}"), "map<string,array<struct<rule_idx:int,match_args:string,response:string>>>")
    kept = F.map_filter("_shared", lambda tool, _: ~F.map_contains_key(F.coalesce("_own", none), tool))
    chosen = F.coalesce(F.nullif(F.col("strategy"), F.lit("")), F.lit(strategy or None), F.lit(dataset_strategy or None))
    out = cases.select("case_id", "strategy").join(own, "case_id", "left").join(shared)
    return out.select("case_id", F.lit(on_miss or dataset_on_miss or "real").alias("on_miss"), chosen.alias("strategy"), F.map_concat(kept, F.coalesce("_own", none)).alias("tools"))


def unanswered(calls: DataFrame, rules: DataFrame, keys: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """Calls whose tool has a rule list but no rule that matches. Tools without a list are left alone.

    An empty list is a row of ``rules`` with a null rule_idx. ``depth`` as in first_match.
    """
    mocked = rules.select("tool", *(keys or [])).distinct()
    hit = first_match(calls, rules.where("rule_idx is not null"), keys, depth)
    return hit.where("rule_idx is null").join(mocked, ["tool", *(keys or [])], "left_semi").drop("rule_idx", "response")


def verify_summary(misses: DataFrame, policy: str) -> DataFrame:
    """One row: policy, misses, llm_answered, ok. Under the policy llm a miss is answered, not a fault."""
    n = misses.agg(F.count(F.lit(1)).alias("n"))
    llm = F.lit(policy == "llm")
    return n.select(F.lit(policy).alias("policy"), F.when(llm, 0).otherwise(F.col("n")).cast("long").alias("misses"), F.when(llm, F.col("n")).otherwise(0).cast("long").alias("llm_answered"), (llm | (F.col("n") == 0)).alias("ok"))


def answered_by(calls: DataFrame, policy: str) -> DataFrame:
    """The ledger layer of each call: its rule, or what the policy for misses says."""
    miss = {"real": "real", "strict": "error", "fallback": "fallback", "llm": "llm"}[policy]
    return calls.withColumn("layer", F.when(F.col("rule_idx").isNotNull(), "rule").otherwise(miss))


def ledger_totals(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Counts a layer, and invalid LLM answers. An entry may count twice: under its layer, and as fallback or error if it carries that mark."""
    layer = F.coalesce("layer", F.lit("rule"))
    marked = F.coalesce(F.col("fallback"), F.lit(False)) & (layer != "fallback")
    failed = F.col("error").isNotNull() & (F.col("error") != "") & (layer != "error")
    return ledger.groupBy(*keys).agg(
        F.count_if(layer == "rule").alias("rule"), F.count_if(layer == "llm").alias("llm"), F.count_if(layer == "real").alias("real"),
        F.sum(F.when(layer == "fallback", 1).otherwise(0) + F.when(marked, 1).otherwise(0)).alias("fallback"),
        F.sum(F.when(layer == "error", 1).otherwise(0) + F.when(failed, 1).otherwise(0)).alias("error"),
        F.count_if((layer == "llm") & ~F.coalesce(F.col("valid"), F.lit(True))).alias("invalid"),
    )


def engine_stats(ledger: DataFrame) -> DataFrame:
    """One row: calls, valid, repaired, fallback, errors of the LLM layer.

    An answer without the mark isn't valid; repaired are valid answers after repairs; an
    empty error is none.
    """
    valid = F.coalesce(F.col("valid"), F.lit(False))
    return ledger.where("layer = 'llm'").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(valid).alias("valid"), F.count_if(valid & (F.coalesce(F.col("repairs"), F.lit(0)) > 0)).alias("repaired"),
        F.count_if(F.coalesce(F.col("fallback"), F.lit(False))).alias("fallback"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    )


def summed_totals(totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ledger_totals of several runs added up."""
    return totals.groupBy(*(keys or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("rule", "llm", "real", "fallback", "error", "invalid")])


def mock_history(ledger: DataFrame, window: int | None = None) -> DataFrame:
    """case_id, history: answered calls in order, as the next answer of a mock engine sees them; with ``window`` the last ones alone.

    With a window, a case's calls are cut before they meet in one array.
    """
    known = ledger.where("layer in ('rule', 'llm', 'real', 'fallback') and response is not null")
    if window is not None:
        last = Window.partitionBy("case_id").orderBy(F.desc("seq"))
        known = known.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= window)
    return known.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "tool", "args", "response"))), lambda x: F.struct(x["tool"].alias("tool"), x["args"].alias("args"), x["response"].alias("response"))).alias("history"))


def resolve_strategy(cases: DataFrame, strategies: DataFrame, flag: str | None = None, dataset_default: str | None = None) -> DataFrame:
    """``cases`` (case_id, tool, strategy) with behavior, examples and fallback_response of the chosen strategy's entry for the tool, else the default's, else generic.

    A case's own strategy goes before the run's flag, that before the dataset's. An entry
    is taken whole: its behavior may be generic and its fallback null. strategies:
    strategy, tool, behavior and, if known, examples and fallback_response.
    """
    chosen = F.coalesce(F.nullif(F.col("strategy"), F.lit("")), F.lit(flag), F.lit(dataset_default), F.lit("default"))
    part = lambda c, kind: F.col(c) if c in strategies.columns else F.lit(None).cast(kind)
    entry = F.struct(F.coalesce(F.nullif(F.col("behavior"), F.lit("")), F.lit("generic")).alias("behavior"), part("examples", "array<string>").alias("examples"), part("fallback_response", "string").alias("fallback_response"))
    s = strategies.select(F.col("strategy").alias("_s"), F.col("tool").alias("_t"), entry.alias("_entry"))
    d = strategies.where("strategy = 'default'").select(F.col("tool").alias("_dt"), entry.alias("_default"))
    c = cases.withColumn("chosen", chosen)
    out = c.join(s, (c["chosen"] == s["_s"]) & (c["tool"] == s["_t"]), "left").join(d, F.col("tool") == F.col("_dt"), "left")
    found = F.coalesce("_entry", "_default")
    out = out.withColumn("behavior", F.coalesce(found["behavior"], F.lit("generic"))).withColumn("examples", F.coalesce(found["examples"], F.array().cast("array<string>")))
    return out.withColumn("fallback_response", found["fallback_response"]).drop("_s", "_t", "_dt", "_entry", "_default")
