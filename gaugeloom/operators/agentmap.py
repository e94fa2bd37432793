"""The map of an agent: which failures can apply, whether the map is consistent, what its parts cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_slug


#: Tools that retrieve, and what agent sources show (fixed patterns).
RETRIEVAL = r"(?i)search|retriev|kb|lookup|find|fetch"
SOURCE_MARKS = {"retriever": "retriever|vectorstore|VectorStore", "memory": "checkpointer|MemorySaver", "structured-output": "with_structured_output|response_format|json_schema"}
#: Failure types and the facts, by name, that make each possible (fixed values); ``app:always`` holds for any agent.
GATES = {
    "input_validation": ("always",), "provider_error": ("always",), "out_of_scope": ("always",), "branch_misrouting": ("edge",), "tool_misuse": ("tool",),
    "tool_error_handling": ("tool",), "prompt_injection": ("tool",), "retrieval_grounding": ("retrieval",), "state_loss": ("multi-turn",),
    "output_contract_violation": ("structured-output",), "constraint_violation": ("constraint",), "skill_misuse": ("skill",),
}


def agent_facts(tools: DataFrame, edges: DataFrame, constraints: DataFrame, skills: DataFrame, sources: DataFrame, multi_turn: bool) -> DataFrame:
    """name, value, ordinal, fact: what is known of an agent, each fact with the text it is cited by.

    tools: tool, ordinal. edges: source, targets (array), ordinal, conditional ones.
    constraints: text, ordinal. skills: skill, ordinal. sources: text of the agent's code.
    """
    row = lambda name, value, ordinal, fact: [F.lit(name).alias("name"), value.cast("string").alias("value"), ordinal.cast("int").alias("ordinal"), fact.alias("fact")]
    cited = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), c)
    tool, n, none = F.col("tool"), F.col("ordinal"), F.lit(None)
    marks = sources.agg(*[F.coalesce(F.bool_or(F.col("text").rlike(p)), F.lit(False)).alias(k) for k, p in SOURCE_MARKS.items()])  # one row
    finds = tools.where(tool.rlike(RETRIEVAL))
    seen = marks.join(finds.agg(F.count(F.lit(1)).alias("finds")))  # one row each
    when = lambda condition, name, fact: seen.where(condition).select(*row(name, none, F.lit(0), F.lit(fact)))
    parts = [
        when(F.lit(True), "always", "app:always"), tools.select(*row("tool", tool, n, cited("tool", tool))), finds.select(*row("retrieval", tool, n, cited("tool", tool))),
        edges.select(*row("edge", F.col("source"), n, F.concat(F.lit("edge:"), "source", F.lit("->"), F.array_join("targets", "|")))),
        constraints.select(*row("constraint", F.col("text"), n, cited("constraint", F.substring("text", 1, 60)))), skills.select(*row("skill", F.col("skill"), n, cited("skill", F.col("skill")))),
        when((F.col("finds") == 0) & F.col("retriever"), "retrieval", "source:retriever"), when(F.col("memory") | F.lit(multi_turn), "multi-turn", "app:multi-turn"),
        when(F.col("structured-output"), "structured-output", "source:structured-output"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failure_gates(facts: DataFrame, gates: dict[str, Column] | None = None) -> DataFrame:
    """failure_type, evidence: each type with the facts that make it possible, in order; types without any are left out.

    facts: name, value and, if known, ordinal and fact, the text cited (else name:value).
    gates: a predicate on a fact for each type; by default GATES.
    """
    gates = gates or {t: F.col("name").isin(*names) for t, names in GATES.items()}
    fact = F.col("fact") if "fact" in facts.columns else F.concat_ws(":", "name", "value")
    order = F.col("ordinal") if "ordinal" in facts.columns else F.lit(0)
    tried = F.array(*[F.when(g, F.lit(t)) for t, g in gates.items()])
    hits = facts.select(F.struct(order.alias("n"), fact.alias("fact")).alias("one"), F.explode(F.filter(tried, lambda t: t.isNotNull())).alias("failure_type"))
    return hits.groupBy("failure_type").agg(F.array_distinct(F.transform(F.sort_array(F.collect_set("one")), lambda x: x["fact"])).alias("evidence"))


def map_problems(intents: DataFrame, scenarios: DataFrame, applicable: DataFrame, tools: DataFrame, skills: DataFrame) -> DataFrame:
    """kind, id, problem of a map.

    intents: intent, evidence. scenarios: scenario, intent, kind, failure_mode, skills,
    evidence. applicable: failure_type. tools: tool. skills: skill. Ids are slugs, items
    have evidence, references lead somewhere, failures apply, and each intent has a happy
    and a failure scenario.
    """
    def flagged(rows: DataFrame, kind: str, ident: str, **checks: Column) -> DataFrame:
        bad = F.array(*[F.when(c, F.lit(k.replace("_", " "))) for k, c in checks.items()])
        return rows.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), F.explode(F.filter(bad, lambda b: b.isNotNull())).alias("problem"))

    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    odd = lambda c: ~F.coalesce(is_slug(F.col(c)), F.lit(False))
    own = flagged(intents, "intent", "intent", id_is_no_slug=odd("intent"), no_evidence=none("evidence"))
    linked = scenarios.join(intents.select(F.col("intent").alias("_i")), F.col("intent") == F.col("_i"), "left").join(applicable.select(F.col("failure_type").alias("_f")), F.col("failure_mode") == F.col("_f"), "left")
    failing = F.col("kind") == "failure"
    more = flagged(linked, "scenario", "scenario", id_is_no_slug=odd("scenario"), no_evidence=none("evidence"), unknown_intent=F.col("_i").isNull(), failure_mode_does_not_apply=failing & F.col("_f").isNull())
    cited = scenarios.select("scenario", F.explode("evidence").alias("token"))
    for prefix, known, column in (("tool", tools, "tool"), ("skill", skills, "skill")):
        named = cited.where(F.col("token").startswith(f"{prefix}:")).select("scenario", F.expr(f"substring(token, {len(prefix) + 2})").alias(column))
        if prefix == "skill":
            named = named.unionByName(scenarios.select("scenario", F.explode("skills").alias("skill")))
        lost = named.join(known.select(column), column, "left_anti").distinct()
        more = more.unionByName(lost.select(F.lit("scenario").alias("kind"), F.col("scenario").alias("id"), F.concat(F.lit(f"unknown {prefix} "), column).alias("problem")))
    have = scenarios.groupBy("intent").agg(F.count_if(F.col("kind") == "happy").alias("happy"), F.count_if(failing).alias("failure"))
    lacking = intents.select("intent").join(have, "intent", "left")
    thin = flagged(lacking, "intent", "intent", no_happy_scenario=F.coalesce("happy", F.lit(0)) == 0, no_failure_scenario=F.coalesce("failure", F.lit(0)) == 0)
    return own.unionByName(more).unionByName(thin)


def node_tools(nodes: DataFrame, tools: DataFrame) -> DataFrame:
    """node, tool: tools that a node's prompt mentions, for nodes with a prompt but no tools of their own.

    A prompt's words meet tool names by equality, so no prompt is held against every tool.
    """
    bare = nodes.where("prompt is not null and coalesce(size(tools), 0) = 0")
    words = bare.select(F.col("id").alias("node"), F.explode(F.array_distinct(F.regexp_extract_all("prompt", F.lit(r"[\w-]+"), F.lit(0)))).alias("tool"))
    return words.join(tools.select("tool").distinct(), "tool", "left_semi").select("node", "tool")


def merged_tools(source: DataFrame, live: DataFrame) -> DataFrame:
    """Tools found in source text and in a running agent: a live field holds if it is there, live-only tools follow."""
    s = source.select("tool", F.col("ordinal").alias("_so"), F.col("description").alias("_sd"), F.col("args_schema").alias("_sa"))
    v = live.select("tool", F.col("ordinal").alias("_lo"), F.col("description").alias("_ld"), F.col("args_schema").alias("_la"))
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), b)
    both = s.join(v, "tool", "full")
    return both.select("tool", pick("_ld", "_sd").alias("description"), pick("_la", "_sa").alias("args_schema"), F.col("_lo").isNotNull().alias("live"), F.struct(F.col("_so").isNull().alias("last"), F.coalesce("_so", "_lo").alias("n")).alias("place"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """id, kind, prompt, evidence: a row a node of (ordinal, id, kind, prompt, evidence), as a graph may name one several times.

    A kind other than graph-node wins, of several the last; the last prompt that isn't
    empty holds; evidence is put together.
    """
    own = F.when(F.col("kind") != "graph-node", F.col("ordinal"))
    said = F.when(F.coalesce(F.col("prompt"), F.lit("")) != "", F.col("ordinal"))
    return nodes.groupBy("id").agg(
        F.coalesce(F.max_by("kind", own), F.max("kind")).alias("kind"), F.max_by("prompt", said).alias("prompt"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )


#: Tools that hand out skills (fixed names).
LOADERS = ("load_skill", "read_skill", "get_skill", "use_skill")


def node_skills(nodes: DataFrame, skills: DataFrame) -> DataFrame:
    """node, skill, how: the skills an LLM node can use.

    nodes: id, kind, prompt, tools, skills and source (skills the code shows for the node,
    and how). skills: skill. A skill the prompt names is used whatever the code shows
    (prompt); a node without any that holds a loader may use all (loader). An agent has
    some dozens of skills: their names are one small array.
    """
    names = skills.agg(F.sort_array(F.collect_set("skill")).alias("_all"))  # one row
    n = nodes.where("kind = 'llm'").join(names)
    shown = F.coalesce("skills", F.array().cast("array<string>"))
    told = F.filter("_all", lambda s: F.contains(F.coalesce("prompt", F.lit("")), s))
    n = n.withColumn("_own", F.array_union(shown, told)).withColumn("_how", F.coalesce(F.col("source"), F.when(F.size(F.array_except(told, shown)) > 0, "prompt")))
    loads = F.arrays_overlap(F.coalesce("tools", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in LOADERS]))
    any_own = F.size("_own") > 0
    linked = F.when(any_own, F.col("_own")).when(loads, F.col("_all"))
    how = F.when(any_own, F.coalesce("_how", F.lit("prompt"))).otherwise("loader")
    return n.select(F.col("id").alias("node"), F.explode(linked).alias("skill"), how.alias("how"))


def uncovered_skills(skills: DataFrame, used: DataFrame) -> DataFrame:
    """Skills that no case exercises. used: case_id, skill."""
    return skills.select("skill").distinct().join(used.select("skill"), "skill", "left_anti")


def merged_constraints(own: Column, derived: Column) -> Column:
    """The configured constraints, then those found that aren't among them, each once and in order."""
    return F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(derived, F.array().cast("array<string>")))
