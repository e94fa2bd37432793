"""Coverage: what a plan asks for, what a dataset holds, and what is missing.

A cell is (intent, topic, scenario, failure_mode). Plans are small; datasets needn't be:
every count of cases is a groupBy on the cell before it meets the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.positions import numbered, numbered_within
from ..schemas import EMPTY

CELL = ("intent", "topic", "scenario", "failure_mode")


def spread(total: Column, buckets: Column, place: Column) -> Column:
    """The share of the bucket at ``place`` (from 0): at least one each, the first ones one more."""
    whole = F.greatest(total, buckets)
    return (F.floor(whole / buckets) + F.when(place < whole % buckets, 1).otherwise(0)).cast("int")


def required_cells(scenarios: DataFrame, topics: DataFrame, failures: DataFrame) -> DataFrame:
    """A cell a scenario and topic (``unspecified`` without topics), and one a failure type."""
    some = topics.select("topic").distinct()
    crossed = scenarios.select("intent", "scenario", F.coalesce("failure_mode", F.lit("none")).alias("failure_mode")).join(some, how="left") if topics.columns else scenarios
    first = crossed.select("intent", F.coalesce("topic", F.lit(EMPTY)).alias("topic"), "scenario", "failure_mode")
    more = failures.select(F.lit("cross-cutting").alias("intent"), F.lit(EMPTY).alias("topic"), F.lit("failure").alias("scenario"), F.col("failure_type").alias("failure_mode"))
    return first.unionAll(more)


def counted_cells(cases: DataFrame, failure_default: str = EMPTY) -> DataFrame:
    """have a cell. Gap reports take an absent failure mode for ``unspecified``, achieved plans for ``none``."""
    parts = [F.coalesce(F.col(c), F.lit(failure_default if c == "failure_mode" else EMPTY)).alias(c) for c in CELL]
    return cases.groupBy(*parts).agg(F.count(F.lit(1)).alias("have"))


def gaps(required: DataFrame, cases: DataFrame, target: int = 1) -> DataFrame:
    """Required cells with fewer than ``target`` cases, and how many are missing."""
    have = required.join(counted_cells(cases), list(CELL), "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return have.where(F.col("have") < target).withColumn("missing", F.lit(target) - F.col("have"))


def achieved(plan: DataFrame, cases: DataFrame) -> DataFrame:
    """``plan`` (cells with kind and count) with have and covered; cells of one key are each credited."""
    have = plan.join(counted_cells(cases, "none"), list(CELL), "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return have.withColumn("covered", F.least("have", "count"))


def by_kind(done: DataFrame) -> DataFrame:
    return done.groupBy("kind").agg(F.sum("count").alias("planned"), F.sum("covered").alias("covered"))


def coverage_percent(done: DataFrame) -> DataFrame:
    """One row: planned, covered, pct; an empty plan is covered."""
    s = done.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("planned"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return s.withColumn("pct", F.when(F.col("planned") > 0, F.bround(F.col("covered") * 100.0 / F.col("planned"), 1)).otherwise(F.lit(100.0)))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"), F.sum("count").alias("cases"), F.sum("multi_turn").alias("multi_turn"))


def intent_cells(scenarios: DataFrame, topics: list[str], happy: int, failure: int) -> DataFrame:
    """Cells of intents: each kind's number of cases spread over an intent's scenarios, topics in rotation.

    scenarios: intent_ord, scenario_ord, intent, scenario, kind, failure_mode. The
    rotation follows the positions of all cells, however many.
    """
    kind_ord = F.when(F.col("kind") == "happy", 0).otherwise(1)
    own = Window.partitionBy("intent", "kind")
    s = scenarios.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("scenario_ord")) - 1)
    s = s.withColumn("count", spread(F.when(F.col("kind") == "happy", happy).otherwise(failure), F.col("n"), F.col("i")))
    names = F.array(*[F.lit(t) for t in topics or [EMPTY]])
    s = numbered(s.withColumn("_kind", kind_ord), ["intent_ord", "_kind", "scenario_ord"], "_place").withColumn("ordinal", F.col("_place").cast("int"))
    s = s.withColumn("topic", F.get(names, F.pmod(F.col("ordinal"), F.size(names))))
    mode = F.when(F.col("kind") == "happy", "none").otherwise(F.coalesce("failure_mode", F.lit("none")))
    variants = F.when(F.col("kind") == "happy", F.array(F.lit("happy"))).otherwise(F.array(F.lit("boundary"), F.lit("adversarial")))
    return s.select("ordinal", "intent", "topic", "scenario", mode.alias("failure_mode"), "kind", "count", variants.alias("variants"))


def topped_up(plan: DataFrame, total: int) -> DataFrame:
    """If the plan asks for fewer than ``total`` cases, happy cells share the rest, each getting one at least."""
    happy = F.col("kind") == "happy"
    sums = plan.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_sum"), F.count_if(happy).alias("_n"))  # one row
    p = numbered_within(plan, ["kind"], ["ordinal"], "_i").join(sums)
    more = happy & (F.col("_sum") < total)
    extra = F.when(more, spread(F.lit(total) - F.col("_sum"), F.greatest("_n", F.lit(1)), F.col("_i"))).otherwise(0)
    variants = F.when(more, F.array(*[F.lit(x) for x in ("happy", "linguistic", "boundary")])).otherwise(F.col("variants"))
    return p.withColumn("count", F.col("count") + extra).withColumn("variants", variants).drop("_sum", "_n", "_i")


def halving_takes(sizes: list[tuple[int, int]], wanted: int) -> tuple[dict[int, int], int]:
    """Greedy takes from cells by size, each at most half of what is still wanted, but one at least.

    sizes: (cases of a cell, number of such cells), the largest first. Returns the takes of
    the cells that are not taken whole, by position, and the position where all stops:
    cells before it without a take of their own are taken whole. A cell that isn't taken
    whole halves what is wanted, so there are few; runs of whole cells are arithmetic.
    """
    parts: dict[int, int] = {}
    place, left = 0, wanted
    for size, cells in sizes:
        if size <= 0:
            break
        end = place + cells
        while place < end and left > 0:
            most = max(1, left // 2)
            if size <= most:
                # whole as long as left // 2 >= size, or one when only ones are taken
                run = max(1, (left - 2 * size) // size + 1) if left >= 2 * size else 1
                run = min(run, end - place)
                left, place = left - run * size, place + run
            else:
                parts[place] = most
                left, place = left - most, place + 1
        if left <= 0:
            break
    return parts, place


def multi_turn(plan: DataFrame, share: float) -> DataFrame:
    """multi_turn a cell: a share of all cases, taken greedily from the largest cells of intents.

    Cells of one size are one entry, and a plan of n cases has at most the root of 2 n
    sizes: these are folded on the driver (halving_takes); cells then find their takes by
    their positions.
    """
    own = F.col("kind").isin("happy", "failure")
    total = plan.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    wanted = int(total.select(F.bround(F.col("n") * F.lit(share)).cast("long")).first()[0])
    sizes = plan.where(own).groupBy("count").agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("count")).collect()
    parts, end = halving_takes([(r["count"], r["cells"]) for r in sizes], wanted)
    cells = numbered(plan.where(own).withColumn("_less", -F.col("count")), ["_less", "ordinal"], "_at").drop("_less")
    take = F.when(F.col("_at") < end, F.col("count")).otherwise(0)
    for place, part in parts.items():
        take = F.when(F.col("_at") == place, part).otherwise(take)
    rest = plan.where(~own | F.col("kind").isNull()).withColumn("multi_turn", F.lit(0))
    return cells.withColumn("multi_turn", take.cast("int")).drop("_at").unionByName(rest)


def round_robin(edges: DataFrame, per_tool: int | None = None) -> DataFrame:
    """Edge cases of a tool, one of each kind in turn; ``per_tool`` keeps the first of each tool.

    edges: tool, kind_ord, ordinal, ...
    """
    turn = F.row_number().over(Window.partitionBy("tool", "kind_ord").orderBy("ordinal"))
    e = edges.withColumn("turn", turn)
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("tool").orderBy("turn", "kind_ord")))
    return e if per_tool is None else e.where(F.col("place") <= per_tool)


def overflow_trimmed(cases: DataFrame, plan: DataFrame) -> DataFrame:
    """The first ``count`` cases of each planned cell, in order; the rest are dropped. A full cell is a window; Spark limits it before the shuffle."""
    limit = plan.groupBy(*CELL).agg(F.sum("count").alias("_limit"))
    ranked = cases.join(limit, list(CELL)).withColumn("_n", F.row_number().over(Window.partitionBy(*CELL).orderBy("ordinal")))
    return ranked.where("_n <= _limit").drop("_n", "_limit")


def missing_in(plan: DataFrame, cases: DataFrame) -> DataFrame:
    """Planned cells with what they still lack; multi-turn wishes shrink with what is there, not below 0."""
    have = counted_cells(cases, "none")
    p = plan.join(have, list(CELL), "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return p.withColumn("multi_turn", F.greatest(F.col("multi_turn") - F.col("have"), F.lit(0))).withColumn("count", F.col("count") - F.col("have")).where("count > 0").drop("have")


def skills_of_cases(cases: DataFrame, scenario_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """case_id, skill, place: by the scenario's list, by evidence skill:<name>, by an expected call of a *skill tool; each once, first place counts.

    cases: case_id, scenario, evidence (array), calls (array of tool and the skill named).
    """
    listed = cases.join(scenario_skills, "scenario").select("case_id", "skill", F.lit(0).alias("rule"), F.col("skill_ord").alias("i"))
    cited = cases.select("case_id", F.posexplode("evidence").alias("i", "token")).where("token like 'skill:%'").select("case_id", F.expr("substring(token, 7)").alias("skill"), F.lit(1).alias("rule"), "i")
    called = cases.select("case_id", F.posexplode("calls").alias("i", "c")).where("c.tool like '%skill' and c.skill is not null").select("case_id", F.col("c.skill").alias("skill"), F.lit(2).alias("rule"), "i")
    known = cited.unionByName(called).join(skills.select("skill"), "skill", "left_semi").select("case_id", "skill", "rule", "i")
    return listed.unionByName(known).groupBy("case_id", "skill").agg(F.min(F.struct("rule", "i")).alias("place"))


def tool_intents(tools: DataFrame, scenarios: DataFrame, intents: DataFrame) -> DataFrame:
    """tool, intent: the first scenario that cites tool:<name>, else the first intent that does, else intents in rotation.

    tools: tool, ordinal; scenarios: scenario_ord, intent, evidence; intents: intent, ordinal, evidence.
    """
    def cited(rows: DataFrame, order: str, rule: int) -> DataFrame:
        tokens = rows.select("intent", F.col(order).alias("o"), F.explode("evidence").alias("token")).where("token like 'tool:%'")
        return tokens.groupBy(F.expr("substring(token, 6)").alias("tool")).agg(F.min(F.struct(F.lit(rule).alias("rule"), "o", "intent")).alias("hit"))

    hits = cited(scenarios.join(intents.select("intent"), "intent", "left_semi"), "scenario_ord", 0).unionByName(cited(intents, "ordinal", 1)).groupBy("tool").agg(F.min("hit").alias("hit"))
    n = intents.agg(F.count(F.lit(1)).alias("n"))  # one row
    turn = tools.join(n).withColumn("_turn", F.col("ordinal") % F.col("n"))
    rotated = turn.join(intents.select(F.col("intent").alias("_r"), F.col("ordinal").alias("_ro")), F.col("_turn") == F.col("_ro"), "left")
    return rotated.join(hits, "tool", "left").select("tool", F.coalesce("hit.intent", "_r").alias("intent"))
