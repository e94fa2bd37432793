"""The views of a report over an artifact folder, computed from its tables, not from stored summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import jsontext
from ..operators import agentmap as am, cases as cs, coverage as cov, mocks, scores as sc, simulation as sim, stability as st
from ..schemas import SLICE_DIMS
from ..sources import artifacts as art


class Report:
    """The tables of one folder and the views over them; nothing is read before a view is used."""

    def __init__(self, spark: SparkSession, folder: str, thresholds: dict[str, float] | None = None, default: float = 0.8, slice_min: float = 0.5, overall_pass: float = 0.8, judges: tuple[str, ...] = ()) -> None:
        self.spark, self.thresholds, self.default, self.slice_min, self.overall_pass, self.judges = spark, thresholds, default, slice_min, overall_pass, list(judges)
        self.docs = art.documents(spark, folder)
        self.cases, self.runs = art.cases(self.docs), art.runs(self.docs)
        self.scores = art.scores(self.docs, self.runs.select("run_id", "run_ordinal").distinct())
        self.ledger, self.stages, self.simulations = art.ledger(self.runs), art.stages(self.docs), art.simulations(self.docs)

    def metrics(self) -> DataFrame:
        return sc.metric_rates(self.scores, self.thresholds, self.default)

    def run_metrics(self) -> DataFrame:
        return sc.run_stats(self.scores)

    def slices(self) -> DataFrame:
        return sc.slice_rates(self.scores, self.cases.select("case_id", *SLICE_DIMS), self.slice_min)

    def verdict(self) -> DataFrame:
        return sc.verdict_of(self.scores, self.cases.select("case_id", *SLICE_DIMS), self.thresholds, self.default, self.slice_min, self.overall_pass)

    def summary(self) -> DataFrame:
        """One row: the verdict, metrics that pass, approved cases and the share of stable cases."""
        passing = self.metrics().agg(F.count_if("passed").alias("metrics_passing"))
        approved = self.cases.agg(F.count_if(F.col("review_status") == "approved").alias("approved"), F.count(F.lit(1)).alias("n_cases"))
        return self.verdict().join(passing).join(approved).join(st.summary(self.behaviour()).select("stable_fraction", "text_varies"))

    def behaviour(self) -> DataFrame:
        calls = self.ledger.where("layer = 'llm'").groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("llm_mock_calls"))
        return st.behaviour(self.runs.select("run_id", "case_id", "trajectory_hash", "output_hash").join(calls, ["run_id", "case_id"], "left"))

    def unstable(self) -> DataFrame:
        return st.unstable_cases(self.behaviour(), self.scores)

    def flips(self) -> DataFrame:
        return st.score_flips(self.behaviour(), self.scores, self.judges)

    def case_matrix(self, metrics: list[str]) -> DataFrame:
        return sc.score_matrix(self.scores, metrics)

    def failing(self) -> DataFrame:
        errors = self.runs.where("error is not null").select("case_id", "run_ordinal", F.concat_ws(": ", "error_class", "error").alias("error"))
        return sc.failing_cases(self.scores, errors)

    def case_table(self) -> DataFrame:
        return cs.case_rows(self.cases)

    def mock_rules(self) -> DataFrame:
        return art.mock_rules(self.docs).withColumn("wildcard", F.col("match_args") == "{}")

    def ledger_totals(self) -> DataFrame:
        return mocks.ledger_totals(self.ledger, ["run_id"])

    def plan(self) -> DataFrame:
        """The stored plan's cells."""
        cells = art.items(art.folded(self.docs, "coverage_plan"), "$.cells", ["path"])
        text = [art.text("item", f"$.{c}").alias(c) for c in (*cov.CELL, "kind")]
        return cells.select("ordinal", *text, art.text("item", "$.count", "int").alias("count"), art.text("item", "$.multi_turn", "int").alias("multi_turn"))

    def coverage(self) -> DataFrame:
        return cov.achieved(self.plan(), self.cases.where("review_status = 'approved'").select(*cov.CELL))

    def coverage_by_kind(self) -> DataFrame:
        return cov.by_kind(self.coverage())

    def simulation_totals(self) -> DataFrame:
        return sim.totals(self.simulations)

    def stage_totals(self) -> DataFrame:
        return self.stages.groupBy("status").agg(F.count(F.lit(1)).alias("stages"), F.sum("seconds").alias("seconds"))

    def tools(self) -> DataFrame:
        t = art.items(art.one(self.docs, "agent_map"), "$.tools", ["path"])
        flag = lambda k, default: F.coalesce(art.text("item", f"$.{k}", "boolean"), F.lit(default)).alias(k)
        return t.select("ordinal", art.text("item", "$.name").alias("tool"), art.text("item", "$.kind").alias("kind"), art.text("item", "$.description").alias("description"), flag("mockable", True), flag("side_effecting", False), art.json_text("item", "$.args_schema").alias("args_schema"), art.json_text("item", "$.output_schema").alias("output_schema"))

    def intents(self) -> DataFrame:
        """intent, scenarios, cases: the map's intents with what the dataset holds of each."""
        own = art.one(self.docs, "agent_map")
        i = art.items(own, "$.intents", []).select("ordinal", art.text("item", "$.id").alias("intent"))
        s = art.items(own, "$.scenarios", []).select(art.text("item", "$.intent").alias("intent"))
        return cs.intent_counts(i, s, self.cases)

    def nodes(self) -> DataFrame:
        """A row a node of the agent's graph: a kind other than graph-node wins, the last of other fields, evidence together."""
        n = art.items(art.one(self.docs, "agent_map"), "$.graph.nodes", [])
        n = n.select("ordinal", art.text("item", "$.id").alias("id"), art.text("item", "$.kind").alias("kind"), art.text("item", "$.prompt").alias("prompt"), art.text("item", "$.evidence", "array<string>").alias("evidence"))
        return am.merged_nodes(n)

    def problems(self) -> DataFrame:
        return art.problems(self.docs)

    def bundle(self) -> DataFrame:
        """One row: how many cases, intents, scenarios, tools, skills and runs the folder holds."""
        counted = [self.cases.agg(F.count(F.lit(1)).alias("cases"))]
        counted += [art.items(art.one(self.docs, "agent_map"), f"$.{part}", []).agg(F.count(F.lit(1)).alias(part)) for part in ("intents", "scenarios", "tools", "skills")]
        counted.append(self.runs.agg(F.countDistinct("run_id").alias("runs")))
        out = counted[0]
        for one in counted[1:]:
            out = out.join(one)  # one row each
        return out

    def running_stage(self, order: list[str]) -> DataFrame:
        """path, stage: the first stage, in the order given, that is running in each state."""
        place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
        return self.stages.where("status = 'running'").groupBy("path").agg(F.min_by("stage", F.when(place > 0, place).otherwise(len(order) + 1)).alias("stage"))

    def text(self, name: str, problems: int = 15) -> DataFrame:
        """section, place, line: the report as lines of text (their wording and widths are fixed); sections and places give their order."""
        number = lambda c: F.coalesce(jsontext.python_number(F.col(c).cast("string")), F.lit("None"))
        real = lambda c: F.coalesce(jsontext.python_float(F.col(c).cast("string")), F.lit("None"))
        line = lambda rows, section, place, *parts: rows.select(F.lit(section).alias("section"), place.cast("long").alias("place"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))
        zero = F.lit(0)
        verdict = self.verdict()
        out = [line(verdict, 0, zero, f"{name}: verdict=", F.col("verdict"), " overall=", real("overall_score"))]
        out.append(line(verdict.select(F.posexplode("reasons").alias("i", "r")), 1, F.col("i"), "  - ", F.col("r")))
        stage = F.format_string("  %-10s %-16s %7.1fs  %s", "stage", "status", F.coalesce("seconds", F.lit(0.0)), F.substring(F.coalesce("reason", "error", F.lit("")), 1, 90))
        out.append(line(self.stages, 2, zero, stage))
        rates = self.metrics().withColumn("pass_rate", F.bround("pass_rate", 4))
        mark = F.when(F.col("passed"), "ok").otherwise("FAIL")
        out.append(line(rates, 3, zero, F.format_string("  %-18s pass_rate=", "metric"), real("pass_rate"), " threshold=", real("threshold"), " errors=", number("errors"), " [", mark, "]"))
        out.append(line(cov.coverage_percent(self.coverage()), 4, zero, "coverage: ", number("covered"), "/", number("planned"), " (", real("pct"), "%)"))
        steady = st.summary(self.behaviour())
        repeats = self.runs.agg(F.countDistinct("run_id").alias("repeats"))
        out.append(line(steady.join(repeats), 5, zero, "stability: repeats=", number("repeats"), " unstable_cases=", number("unstable"), " text_varies=", number("text_varies")))
        wrong = self.problems().orderBy("path").limit(problems)
        out.append(line(wrong, 6, zero, "  [warning] ", F.regexp_extract("path", "([^/]+)$", 1), ": ", F.substring("problem", 1, 120)))
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return rows

    def analysis(self, gaps: int = 20, failing: int = 40) -> DataFrame:
        """One row for whoever analyses the report: the verdict with its reasons, weak slices, and the first gaps, failing cases and evaluator errors.

        Lists are cut before they are gathered.
        """
        listed = lambda rows, order, item, name: rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))), lambda x: x["item"]).alias(name))
        missing = self.coverage().where("covered < count").orderBy("ordinal").limit(gaps)
        cell = F.concat_ws("/", *cov.CELL)
        bad = self.failing().orderBy("case_id").limit(failing)
        errors = sc.evaluator_errors(self.scores)
        weak = sc.weak_slices(self.slices())
        return (
            self.verdict().select("verdict", "overall_score", "reasons").join(listed(weak, ["dim", "value"], F.col("weak"), "weak_slices")).join(listed(missing, ["ordinal"], cell, "coverage_gaps"))
            .join(listed(bad, ["case_id"], F.col("case_id"), "failing_cases")).join(listed(errors, ["metric"], F.concat(F.col("metric"), F.lit(": "), F.col("errors").cast("string"), F.lit(" error(s)")), "evaluator_errors"))
        )

    def tool_briefs(self, width: int = 3000) -> DataFrame:
        """tool, brief: a tool as JSON text for a prompt; what is empty or usual is left out, the text is cut."""
        t = self.tools()
        parts = F.struct("tool", "description", F.when(F.col("kind") != "tool", F.col("kind")).alias("kind"), F.when(F.col("side_effecting"), True).alias("side_effecting"), "args_schema", "output_schema")
        return t.select("ordinal", "tool", F.substring(F.to_json(parts), 1, width).alias("brief"))

    def review_progress(self) -> DataFrame:
        """One row: cases by what became of their review, and finished runs."""
        n = lambda status: F.count_if(F.col("review_status") == status).alias(status)
        return self.cases.agg(n("approved"), n("pending"), n("rejected")).join(self.runs.agg(F.countDistinct("run_id").alias("runs"), F.count("error").alias("failed_runs")))

    def register(self, prefix: str = "v_") -> list[str]:
        """Every view that needs no argument as a temporary view."""
        names = ("metrics", "run_metrics", "slices", "verdict", "summary", "unstable", "flips", "failing", "case_table", "mock_rules", "ledger_totals", "coverage", "coverage_by_kind", "simulation_totals", "stage_totals", "tools", "intents", "nodes", "problems")
        for name in names:
            getattr(self, name)().createOrReplaceTempView(prefix + name)
        return [prefix + n for n in names]
