"""Small YAML and JSON specifications: scenarios, evaluators, thresholds; of one project on the driver, or of any number of projects as rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SCENARIO = "scenario_id string, ordinal int, intent string, persona string, goal string, opening string, followups array<string>, max_turns int, success_contains string, expect_contains string, expect_not_contains string"


def document(spark: SparkSession, path: str) -> object:
    """The one document of a file; a specification is a few kilobytes."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """A row a scenario. Each needs an id, an opening, turns, and a success text or an expectation."""
    doc = document(spark, path)
    rows = []
    for i, s in enumerate(doc.get("scenarios", []) if isinstance(doc, dict) else doc or []):
        expect = s.get("expect") or {}
        lacking = [k for k in ("id", "opening", "max_turns") if not s.get(k)]
        if lacking or not (s.get("success_contains") or expect):
            raise ValueError(f"scenario {s.get('id', i)}: {', '.join(lacking) or 'no success_contains or expect'} is missing")
        rows.append((s["id"], i, s.get("intent"), s.get("persona"), s.get("goal"), s["opening"], list(s.get("followups") or []), int(s["max_turns"]), s.get("success_contains"), expect.get("contains"), expect.get("not_contains")))
    return spark.createDataFrame(rows, SCENARIO)


def evaluators(spark: SparkSession, path: str) -> list[dict]:
    """The evaluator specs of a file; none is an error."""
    doc = document(spark, path)
    specs = doc.get("evaluators") if isinstance(doc, dict) else doc
    if not specs:
        raise ValueError("no evaluators are given")
    return [dict(s) for s in specs]


def is_judge(spec: dict) -> bool:
    from ..operators.evaluators import DETERMINISTIC, JUDGED

    return spec.get("type") in JUDGED or spec.get("type") not in (*DETERMINISTIC, "custom")


def judge_metrics(specs: list[dict]) -> list[str]:
    """The metric names of judges: the name, else the prompt's name in small letters without its ending, else the type."""
    prompt = lambda s: str(s.get("prompt") or "").lower().removesuffix("_prompt")
    return [s.get("name") or prompt(s) or s["type"] for s in specs if is_judge(s)]


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """YAML (or JSON) text as JSON text; null where it is neither or nothing."""
    import yaml

    # the same loader in C, where there is one
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(t: str | None) -> str | None:
        try:
            doc = yaml.load(t, loader) if t else None
        except yaml.YAMLError:
            return None
        return None if doc is None else json.dumps(doc, default=str, ensure_ascii=False)

    return text.map(one)


def _listed(doc: Column, name: str, kind: str) -> Column:
    """The list that a document is or has under ``name``."""
    wrapped = F.when(doc.startswith("["), F.concat(F.lit(f'{{"{name}":'), doc, F.lit("}"))).otherwise(doc)
    return F.from_json(wrapped, f"struct<{name}:array<{kind}>>")[name]


_SCENARIO = "struct<id:string,intent:string,persona:string,goal:string,opening:string,followups:array<string>,max_turns:int,success_contains:string,expect:struct<contains:string,not_contains:string>>"


def scenario_rows(files: DataFrame) -> DataFrame:
    """path, the columns of SCENARIO and problem, of scenario files (path, text) of any number of projects.

    A scenario needs an id, an opening, turns, and a success text or an expectation: what
    it lacks is its problem. A file that is neither YAML nor JSON is one row with a problem.
    """
    docs = files.select("path", yaml_json("text").alias("doc"))
    # a broken file has one row without a scenario: files are read once
    broken, none = F.col("doc").isNull(), F.array(F.lit(None).cast(_SCENARIO))
    s = docs.select("path", broken.alias("broken"), F.posexplode(F.when(broken, none).otherwise(_listed(F.col("doc"), "scenarios", _SCENARIO))).alias("ordinal", "s"))
    absent = lambda name, there: F.when(~F.coalesce(there, F.lit(False)), name)
    filled = lambda c: F.col(c) != ""
    expects = F.coalesce(filled("s.success_contains"), F.lit(False)) | F.col("s.expect").isNotNull()
    lacking = F.concat_ws(", ", absent("id", filled("s.id")), absent("opening", filled("s.opening")), absent("max_turns", F.col("s.max_turns") > 0), absent("success_contains or expect", expects))
    unbroken = lambda c: F.when(~F.col("broken"), c)
    return s.select(
        "path", F.col("s.id").alias("scenario_id"), unbroken(F.col("ordinal")).alias("ordinal"), "s.intent", "s.persona", "s.goal", "s.opening", unbroken(F.coalesce("s.followups", F.array().cast("array<string>"))).alias("followups"), "s.max_turns", "s.success_contains",
        F.col("s.expect.contains").alias("expect_contains"), F.col("s.expect.not_contains").alias("expect_not_contains"), F.when(F.col("broken"), "not YAML").when(lacking != "", F.concat(lacking, F.lit(" is missing"))).alias("problem"),
    )


def evaluator_rows(files: DataFrame) -> DataFrame:
    """path, ordinal, type, metric, judge and problem of evaluator files (path, text): what each spec makes and whether a model judges it."""
    from ..operators.evaluators import DETERMINISTIC, JUDGED

    docs = files.select("path", yaml_json("text").alias("doc")).withColumn("specs", _listed(F.col("doc"), "evaluators", "struct<type:string,name:string,prompt:string,ref:string>"))
    # a file without any has one row without an ordinal: files are read once
    s = docs.select("path", F.posexplode_outer(F.when(F.size("specs") > 0, F.col("specs"))).alias("ordinal", "s")).select("path", "ordinal", "s.*")
    none = F.col("ordinal").isNull()
    known, judged = F.col("type").isin(*DETERMINISTIC), F.col("type").isin(*JUDGED)
    judge = F.coalesce(judged | ~(known | (F.col("type") == "custom")), F.lit(True))
    prompt = F.nullif(F.regexp_replace(F.lower(F.coalesce("prompt", F.lit(""))), "_prompt$", ""), F.lit(""))
    metric = F.when(known, F.col("type")).otherwise(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.when(judge, prompt), F.col("type")))
    problem = F.when(none, "no evaluators are given").when(F.coalesce(F.col("type"), F.lit("")) == "", "no type").when((F.col("type") == "custom") & ~F.coalesce(F.col("ref").contains(":"), F.lit(False)), "no module:function")
    return s.select("path", "ordinal", "type", F.when(~none, metric).alias("metric"), F.when(~none, judge).alias("judge"), problem.alias("problem"))


@dataclass(frozen=True)
class Thresholds:
    """What metrics must reach: their own rates, a rate for the others, for slices and for all together."""

    metrics: dict[str, float] = field(default_factory=dict)
    default: float = 0.8
    slice_min: float = 0.5
    overall_pass: float = 0.8

    @classmethod
    def of(cls, doc: object) -> Thresholds:
        """From the thresholds of a configuration; what it doesn't say has its default, what is no rate is an error."""
        given = (doc.get("thresholds") or {}) if isinstance(doc, dict) else None
        if not isinstance(given, dict):
            raise ValueError("a configuration is a mapping, and so are its thresholds")
        strange = sorted(set(given) - set(cls.__dataclass_fields__))
        if strange:
            raise ValueError(f"unknown thresholds: {', '.join(strange)}")
        rates = {"metrics": {str(k): cls._rate(f"metrics.{k}", v) for k, v in (given.get("metrics") or {}).items()}}
        return cls(**rates, **{k: cls._rate(k, v) for k, v in given.items() if k != "metrics"})

    @staticmethod
    def _rate(name: str, value: object) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise ValueError(f"thresholds.{name}: not a number")
        try:
            return float(value)
        except ValueError:
            raise ValueError(f"thresholds.{name}: not a number") from None

    def for_metric(self, name: str) -> float:
        return self.metrics.get(name, self.default)


def thresholds(spark: SparkSession, path: str) -> Thresholds:
    return Thresholds.of(document(spark, path))


def discovered(spark: SparkSession, roots: list[str]) -> DataFrame:
    """folder, artifacts: the folders directly below any of the roots that hold a known artifact, with how many. A root that isn't there has none."""
    from .datasource import artifacts, opened

    found = None
    for root in roots:
        base = opened(root)[1]
        below = F.substring("path", len(base) + 2, 1 << 20)
        own = artifacts(spark, root).where("kind is not null").where(below.contains("/"))
        own = own.groupBy(F.concat(F.lit(f"{base}/"), F.substring_index(below, "/", 1)).alias("folder")).agg(F.count(F.lit(1)).alias("artifacts"))
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "folder string, artifacts long") if found is None else found


def projects(docs: DataFrame) -> DataFrame:
    """folder, artifacts: folders of a tree that hold a known artifact. A work or results folder counts as its parent."""
    folder = F.regexp_replace("path", r"/(?:(?:work|results)/)?[^/]+$", "")
    return docs.where("kind is not null").groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("artifacts"))
