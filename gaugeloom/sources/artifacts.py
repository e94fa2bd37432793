"""Reading artifact folders: JSON documents become VARIANT rows, then the silver tables.

Documents are read by Spark from any file system it knows. Each row keeps its path; what
can't be parsed or recognised becomes a row of problems, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.jsontext import json_string
from ..functions.jsonvalues import output_hash, trajectory_hash
from .datasource import artifacts, opened, register
from .kinds import KINDS


def registry(spark: SparkSession) -> DataFrame:
    """kind, file, legacy (array), tier, folded_into, wrap_key: one row a kind."""
    return spark.createDataFrame([(k, f, list(o), t, p, w) for k, f, o, t, p, w in KINDS], "kind string, file string, legacy array<string>, tier string, folded_into string, wrap_key string")


def name_patterns(spark: SparkSession) -> DataFrame:
    """kind, pattern, rank: a regular expression a file name, current names before older ones."""
    r = registry(spark).select("kind", F.posexplode(F.concat(F.array("file"), "legacy")).alias("rank", "name")).where("name is not null")
    return r.select("kind", F.concat(F.lit(r"(?:^|/)"), F.replace(F.replace("name", F.lit("."), F.lit(r"\.")), F.lit("{run_id}"), F.lit("([^/]+)")), F.lit("$")).alias("pattern"), "rank")


def kind_of_files(files: DataFrame, spark: SparkSession) -> DataFrame:
    """``files`` (path) with kind, run_id and rank by their names; of a kind's names the current one wins.

    The registry is some thirty names, tried one after the other in each row.
    """
    hits = []
    for rank, kind, name in sorted((rank, kind, name) for kind, file, legacy, *_ in KINDS for rank, name in enumerate((file, *legacy)) if name):
        pattern = r"(?:^|/)" + name.replace(".", r"\.").replace("{run_id}", "([^/]+)") + "$"
        run = F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")) if "{run_id}" in name else F.lit(None).cast("string")
        hits.append(F.when(F.col("path").rlike(pattern), F.struct(F.lit(kind).alias("kind"), run.alias("run_id"), F.lit(rank).alias("rank"))))
    return files.select(*files.columns, F.coalesce(*hits).alias("_named")).select(*files.columns, "_named.kind", "_named.run_id", "_named.rank")


def kind_of_schema(schema_id: Column) -> Column:
    """``<namespace>/<kind>/v1`` → kind; ``report`` is an older name."""
    kind = F.replace(F.nullif(F.regexp_extract(schema_id, r"^[^/]+/([^/]+)/v\d+$", 1), F.lit("")), F.lit("-"), F.lit("_"))
    return F.when(kind == "report", "score_report").otherwise(kind)


#: So many of Spark's own partitions, of some thirty small files each, become one task.
PARTS_A_TASK = 128


def small_files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """path, text of the files below a folder whose names match.

    Tasks list the folders and read the files (``datasource``). A file system that only
    Spark can open is listed by Spark, which counts a file as 4 MB at least, so that small
    files would be a task every thirty, each with a report to the driver.
    """
    try:
        opened(folder)
    except ValueError:  # a scheme that pyarrow doesn't know
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder).select("path", F.decode("content", "UTF-8").alias("text"))
        parts = raw.rdd.getNumPartitions()
        return raw.coalesce(max(PARTS_A_TASK, parts // PARTS_A_TASK)) if parts > PARTS_A_TASK else raw
    return artifacts(spark, folder, names).select("path", "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, run_id, rank, doc (VARIANT, null if not JSON), text of every JSON file under a folder.

    A document says what it is by its schema; its name decides only if it has none.
    """
    return identified(small_files(spark, folder, "*.json"))


def identified(files: DataFrame) -> DataFrame:
    """The same of any files (path, text)."""
    named = kind_of_files(files, files.sparkSession)
    doc = F.try_parse_json("text")
    known = named.withColumn("doc", doc)
    by_schema = kind_of_schema(F.try_variant_get("doc", "$.schema", "string"))
    run = F.coalesce(F.try_variant_get("doc", "$.run_id", "string"), "run_id")
    return known.withColumn("kind", F.coalesce(by_schema, "kind")).withColumn("run_id", run)


def problems(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.when(F.col("doc").isNull(), "not JSON").when(F.col("kind").isNull(), "unknown kind").alias("problem")).where("problem is not null")


def index(docs: DataFrame) -> DataFrame:
    """kind, run_id, path: which artifacts are there, a current name before an older one."""
    good = docs.where("doc is not null and kind is not null")
    return good.groupBy("kind", F.when(F.col("kind").isin("run", "score_report"), F.col("run_id")).alias("run_id")).agg(F.min_by("path", F.struct(F.coalesce("rank", F.lit(99)), "path")).alias("path"))


def one(docs: DataFrame, kind: str) -> DataFrame:
    return docs.where(F.col("kind") == kind)


def folded(docs: DataFrame, kind: str) -> DataFrame:
    """A derived kind, taken out of its parent by its dotted path; null if a step is missing."""
    into = {k: p for k, _, _, _, p, _ in KINDS}[kind]
    parent, _, path = into.partition(".")
    return one(docs, parent).select("path", F.try_variant_get("doc", f"$.{path}", "variant").alias("doc"))


def items(rows: DataFrame, path: str, keep: list[str], name: str = "item") -> DataFrame:
    """ordinal and an item a row of the list at ``path`` of doc."""
    listed = F.from_json(F.to_json(F.try_variant_get("doc", path, "variant")), "array<variant>")
    return rows.select(*keep, F.posexplode(listed).alias("ordinal", name))


def text(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def json_text(v: str, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def cases(docs: DataFrame) -> DataFrame:
    c = items(one(docs, "dataset").withColumn("dataset", text("doc", "$.name")), "$.cases", ["dataset"])
    meta = [text("item", f"$.metadata.{k}").alias(k) for k in ("intent", "topic", "scenario", "failure_mode", "variant", "source")]
    return c.select(
        "dataset", text("item", "$.id").alias("case_id"), "ordinal", json_text("item", "$.inputs").alias("inputs"), json_text("item", "$.reference_outputs").alias("reference_outputs"),
        json_text("item", "$.metadata").alias("metadata"), *meta, text("item", "$.review.status").alias("review_status"), text("item", "$.review.note").alias("review_note"),
        text("item", "$.publication.langsmith_example_id").alias("publication_id"), text("item", "$.metadata.user_turns", "array<string>").alias("user_turns"),
    )


def run_order(runs: DataFrame) -> DataFrame:
    """_run, _at, run_ordinal of distinct runs (run_id, timestamp) by time: the window sees two short texts a run, never a document."""
    short = runs.select(F.col("run_id").alias("_run"), F.col("timestamp").alias("_at")).distinct()
    return short.withColumn("run_ordinal", F.dense_rank().over(Window.orderBy("_at", "_run")) - 1)


def runs(docs: DataFrame) -> DataFrame:
    """Case runs with their hashes; run_ordinal follows the time stamps."""
    r = one(docs, "run").select("doc", "run_id", F.col("text").alias("_text"), text("doc", "$.timestamp").alias("timestamp"))
    r = r.join(run_order(r), r["run_id"].eqNullSafe(F.col("_run")) & r["timestamp"].eqNullSafe(F.col("_at"))).drop("_run", "_at")
    # a VARIANT forgets whether a number had a point, but hashes tell 1 and 1.0 apart: calls are taken from the text
    listed = F.from_json(F.to_json(F.try_variant_get("doc", "$.case_runs", "variant")), "array<variant>")
    raw = F.from_json("_text", "struct<case_runs:array<struct<tool_calls:string>>>")["case_runs"]["tool_calls"]
    c = r.select("run_id", "run_ordinal", F.posexplode(F.arrays_zip(listed.alias("item"), raw.alias("raw"))).alias("ordinal", "z")).select("run_id", "run_ordinal", "ordinal", "z.item", "z.raw")
    rows = c.select(
        "run_id", "run_ordinal", text("item", "$.case_id").alias("case_id"), "ordinal", text("item", "$.outputs.response").alias("response"), text("item", "$.error").alias("error"), text("item", "$.error_class").alias("error_class"),
        json_text("item", "$.tool_calls").alias("tool_calls"), "raw", json_text("item", "$.mock_calls").alias("mock_calls"), json_text("item", "$.log").alias("log"),
    )
    made = F.coalesce(F.from_json("raw", "array<struct<name:string,args:string>>"), F.array().cast("array<struct<name:string,args:string>>"))
    pair = lambda x: F.concat(F.lit("["), json_string(x["name"]), F.lit(","), F.coalesce(x["args"], F.lit("{}")), F.lit("]"))
    hashed = rows.withColumn("calls", F.concat(F.lit("["), F.array_join(F.transform(made, pair), ","), F.lit("]"))).drop("raw")
    return hashed.withColumn("trajectory_hash", trajectory_hash("calls", "error")).withColumn("output_hash", output_hash("response", "calls", "error"))


def ledger(case_runs: DataFrame) -> DataFrame:
    entry = "array<struct<tool:string,args:string,layer:string,rule:int,strategy:string,response:string,valid:boolean,repairs:int,fallback:boolean,seconds:double,error:string>>"
    return case_runs.select("run_id", "case_id", F.posexplode(F.from_json("mock_calls", entry)).alias("seq", "e")).select("run_id", "case_id", "seq", "e.*")


#: What is read of a case of a score report.
_MARKS = "struct<case_id:variant,scores:map<string,struct<score:double,comment:string>>,errors:map<string,string>,skipped:map<string,string>>"


def score_rows(reports: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, case_id, metric, outcome, score, comment of score reports (doc, text): each is read once for its scores, errors and skipped metrics, all cases in one pass over its text.

    A VARIANT tells whether the text is JSON, but writing it out again costs many times as
    much as both: only if something in the list is no object are cases taken from it, one by one.
    """
    together = F.from_json("text", f"struct<cases:array<{_MARKS}>>")["cases"]
    read = reports.where("doc is not null").select(*keep, "text", together.alias("_cases"))
    listed = F.to_json(F.try_variant_get(F.try_parse_json("text"), "$.cases", "variant"))
    each = F.transform(F.from_json(listed, "array<variant>"), lambda v: F.from_json(F.to_json(v), _MARKS))
    # outer: else Spark infers a filter from the list's size, for which it works the list out once more
    c = read.select(*keep, F.explode_outer(F.when(F.forall("_cases", lambda c: c.isNotNull()), F.col("_cases")).otherwise(each)).alias("c")).where("c is not null")
    mark = lambda name, outcome, score, comment: F.struct(name.alias("metric"), F.lit(outcome).alias("outcome"), score.alias("score"), comment.alias("comment"))
    scored = F.transform(F.map_entries("c.scores"), lambda m: mark(m["key"], "scored", m["value"]["score"], m["value"]["comment"]))
    unscored = lambda key, outcome: F.transform(F.map_entries(f"c.{key}"), lambda m: mark(m["key"], outcome, F.lit(None).cast("double"), m["value"]))
    # a number has one spelling, as it has where runs are read
    plain = F.when(F.schema_of_variant("c.case_id") == "STRING", text("c.case_id", "$")).otherwise(F.try_variant_get(F.try_parse_json(F.to_json("c.case_id")), "$", "string"))
    marks = F.flatten(F.filter(F.array(scored, unscored("errors", "error"), unscored("skipped", "skipped")), lambda x: x.isNotNull()))
    return c.select(*keep, plain.alias("case_id"), F.explode_outer(marks).alias("m")).where("m is not null").select(*keep, "case_id", "m.*")


def scores(docs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The long score table of all score reports; run_ordinal by ``order`` (run_id, run_ordinal) or by run_id."""
    rep = one(docs, "score_report").select("doc", "text", "run_id")
    if order is None:
        order = rep.select("run_id").distinct().withColumn("run_ordinal", F.dense_rank().over(Window.orderBy("run_id")) - 1)
    return score_rows(rep.join(order, "run_id", "left"), ["run_id", "run_ordinal"])


def simulations(docs: DataFrame) -> DataFrame:
    s = items(one(docs, "simulation"), "$.results", ["path"])
    return s.select("path", "ordinal", text("item", "$.scenario_id").alias("scenario_id"), text("item", "$.stop_reason").alias("stop_reason"), text("item", "$.turns", "int").alias("turns"), text("item", "$.transcript", "array<struct<role:string,content:string>>").alias("transcript"), text("item", "$.violations", "array<string>").alias("violations"))


def stages(docs: DataFrame) -> DataFrame:
    s = one(docs, "pipeline_state").select("path", F.explode(F.from_json(F.to_json(F.try_variant_get("doc", "$.stages", "variant")), "map<string,struct<status:string,attempts:int,seconds:double,error:string,reason:string>>")).alias("stage", "r"))
    return s.select("path", "stage", "r.*")


def mock_rules(docs: DataFrame) -> DataFrame:
    """scope, case_id, tool, rule_idx, match_args, response of datasets and their cases."""
    rule = "map<string,array<struct<matchArgs:variant,response:variant>>>"

    def exploded(rows: DataFrame, source: Column, keep: list[str]) -> DataFrame:
        r = rows.select(*keep, F.explode(F.from_json(source, rule)).alias("tool", "rules")).select(*keep, "tool", F.posexplode("rules").alias("rule_idx", "r"))
        return r.select(*keep, "tool", "rule_idx", F.coalesce(F.to_json("r.matchArgs"), F.lit("{}")).alias("match_args"), F.to_json("r.response").alias("response"))

    d = exploded(one(docs, "dataset"), json_text("doc", "$.mocks.tools"), []).select(F.lit("dataset").alias("scope"), F.lit(None).cast("string").alias("case_id"), "*")
    own = exploded(cases(docs).select("case_id", "metadata"), F.get_json_object("metadata", "$.mocks.tools"), ["case_id"]).select(F.lit("case").alias("scope"), "*")
    return d.unionByName(own)


def upload(docs: DataFrame) -> DataFrame:
    """path, kind, run_id, rank, doc, text of uploaded files (path: the name, text) instead of a folder's."""
    return identified(docs.select("path", "text"))


def log_tail(spark: SparkSession, path: str, lines: int = 40) -> DataFrame:
    """line_no, line: the last lines of a log, in order. Blank lines at its end don't count.

    The file is read from its end, a block at a time, until it has given so many lines.
    """
    register(spark)
    return spark.read.format("tail").option("lines", str(lines)).load(path).select("line_no", "line")


def agent_targets(spark: SparkSession, folder: str) -> DataFrame:
    """path of Python files that define TOOLS and build_agent."""
    src = small_files(spark, folder, "*.py")
    return src.where(F.col("text").rlike(r"(?m)^TOOLS\s*=") & F.col("text").rlike(r"(?m)^def build_agent\(")).select("path")


def skill_files(spark: SparkSession, folder: str) -> DataFrame:
    """name (its folder), path, text of each SKILL.md."""
    src = small_files(spark, folder, "SKILL.md")
    return src.select(F.regexp_extract("path", r"([^/]+)/SKILL\.md$", 1).alias("name"), "path", "text")


def catalog(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Registers a temporary view a silver table of a folder; returns their names."""
    docs = documents(spark, folder)
    case_runs = runs(docs)
    views = {"artifacts": index(docs), "problems": problems(docs), "cases": cases(docs), "case_runs": case_runs, "ledger": ledger(case_runs), "scores": scores(docs), "simulations": simulations(docs), "stages": stages(docs), "mock_rules": mock_rules(docs)}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in views]
