"""Queries over folders that grow: artifacts written and read by the data source, publishing, and streams that go on from where they were."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import custom
from ..sources import artifacts as art, datasource as ds, publication as pub
from ..sources.folders import shared_folder
from ..streaming import progress as pg
from ..streaming.incremental import LiveScores
from . import adapters as ad
from .adapters import LINES_SQL, TALKS_SQL, table
from .registry import query, r6

_written: dict[tuple[str, str], str] = {}


def _customer_runs(spark: SparkSession, d: str) -> str:
    """A folder with a run document a customer, a score report for every third, and a dataset; a thousand customers share a project."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        root = shared_folder(spark, "customer-runs").removeprefix("file://")
        c = table(spark, d, "customer")
        name = lambda kind: F.concat(F.lit("p"), F.floor(F.col("c_custkey") / 1000).cast("string"), F.lit(f"/results/{kind}-c"), F.col("c_custkey").cast("string"), F.lit(".json"))
        runs = c.select(name("run").alias("path"), F.to_json(F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("run_id"), F.array(F.struct(F.col("c_mktsegment").alias("case_id"), F.col("c_acctbal").cast("double").alias("cost"))).alias("case_runs"))).alias("text"))
        reports = c.where("c_custkey % 3 = 0").select(name("score-report").alias("path"), F.lit("{").alias("text"))
        one = c.limit(1).select(F.lit("dataset.json").alias("path"), F.lit('{"cases": []}').alias("text"))
        ds.save(runs.unionByName(reports).unionByName(one), root, c.count() * 4 // 3 + 1)
        _written[key] = root
    return _written[key]


@query("SELECT 'c' || c_custkey AS run_id, c_mktsegment AS case_id, round(c_acctbal, 4) AS cost FROM customer WHERE c_custkey::VARCHAR LIKE '1%'")
def source_runs(spark, d):
    """Run documents by the data source: other kinds and runs are dropped from the listing, unopened."""
    own = ds.artifacts(spark, _customer_runs(spark, d)).where(F.col("kind") == "run").where(F.col("run_id").startswith("c1"))
    case = F.get(F.from_json("text", "struct<case_runs:array<struct<case_id:string,cost:double>>>")["case_runs"], F.lit(0))
    return own.select("run_id", case["case_id"].alias("case_id"), F.round(case["cost"], 4).alias("cost"))


@query("SELECT kind, problem, n FROM (SELECT 'run' AS kind, NULL AS problem, count(*) AS n FROM customer UNION ALL SELECT 'score_report', 'not JSON', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'dataset', NULL, 1) WHERE n > 0")
def source_index(spark, d):
    return ds.artifacts(spark, _customer_runs(spark, d)).groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey::VARCHAR AS case_id, 1::BIGINT AS times, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS batch, c_mktsegment AS topic FROM customer WHERE c_acctbal > 0")
def published_cases(spark, d):
    """Approved customers published in two batches, the second handed over twice and with those of the first: each is there once."""
    c = table(spark, d, "customer")
    cases = c.select(F.col("c_custkey").cast("string").alias("case_id"), F.when(F.col("c_acctbal") > 0, "approved").otherwise("pending").alias("review_status"), F.lit(None).cast("string").alias("publication_id"), F.col("c_mktsegment").alias("topic"))
    root = shared_folder(spark, "published").removeprefix("file://")
    left = pub.publish_batch(cases.where("cast(case_id as long) % 2 = 0"), root).count()
    shown = lambda: spark.read.format("publication").load(root)
    first = [r[0] for r in shown().select("batch").distinct().collect()]  # one batch
    left += pub.publish_batch(cases, root).count() + pub.publish_batch(cases, root).count()
    rows = shown().groupBy(F.col("local_case_id").alias("case_id")).agg(F.count(F.lit(1)).alias("times"), F.first("batch").alias("b"), F.first(F.get_json_object("document", "$.topic")).alias("topic"))
    return rows.select("case_id", (F.col("times") + left).alias("times"), F.when(F.col("b").isin(first), 1).otherwise(2).alias("batch"), "topic")


def _kept_up(stream: DataFrame, mode: str, root: str, name: str) -> DataFrame:
    """All that a stream gives out when it has read everything there is; its table lies in the shared folder."""
    rows = f"{root}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{0 if mode == 'complete' else number:08d}")

    done = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(rows)


@query("SELECT event_type AS \"group\", count(*) AS done, count(*) FILTER (value > 200) AS errors FROM events GROUP BY 1")
def live_progress(spark, d):
    """Finished events counted as a stream of four files, a file a batch."""
    root = shared_folder(spark, "progress")
    e = table(spark, d, "events").select(F.col("event_type").alias("group"), (F.col("value") > 200).alias("error"))
    e.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return _kept_up(pg.progress(stream), "complete", root, "counts")


@query(f"WITH {TALKS_SQL} SELECT conv_id, turns, stop_reason FROM stops")
def live_talks(spark, d):
    """Conversations followed as a stream: those that end, and, by timers, those that fall silent."""
    root = shared_folder(spark, "talks")
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.col("turn")).alias("ts"))
    m.coalesce(1).write.mode("append").parquet(f"{root}/in")
    # a message of no conversation, much later: time goes on although nobody speaks
    later = m.limit(1).select(F.lit(None).cast("long").alias("conv_id"), "turn", F.lit("clock").alias("role"), "text", F.timestamp_seconds(F.lit(10**9)).alias("ts"))
    later.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return _kept_up(pg.follow(stream, "tion", 2), "append", root, "ended")


def _report_files(lines: DataFrame) -> DataFrame:
    """A score report a run and some thousand orders, of lines as repeats of their order: a line is a case of its report."""
    marks = F.map_from_entries(F.transform(ad.line_marks(), lambda m: F.struct(m["metric"].alias("key"), F.struct(m["score"].alias("score"), F.lit("").alias("comment")).alias("value"))))
    part = F.floor(F.col("l_orderkey") / 4000).cast("string")
    cases = lines.select("run_ordinal", part.alias("part"), F.struct(F.col("l_orderkey").cast("string").alias("case_id"), marks.alias("scores")).alias("case"))
    run = F.concat(F.lit("r"), F.col("run_ordinal").cast("string"), F.lit("p"), F.col("part"))
    files = cases.groupBy("run_ordinal", run.alias("run_id")).agg(F.collect_list("case").alias("cases"))
    return files.select("run_ordinal", F.concat(F.lit("results/score-report-"), "run_id", F.lit(".json")).alias("path"), F.to_json(F.struct(F.lit("demo/score-report/v1").alias("schema"), "run_id", "cases")).alias("text"))


@query(f"""WITH {LINES_SQL}, per AS (SELECT metric, case_id, avg(score) AS a, min(score) AS lo, max(score) AS hi, count(*) AS n FROM scores GROUP BY ALL)
SELECT metric, round(avg(a), 6) AS pass_rate, round(avg(lo), 6) AS min_over_repeats, count(*) AS n_cases, sum(n)::BIGINT AS n_scores, avg(a) >= 0.6 AS passed, count(*) FILTER (n > 1 AND lo <> hi) AS disagreeing FROM per GROUP BY metric""")
def live_metric_rates(spark, d):
    """Orders' scores as reports that arrive in three batches, the second with the first's files again: rates are kept up by adding parts."""
    root = shared_folder(spark, "reports")
    inbox = f"{root}/in".removeprefix("file://")
    files = _report_files(ad.lines(spark, d))
    saved = f"{root}/files"
    files.write.options(**ds.DOCUMENT_ROWS).parquet(saved)
    files = spark.read.schema(files.schema).parquet(saved)
    live = LiveScores(spark, f"{root}/live")
    for batch in ("run_ordinal = 0", "run_ordinal <= 1", "run_ordinal > 1"):
        ds.save(files.where(batch), inbox)
        live.follow(inbox, settle=0.0, availableNow=True).awaitTermination()
    apart = live.disagreeing().groupBy("metric").agg(F.count(F.lit(1)).alias("disagreeing"))
    m = live.metrics(default=0.6).join(apart, "metric", "left")
    return m.select("metric", r6(F.col("pass_rate")).alias("pass_rate"), r6(F.col("min_over_repeats")).alias("min_over_repeats"), "n_cases", "n_scores", "passed", F.coalesce("disagreeing", F.lit(0)).alias("disagreeing"))


@query("""SELECT source AS case_id, doc_id::INT AS run_ordinal, 'longer' AS metric, 'scored' AS outcome, (n_chars > coalesce(max(n_chars) OVER w, -1))::INT::DOUBLE AS score, coalesce(n_chars || ' after ' || max(n_chars) OVER w, 'first') AS comment
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def custom_evaluator(spark, d):
    """Documents scored in SQL by an evaluator named module:function, a source a case, with what it remembers of the case."""
    custom.register(spark, "score_longer", "gaugeloom.operators.custom:longer_than_before", "longer")
    runs = table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("int").alias("run_ordinal"), "n_chars")
    return spark.sql("SELECT * FROM score_longer(TABLE({runs}))", runs=runs)


@query("WITH t AS (SELECT event_id, ts, event_type, row_number() OVER (ORDER BY event_id DESC) AS n FROM events) SELECT (least(40, (SELECT count(*) FROM t)) - n)::INT AS line_no, event_id || ' ' || event_type AS line FROM t WHERE n <= 40")
def log_end(spark, d):
    """The last lines of a log of all events, read from the file's end."""
    root = shared_folder(spark, "log")
    lines = table(spark, d, "events").orderBy("event_id").select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"))
    lines.coalesce(1).write.text(f"{root}/log")
    name = [f.path for f in ds.opened(f"{root}/log".removeprefix("file://"))[0].get_file_info(fs.FileSelector(f"{root}/log".removeprefix("file://"))) if f.path.endswith(".txt")]
    return art.log_tail(spark, name[0])
