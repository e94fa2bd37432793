"""Views over runs and score reports that keep up with a folder: each new document is read once.

What views need of a document can be added up: sums, counts, smallest and largest scores a
case and metric, the statistics of a run, and what a case did, as sets of hashes. A batch
of new documents leaves these parts in a folder of its own, named after the batch, so a
batch that is tried again replaces what it left. Views merge the parts; ``compact`` merges
them for good.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scores as sc, stability as st
from ..sources import artifacts as art
from ..sources.datasource import DOCUMENT_ROWS, register

CELLS = "case_id string, metric string, total double, n long, low double, high double, bad long"
RUNS = "run_id string, metric string, n long, total double, low double, high double, errors long, skipped long"
DID = "case_id string, trajectories array<string>, outputs array<string>, llm_mock_calls long, runs long"
RAN = "run_id string, batch int"


@dataclass(frozen=True)
class LiveScores:
    """The parts of all reports seen so far, below ``folder`` (a folder that all executors see)."""

    spark: SparkSession
    folder: str

    def _parts(self, name: str, schema: str) -> DataFrame:
        """Nothing was absorbed: no rows."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def _new(self, files: DataFrame, kind: str, batch: int) -> DataFrame:
        """The documents of a kind whose run no earlier batch has added."""
        name, schema = {"run": ("ran", RAN), "score_report": ("runs", RUNS + ", batch int")}[kind]
        docs = files.where(F.col("kind") == kind).select("path", "kind", "run_id", F.lit(0).alias("rank"), F.try_parse_json("text").alias("doc"), "text")
        seen = self._parts(name, schema).where(F.col("batch") < batch).select("run_id").distinct()
        return docs.join(seen, "run_id", "left_anti")

    def absorb(self, files: DataFrame, batch: int) -> None:
        """Adds a batch of files (path, kind, run_id, text). A run that an earlier batch has added is left out.

        The source is read once and each report is parsed once: documents and scores are
        kept while their parts are made.
        """
        at = lambda name: f"{self.folder}/{name}/{batch:08d}"

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").options(**DOCUMENT_ROWS).parquet(at(name))
            return self.spark.read.schema(rows.schema).parquet(at(name))

        files = kept(files.where(F.col("kind").isin("run", "score_report")).select("path", "kind", "run_id", "text"), "_batch")
        scores = kept(art.score_rows(self._new(files, "score_report", batch), ["run_id"]).drop("comment"), "_scores")
        runs = scores.groupBy("run_id", "metric").agg(
            F.count_if(F.col("outcome") == "scored").alias("n"), F.sum("score").alias("total"), F.min("score").alias("low"), F.max("score").alias("high"),
            F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        )
        sc.case_cells(scores, True).write.mode("overwrite").parquet(at("cells"))
        ran = art.runs(self._new(files, "run", batch))
        layers = F.from_json("mock_calls", "array<struct<layer:string>>")["layer"]
        llm = F.coalesce(F.size(F.filter(layers, lambda x: x == "llm")), F.lit(0))
        did = ran.groupBy("case_id").agg(F.collect_set("trajectory_hash").alias("trajectories"), F.collect_set("output_hash").alias("outputs"), F.sum(llm).cast("long").alias("llm_mock_calls"), F.count(F.lit(1)).alias("runs"))
        did.write.mode("overwrite").parquet(at("did"))
        # what was seen is written last: a batch that breaks off before is done again
        ran.select("run_id").distinct().withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(at("ran"))
        runs.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(at("runs"))
        for name in ("_batch", "_scores"):
            done = self.spark._jvm.org.apache.hadoop.fs.Path(at(name))
            done.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(done, True)

    def follow(self, source: str, settle: float = 1.0, **trigger: object) -> StreamingQuery:
        """Absorbs the reports of a folder of artifacts as they come; ``trigger`` as of DataStreamWriter.trigger."""
        register(self.spark)
        files = self.spark.readStream.format("artifacts").option("settleSeconds", str(settle)).load(source)
        writer = files.writeStream.foreachBatch(lambda rows, batch: self.absorb(rows, batch)).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**trigger).start()

    def cells(self) -> DataFrame:
        return sc.merged_cells(self._parts("cells", CELLS))

    def metrics(self, thresholds: dict[str, float] | None = None, default: float = 0.8) -> DataFrame:
        """As scores.metric_rates of all reports."""
        return sc.rates_of_cells(self.cells().where("n > 0 or bad > 0"), thresholds, default)

    def slices(self, cases: DataFrame, slice_min: float = 0.5) -> DataFrame:
        """As scores.slice_rates of all reports; cases: case_id and its tags."""
        return sc.cube_slices(sc.cube_of_cells(self.cells(), cases), slice_min)

    def verdict(self, cases: DataFrame, thresholds: dict[str, float] | None = None, default: float = 0.8, slice_min: float = 0.5, overall_pass: float = 0.8) -> DataFrame:
        """As scores.verdict_of all reports."""
        cube = sc.cube_of_cells(self.cells(), cases)
        return sc.verdict(sc.cube_rates(cube, thresholds, default), sc.weak_slices(sc.cube_slices(cube, slice_min)), slice_min, overall_pass)

    def behaviour(self) -> DataFrame:
        """As stability.behaviour of all runs: the sets of a case's parts are few and small."""
        distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long").alias(c)
        return self._parts("did", DID).groupBy("case_id").agg(distinct("trajectories"), distinct("outputs"), F.sum("llm_mock_calls").alias("llm_mock_calls"), F.sum("runs").alias("runs"))

    def stability(self) -> DataFrame:
        """As stability.summary of all runs."""
        return st.summary(self.behaviour())

    def flips(self, judges: list[str]) -> DataFrame:
        """As stability.score_flips: scores that differ although the agent did the same."""
        steady = self.behaviour().where("trajectories <= 1").select("case_id")
        return self.disagreeing().join(steady, "case_id", "left_semi").withColumn("kind", F.when(F.col("metric").isin(judges), "evaluator").otherwise("output"))

    def run_metrics(self) -> DataFrame:
        """run_id, metric, n, avg, min, max, errors, skipped."""
        runs = self._parts("runs", RUNS)
        return runs.select("run_id", "metric", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avg"), F.col("low").alias("min"), F.col("high").alias("max"), "errors", "skipped")

    def disagreeing(self) -> DataFrame:
        """case_id, metric, lo, hi: scores that differ between runs."""
        return self.cells().where("n > 1 and low <> high").select("case_id", "metric", F.col("low").alias("lo"), F.col("high").alias("hi"))

    def compact(self, into: str) -> LiveScores:
        """The same parts merged into as few rows as they have cases and metrics, in another folder."""
        self.cells().write.parquet(f"{into}/cells/00000000")
        did = self._parts("did", DID)
        merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        did.groupBy("case_id").agg(merged("trajectories"), merged("outputs"), F.sum("llm_mock_calls").alias("llm_mock_calls"), F.sum("runs").alias("runs")).write.parquet(f"{into}/did/00000000")
        for name, schema in (("runs", RUNS + ", batch int"), ("ran", RAN)):
            self._parts(name, schema).write.parquet(f"{into}/{name}/00000000")
        return LiveScores(self.spark, into)
