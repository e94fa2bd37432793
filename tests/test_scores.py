import pytest

from gaugeloom.operators import scores as sc, stability as st

SCORES = "run_ordinal int, case_id string, metric string, outcome string, score double, comment string"

#: Three cases, two runs: one fails contains in the second run, c3 flips under the judge's contract.
ROWS = [
    (0, "c1", "contains", "scored", 1.0, ""), (1, "c1", "contains", "scored", 0.0, "missing"),
    (0, "c2", "contains", "scored", 0.0, "missing"), (1, "c2", "contains", "scored", 0.0, "missing"),
    (0, "c3", "contains", "scored", 1.0, ""), (1, "c3", "contains", "scored", 1.0, ""),
    (0, "c1", "contract", "scored", 1.0, ""), (1, "c1", "contract", "scored", 1.0, ""),
    (0, "c2", "contract", "scored", 1.0, ""), (1, "c2", "contract", "scored", 1.0, ""),
    (0, "c3", "contract", "scored", 0.0, "Test entry"), (1, "c3", "contract", "scored", 1.0, ""),
    (0, "c3", "correctness", "error", None, "no judge"), (0, "c1", "style", "skipped", None, "no reference"),
]
CASES = [("c1", "i.a", "none", "happy"), ("c2", "i.b", "out_of_scope", "adversarial"), ("c3", "i.a", "none", None)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(ROWS, SCORES)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(CASES, "case_id string, intent string, failure_mode string, variant string")


def test_rates_are_means_of_case_means(scores):
    got = {r.metric: r for r in sc.metric_rates(scores).collect()}
    assert round(got["contains"].pass_rate, 4) == 0.5
    assert round(got["contract"].pass_rate, 4) == 0.8333
    assert (got["contains"].n_cases, got["contains"].n_scores) == (3, 6)
    assert got["correctness"].pass_rate is None and got["correctness"].errors == 1 and not got["correctness"].passed
    assert "style" not in got  # only skipped


def test_thresholds_compare_unrounded_rates(scores):
    got = {r.metric: r.passed for r in sc.metric_rates(scores, {"contains": 0.5}, 0.84).collect()}
    assert got["contains"] and not got["contract"]


def test_run_stats(scores):
    got = {(r.run_ordinal, r.metric): r for r in sc.run_stats(scores).collect()}
    assert round(got[0, "contains"].avg, 4) == 0.6667
    assert (got[0, "correctness"].n, got[0, "correctness"].errors, got[0, "correctness"].avg) == (0, 1, None)
    assert got[0, "style"].skipped == 1
    assert [r.metric for r in sc.dead_evaluators(sc.run_stats(scores)).collect()] == ["correctness"]


def test_slices_and_verdict(scores, cases):
    good = scores.where("outcome = 'scored'")
    rates = sc.slice_rates(good, cases)
    weak = sc.weak_slices(rates)
    assert {r.weak for r in weak.collect()} == {"intent=i.b", "failure_mode=out_of_scope", "variant=adversarial"}
    v = sc.verdict(sc.metric_rates(good), weak).first()
    assert v.verdict == "fail" and v.overall_score == 0.6667
    assert v.reasons[0] == "metric contains 0.5 < 0.6"
    assert v.reasons[1:] == ["slice intent=i.b below slice_min 0.5", "slice failure_mode=out_of_scope below slice_min 0.5", "slice variant=adversarial below slice_min 0.5"]


def test_verdict_without_metrics_fails(spark, cases):
    none = spark.createDataFrame([], SCORES)
    v = sc.verdict(sc.metric_rates(none), sc.weak_slices(sc.slice_rates(none, cases))).first()
    assert v.verdict == "fail" and v.overall_score is None and v.reasons == ["no metrics were scored"]


def test_missing_stage_makes_it_incomplete(spark):
    v = spark.createDataFrame([("pass",)], "verdict string")
    stages = spark.createDataFrame([("infer", "ok"), ("score", "failed")], "stage string, status string")
    assert sc.incomplete(v, stages, ["infer", "score"]).first().verdict == "incomplete"
    assert sc.incomplete(v, stages, ["infer"]).first().verdict == "pass"


def test_failing_cases_and_comments(scores):
    got = {r.case_id: r for r in sc.failing_cases(scores).collect()}
    assert got["c2"].metrics == {"contains": 0.0} and got["c2"].comments == {"contains": ["missing", "missing"]}
    assert set(got) == {"c1", "c2", "c3"}
    assert [r.case_id for r in sc.suspect_comments(scores, ["contract"]).collect()] == ["c3"]


def test_matrix_round_trip(scores):
    wide = sc.score_matrix(scores, ["contains", "contract"])
    back = sc.matrix_rows(wide, ["contains", "contract"])
    assert wide.count() == 6 and back.count() == 12


def test_chunks(spark):
    from pyspark.sql import functions as F

    n = [r["count"] for r in sc.contiguous_chunks(spark.range(7), "id", 3).groupBy("chunk").count().orderBy("chunk").collect()]
    assert n == [3, 2, 2]
    assert sc.contiguous_chunks(spark.range(0), "id", 3).agg(F.count("*")).first()[0] == 0


def test_stability(spark, scores):
    runs = spark.createDataFrame([("c1", "t1", "o1", 1), ("c1", "t2", "o2", 0), ("c2", "t1", "o1", 0), ("c2", "t1", "o1", 0), ("c3", "t1", "o1", 0), ("c3", "t1", "o2", 0)], "case_id string, trajectory_hash string, output_hash string, llm_mock_calls int")
    seen = st.behaviour(runs)
    assert [(r.case_id, r.metrics) for r in st.unstable_cases(seen, scores).collect()] == [("c1", ["contains"])]
    assert [(r.case_id, r.metric, r.kind) for r in st.score_flips(seen, scores, ["contract"]).collect()] == [("c3", "contract", "evaluator")]
    s = st.summary(seen).first()
    assert (s.cases, s.unstable, s.text_varies, s.llm_attributed, s.stable_fraction) == (3, 1, 2, 1, 0.6667)


def test_partitions_change_nothing(spark, scores, cases):
    def rows():
        return sorted(map(tuple, sc.slice_rates(scores.repartition(7), cases).collect()), key=str)

    before = rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_slices_just_below_the_limit_are_weak(spark, tmp_path):
    """A rate of 0.49996 is recorded as 0.5, but is below it: the queries judge as their SQL does."""
    import duckdb

    from gaugeloom.plans.queries import QUERIES, SQL

    lines = [(k, 1, k, 1, 1.0, 1.0, d, 0.0, "N", "F", "1995-01-01") for k in (1, 2) for d in (0.049995, 0.049997)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "1-URGENT", "F"), (2, 7, "5-LOW", "O")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("slice_rates_macro", "weak_slices", "overall_verdict"):
        got = QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name


def test_matrix_is_one_aggregation(spark, scores):
    """A pivot aggregates by metric first: as many rows in memory as there are scores."""
    wide = sc.score_matrix(scores, ["contains", "contract"])
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
