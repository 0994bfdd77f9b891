"""P/J/E/O operators and S1–S10 on the reference's relational scenarios (FIXTURES.md §8)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from codescope.operators import relational as R
from codescope.sources import store as S

MODELS = "id string, name string, provider string, version string, context_window int, is_active boolean"
EXPS = ("id string, owner_id string, name string, description string, status string, "
        "selected_models array<string>, created_at timestamp_ntz, completed_at timestamp_ntz")


def _models(spark, rows):
    return spark.createDataFrame(rows, MODELS)


def _exp(spark, rows):
    return spark.createDataFrame(rows, EXPS)


def test_registry_upsert_is_idempotent(spark):
    reg = _models(spark, [("1", "gpt-4", "openai", None, None, True)])
    inc = _models(spark, [("2", "gpt-4", "other", None, None, True), ("3", "gemma-7b", "hf", None, None, True),
                          ("4", "gemma-7b", "hf2", None, None, True)])
    out = S.upsert_registry(reg, inc)
    names = sorted(r["name"] for r in out.collect())
    assert names == ["gemma-7b", "gpt-4"]
    assert out.where("name = 'gpt-4'").first()["provider"] == "openai"   # first registration wins
    assert S.upsert_registry(out, inc).count() == 2


def test_selection_violations_and_plan(spark):
    t = dt.datetime(2024, 1, 1)
    models = _models(spark, [("a", "m-a", "p", None, None, True), ("b", "m-b", "p", None, None, True),
                             ("c", "m-c", "p", None, None, False), ("d", "m-d", "p", None, None, True)])
    exps = _exp(spark, [("e1", "u", "x", None, "pending", ["m-a", "m-b"], t, None),
                        ("e2", "u", "y", None, "pending", ["m-c", "ghost"], t, None),
                        ("e3", "u", "z", None, "pending", [], t, None)])
    v = {(r["experiment_id"], r["model_name"], r["reason"]) for r in R.selection_violations(exps, models).collect()}
    assert v == {("e2", "m-c", "inactive"), ("e2", "ghost", "unregistered"), ("e3", None, "no_models")}
    prompts = spark.createDataFrame([("p1", "e1", "stmt")], "id string, experiment_id string, problem_statement string")
    plan = R.generation_plan(exps, prompts, models)
    assert sorted(r["model_name"] for r in plan.collect()) == ["m-a", "m-b"]   # 4 registered, 2 selected


def test_outcome_split_keeps_survivors(spark):
    plan = spark.createDataFrame([("p1", "good"), ("p1", "bad")], "prompt_id string, model_name string")
    res = spark.createDataFrame([("p1", "good", "code", None), ("p1", "bad", None, "boom")],
                                "prompt_id string, model_name string, code string, error string")
    ok, bad, gaps = R.outcome_split(plan, res)
    assert [r["model_name"] for r in ok.collect()] == ["good"]
    assert [r["error"] for r in bad.collect()] == ["boom"]
    assert [r["model_name"] for r in gaps.collect()] == ["bad"]
    both = R.all_outcomes(ok.drop("error"), bad.select("prompt_id", "model_name", "error"))
    assert both.count() == 2 and set(both.columns) == {"prompt_id", "model_name", "code", "error"}


def test_paging(spark):
    base = dt.datetime(2024, 1, 1)
    exps = _exp(spark, [(f"e{i}", "u1", ["First", "Second", "c", "d", "e"][i], None, "pending", [],
                         base + dt.timedelta(days=[0, 1, -1, -2, -3][i]), None) for i in range(5)]
                + [("x", "u2", "Other", None, "pending", [], base + dt.timedelta(days=9), None)])
    top2 = [r["name"] for r in R.list_experiments(exps, "u1", limit=2).collect()]
    assert top2 == ["Second", "First"]
    assert R.list_experiments(exps, "u1", limit=999999).count() == 5
    assert R.list_experiments(exps, "u1", skip=4, limit=10).count() == 1
    reg = _models(spark, [(str(i), f"m{i:03d}", "p", None, None, True) for i in range(150)])
    assert R.list_models(reg, limit=999).count() == 100          # ceiling
    assert R.list_models(reg).count() == 50                       # default


def test_point_lookup_and_active_filter(spark):
    reg = _models(spark, [("1", "a", "p", None, None, True), ("2", "b", "p", None, None, None),
                          ("3", "c", "p", None, None, False)])
    assert [r["name"] for r in R.active_only(reg).collect()] == ["a"]
    assert R.point_lookup(reg, "name", "zzz").count() == 0
    assert R.point_lookup(reg, "name", "b").first()["id"] == "2"


def test_with_rate_default(spark):
    df = spark.createDataFrame([("gpt-4", 1000), ("other", 2000)], "model_name string, tokens int")
    rates = spark.createDataFrame([("gpt-4", 0.03)], "model_name string, rate_per_1k double")
    got = {r["model_name"]: r["rate_per_1k"] for r in R.with_rate(df, rates).collect()}
    assert got == {"gpt-4": 0.03, "other": 0.03}


def test_unique_modes(spark):
    inc = spark.createDataFrame([("s1", 0.5, 1), ("s1", 1.0, 2), ("s2", 0.0, 1)], "solution_id string, pass_rate double, t int")
    with pytest.raises(S.DuplicateKeyError):
        S.enforce_unique(inc, None, "solution_id")
    latest = {r["solution_id"]: r["pass_rate"] for r in S.enforce_unique(inc, None, "solution_id", "replace", "t").collect()}
    assert latest == {"s1": 1.0, "s2": 0.0}
    target = spark.createDataFrame([("s2", 0.9, 0)], "solution_id string, pass_rate double, t int")
    skip = S.enforce_unique(inc, target, "solution_id", "skip", "t").collect()
    assert [(r["solution_id"], r["pass_rate"]) for r in skip] == [("s1", 0.5)]


def test_create_experiment_status_and_cascade(spark):
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame(
        [("e1", "u", "n", None, ["m"], t, [("Write f", None, "easy", "custom"), ("  ", "py", None, None)])],
        "id string, owner_id string, name string, description string, selected_models array<string>, "
        "created_at timestamp_ntz, prompts array<struct<problem_statement:string, language:string, "
        "difficulty:string, source_dataset:string>>")
    exps, prompts = S.create_experiments(req)
    assert exps.first()["status"] == "pending"
    p = prompts.collect()
    assert len(p) == 1 and p[0]["language"] == "python"
    done = S.update_status(exps, spark.createDataFrame([("e1", "completed"), ("zz", "failed")], "id string, status string"),
                           now=F.lit(t).cast("timestamp_ntz")).collect()
    assert (done[0]["status"], done[0]["completed_at"]) == ("completed", t)
    running = S.update_status(exps, spark.createDataFrame([("e1", "running")], "id string, status string")).first()
    assert running["completed_at"] is None
    sols = spark.createDataFrame([("s1", prompts.first()["id"]), ("s9", "other")], "id string, prompt_id string")
    ex = spark.createDataFrame([("s1",), ("s9",)], "solution_id string")
    sim = spark.createDataFrame([("s1", "s9"), ("s9", "s9")], "solution_a_id string, solution_b_id string")
    left = S.cascade_delete(exps, {"experiments": exps, "prompts": prompts, "generated_solutions": sols,
                                   "execution_results": ex, "similarity_scores": sim})
    assert left["experiments"].count() == 0 and left["prompts"].count() == 0
    assert [r["id"] for r in left["generated_solutions"].collect()] == ["s9"]
    assert [r["solution_id"] for r in left["execution_results"].collect()] == ["s9"]
    assert left["similarity_scores"].count() == 1


def test_load_problems(spark, tmp_path):
    data = [{"problem_statement": "Write f", "language": "python", "difficulty": "easy", "source_dataset": "custom",
             "reference_tests": [{"call": "f(1)", "expected_output": 2}]}]
    (tmp_path / "custom_problems.json").write_text(json.dumps(data, indent=2))
    df = S.load_problems(spark, str(tmp_path))
    r = df.first()
    assert r["problem_statement"] == "Write f" and r["reference_tests"][0]["call"] == "f(1)"
    with pytest.raises(ValueError):
        S.load_problems(spark, str(tmp_path), source="humaneval")


def test_append_rows(spark, tmp_path):
    df = spark.createDataFrame([("s1", None)], "solution_id string, pass_rate double")
    S.append_rows(df, str(tmp_path / "t"), defaults={"pass_rate": 0.0, "total_tests": 0}, key_cols=["solution_id"])
    S.append_rows(df, str(tmp_path / "t"), defaults={"pass_rate": 0.0, "total_tests": 0}, key_cols=["solution_id"])
    back = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(back) == 2 and back[0]["pass_rate"] == 0.0 and back[0]["id"] == back[1]["id"]


def test_results_document(spark):
    lb = spark.createDataFrame([(1, "b", 0.5, 2), (1, "a", 0.9, 1)], "experiment_id int, model string, correctness double, position int")
    doc = json.loads(S.results_document(lb).first()["document"])
    assert [m["model"] for m in doc["models"]] == ["a", "b"]


def test_unique_keeps_rows_without_order_value(spark):
    from codescope.sources.store import enforce_unique, upsert_registry
    rows = [(1, 1.0, None), (2, 0.25, None), (2, 0.5, 3), (3, 0.1, 1), (3, 0.2, 1)]
    df = spark.createDataFrame(rows, "solution_id long, pass_rate double, t int")
    latest = {r["solution_id"]: r["pass_rate"] for r in enforce_unique(df, None, "solution_id", "replace", "t").collect()}
    first = {r["solution_id"]: r["pass_rate"] for r in enforce_unique(df, None, "solution_id", "skip", "t").collect()}
    assert latest == {1: 1.0, 2: 0.5, 3: 0.2} and first == {1: 1.0, 2: 0.25, 3: 0.1}
    reg = spark.createDataFrame([("a", "x", 0)], "name string, provider string, at int")
    inc = spark.createDataFrame([("b", "late", 9), ("b", "early", 2), ("a", "z", 1)], "name string, provider string, at int")
    assert {r["name"]: r["provider"] for r in upsert_registry(reg, inc, "at").collect()} == {"a": "x", "b": "early"}
